import os
import re
import sys
import time
import tracemalloc

import numpy as np
import pyarrow as pa

from ordertide.llm import ngram_join, store


def own_mb(pid):
    """MB that a process holds besides mapped files."""
    with open(f"/proc/{pid}/status") as f:
        return int(re.search(r"RssAnon:\s+(\d+)", f.read())[1]) / 1024


def test_workers_give_memory_back_after_a_task(spark):
    def work(batches):
        for batch in batches:
            before = own_mb(os.getpid())
            held = [np.ones(8000) for _ in range(4000)]  # 250 MB in pieces
            sys.kept = np.ones(8000)  # what stays lies behind them
            yield pa.RecordBatch.from_pydict({"pid": [os.getpid()] * batch.num_rows, "before": [before] * batch.num_rows, "most": [own_mb(os.getpid())] * batch.num_rows})
            del held

    r = store.map_arrow(spark.range(0, 1, 1, 1), work, "pid long, before double, most double").collect()[0]
    assert r.most - r.before > 200
    for _ in range(50):
        if (now := own_mb(r.pid)) < r.before + 50:
            break
        time.sleep(0.1)
    assert now < r.before + 50, (r, now)


def test_memory_for_texts_is_bounded():
    """What a task takes beside a batch of 4 MB of short texts: 38 MB, when it worked on the batch as a whole."""
    rng = np.random.default_rng(0)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**5, 300)) for _ in range(2300)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    assert 3 << 20 < batch.nbytes < 6 << 20
    known = type("Known", (), {"value": (np.zeros(0, np.uint64), np.zeros(0, np.int64))})
    tracemalloc.start()
    rows = sum(b.num_rows for b in ngram_join._prefixes(5, 8, 10, known, ngram_join.Numbers())(iter([batch])))
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert rows > 100_000 and most < 30, most
