import json
import os

from ordertide.operators import book, quality
from ordertide.sources import feed
from ordertide.sources.tables import mbo
from ordertide.streaming import feed as stream


def test_streams_give_the_batch_results(spark, tmp_path):
    events = mbo(spark, "/root/testdata/sf0.001").orderBy("key_ts_ns")
    rows = [r.value for r in feed.to_wire(events).collect()]
    src = tmp_path / "in"
    src.mkdir()
    for k in range(3):
        (src / f"{k}.mbo.json").write_text("\n".join(rows[k * len(rows) // 3 : (k + 1) * len(rows) // 3]) + "\n")
    (src / "other.json").write_text(json.dumps({"x": 1}) + "\n")
    batch = feed.parse(feed.read_folder(spark, str(src)))
    seen = {}

    def last(name):
        def each(df, _):
            for r in df.collect():
                seen.setdefault(name, {})[r[0]] = tuple(r)
        return each

    live = stream.stream_events(spark, str(src), files_per_trigger=1)
    for name, df, mode in (("book", stream.book_updates(live), "update"), ("best", stream.best_quotes(quality.kept(live)), "complete")):
        q = stream.run(df, f"{tmp_path}/{name}", last(name), mode)
        assert q.awaitTermination(120)
    source = batch.withColumnRenamed("source_idx", "source_id")
    assert seen["book"] == {r[0]: tuple(r) for r in book.updates(source).collect()}
    assert seen["best"] == {r[0]: tuple(r) for r in book.best(batch).collect()}

    totals = []
    q = stream.run(stream.summaries(live), f"{tmp_path}/sum", lambda df, _: totals.append(df.first()), "complete")
    assert q.awaitTermination(120)
    assert totals[-1] == quality.summary(batch).first()


def test_ties_take_the_later_source_first(spark, tmp_path):
    """Both files' quotes tie: the later file's bid comes first, so the earlier one's higher bid improves it."""
    src = tmp_path / "in"
    src.mkdir()
    for name, price in (("a", "2.0"), ("b", "1.0")):
        event = {"ts_recv": "2026-04-01T07:00:00Z", "hd": {"instrument_id": 7}, "action": "A", "side": "B", "price": price, "size": 1, "order_id": "1", "flags": 0, "sequence": 5}
        (src / f"{name}.mbo.json").write_text(json.dumps(event) + "\n")
    seen = []
    q = stream.run(stream.book_updates(stream.stream_events(spark, str(src))), f"{tmp_path}/c", lambda df, _: seen.extend(df.collect()))
    assert q.awaitTermination(120)
    assert [tuple(r) for r in seen] == [(7, 2.0, 0.0, 2)]


def test_an_empty_side_stays_so_between_batches(spark, tmp_path):
    """The state tells a best price of 0 from an empty side, from one file to the next."""
    src = tmp_path / "in"
    src.mkdir()
    for k, quoted in enumerate(([("B", "0.0")], [("B", "-1.0"), ("A", "0.0")], [("A", "3.0"), ("B", "-2.0")])):
        lines = [{"ts_recv": f"2026-04-01T07:00:0{k}Z", "hd": {"instrument_id": 7}, "action": "A", "side": s, "price": p, "size": 1, "order_id": "1", "flags": 0, "sequence": i} for i, (s, p) in enumerate(quoted)]
        (src / f"{k}.mbo.json").write_text("".join(json.dumps(e) + "\n" for e in lines))
        os.utime(src / f"{k}.mbo.json", (1e9 + k, 1e9 + k))
    for zero_is_empty, last in ((False, (7, 0.0, 0.0, 2)), (True, (7, -1.0, 3.0, 4))):
        seen = []
        books = stream.book_updates(stream.stream_events(spark, str(src), files_per_trigger=1), zero_is_empty)
        q = stream.run(books, f"{tmp_path}/{zero_is_empty}", lambda df, _: seen.extend(df.collect()))
        assert q.awaitTermination(120)
        assert tuple(seen[-1]) == last
