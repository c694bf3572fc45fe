import json
import re

import pytest
from pyspark.sql import functions as F

from ordertide import cli
from ordertide.operators import digest, order, quality
from ordertide.sources import feed

GOOD = {"ts_recv": "2026-04-01T07:00:00.123456789Z", "hd": {"ts_event": "2026-04-01T07:00:00.100000000Z", "rtype": 160, "publisher_id": 101, "instrument_id": 12345}, "action": "A", "side": "B", "price": "0.001234567", "size": 100, "channel_id": 79, "order_id": "9876543210", "flags": 0, "ts_in_delta": -1000, "sequence": 555, "symbol": "X"}


def event(**changes):
    e = json.loads(json.dumps(GOOD)) | changes
    return json.dumps({k: v for k, v in e.items() if v != "absent"})


def parsed(spark, *lines, **options):
    return feed.parse(spark.createDataFrame([(x, i) for i, x in enumerate(lines)], "value string, i int"), **options).orderBy("i").collect()


def test_golden_line(spark):
    r = parsed(spark, event())[0]
    assert (r.key_ts_ns, r.ts_recv_ns) == (1775026800123456789,) * 2
    assert abs(r.price - 0.001234567) < 1e-12 and r.has_price and str(r.price_dec) == "0.001234567"
    assert (r.size, int(r.order_id), r.instrument_id, r.flags, r.sequence, r.action, r.side, r.parse_status) == (100, 9876543210, 12345, 0, 555, "A", "B", "ok")


def test_prices_and_keys(spark):
    rows = parsed(spark, event(price="9223372036854775807", action="R", side="N"), event(price=None), event(price=12.5), event(price="absent"))
    assert [r.has_price for r in rows] == [False, False, True, False] and rows[2].price == 12.5
    moved = json.dumps(dict(sorted(GOOD.items(), reverse=True)))
    assert parsed(spark, moved)[0][1:] == parsed(spark, event())[0][1:]


def test_times(spark):
    rows = parsed(spark, event(ts_recv="absent"), event(ts_recv=None), event(ts_recv="absent", hd={"instrument_id": 1}), event(ts_recv="2026-04-01T07:00:00+02:00", hd={}), event(hd=None))
    assert [r.key_ts_ns for r in rows] == [1775026800100000000, 1775026800100000000, 0, 0, 1775026800123456789]
    assert [r.parse_status for r in rows] == ["ok", "ok", "drop", "drop", "ok"] and rows[0].ts_recv_ns == 0 and rows[4].instrument_id == 0


def test_dirty_lines(spark):
    lines = ["", "   ", "not json at all", "{bad", "{}", event() + "\r", event(action="AB", side="Q"), event(unknown=5, sequence=-4), event()[:40]]
    rows = parsed(spark, *lines)
    assert [(r.i, r.parse_status) for r in rows] == [(2, "error"), (3, "error"), (4, "drop"), (5, "ok"), (6, "ok"), (7, "ok"), (8, "error")]
    assert (rows[4].action, rows[4].side, rows[5].sequence) == ("?", "Q", 0)
    assert parsed(spark, event(action="N"), normalise=True)[0].action == "?" and parsed(spark, event(action="N"))[0].action == "N"


@pytest.fixture
def folder(tmp_path):
    base = 1775026800
    for name, times in (("b.mbo.json", (10, 40, 70)), ("a.mbo.json", (20, 30, 80)), ("c d.mbo.json", (50, 60, 90))):
        (tmp_path / name).write_text("".join(event(ts_recv=f"2026-04-01T07:00:{t // 10:02d}.{t % 10}00000000Z", sequence=t, price=f"{t}.0") + "\n" for t in times))
    for other in ("manifest.json", "symbology.json", ".mbo.json", "x.mbo.json.txt"):
        (tmp_path / other).write_text("{}\n")
    (tmp_path / "_hidden.mbo.json").write_text(event() + "\n")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "z.mbo.json").write_text(event() + "\n")
    assert base
    return tmp_path


def test_folder(spark, folder):
    events = feed.read_events(spark, str(folder), folder=True).withColumnRenamed("source_idx", "source_id")
    assert [r[0] for r in events.groupBy("source_id").count().orderBy("source_id").collect()] == [0, 1, 2]
    merged = order.with_position(events, order.merge_keys(within=("block", "row"))).orderBy("pos").collect()
    assert [r.sequence for r in merged] == list(range(10, 100, 10)) and [r.pos for r in merged] == list(range(1, 10))
    assert [r.source_id for r in merged][:2] == [1, 0]


def test_split_files_keep_their_order(spark, tmp_path):
    n = 3000
    (tmp_path / "a.mbo.json").write_text("".join(event(sequence=i) + "\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")
    try:
        rows = feed.read_events(spark, f"{tmp_path}/a.mbo.json", folder=False)
        assert rows.rdd.getNumPartitions() > 3
        assert [r.sequence for r in rows.orderBy("block", "row").select("sequence").collect()] == list(range(n))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_command_line(spark, folder, tmp_path, capsys, monkeypatch):
    assert cli.main(["hard", str(folder)], spark) == 0
    said = capsys.readouterr().out
    assert "Cross-check: OK" in said and "Total messages: 9" in said
    assert cli.main(["hard", str(folder), "flat", "--hash"], spark) == 0
    said = capsys.readouterr().out
    assert "Cross-check" not in said and "Hash: 0x" in said
    monkeypatch.setenv("PRINT_EVERY", "2")
    assert cli.main(["hard", str(folder), "flat"], spark) == 0
    assert capsys.readouterr().out.count("timestamp=2026") == 4
    monkeypatch.delenv("PRINT_EVERY")
    assert cli.main(["standard", f"{folder}/a.mbo.json"], spark) == 0
    said = capsys.readouterr().out
    assert "Total messages: 3" in said and said.count("timestamp=2026") == 6
    assert cli.main(["hard", str(folder), "sideways"], spark) == 1
    assert cli.main([], spark) == 1
    assert cli.main(["standard", f"{folder}/none.json"], spark) == 1
    (tmp_path / "void").mkdir()
    assert cli.main(["hard", f"{tmp_path}/void"], spark) == 1
    (tmp_path / "void" / "e.mbo.json").write_text("")
    assert cli.main(["hard", f"{tmp_path}/void"], spark) == 0
    capsys.readouterr()
    assert cli.main(["standard", f"{tmp_path}/void/e.mbo.json"], spark) == 0
    assert capsys.readouterr().out.splitlines()[:2] == ["Total messages: 0", "Parse errors: 0"]


def test_command_line_with_an_unsorted_file(spark, tmp_path, capsys, monkeypatch):
    at = lambda s, q: event(sequence=q, order_id=str(q), ts_recv=f"2026-03-09T07:52:{s:02}.000000000Z")
    (tmp_path / "a.mbo.json").write_text("\n".join([at(5, 1), at(2, 2), at(9, 3)]) + "\n")
    (tmp_path / "b.mbo.json").write_text("\n".join([at(3, 4), at(6, 5)]) + "\n")
    monkeypatch.setenv("PRINT_EVERY", "1")
    seen = {}
    for mode in ("flat", "hierarchy"):
        assert cli.main(["hard", str(tmp_path), mode, "--hash"], spark) == 0
        said = capsys.readouterr().out.splitlines()
        assert [int(re.search(r"order_id=(\d+)", x)[1]) for x in said if x.startswith("timestamp=")] == [4, 1, 2, 5, 3]
        seen[mode] = [x for x in said if x.startswith(("Total:", "Hash:"))]
    assert seen["flat"] == seen["hierarchy"]
    events = feed.read_events(spark, str(tmp_path), folder=True).withColumnRenamed("source_idx", "source_id")
    place = F.array_position(F.array(*map(F.lit, [4, 1, 2, 5, 3])), F.col("sequence").cast("int"))
    want = digest.stream_digest(events.withColumn("pos", place)).first().digest
    assert f"digest: {want & digest.MASK:#018x}" in seen["flat"][0]


def test_every_sampled_event_is_printed(spark, tmp_path, capsys, monkeypatch):
    n = 2500
    (tmp_path / "a.mbo.json").write_text("".join(event(sequence=i, order_id=str(i)) + "\n" for i in range(n)))
    monkeypatch.setenv("PRINT_EVERY", "1")
    for args, more in ((["standard", f"{tmp_path}/a.mbo.json"], 20), (["hard", str(tmp_path), "flat"], 0)):
        assert cli.main(args, spark) == 0
        said = [int(x) for x in re.findall(r"order_id=(\d+)", capsys.readouterr().out)]
        assert said[:n] == list(range(n)) and len(said) == n + more


def test_settings(monkeypatch):
    for said, mb in (("", 192), ("1", 16), ("9999", 4096), ("64", 64), ("x", 192)):
        monkeypatch.setenv("CHUNK_MB", said)
        assert cli.chunk_bytes() == mb << 20
    for said, n in (("", 7), ("0", 1), ("-5", 1), ("12", 12), ("x", 7)):
        monkeypatch.setenv("PRINT_EVERY", said)
        assert cli.sample_step(7) == n


def test_summary_counts_errors_and_drops(spark):
    lines = [event(), event(flags=12), event(ts_recv="absent"), event(ts_recv="absent", hd={}), "{bad", ""]
    r = quality.summary(feed.parse(spark.createDataFrame([(x,) for x in lines], "value string"))).first()
    assert (r.total, r.errors, r.dropped, r.fallback, r.bad_ts_recv, r.maybe_bad_book) == (3, 1, 1, 1, 1, 1)
