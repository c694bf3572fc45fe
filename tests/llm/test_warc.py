import base64
import hashlib

import pytest

from ordertide.llm import op3, warc

ROWS = [(1, "http://a/", "same"), (2, "http://b/", "same"), (9, None, None), (4, "u\r\nWARC-Type: x", ""), (5, "h", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (6, "é", "ü漢" * 20_000), (7, "x", "\r\n\r\n"), (2, "http://b/", "same"), (3, "z", "same\n"), (None, "n", "same"), (8, "k", " ")]


def expected(rows, least=0):
    firsts = {}
    for i, _, html in rows:
        if i is not None:
            firsts[html or ""] = min(i, firsts.get(html or "", i))
    out = []
    for i, _, html in rows:
        b, first = (html or "").encode(), firsts.get(html or "")
        revisit = len(b) >= least and first is not None and i != first
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_archive(spark, least):
    pages = spark.createDataFrame([(*r, "extra") for r in ROWS], "page_id long, url string, html string, header string")
    archive = warc.write_archive(pages, min_bytes=least)
    assert rows_of(warc.read_archive(archive)) == expected(ROWS, least)
    assert spark.table(archive.payloads).count() == len({r[2] or "" for r in ROWS})
    archive.drop()


def test_files_hold_the_same_records(spark, tmp_path):
    archive = warc.write_archive(spark.createDataFrame(ROWS, "page_id long, url string, html string"))
    warc.write_files(archive, f"{tmp_path}/w", 2)
    back = {(bytes(r.header), bytes(r.block)) for r in warc.read_files(spark, f"{tmp_path}/w").collect()}
    recs = warc.records(archive).collect()
    assert back == {(bytes(r.header), bytes(r.block)) for r in recs} and len(recs) == len(ROWS)
    assert {bytes(r.payload).decode() for r in recs} == {r[2] or "" for r in ROWS}
    archive.drop()


def test_damage_is_noticed(spark):
    archive = warc.write_archive(spark.createDataFrame(ROWS[:2], "page_id long, url string, html string"))
    bad = spark.createDataFrame([(hashlib.sha256(b"same").hexdigest(), b"sane")], "sha256 string, payload binary")
    spark.sql(f"DROP TABLE {archive.payloads}")
    bad.write.bucketBy(4, "sha256").saveAsTable(archive.payloads)
    with pytest.raises(Exception, match="doesn't match its digest"):
        warc.read_archive(archive).collect()
    archive.drop()


def test_empty_table(spark):
    archive = warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"))
    assert rows_of(warc.read_archive(archive)) == []
    archive.drop()


def test_query_and_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    assert rows_of(op3.query(spark, sf)) == sorted(con.sql(op3.SQL).fetchall(), key=str)


def test_records_say_their_length(spark):
    schema = "record binary"
    good = b"WARC/1.1\r\nContent-Length: 9\r\n\r\na\r\n\r\n\xff\x00bc\r\n\r\n"
    got = warc.taken_apart(spark.createDataFrame([(bytearray(good),)], schema)).first()
    assert bytes(got.block) == b"a\r\n\r\n\xff\x00bc" and bytes(got.header).endswith(b": 9\r\n\r\n")
    for bad in (good.replace(b": 9", b": 8"), good.replace(b"Length", b"Size"), b"WARC/1.1\r\n"):
        with pytest.raises(Exception, match="isn't as long"):
            warc.taken_apart(spark.createDataFrame([(bytearray(bad),)], schema)).collect()
