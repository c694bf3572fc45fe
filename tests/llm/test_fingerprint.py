import hashlib
import re
import unicodedata

import xxhash

from ordertide.llm import fingerprint as fp
from ordertide.llm import op5

WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"


def canon(text):
    nfkc = lambda t: unicodedata.normalize("NFKC", t)
    return re.sub(f"[{WHITE}]+", " ", nfkc(nfkc(text).casefold())).strip(" ")


def digest(text):
    b = canon(text).encode()
    h = lambda data, seed: xxhash.xxh64(data, seed=seed).intdigest()
    return f"{h(b, 42):016x}{h(b, h(fp.SECOND_SEED.encode(), 42)):016x}"


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (-r[0], digest(r[1]), r[1]))
    out = []
    for k, (i, text) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        third = len(text) // 3
        ed = text[: len(text) - third] + nxt[:third]
        out.append((i, len(text), hashlib.sha256(ed.encode()).hexdigest(), digest(text), digest(ed), float(canon(text) == canon(ed)), float(canon(text) == canon(nxt)), min(j for j, t in rows if canon(t) == canon(text))))
    return sorted(out)


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id"]


def got(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(op5.query(spark, sf)) == brute(rows)


def test_odd_rows(spark, tmp_path):
    texts = ["", None, " A　b ", "a B", "Straße ﬁ", "STRASSE FI", "é", "é", "x" * 50_000, "ab", "漢字 かな カナ", "a b"]
    rows = [(7 * i, t) for i, t in enumerate(texts)] + [(14, " A　b ")]
    spark.createDataFrame([(i, t, "f", 1) for i, t in rows], "doc_id long, text string, fingerprint string, class_id int").write.parquet(f"{tmp_path}/documents.parquet")
    assert got(op5.query(spark, str(tmp_path))) == brute(rows)


def test_ranges_agree_with_one_range(spark):
    rows = [(i * i % 1009, f"text {i} " * (i % 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = (sorted(map(tuple, fp.with_next(df, "doc_id", ["text"], ["text"], b).collect())) for b in (1 << 30, 200))
    assert one == many and len(one) == 300


def test_repeated_ids_have_an_order(spark, tmp_path):
    """Equal ids: by fingerprint, then by text, wherever rows come from."""
    texts = ["a  b", "a b", " a b", "A b", "c", "C ", "c  "]
    rows = [(i, t) for i in (3, 5, 9) for t in texts] + [(4, "x y z")]
    for parts in (1, 5):
        path = f"{tmp_path}/{parts}"
        spark.createDataFrame(rows if parts == 1 else rows[::-1], "doc_id long, text string").repartition(parts).write.parquet(f"{path}/documents.parquet")
        assert got(op5.query(spark, path)) == brute(rows)


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fp, "BLOCKS", 7)
    monkeypatch.setattr(fp, "RANGES", 5)
    df = spark.createDataFrame([(i * 37 % 500 if i % 50 else None, f"t{i}") for i in range(600)], "doc_id long, text string")
    one, many = (sorted(map(str, fp.with_next(df, "doc_id", ["text"], ["text"], b).collect())) for b in (1 << 30, 60))
    assert one == many and len(one) == 600


def test_empty_and_single(spark, tmp_path):
    schema = "doc_id long, text string"
    for name, rows in (("none", []), ("one", [(5, "abcdef")])):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        assert got(op5.query(spark, f"{tmp_path}/{name}")) == (brute(rows) if rows else [])


def test_collision_splits_the_class(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "ab"), (2, "ac"), (3, "AB"), (4, "ac"), (5, "zz")], "doc_id long, text string").withColumn("fingerprint", F.substring(F.lower("text"), 1, 1))
    assert {(r.doc_id, r.class_id) for r in fp.classes(df, "doc_id", "text").collect()} == {(1, 1), (2, 2), (3, 1), (4, 2)}
