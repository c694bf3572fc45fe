import struct

import pytest
from pyspark.sql import functions as F

from ordertide.functions import scalars as S


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "text,ns",
    [
        ("2026-04-01T07:00:00.123456789Z", 1775026800123456789),
        ("2026-04-01T07:00:00Z", 1775026800000000000),
        ("2026-04-01T07:00:00.5Z", 1775026800500000000),
        ("2026-04-01T07:00:00.000000001Z", 1775026800000000001),
        ("2026-04-01T07:00:00.1234567891Z", 1775026800123456789),
        ("1970-01-01T00:00:00.000000000Z", 0),
        ("1969-12-31T23:59:59.5Z", -500000000),
        ("2026-13-01T07:00:00Z", None),
        ("2026-02-30T07:00:00Z", None),
        ("2026-04-01T07:00:00+02:00", None),
        ("2026-04-01", None),
        ("", None),
        (None, None),
    ],
)
def test_timestamps(spark, text, ns):
    assert one(spark, text, S.parse_timestamp_ns) == ns


@pytest.mark.parametrize("ns,text", [(1775026800123456789, "2026-04-01T07:00:00.123456789Z"), (1, "1970-01-01T00:00:00.000000001Z"), (-1, "1969-12-31T23:59:59.999999999Z"), (1775026800000000042, "2026-04-01T07:00:00.000000042Z"), (None, None)])
def test_format(spark, ns, text):
    assert one(spark, ns, S.format_timestamp, "bigint") == text


@pytest.mark.parametrize("text,value", [("0.001234567", 0.001234567), ("-12.5", -12.5), ("5411750000000", 5411750000000.0), ("1e3", 1000.0), (S.UNDEF_PRICE, None), (None, None), ("x", None), ("", None)])
def test_price(spark, text, value):
    assert one(spark, text, S.price) == value


def test_price_scales(spark):
    assert one(spark, "5411750000000", lambda c: S.price(c, "nano")) == 5411.75
    assert one(spark, "1.5", lambda c: S.price(c, "nano")) == 1.5
    assert str(one(spark, "0.000000001", S.exact_price)) in ("1E-9", "0.000000001")
    with pytest.raises(ValueError):
        S.price(F.lit("1"), "other")


@pytest.mark.parametrize("text,value", [("9876543210", 9876543210), ("18446744073709551615", 2**64 - 1), ("18446744073709551616", 0), ("-1", 0), ("abc", 0), (None, 0)])
def test_order_id(spark, text, value):
    assert int(one(spark, text, S.order_id)) == value


def test_codes_and_counts(spark):
    assert [one(spark, x, S.action) for x in ("A", "F", "N", "AA", None)] == ["A", "F", "?", "?", "?"]
    assert [one(spark, x, S.side) for x in ("B", "N", "X", None)] == ["B", "N", "?", "?"]
    assert [one(spark, x, S.one_letter) for x in ("N", "AA", "", None)] == ["N", "?", "?", "?"]
    assert [one(spark, x, S.count_or_zero, "bigint") for x in (5, 0, -3, None)] == [5, 0, 0, 0]


def test_bits(spark):
    assert one(spark, -0.1, S.double_bits, "double") == struct.unpack("<q", struct.pack("<d", -0.1))[0]
    assert one(spark, 255, S.hex64, "bigint") == "0x00000000000000ff"
    row = spark.sql("SELECT 7L AS i, 12L AS f, 'A' AS a, 'B' AS s, true AS p").select(S.packed_instrument(F.col("i"), F.col("f")), S.packed_codes(F.col("a"), F.col("s"), F.col("p"))).first()
    assert tuple(row) == (7 << 32 | 12, 65 | 66 << 8 | 1 << 16)
    assert [one(spark, x, lambda c: S.index_ts(c, F.lit(9)), "bigint") for x in (0, None, 5)] == [9, 9, 5]


def test_days(spark):
    assert spark.range(1).select(S.days_from_civil(F.lit(2024), F.lit(2), F.lit(29))).first()[0] == 19782
