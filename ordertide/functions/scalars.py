"""Timestamps in nanoseconds, prices, flags and codes of market events, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the feed's format.
UNDEF_PRICE = "9223372036854775807"
LAST, TOP_OF_BOOK, SNAPSHOT, BY_PRICE, BAD_TS_RECV, MAYBE_BAD_BOOK = 128, 64, 32, 16, 8, 4
ACTIONS, SIDES = ("A", "C", "R", "T", "M", "F"), ("B", "A", "N")
NANOS = 1_000_000_000
#: Fixed values of the ordered hash.
HASH_START, HASH_FACTOR = 0xCBF29CE484222325, 0x100000001B3


def days_from_civil(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01 in the Gregorian calendar."""
    return F.unix_date(F.make_date(year, month, day))


def parse_timestamp_ns(text: Column) -> Column:
    """`YYYY-MM-DDTHH:MM:SS[.fraction]Z` as nanoseconds since 1970, BIGINT.

    Digits after the ninth are cut off. Anything else, zone offsets included, is null.
    """
    whole = F.unix_seconds(F.concat(F.substring(text, 1, 19), F.lit("Z")).try_cast("timestamp"))
    nanos = F.rpad(F.rtrim(F.substring(text, 21, 9), F.lit("Z")), 9, "0").cast("bigint")
    shaped = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?Z?$")
    return F.when(shaped, whole * F.lit(NANOS).cast("bigint") + nanos)


def format_timestamp(ns: Column) -> Column:
    """Nanoseconds as `YYYY-MM-DDTHH:MM:SS.nnnnnnnnnZ`, always nine digits."""
    seconds = F.floor(ns / F.lit(NANOS).cast("decimal(20,0)")).cast("bigint")
    nanos = ns - seconds * F.lit(NANOS).cast("bigint")
    return F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad(nanos.cast("string"), 9, "0"), F.lit("Z"))


def index_ts(recv: Column, event: Column) -> Column:
    """The receive time, or the event time where that is absent (null or 0)."""
    return F.coalesce(F.nullif(recv, F.lit(0)), event)


def price(text: Column, scale: str = "as written") -> Column:
    """A price in text as DOUBLE; null for null, for the undefined price, and for what isn't a number.

    `scale="nano"` reads integers without a point as counts of 1e-9.
    """
    value = F.when(text != UNDEF_PRICE, text.try_cast("double"))
    if scale == "nano":
        return F.when(text.rlike(r"^-?[0-9]+$"), value / 1e9).otherwise(value)
    if scale != "as written":
        raise ValueError(f"scale is {scale!r}: 'as written' or 'nano'")
    return value


def exact_price(text: Column) -> Column:
    """The same as DECIMAL(38,9)."""
    return F.when(text != UNDEF_PRICE, text.try_cast("decimal(38,9)"))


def order_id(text: Column) -> Column:
    """Unsigned 64-bit order ids as DECIMAL(20,0); 0 where there is none or it doesn't fit."""
    value = text.try_cast("decimal(20,0)")
    return F.coalesce(F.when((value >= 0) & (value <= F.lit(str(2**64 - 1)).cast("decimal(20,0)")), value), F.lit(0).cast("decimal(20,0)"))


def count_or_zero(value: Column) -> Column:
    """Sizes, sequences, ids and flags: missing or negative ones are 0."""
    return F.greatest(F.coalesce(value.try_cast("bigint"), F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))


def action(text: Column) -> Column:
    return F.when(text.isin(*ACTIONS), text).otherwise(F.lit("?"))


def side(text: Column) -> Column:
    return F.when(text.isin(*SIDES), text).otherwise(F.lit("?"))


def side_meaning(action_: Column, side_: Column) -> Column:
    """What a side says of its action: aggressor of a trade, filled order, or order in the book; null
    without a side and for actions that have none."""
    who = F.when(side_ == "A", F.lit("sell")).when(side_ == "B", F.lit("buy"))
    what = F.when(action_ == "T", F.lit("aggressor")).when(action_ == "F", F.lit("order filled")).when(action_.isin("A", "M", "C"), F.lit("order in the book"))
    return F.concat(who, F.lit(" "), what)


def one_letter(text: Column) -> Column:
    """The code as sent where it is one character, else `?`."""
    return F.when(F.char_length(text) == 1, text).otherwise(F.lit("?"))


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(bit) != 0


def packed_instrument(instrument_id: Column, flags: Column) -> Column:
    return F.shiftleft(instrument_id.cast("bigint"), 32).bitwiseOR(flags.cast("bigint"))


def packed_codes(action_: Column, side_: Column, has_price: Column) -> Column:
    letters = F.ascii(action_).cast("bigint").bitwiseOR(F.shiftleft(F.ascii(side_).cast("bigint"), 8))
    return letters.bitwiseOR(F.shiftleft(has_price.cast("int").cast("bigint"), 16))


def double_bits(value: Column) -> Column:
    """The 64 bits of a double as BIGINT."""
    return F.java_method(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), value).cast("bigint")


def hex64(value: Column) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(value)), 16, "0"))


def sending_ts(ts_recv_ns: Column, ts_in_delta: Column) -> Column:
    """When the venue sent a message: its receive time less the delta."""
    return ts_recv_ns - ts_in_delta


def event_text(
    key_ts_ns: str = "key_ts_ns", instrument_id: str = "instrument_id", order_id_: str = "order_id", side_: str = "side",
    price_: str = "price", has_price: str = "has_price", size: str = "size", action_: str = "action",
) -> Column:
    """One line for an event, the price with nine decimals or the word null."""
    shown = F.when(F.col(has_price), F.format_string("%.9f", F.col(price_))).otherwise(F.lit("null"))
    parts = (("timestamp", format_timestamp(F.col(key_ts_ns))), ("instrument", F.col(instrument_id)), ("order_id", F.col(order_id_)), ("side", F.col(side_)), ("price", shown), ("size", F.col(size)), ("action", F.col(action_)))
    return F.concat_ws(" | ", *(F.concat(F.lit(f"{name}="), c.cast("string")) for name, c in parts))
