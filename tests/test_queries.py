import pytest

from ordertide import queries as base
from tests.compare import connect, same

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(base.queries()))
def test_query(spark, con, name):
    df = base.queries()[name](spark, SF)
    if name in base.oracle_sql():
        same(df, con, base.oracle_sql()[name])
    else:
        assert df.count() == 1


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.fixture(scope="module")
def odd_prices(tmp_path_factory):
    """Events with quotes of 0 and below: some sides' best is 0, and worse quotes come after it."""
    path = str(tmp_path_factory.mktemp("odd"))
    prices = "[0.0, 2.5, -1.0, 1.0, 0.0, 3.0, -2.0]"
    connect(SF).sql(f"""COPY (SELECT range AS event_id, TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * range AS ts, range // 3 % 5 AS user_id,
      CASE range % 4 WHEN 0 THEN 'click' ELSE 'view' END AS event_type, CAST(CASE WHEN user_id = 4 THEN -1.0 - range % 7 ELSE ({prices})[1 + range * range // 11 % 7] END AS DOUBLE) AS value,
      '{{"k": 1}}' AS props FROM range(300)) TO '{path}/events.parquet' (FORMAT parquet)""")
    return path


def test_exact_fold_takes_zero_as_a_price(spark, odd_prices):
    df = base.queries()["lob_exact_fold"](spark, odd_prices)
    same(df, connect(odd_prices), base.oracle_sql()["lob_exact_fold"])


def test_stream_book_takes_zero_as_a_price(spark, odd_prices):
    df = base.queries()["stream_book"](spark, odd_prices)
    same(df, connect(odd_prices), base.oracle_sql()["stream_book"])
