"""Queries on tables with rows that the given ones lack."""

import datetime as dt

import duckdb
import pytest

from quernstone.queries import QUERIES, SQL
from tests.oracle import assert_same

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def zero_mids(spark, tmp_path_factory):
    """Events of two days of which some have a bid and an ask of zero."""
    sf = str(tmp_path_factory.mktemp("zeros"))
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i * 600) SECOND AS ts, CASE WHEN i % 97 = 5 THEN 7 ELSE i * 7919 % 50 END AS user_id,
        CASE WHEN i % 2 = 0 THEN 'view' ELSE 'click' END AS event_type, CASE WHEN i % 97 = 5 THEN 0.0 ELSE (i * 31 % 101 + 1) / 4 END::DOUBLE AS value, '' AS props FROM range(600) t(i)) TO '{sf}/events.parquet' (FORMAT parquet)""")
    return sf


def test_ridge_over_a_mid_of_zero(spark, zero_mids):
    rows = QUERIES["V17_ridge"](spark, zero_mids).collect()
    assert sorted(r["symbol"] for r in rows) == ["click", "view"] and all(r["n_train"] > 0 and r["r2_test"] is not None for r in rows)


def test_volatility_over_a_mid_of_zero(spark, zero_mids):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{zero_mids}/events.parquet'")
    got = QUERIES["A3_micro_features"](spark, zero_mids)
    assert got.where("isnan(vol)").count() > 0
    assert_same(got, con, SQL["A3_micro_features"])


def test_scores_on_a_bound_of_the_verdicts(spark, tmp_path):
    """Scores that are 30 or 60 but for the last digit: the steps of the maps must be those of their decimals."""
    con = duckdb.connect()
    con.execute("CREATE TABLE part AS SELECT k::BIGINT AS p_partkey, s::INT AS p_size FROM (VALUES (13986, 20), (48100, 44), (62900, 32), (76886, 20)) t(k, s)")
    con.execute(f"COPY part TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    assert_same(QUERIES["V7_composite"](spark, str(tmp_path)), con, SQL["V7_composite"])


@pytest.mark.parametrize("name", ["SP12_spec_checks", "V2_sweep_axes"])
def test_documents_are_dealt_out_and_read_once(spark, name):
    """Documents are many times as long as the parts they are made of: dealt out before they are read, and equal ones read once by a worker."""
    from quernstone.plans import spec as P

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "hashpartitioning(p_partkey" in plan[plan.rindex("ArrowEvalPython") :]
    read = P._told if name == "SP12_spec_checks" else P._swept
    read.cache_clear()
    assert read('{"a": null}') == read('{"a": null}') and read.cache_info().hits == 1


def test_repeated_documents(spark):
    from quernstone.plans import spec as P

    text = '{"entry":{"condition":{"type":"compare","left":{"kind":"indicator","name":"sma","params":{"period":%d}},"right":null}},"exit":{"exits":[]}}'
    rows = spark.createDataFrame([(i, [None, "", "no", "{}", text % 20, text % 30][i % 6]) for i in range(60)], "k int, t string")
    told = {(r["t"], r["tier"], r["warm_up"], r["errors"]) for r in P.checked(rows, "t").collect()}
    assert len(told) == 6 and {x[2] for x in told} == {None, 1, 21, 31} and sum(x[3] == "not_json" for x in told) == 3
    axes = P.sweep_axes(rows.where("t IS NULL OR t <> 'no'"), "k", "t").collect()
    assert sorted((r["k"] % 6, r["axis"], r["base"], r["places"]) for r in axes) == sorted([(4, "indicator_period", 20.0, 1), (5, "indicator_period", 30.0, 1)] * 10)


def test_quiet_sources_cost_one_message():
    """A source that has not failed and does not end in a failure asks the state store once and tells nothing; one that fails is kept with one timer."""
    import pandas as pd

    from quernstone.streaming.failures import Streaks

    class Store:
        def __init__(self):
            self.calls, self.value = [], None

        def __getattr__(self, name):
            def call(*args):
                self.calls.append(name)
                if name in ("update", "clear"):
                    self.value = args[0] if args else None
                return self.value if name == "get" else []

            return call

    walker, store = Streaks("k", "id", 2, 12), Store()
    walker.handle = walker.streak = store
    rows = lambda *bad: iter([pd.DataFrame({"id": range(len(bad)), "ts": [START + dt.timedelta(hours=i) for i in range(len(bad))], "bad": bad})])
    assert list(walker.handleInputRows(("a",), rows(False, True, False), None)) == [] and store.calls == ["get"]
    (told,) = walker.handleInputRows(("a",), rows(False, True, True), None)
    assert told.values.tolist() == [[2, "a", "alert", 2]] and store.value == (2, START + dt.timedelta(hours=2))
    (told,) = walker.handleInputRows(("a",), rows(False), None)
    assert told.values.tolist() == [[0, "a", "recovered", 2]] and store.value is None
    assert store.calls[1:] == ["get", "update", "registerTimer", "get", "deleteTimer", "clear"]


def test_spans_over_rows_of_one_time(spark, monkeypatch):
    """Rows of one time and questions of one time and bound count once in the tree of a span, and each question is answered."""
    from quernstone.operators import chunked
    from quernstone.operators import joins as J

    sizes, own = {}, chunked.written

    def counted(df, name, *rest):
        out = own(df, name, *rest)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(chunked, "written", counted)
    at = lambda s: START + dt.timedelta(seconds=s)
    quotes = [("a", at(i), 10.0 + (7 * i + 3 * c) % 11) for i in range(0, 60, 6) for c in range(20)] + [("a", at(30), None)]
    asks = [(20 * i + c, "a", at(i), 10.0 + c % 4) for i in range(0, 60, 5) for c in range(20)] + [(-1, None, at(0), 50.0), (-2, "a", None, 50.0), (-3, "a", at(0), None)]
    left = spark.createDataFrame(asks, "id int, k string, t timestamp_ntz, bound double")
    got = J.within(left, spark.createDataFrame(quotes, "k string, ts timestamp_ntz, v double"), ["k"], "t", "ts", 12, "v", "bound", "hit", "id")
    assert got.columns == ["id", "k", "t", "bound", "hit"]
    reached = lambda k, t, b: min((ts for kk, ts, v in quotes if None not in (k, t, b, v) and kk == k and t <= ts <= t + dt.timedelta(seconds=12) and v <= b), default=None)
    assert sorted((r["id"], str(r["hit"])) for r in got.collect()) == sorted((i, str(reached(k, t, b))) for i, k, t, b in asks)
    assert sizes["places"] == 10 + 2 * (12 * 4 + 1)  # those without a key or a time can have no answer
