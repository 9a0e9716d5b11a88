"""What only shows on larger tables: numbers beyond 32 bits, rows that gather in one task, work done twice."""

import os

import pytest
from pyspark.sql import functions as F

from tracewell.sources import events as E


def test_rows_far_down_an_exhibit_are_numbered(spark):
    rows = spark.createDataFrame([("EX-002", 21_475, 7), ("EX-002", 2_000_000_000, 0), ("EX-002", 1, 3)], "exhibit string, row int, sub int").withColumn("flags", F.lit(None).cast("array<string>"))
    got = {r.row: (r.seq, r.event_id) for r in E.numbered(rows).collect()}
    assert got == {21_475: (2_002_147_500_007, "EX-002-21475-7"), 2_000_000_000: (202_000_000_000_000, "EX-002-2000000000-0"), 1: (2_000_000_100_003, "EX-002-1-3")}


def test_values_of_an_event_are_computed_once(spark):
    """Each identifier is normalised in one place of the plan; links and filters read it."""
    records = spark.createDataFrame([("EX-001", "a", "COMPLAINT", "complaint", 1, 0, {"name": "a b", "phone": "9876543210", "account": "123456789012", "upi": "a.b@okbank"})], "exhibit string, source string, kind string, part string, row int, sub int, fields map<string,string>").withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    made = E.complaints(records).filter("size(entities) > 2").select("row", "entities", "links")
    assert [len(r.links) for r in made.collect()] == [4]
    plan = E.complaints(records).select("row", "entities", "links")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[A-Za-z]{2}-?[A-Za-z]{5,8}") <= 4 and plan.count("[xX*#]") <= 4  # once or twice for victims and for suspects, dozens before


def test_records_of_one_part_are_dealt_over_cores(spark, tmp_path):
    from tracewell.plans import record_queries as Q

    spark.range(40).selectExpr("id as c_custkey", "'n' || id as c_name", "double(id) as c_acctbal").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    assert Q.c08_complaint_events(spark, str(tmp_path)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def _transfers(spark):
    import datetime as dt
    import random

    rnd = random.Random(4)
    rows = [(f"A{rnd.randrange(6)}", f"B{rnd.randrange(6)}", 10.0 * i, dt.datetime(2026, 1, 1) + dt.timedelta(minutes=rnd.randrange(9000)), i) for i in range(300)]
    rows = [(b, a, *r) if i % 2 else (a, b, *r) for i, (a, b, *r) in enumerate(rows)]
    return spark.createDataFrame(rows, "src string, dst string, amount double, ts timestamp_ntz, seq long")


def test_nodes_cut_into_spans_give_what_whole_ones_give(spark):
    from tracewell.operators import transfers as T

    t = _transfers(spark)
    for f in (lambda many: T.shortest_lag(t, "HOUR", many), lambda many: T.largest_burst(t, "src", many=many)):
        cut, whole = sorted(f(0).collect()), sorted(f(10**6).collect())
        assert cut == whole and len(whole) == 12


def test_reasons_read_transfers_once(spark):
    from tracewell.operators import scoring as S

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    t = _transfers(spark).mapInArrow(count, "src string, dst string, amount double, ts timestamp_ntz, seq long")
    assert S.financial_reasons(t).count() > 0 and seen.value == 300


def test_masked_accounts_share_the_members_of_their_digits(spark):
    """Members are gathered by last digits and not by pair, so no shuffle or sort follows the join."""
    from tracewell.operators import rules as R

    nodes = spark.createDataFrame([(f"ACCOUNT|MASKED-0{i}1234",) for i in range(5)] + [(f"ACCOUNT|9{i:07d}1234",) for i in range(7)] * 2, "node string")
    found = R.masked_match(nodes)
    assert [len(r.members) for r in found.collect()] == [7] * 5
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")


def test_layers_need_no_lags_and_taken_transfers_no_shuffle(spark):
    from tracewell.operators import trace as G

    hops = G.trace(_transfers(spark), spark.createDataFrame([("A1",)], "node string"), 4, lags=False)
    assert hops.columns == ["depth", "src", "dst", "amount", "ts", "seq", "via"]
    assert hops.select("seq").distinct().count() == hops.count() > 100
    assert "Join" not in hops._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_statements_are_shuffled_before_they_double(spark):
    from tracewell.plans import registry

    plan = registry.a04_edges(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(src") == 1 and "Union" not in plan


def test_a_delimited_file_is_not_held_as_rows():
    import tracemalloc

    from tracewell.sources import exhibits as X

    raw = ("Calling Party No.;Called-Number;Duration (sec);Call Type\n" + "".join(f"9{i:09d};8000000001;{i};OUT\n" for i in range(30_000))).encode()
    tracemalloc.start()
    kind, _, rows = X.open_file("a.csv", raw)
    first, n = None, 0
    for n, r in enumerate(rows, 1):
        first = first or r
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (kind, n, first) == ("CDR", 30_000, ("row", 2, 0, {"a_party": "9000000000", "b_party": "8000000001", "duration": "0", "call_type": "OUT"}))
    assert peak < 2 * len(raw)


def test_a_file_that_breaks_half_way_gives_one_error(spark):
    from tracewell.sources import exhibits as X

    raw = b"caller,called,type,start_time\n" + b"9876543210,9876543211,OUT,2026-09-08 09:00:00\n" * 20_000
    files = spark.createDataFrame([("EX-001", "a.csv", raw + b'"' + b"x" * 200_000), ("EX-002", "b.csv", raw)], "exhibit string, source string, content binary")
    assert {tuple(r) for r in X.records(files).groupBy("exhibit", "kind").count().collect()} == {("EX-001", "ERROR", 1), ("EX-002", "CDR", 20_000)}
