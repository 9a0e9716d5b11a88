"""Operators on random small inputs, held against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tracewell.functions import normalize as N
from tracewell.functions import textmine as M
from tracewell.operators import trace as G
from tracewell.operators import transfers as T
from tracewell.operators.components import connected_components

START = dt.datetime(2026, 9, 8)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    out = []
    for i in range(600):
        s, d = rnd.sample("ABCDEFG", 2)
        ts = None if rnd.random() < 0.05 else START + dt.timedelta(seconds=rnd.randrange(40 * 3600))
        out.append((s, d, float(rnd.choice((100, 200, 45000))), ts, i))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, amount double, ts timestamp_ntz, seq long")


def test_duplicates(frame, rows):
    seen, want = set(), {}
    for s, d, a, ts, i in sorted(rows, key=lambda r: (r[3] is None, r[3] or START, r[4])):
        m = None if ts is None else int((ts - START).total_seconds() // 60)
        near = [(s, d, a, m)] if m is None else [(s, d, a, m + k) for k in (-1, 0, 1)]
        want[i] = any(k in seen for k in near)
        seen.add((s, d, a, m))
    assert {r.seq: r.corroborated for r in T.mark_duplicates(frame).collect()} == want


@pytest.mark.parametrize("span", ["HOUR", "DAY"])
def test_shortest_lag(frame, rows, span):
    want = {}
    for n in "ABCDEFG":
        ins, outs = ([r[3] for r in rows if r[k] == n and r[3]] for k in (1, 0))
        lags = [(o - i).total_seconds() / 60 for o in outs for i in ins if i <= o]
        if lags:
            want[n] = min(lags)
    assert {r.node: r.lag_minutes for r in T.shortest_lag(frame, span).collect()} == pytest.approx(want)


def test_largest_burst(frame, rows):
    want = {}
    for n in "ABCDEFG":
        at = [r[3] for r in rows if r[0] == n and r[3]]
        want[n] = max(sum(t - dt.timedelta(minutes=60) <= u <= t for u in at) for t in at)
    assert {r.node: r.burst for r in T.largest_burst(frame, "src").collect()} == want


def test_trace_depth_is_least(spark, frame, rows):
    arrive, want, taken, depth = {"A": START - dt.timedelta(days=1)}, {}, set(), 1
    while depth <= 6 and arrive:
        nxt = {}
        for s, d, _, ts, i in rows:
            if i not in taken and s in arrive and (ts is None or ts >= arrive[s]):
                want[i] = depth
                at = ts or arrive[s]
                nxt[d] = min(nxt.get(d, at), at)
        taken |= set(want)
        arrive, depth = nxt, depth + 1
    got = {r.seq: r.depth for r in G.trace(frame, spark.createDataFrame([("A",)], "node string")).collect()}
    assert got == want
    assert G.trace(frame, spark.createDataFrame([], "node string")).count() == 0


def test_traced_queries_go_to_the_full_depth(spark, monkeypatch):
    from tracewell.plans import registry

    pays = [("ACCOUNT|A", "ACCOUNT|B"), ("ACCOUNT|B", "ACCOUNT|C1"), ("ACCOUNT|C1", "ACCOUNT|D"), ("ACCOUNT|D", "ACCOUNT|E"), ("ACCOUNT|E", "ACCOUNT|F"), ("ACCOUNT|F", "ACCOUNT|G"), ("ACCOUNT|G", "ACCOUNT|H")]
    rows = [(s, d, 100.0 - i, START + dt.timedelta(hours=i), i) for i, (s, d) in enumerate(pays)]
    paid = spark.createDataFrame(rows, "src string, dst string, amount double, ts timestamp_ntz, seq long")
    monkeypatch.setattr(registry, "funds", lambda spark, sf: paid)
    assert {r.seq: r.depth for r in registry.QUERIES["g03_trace"](spark, "").collect()} == {i: i + 1 for i in range(6)}
    layers = {r.node: r.layer for r in registry.QUERIES["g06a_layers_full"](spark, "").collect()}
    assert layers == {"ACCOUNT|A": 0} | {d: i + 1 for i, (_, d) in enumerate(pays[:6])}


def test_sim_velocity_counts_numbers_where_no_card_is_known(spark):
    from tracewell.operators import rules as R

    pairs = [(f"PHONE|{h}{i}", f"IMEI|{h}", "USES_HANDSET") for h in "abc" for i in range(3)] + [(f"IMSI|{i}", "IMEI|d", "SIM_IN_HANDSET") for i in range(3)] + [("IMSI|9", "IMEI|c", "SIM_IN_HANDSET")]
    seen = [("PHONE|b0", START), ("PHONE|b1", START + dt.timedelta(days=40)), ("PHONE|a0", START)]
    got = R.sim_velocity(spark.createDataFrame(pairs, "src string, dst string, rel string"), spark.createDataFrame(seen, "node string, ts timestamp_ntz")).collect()
    assert sorted(r.entity for r in got) == ["IMEI|a", "IMEI|d"]


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*edges, (None, 3)], "src long, dst long")).collect()}
    assert got == {n: root(n) for n in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_components_of_long_chains_end_in_logarithmic_rounds(spark, monkeypatch, limit):
    from tracewell import storage
    from tracewell.operators import components

    n = 2000
    chains = [list(range(1, n + 1)), list(range(2 * n, n, -1)), random.Random(1).sample(range(2 * n + 1, 3 * n + 1), n)]
    edges = [e for c in chains for e in zip(c, c[1:], strict=False)]
    edges += [(3 * n + n // 2, 3 * n + i) for i in range(1, n + 1)] + [(4 * n + a, 4 * n + b) for a in range(1, 61) for b in range(1, a)]
    rounds = []
    pointers = components._pointers
    monkeypatch.setattr(components, "_pointers", lambda e, k: rounds.append(k) or pointers(e, k))
    monkeypatch.setattr(storage, "BROADCAST_BYTES", limit)
    if not limit:  # as if each task read few edges
        stars = components._stars
        monkeypatch.setattr(components, "_stars", lambda e: stars(e, 10))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    got = sorted((r.node, r.component) for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert got == [(i, (i - 1) // n * n + 1) for i in range(1, 4 * n + 61)]
    assert len(rounds) <= 26  # 2 log2 of the nodes
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize(("f", "value", "want"), [
    (N.norm_msisdn, "+91 98765 43210", "9876543210"), (N.norm_msisdn, "09876543210", "9876543210"), (N.norm_msisdn, "vm-SBIINB", "VM-SBIINB"), (N.norm_msisdn, "1930", "1930"), (N.norm_msisdn, "", None),
    (N.parse_amount, "Rs. 4,85,000.00 Dr", -485000.0), (N.parse_amount, "(500)", -500.0), (N.parse_amount, "₹ 99", 99.0), (N.parse_amount, "NA", None),
    (N.norm_ip, "010.1.2.3", "10.1.2.3"), (N.norm_ip, "300.1.1.1", None), (N.subnet24, "10.1.2.3", "10.1.2.0/24"), (N.norm_mac, "AA-BB-CC-00-11-22", "aa:bb:cc:00:11:22"), (N.norm_imei, "359871042256641", "35987104225664"),
    (N.parse_ts, "08/09/2026 10:32:00", dt.datetime(2026, 9, 8, 10, 32)), (N.parse_ts, "2026-09-08T05:02:00Z", dt.datetime(2026, 9, 8, 10, 32)), (N.parse_ts, "1757308320", dt.datetime(2025, 9, 8, 10, 42)), (N.parse_ts, "8/9/2026, 1:05 PM", dt.datetime(2026, 9, 8, 13, 5)), (N.parse_ts, "n/a", None),
    (lambda c: N.inr(c.cast("double")), "12345678.5", "1,23,45,678.50"), (N.norm_key, "A-Party No.", "apartyno"), (N.norm_upi, " A.b@OkBank", "a.b@okbank"), (N.norm_upi, "a@b.com", None),
    (lambda c: M.lure(c)["score"], "Share OTP, KYC urgent", 49), (lambda c: F.size(M.url_risk(c)), "http://sbi-kyc-update.xyz/a.apk", 4), (lambda c: F.size(M.url_risk(c)), "https://onlinesbi.sbi/x", 0),
    (lambda c: M.indicators(c)["accounts"], "a/c no 123456789, fac 987654321 or 12345678", ["123456789"]), (lambda c: M.indicators(c)["phones"], "call +91-9876543210 not 98765432101", ["9876543210"]),
])
def test_scalars(spark, f, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0] == want


def test_every_query_with_sql_is_registered():
    from tracewell.plans import registry

    assert set(registry.ORACLES) <= set(registry.QUERIES)


@pytest.mark.parametrize("span", ["HOUR", "DAY"])
def test_lags_of_hops_reach_over_spans(spark, frame, span):
    hops = G.trace(frame, spark.createDataFrame([("A",)], "node string"), 4).drop("lag_minutes")
    every = hops.collect()
    into = {}
    for h in every:
        if h.ts is not None:
            into.setdefault(h.dst, []).append(h.ts)
    got = {r.seq: r.lag_minutes for r in G._lagged(hops, span).collect()}
    assert len(got) == len(every) > 100
    for h in every:
        before = [t for t in into.get(h.src, ()) if h.ts is not None and t <= h.ts]
        want = (h.ts - max(before)).total_seconds() / 60 if before else None
        assert got[h.seq] == (want if want is None else pytest.approx(want))
