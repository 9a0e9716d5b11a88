"""Scoring: reasons with points become a score from 0 to 100, a band, and ranked suspects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.textmine import saturated
from tracewell.operators import transfers as T
from tracewell.operators.rules import first_events
from tracewell.storage import settled

# Points of each reason.
WEIGHTS = {
    "IN_TRAIL": 8, "PASS_THROUGH": 18, "LAYER_30": 22, "LAYER_60": 15, "LAYER_180": 8, "FAN_OUT": 12, "CASH_OUT": 16, "CRYPTO_OUT": 18,
    "STRUCTURING": 12, "ROUND_SUM": 5, "NIGHT_OPS": 8, "VELOCITY": 10, "PRE_TXN_CONTACT": 20, "LURE_SENDER": 14, "SPOOFED_HEADER": 16,
    "MALWARE_HOST": 14,
}
CONFIDENCE = {"HIGH": 1.0, "MEDIUM": 0.6, "LOW": 0.3}
BANDS = ((75, "CRITICAL"), (55, "HIGH"), (35, "MEDIUM"))


def _reasons(df: DataFrame, code: str) -> DataFrame:
    return df.select("node", F.lit(code).alias("code"), F.lit(float(WEIGHTS[code])).alias("points"))


def financial_reasons(transfers: DataFrame, layers: DataFrame | None = None, cash_outs: DataFrame | None = None) -> DataFrame:
    """``node, code, points`` of the reasons that transfers give (once where corroborated)."""
    once = transfers.filter("not corroborated") if "corroborated" in transfers.columns else transfers
    once = settled(once if hasattr(once, "_tracewell_rows") else once.select("src", "dst", "amount", "ts"))
    lag = T.shortest_lag(once)
    out = [
        _reasons(T.pass_through(T.node_flows(once)), "PASS_THROUGH"),
        _reasons(lag.filter("lag_minutes <= 30"), "LAYER_30"),
        _reasons(lag.filter("lag_minutes > 30 and lag_minutes <= 60"), "LAYER_60"),
        _reasons(lag.filter("lag_minutes > 60 and lag_minutes <= 180"), "LAYER_180"),
        _reasons(T.fan(once, "out"), "FAN_OUT"),
        _reasons(T.structured(once), "STRUCTURING"),
        _reasons(T.repeated_amounts(once), "ROUND_SUM"),
        _reasons(T.night_share(once, "src"), "NIGHT_OPS"),
        _reasons(T.largest_burst(once, "src").filter("burst >= 4"), "VELOCITY"),
    ]
    if layers is not None:
        out.append(_reasons(layers.filter("layer > 0"), "IN_TRAIL"))
    if cash_outs is not None:  # node, mode; one reason per event
        out += [_reasons(cash_outs.filter("mode = 'CASH'"), "CASH_OUT"), _reasons(cash_outs.filter("mode = 'CRYPTO'"), "CRYPTO_OUT")]
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return every


def carried(findings: DataFrame, first: int = 8) -> DataFrame:
    """Reasons from findings: score by confidence for their first members, half for places, 2 at least."""
    weight = F.coalesce(*(F.when(F.col("confidence") == k, v) for k, v in CONFIDENCE.items()), F.lit(0.3))
    each = findings.select("code", (F.col("score") * weight).alias("points"), F.explode(F.slice("members", 1, first)).alias("node")).filter("points > 0")
    place = F.substring_index("node", "|", 1).isin("CELL", "DOMAIN", "IP")
    return each.select("node", "code", F.when(place, F.greatest(F.lit(2.0), F.col("points") / 2)).otherwise(F.col("points")).alias("points"))


def scores(reasons: DataFrame, victims: DataFrame | None = None, probable: DataFrame | None = None) -> DataFrame:
    """``node, raw, score, band, reasons``; victims get 20 at most, probable victims 25."""
    s = reasons.groupBy("node").agg(F.sum("points").alias("raw"), F.array_sort(F.collect_set("code")).alias("reasons"))
    cap = F.lit(100)
    for df, most in ((probable, 25), (victims, 20)):
        if df is not None:
            s = s.join(df.select("node", F.lit(most).alias("_cap")).distinct(), "node", "left")
            cap = F.least(cap, F.coalesce("_cap", F.lit(100)))
            s = s.withColumn("_least", cap).drop("_cap")
            cap = F.col("_least")
    s = s.withColumn("score", F.least(saturated(F.col("raw"), 55.0), cap))
    band = F.lit("LOW")
    for least, name in reversed(BANDS):
        band = F.when(F.col("score") >= least, name).otherwise(band)
    return s.select("node", "raw", "score", band.alias("band"), "reasons")


def main_reasons(reasons: DataFrame, clusters: DataFrame, top: int = 10) -> DataFrame:
    """``cluster, main``: the reasons of all nodes of a cluster, heaviest first, as ``code, points`` of the node where they weigh most."""
    named = reasons.join(clusters.select("node", "component"), "node", "left").select(F.coalesce("component", "node").alias("cluster"), "code", "points")
    each = named.groupBy("cluster", "code").agg(F.max("points").alias("points"))
    first = each.withColumn("_place", F.row_number().over(Window.partitionBy("cluster").orderBy(F.col("points").desc(), "code"))).filter(F.col("_place") <= top)
    return first.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "code", "points"))), lambda x: F.struct(x["code"].alias("code"), x["points"].alias("points"))).alias("main"))


def reason_evidence(reasons: DataFrame, findings: DataFrame, transfers: DataFrame, observations: DataFrame, most: int = 50) -> DataFrame:
    """``node, code, evidence`` of each reason: a finding's own events, else the node's transfers, else its other events."""
    each = reasons.select("node", "code").distinct()
    of_findings = each.join(findings.select("code", "evidence"), "code")
    rest = each.join(findings.select("code"), "code", "left_anti")
    moved = transfers.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("node"), "event_id", "seq")
    paid = first_events(rest.join(moved, "node"), ["node", "code"], most)
    others = rest.join(paid.select("node", "code"), ["node", "code"], "left_anti").join(observations.select("node", "event_id", "seq"), "node")
    return of_findings.select("node", "code", "evidence").unionByName(paid).unionByName(first_events(others, ["node", "code"], most))


def suspects(scored: DataFrame, clusters: DataFrame, flows: DataFrame, layers: DataFrame, victims: DataFrame, top_reasons: int = 10) -> DataFrame:
    """One row per cluster: primary node, score, band, money in and out, least layer and main reasons.

    Clusters with a victim are left out.  Money is summed over accounts where the cluster has
    any, else over payment addresses, as both rails may show one transfer.
    """
    named = scored.join(clusters.select("node", "component"), "node", "left").withColumn("cluster", F.coalesce("component", "node"))
    named = named.join(flows, "node", "left").join(layers, "node", "left")
    hurt = victims.select("node").distinct().join(clusters.select("node", "component"), "node", "left").select(F.coalesce("component", "node").alias("cluster")).distinct()
    kind = F.substring_index("node", "|", 1)
    total = lambda c, k: F.sum(F.when(k, F.coalesce(F.col(c), F.lit(0.0)).cast(T.MONEY)))
    on = kind == "ACCOUNT"
    rows = named.join(hurt, "cluster", "left_anti").groupBy("cluster").agg(
        F.max(F.struct("score", "raw", "node")).alias("best"),
        F.count("*").alias("members"),
        F.coalesce(total("in_amount", on), total("in_amount", ~on)).cast("double").alias("received"),
        F.coalesce(total("out_amount", on), total("out_amount", ~on)).cast("double").alias("sent"),
        F.min("layer").alias("layer"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))), 1, top_reasons).alias("reasons"),
    )
    band = F.lit("LOW")
    for least, name in reversed(BANDS):
        band = F.when(F.col("score") >= least, name).otherwise(band)
    return rows.withColumn("score", F.col("best.score")).select("cluster", F.col("best.node").alias("primary"), "score", band.alias("band"), "members", "received", "sent", "layer", "reasons")


def ranked(suspects_: DataFrame, top: int) -> DataFrame:
    """The report's list: by score, then money received."""
    order = Window.orderBy(F.col("score").desc(), F.col("received").desc(), "cluster")
    best = suspects_.orderBy(F.col("score").desc(), F.col("received").desc(), "cluster").limit(top)
    return best.withColumn("rank", F.row_number().over(order))
