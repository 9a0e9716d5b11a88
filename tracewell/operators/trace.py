"""Tracing funds forward in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import transfers as T
from tracewell.storage import discard, materialize, rows_of, settled


def trace(transfers: DataFrame, origins: DataFrame, max_depth: int = 6, lags: bool = True) -> DataFrame:
    """``depth, src, dst, amount, ts, seq, lag_minutes, via`` of every transfer that money from ``origins`` can have taken.

    ``transfers`` has src, dst, amount, ts and seq (unique); ``origins`` has node.  A transfer
    follows when its payer was reached no later than its time; a transfer without a time
    always follows, and passes on the time at which its payer was reached.  Breadth-first, so a hop's depth is the least
    possible.  Each round joins the transfers with the earliest arrival of
    each node reached in the round before, and with its earliest arrival in rounds before that, which tells the
    transfers already taken; rounds are cut by tables in the shared folder.  ``via`` is the seq of
    the hop that reached the payer earliest, ``lag_minutes`` the time since its latest
    arrival that is not later than the hop (left out unless ``lags``).  No origins give no hops.
    """
    t = settled(transfers).filter(F.col("src") != F.col("dst")).select("src", "dst", "amount", "ts", "seq")
    start = origins.select("node").distinct().select("node", F.lit(None).cast("timestamp").alias("arrived"), F.lit(None).cast(t.schema["seq"].dataType).alias("via"))
    reached = materialize(start.withColumns({"before": F.lit(None).cast("timestamp"), "seen": F.lit(False), "always": F.lit(False)}))
    found = past = None
    for depth in range(1, max_depth + 1):
        step = t.join(reached.withColumnRenamed("node", "src"), "src").filter("arrived is null or ts is null or ts >= arrived").filter("not (seen and (always or ts is null or coalesce(ts >= before, false)))")
        hop = materialize(step.select(F.lit(depth).alias("depth"), "src", "dst", "amount", "ts", "seq", F.coalesce(F.col("ts").cast("timestamp"), "arrived").alias("_at"), "via"))
        if not rows_of(hop):
            discard(hop)
            break
        found = hop if found is None else found.unionByName(hop)
        if depth == max_depth:
            break
        now = reached.select("node", F.col("arrived").alias("before"), F.lit(True).alias("seen"), F.col("arrived").isNull().alias("always"))
        past = now if past is None else past.unionByName(now)
        past = materialize(past.groupBy("node").agg(F.min("before").alias("before"), F.bool_or("seen").alias("seen"), F.bool_or("always").alias("always")))
        early = F.min_by("seq", F.struct(F.col("_at").isNotNull(), F.col("_at"), F.col("seq")))
        new = hop.groupBy(F.col("dst").alias("node")).agg(F.when(F.count_if(F.col("_at").isNull()) > 0, F.lit(None)).otherwise(F.min("_at")).cast("timestamp").alias("arrived"), early.alias("via"))
        reached = materialize(new.join(past, "node", "left").fillna(False, ["seen", "always"]))
    if found is None:
        none = t.limit(0).select(F.lit(0).alias("depth"), "src", "dst", "amount", "ts", "seq", F.lit(0.0).alias("lag_minutes"), F.col("seq").alias("via"))
        return none if lags else none.drop("lag_minutes")
    return _lagged(found) if lags else found.drop("_at")


def _lagged(hops: DataFrame, span: str = "DAY", many: int = T.MANY_ROWS) -> DataFrame:
    """Add the time since the payer's latest arrival; hops are carried through the windows of their payers, arrivals bring only their time."""
    own = ("depth", "dst", "amount", "seq", "via")
    kept = [F.col(c) for c in own]
    nothing = [F.lit(None).cast(hops.schema[c].dataType).alias(c) for c in own]
    timed = hops.filter("ts is not null")
    legs = F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("out"), *kept), F.struct(F.col("dst").alias("node"), F.lit(0).alias("out"), *nothing)))
    seen = T.with_latest(timed.select(legs.alias("leg"), "ts").select("leg.*", "ts"), 2 * timed.count(), span, many)
    lag = (F.timestamp_diff("MICROSECOND", F.col("latest"), F.col("ts")) / 6e7).alias("lag_minutes")
    rest = hops.filter("ts is null").select("depth", "src", "dst", "amount", "ts", "seq", F.lit(None).cast("double").alias("lag_minutes"), "via")
    return seen.select("depth", F.col("node").alias("src"), "dst", "amount", "ts", "seq", lag, "via").unionByName(rest)


def paths(hops: DataFrame, top: int = 25) -> DataFrame:
    """``total, length, seqs``: the ``top`` routes by amount, then length, then seqs, that end where nothing follows.

    A hop's route is the route of the hop that reached its payer earliest (``via``), and the hop.
    """
    deepest = hops.agg(F.max("depth")).first()[0] or 0
    own = hops.select("depth", "seq", "via", F.abs("amount").cast("decimal(18,2)").alias("amount"))
    ends = own.join(own.select(F.col("via").alias("seq")).distinct(), "seq", "left_anti").select("seq")
    routes = every = None
    for depth in range(1, deepest + 1):
        here = own.filter(F.col("depth") == depth)
        if routes is None:
            routes = here.select("seq", F.col("amount").cast("decimal(38,2)").alias("total"), F.array("seq").alias("seqs"))
        else:
            before = routes.select(F.col("seq").alias("via"), F.col("total").alias("_total"), F.col("seqs").alias("_seqs"))
            routes = here.join(before, "via").select("seq", (F.col("_total") + F.col("amount")).cast("decimal(38,2)").alias("total"), F.concat("_seqs", F.array("seq")).alias("seqs"))
        routes = materialize(routes)
        every = routes if every is None else every.unionByName(routes)
    if every is None:
        return own.limit(0).select(F.lit(0.0).alias("total"), F.lit(0).alias("length"), F.array("seq").alias("seqs"))
    best = every.join(ends, "seq").select(F.col("total").cast("double").alias("total"), F.size("seqs").alias("length"), "seqs")
    return best.orderBy(F.col("total").desc(), F.col("length").desc(), "seqs").limit(top)


def layers(hops: DataFrame, origins: DataFrame) -> DataFrame:
    """``node, layer``: least depth at which money reaches a node; origins are layer 0."""
    every = hops.select(F.col("dst").alias("node"), F.col("depth").alias("layer")).unionByName(origins.select("node", F.lit(0).alias("layer")))
    return every.groupBy("node").agg(F.min("layer").alias("layer"))


def default_origins(flows: DataFrame) -> DataFrame:
    """The node with the largest net loss, for cases without a known victim."""
    return flows.withColumn("loss", F.col("out_amount") - F.col("in_amount")).orderBy(F.col("loss").desc(), "node").limit(1).select("node")


def traced_total(hops: DataFrame) -> DataFrame:
    """``total_traced`` counts money once per layer; ``from_origins`` only what left the origins."""
    cents = F.abs("amount").cast("decimal(18,2)")
    return hops.agg(F.sum(cents).cast("double").alias("total_traced"), F.sum(F.when(F.col("depth") == 1, cents)).cast("double").alias("from_origins"))
