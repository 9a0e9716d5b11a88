"""URL filters: rules, and beyond them the ratio of two character language models.

Variable-order Markov models of accepted and of rejected URLs (contexts of five characters
down to none, each smoothed by the shorter) give every character a log-likelihood ratio.
A URL's ratio is divided by its length and compared with a threshold that is calibrated on
URLs left out of training.  Characters are those of the url, with A-Z lower-cased up to the
end of the host.  Counts and ratios stay in tables keyed by gram, which grow with the
corpus; urls are scored by joining their grams.  Everything on the executors is DataFrame
functions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.columns import bound
from tracewell.storage import BROADCAST_BYTES, bytes_of, join_checked, join_groups, materialize

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
ORDER = 5
START = "\x02"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
VERDICTS = ("allow", "block")
_BINS = 2000


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where the url is null or has no ``://``."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, u.substr(at + 3, F.length(u))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, UPPER.lower()), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """``struct(verdict, rule)`` of the longest rule that fits, else null."""
    found = F.lit(None)
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def grams(url: Column) -> Column:
    """Each character of the url with the ``ORDER`` before it; before the first stand marks of the beginning."""
    front = F.regexp_extract(url, "^([^/?#]*://)?[^/?#]*", 0)
    known = F.concat(F.lit(START * ORDER), F.translate(front, UPPER, UPPER.lower()), url.substr(F.length(front) + 1, F.length(url)))

    def each(c):
        return F.transform(F.sequence(F.lit(1), F.size(c) - ORDER), lambda i: F.array_join(F.slice(c, i, F.lit(ORDER + 1)), ""))

    return F.when(F.length(url) > 0, bound(F.filter(F.split(known, ""), lambda c: c != ""), each)).otherwise(F.array().cast("array<string>"))


def gram_counts(rows: DataFrame) -> DataFrame:
    """``gram, n, allow, block`` from ``url, verdict``: how often each gram stands in all urls, and in those of each verdict that are trained on."""
    each = rows.select(F.when(~_held_out(), F.col("verdict")).alias("verdict"), F.explode(grams(F.col("url"))).alias("gram"))
    return materialize(each.groupBy("gram").agg(F.count("*").alias("n"), *(F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS)))


def _held_out() -> Column:
    return F.pmod(F.xxhash64("url"), F.lit(5)) == 0


def ratios(counts: DataFrame) -> DataFrame:
    """``gram, n, ratio``: log-likelihood ratio of each gram in thousandths, by Witten and Bell's mixture of all orders up to ``ORDER``."""
    sizes = [counts]
    for k in range(ORDER - 1, -1, -1):
        sizes.append(materialize(sizes[-1].groupBy(F.right("gram", F.lit(k + 1)).alias("gram")).agg(*(F.sum(c).alias(c) for c in ("n", *VERDICTS)))))
    below = None
    for k, level in enumerate(reversed(sizes)):
        if below is None:
            total = level.agg(F.count("*").alias("_kinds"), *(F.sum(v).alias(f"_{v}") for v in VERDICTS))
            p = level.crossJoin(F.broadcast(total))
            p = p.select("gram", "n", *((F.col(v) + 0.5) / (F.col(f"_{v}") + 0.5 * (F.col("_kinds") + 1)) for v in VERDICTS))
        else:
            context = F.left("gram", F.lit(k))
            sums = materialize(level.groupBy(context.alias("_context")).agg(*(F.sum(v).alias(f"_{v}") for v in VERDICTS), *(F.count_if(F.col(v) > 0).alias(f"_{v}_kinds") for v in VERDICTS)))
            p = join_checked(level.withColumn("_context", context), sums, "_context")
            shorter = materialize(below.select(F.col("gram").alias("_shorter"), *(F.col(v).alias(f"_p_{v}") for v in VERDICTS)))
            p = join_checked(p.withColumn("_shorter", F.right("gram", F.lit(k))), shorter, "_shorter")
            p = p.select("gram", "n", *((F.col(v) + (F.col(f"_{v}_kinds") + 1) * F.col(f"_p_{v}")) / (F.col(f"_{v}") + F.col(f"_{v}_kinds") + 1) for v in VERDICTS))
        below = p.toDF("gram", "n", *VERDICTS)
    ratio = F.round(1000 * F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.log("allow") - F.log("block")))).cast("long")
    return materialize(below.select("gram", "n", ratio.alias("ratio")))


def scored(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``uid, score`` of each of ``uid, url`` that has characters: the sum of its grams' ratios over their number.

    The table is broadcast while it is small; beyond that only grams with over a thousandth of all are.
    """
    each = rows.select("uid", F.explode(grams(F.col("url"))).alias("gram"))
    if bytes_of(table) <= BROADCAST_BYTES:
        known = each.join(F.broadcast(table), "gram")
    else:
        known = join_groups(each, table, "gram", "n", table.agg(F.sum("n")).first()[0])
    return known.groupBy("uid").agg((F.sum("ratio") / 1000.0 / F.count("*")).alias("score"))


def threshold(judged: DataFrame) -> float:
    """The score that parts ``verdict, score`` best; 0 without both verdicts."""
    bins = F.greatest(F.lit(-_BINS), F.least(F.lit(_BINS), F.floor(F.col("score") * 100))).cast("int")
    found = judged.groupBy("verdict", bins.alias("bin")).count().toArrow()
    hits = {v: np.zeros(2 * _BINS + 1) for v in VERDICTS}
    for v, b, n in zip(*(found.column(i).to_pylist() for i in range(3)), strict=True):
        hits[v][b + _BINS] = n
    if not all(h.any() for h in hits.values()):
        return 0.0
    right = np.cumsum(hits["block"]) / hits["block"].sum() - np.cumsum(hits["allow"]) / hits["allow"].sum()
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return (int(best[len(best) // 2]) - _BINS + 1) / 100


def url_filter(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` per row of ``pages``.

    A verdict is the rule's where one fits, else block when the score is below the calibrated
    threshold, else allow.  Null and empty urls score 0.  Equal urls get equal verdicts;
    an empty table gives no rows; other columns are ignored.
    """
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    rows = materialize(rows.withColumn("uid", F.monotonically_increasing_id()).withColumn("verdict", F.col("_rule.verdict")))
    counts = gram_counts(rows)
    seen = counts.agg(*(F.coalesce(F.sum(v), F.lit(0)) for v in VERDICTS)).first()
    if all(seen):
        values = materialize(scored(rows, ratios(counts)))
        limit = threshold(rows.filter(F.col("verdict").isNotNull() & _held_out()).join(values, "uid").select("verdict", "score"))
    else:
        values, limit = rows.limit(0).select("uid", F.lit(0.0).alias("score")), 0.0
    rows = rows.join(values, "uid", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    own = F.when(F.col("score") < limit, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("verdict", own).alias("verdict"), "score")
