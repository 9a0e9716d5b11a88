"""Mixing sources to target weights by Sainte-Laguë apportionment.

The budget of tokens is cut into equal blocks.  Blocks go to the sources by highest
quotients target / (2 n + 1), then, within each source, to its shards in the same way by
the shards' tokens.  In each shard documents stand in a seeded order; the shard's quota of
blocks is taken from that order, around it again where the quota exceeds the shard.  Only
DataFrame operations run; blocks are counted, never stored as rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.columns import fresh
from tracewell.storage import join_checked, join_groups, materialize, named_as, rows_of

WORD = "[^\\x20\\x09-\\x0D]+"
REACH = 3
RANGE = 256


def targets(sizes: DataFrame, weights: Sequence[int], reach: int = REACH) -> DataFrame:
    """``source, source_size, weight, target`` from ``source, source_size``, one row a source.

    Sources by code point, null last, get the weights in turn.  Targets share the total by
    weight and stop at ``reach`` times their source's size; what is above is shared again
    by weight among the rest.  That fixed point is found in one sorted pass: a source is
    full when the level of the rest, tokens a weight, passes its own ceiling.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    w = sizes.withColumn("weight", F.element_at(F.array(*(F.lit(int(x)) for x in weights)), (turn % len(weights) + 1).cast("int")).cast("long"))
    by_ceiling = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").isNull(), F.col("source").cast("binary"))
    every = Window.partitionBy()
    w = w.withColumn("_above", F.sum("weight").over(by_ceiling.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    w = w.withColumn("_filled", F.coalesce(F.sum(F.col("source_size") * reach).over(by_ceiling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = w.withColumn("_left", F.sum("source_size").over(every) - F.col("_filled"))
    full = F.col("_left") * F.col("weight") > F.col("source_size") * reach * F.col("_above")
    first_open = F.min(F.when(~full, F.struct((F.col("source_size") / F.col("weight")).alias("r"), F.col("_left").alias("left"), F.col("_above").alias("above")))).over(every)
    ceiling = (F.col("source_size") * reach).cast("double")
    share = F.col("_open.left") * F.col("weight") / F.col("_open.above")
    return w.withColumn("_open", first_open).select("source", "source_size", "weight", F.when(full | F.col("_open").isNull(), ceiling).otherwise(F.least(ceiling, share)).alias("target"))


def apportion(parts: DataFrame, group: list[str], votes: str, seats: str, out: str) -> DataFrame:
    """Sainte-Laguë: the ``seats`` of each group go to its parts by highest quotients of ``votes``.

    With s parts, n seats and a fair share q, a part gets between q (1 - d) - 1 and
    q (1 + d) + 1 seats, d = (s / 2 + 1) / n; so only the quotients in between, about two a part
    besides s in all, are ranked.  Ties go to the smaller ``_tie``.
    """
    g = Window.partitionBy(*group)
    q = F.col("_n") * (F.col(votes) / F.sum(votes).over(g))
    p = parts.filter(F.col(votes) > 0).withColumn("_n", F.col(seats).cast("long")).withColumn("_q", q).withColumn("_d", (F.count("*").over(g) / 2 + 1) / F.greatest(F.col("_n"), F.lit(1)))
    p = p.withColumn("_low", F.greatest(F.lit(0).cast("long"), F.floor(F.col("_q") * (1 - F.col("_d"))) - 1)).withColumn("_high", F.ceil(F.col("_q") * (1 + F.col("_d"))) + 1)
    p = p.withColumn("_open", F.col("_n") - F.sum("_low").over(g))
    c = p.withColumn("_seat", F.explode(F.sequence("_low", "_high")))
    ranked = c.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy((F.col(votes) / (2 * F.col("_seat") + 1)).desc(), "_tie", "_seat")))
    won = ranked.groupBy(*group, "_tie").agg((F.first("_low") + F.sum(F.when(F.col("_rank") <= F.col("_open"), 1).otherwise(0))).alias(out))
    return won


def _sized(docs: DataFrame, shards: int, seed: int) -> DataFrame:
    """``doc_id, source, size, _order, _head, _tie`` of each row: its place in the seeded order, the first 32 bits of that, and its shard."""
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = sized.withColumn("_order", _order("doc_id", seed)).withColumn("_head", _head(F.col("_order")))
    return materialize(sized.withColumn("_tie", F.col("_head") % shards))


def _order(doc_id: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))


def _head(order: Column) -> Column:
    return F.conv(F.substring(order, 1, 8), 16, 10).cast("long")


def _key() -> Column:
    return F.coalesce(F.hex(F.col("source").cast("string")), F.lit("~"))


def _takes(sized: DataFrame, weights: Sequence[int], block: int, reach: int) -> DataFrame:
    """``_source, _tie, shard_size, _take, source_size, target``: words that each shard of each source gives."""
    shard = materialize(sized.groupBy("source", "_tie").agg(F.sum("size").alias("shard_size")))
    goal = targets(shard.groupBy("source").agg(F.sum("shard_size").alias("source_size")), weights, reach)
    goal = materialize(goal.withColumn("_tie", F.coalesce(F.hex("source"), F.lit("~"))).withColumn("_all", F.lit(1)).withColumn("_seats", F.round(F.sum("target").over(Window.partitionBy()) / block)))
    seats = apportion(goal, ["_all"], "target", "_seats", "quota").withColumnRenamed("_tie", "_source").drop("_all")
    plan = goal.withColumnRenamed("_tie", "_source").drop("_all", "_seats").join(seats, "_source", "left").fillna(0, ["quota"])
    plan = materialize(plan.select("_source", "source_size", "target", "quota"))
    parts = join_checked(shard.withColumn("_source", _key()).drop("source"), named_as(plan, ["_source", "quota"]), "_source")
    per = apportion(parts, ["_source"], "shard_size", "quota", "shard_quota")
    parts = parts.drop("quota").join(per, ["_source", "_tie"], "left").select("_source", "_tie", "shard_size", F.least(F.coalesce("shard_quota", F.lit(0)) * block, F.col("shard_size") * reach).alias("_take"))
    return join_checked(parts, named_as(plan, ["_source", "source_size", "target"]), "_source")


def mix_plan(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), block: int = 8, shards: int = 1024, seed: int = 42, reach: int = REACH) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target and taken (words the mix takes, repeats counted).

    Size is the number of words (null text: 0).  A null source is a source of its own.
    No document is taken more than ``reach`` times.  Rows without words get taken 0; rows
    that agree in doc_id and source share one place in the seeded order, the longer text
    last; reruns agree.  Where all sources are empty, targets are 0; an empty table gives
    no rows; other columns are ignored.
    """
    sized = _sized(docs, shards, seed)
    parts = _takes(sized, weights, block, reach)
    w = Window.partitionBy("_source", "_tie").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.withColumn("_source", _key()).withColumn("_before", F.coalesce(F.sum("size").over(w), F.lit(0)))
    rows = rows.join(parts, ["_source", "_tie"])
    laps = F.floor(F.col("_take") / F.greatest(F.col("shard_size"), F.lit(1)))
    rest = F.col("_take") - laps * F.col("shard_size")
    taken = laps * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before")))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), block: int = 8, shards: int = 1024, seed: int = 42, reach: int = REACH) -> DataFrame:
    """The rows of the mix, with the columns of ``docs``: a document once for each time it is taken.

    A source gives as many words as ``mix_plan`` takes of it, but in one seeded order of the
    whole source, around it again where they exceed it, so all documents are whole but the
    last of each source, of which the first words are taken.  The order is cut into ranges
    of about ``RANGE`` documents; sums of words tell which ranges are in, and only the range
    in which a source ends is sorted.  Rows that agree in doc_id and source follow each
    other by size and text.  Null and empty texts never appear; ties follow doc_id; an empty
    table gives an empty table; other columns are kept, whatever their names.
    """
    sized = _sized(docs, shards, seed)
    give = _takes(sized, weights, block, reach).groupBy("_source").agg(F.sum("_take").alias("_words"))
    per = sized.groupBy(_key().alias("_source")).agg(F.ceil(F.count("*") / RANGE).alias("_ranges"), F.sum("size").alias("_size"), F.count("*").alias("_count")).join(give, "_source")
    laps = F.floor(F.col("_words") / F.greatest("_size", F.lit(1)))
    per = materialize(per.select("_source", "_ranges", "_count", laps.alias("_laps"), (F.col("_words") - laps * F.col("_size")).alias("_rest")))
    ranges = join_groups(sized.withColumn("_source", _key()), per, "_source", "_count", rows_of(sized)).groupBy("_source", _range(F.col("_head"), F.col("_ranges")).alias("_range")).agg(F.sum("size").alias("_size"), F.first("_laps").alias("_laps"), F.first("_rest").alias("_rest"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.withColumn("_left", F.col("_rest") - before).withColumn("_more", F.when(F.col("_left") >= F.col("_size"), 1).when(F.col("_left") <= 0, 0))

    source, count, many, at, times, more, left, order, size, last, lap = fresh(docs, "_source", "_ranges", "_count", "_range", "_laps", "_more", "_left", "_order", "_size", "_last", "_lap")
    ranges = materialize(ranges.select(F.col("_source").alias(source), F.col("_range").alias(at), F.col("_laps").alias(times), F.col("_more").alias(more), F.col("_left").alias(left)))
    text = F.col("text").cast("string")
    sources = named_as(per, [F.col("_source").alias(source), F.col("_ranges").alias(count), F.col("_count").alias(many)])
    rows = join_groups(docs.withColumn(source, _key()).withColumn(order, _order("doc_id", seed)), sources, source, many, rows_of(sized))
    rows = join_checked(rows.withColumn(at, _range(_head(F.col(order)), F.col(count))), ranges, [source, at])

    def repeated(frame: DataFrame, n: Column) -> DataFrame:
        return frame.filter(n > 0).withColumn(lap, F.explode(F.sequence(F.lit(1).cast("long"), n)))

    whole = repeated(rows.filter(F.col(more).isNotNull() & text.rlike(WORD)), F.col(times) + F.col(more))
    ends = rows.filter(F.col(more).isNull()).withColumn(size, F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")).filter(F.col(size) > 0)
    w = Window.partitionBy(source).orderBy(order, "doc_id", size, text).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn(last, F.greatest(F.lit(0), F.least(F.col(size), F.col(left) - F.coalesce(F.sum(size).over(w), F.lit(0)))))
    ends = repeated(ends, F.col(times) + (F.col(last) > 0).cast("long"))
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit("[\\x20\\x09-\\x0D]*" + WORD), F.lit(0)), F.lit(1), F.col(last).cast("int")), "")
    ends = ends.withColumn("text", F.when((F.col(lap) > F.col(times)) & (F.col(last) < F.col(size)), cut).otherwise(F.col("text")))
    return whole.select(*docs.columns).unionByName(ends.select(*docs.columns))


def _range(head: Column, ranges: Column) -> Column:
    return F.shiftright(head * ranges, 32)
