"""Exact dedup: a two-pass Bloom filter finds the hashes that may repeat.

Pass one hashes each normalised text and counts, in filters whose counts stop at two,
the cells of its hash.  Pass two tests each hash: a row whose cells were not all hit twice
is unique for certain and passes straight through; only the others are shuffled, by their
SHA-256, and grouped.  False positives cost a shuffled row, never a wrong result.  Filters are
sharded by hash, as many shards as the rows need; rows lie in a folder for each shard, and
shards are tested one after the other, so what is broadcast at once has a fixed bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm import bloom
from tracewell.storage import discard, join_groups, materialize, materialize_all

SPACES = "[\\x20\\x09-\\x0D]"
_ID, _SIZE, _SHA = "doc_id", "_chars", "text_sha256"


def hashed(docs: DataFrame) -> DataFrame:
    """Doc_id, code points of the text and SHA-256 of its normalised form; null counts as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").alias(_ID), F.length(text).cast("long").alias(_SIZE), F.sha2(F.regexp_replace(text, SPACES, "").cast("binary"), 256).alias(_SHA))


def possibly_repeated(rows: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """``rows`` (with a 64-bit ``_key``) and whether the filter holds each."""
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)

    def test(batches):
        for b in batches:
            keys = b.column("_key").to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bloom.contains(shared.value, keys))], names=[*b.schema.names, "_maybe"])

    return rows.mapInArrow(test, T.StructType([*rows.schema.fields, T.StructField("_maybe", T.BooleanType())]))


def _tested(rows: DataFrame, shards: int, bits: int) -> DataFrame:
    """``rows`` and ``_maybe``, shard by shard."""
    dealt = materialize(rows.withColumn("_shard", F.pmod(F.xxhash64("_key"), F.lit(shards)).cast("int")), "_shard")
    bitmaps = bloom.repeated(dealt, bits)
    out = materialize_all(possibly_repeated(dealt.filter(F.col("_shard") == s), bloom.fetch(bitmaps, s, bits)) for s in range(shards))
    discard(dealt)
    discard(bitmaps)
    return out


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without white space.  The row with the most
    code points in its original text stays, then the smallest doc_id (null after all
    others).  Null and empty texts, and texts of white space only, are one group.  Rows
    that agree in doc_id, length and normalised text all count as kept when they are those
    that stay.  An empty table gives no rows; other columns are ignored, whatever
    their names.
    """
    total = docs.count()
    tested = _tested(hashed(docs).withColumn("_key", F.xxhash64(_SHA)), *bloom.size_for(total))
    alone = tested.filter("not _maybe").select(_ID, F.col(_ID).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), _SHA)
    maybe = tested.filter("_maybe").select(_ID, _SIZE, _SHA)
    best = F.min(F.struct((-F.col(_SIZE)).alias("s"), F.col(_ID).isNull().alias("n"), F.col(_ID).alias("i")))
    groups = materialize(maybe.groupBy(_SHA).agg(best.alias("best"), F.count("*").alias("group_size")).select(_SHA, F.col("best.i").alias("keep_id"), (-F.col("best.s")).alias("_most"), "group_size"))
    joined = join_groups(maybe, groups, _SHA, "group_size", max(1, total))
    kept = F.col(_ID).eqNullSafe(F.col("keep_id")) & (F.col(_SIZE) == F.col("_most"))
    return alone.unionByName(joined.select(_ID, "keep_id", "group_size", kept.alias("kept"), _SHA))
