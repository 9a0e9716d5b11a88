"""Line dedup: repeated runs of lines from the order of suffixes, by distributed prefix doubling.

Every line with words has a 128-bit ID, and the corpus is the sequence of the IDs of its
documents in order of doc_id, each ended by a gap.  Prefix doubling ranks the blocks of 1, 2, 4, ... lines
that stand in more than one place: the pairs of ranks of a block's halves are sorted and
numbered over the whole corpus, so ranks are exact, follow the order of the suffixes, and equal
ones are an LCP interval, all suffixes that agree in that many lines.  Places whose block
stands nowhere else drop out of the next round.

Only intervals of suffixes that agree in ``min_words`` words matter, so log2 ``min_words``
rounds are enough.  How many lines these words take is told by the lines themselves; the interval of the
suffixes that agree in m lines is that of the ranks of the two blocks of 2 ** j lines which cover them.  The same
is done for the shortest runs up to a line.  Where runs overlap they add up to the maximal
repeated runs, and all copies but the first are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.columns import fresh
from tracewell.llm.words import pieces
from tracewell.storage import discard, join_checked, join_groups, materialize, named_as, rows_of

MIN_WORDS = 50
REACH = 12


def line_ids(text: bytes) -> tuple[list[int], list[int]]:
    """ID and number of words of each line with words; white space within a line doesn't matter."""
    ids, words = [], []
    for line in text.split(b"\n"):
        w = line.split()
        if w:
            ids.append(xxhash.xxh3_128_intdigest(b" ".join(w)))
            words.append(len(w))
    return ids, words


def minimal_runs(words: np.ndarray, first: np.ndarray, past: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The shortest runs with ``least`` words from each line on and up to each line, inside stretches from ``first`` to ``past``."""
    total = np.concatenate([[0], np.cumsum(words)])
    at = np.arange(len(words))
    stop = np.searchsorted(total, total[:-1] + least)
    ok = stop <= past
    start = np.searchsorted(total, total[1:] - least, "right") - 1
    back = (start >= first) & (total[1:] >= least)
    runs = np.unique(np.stack([np.concatenate([at[ok], start[back]]), np.concatenate([stop[ok], at[back] + 1])], 1), axis=0)
    return runs[:, 0], runs[:, 1]


def _lines(docs: DataFrame) -> DataFrame:
    """``doc_id, uid, line, words, high, low`` of each line with words; lines are counted from 0."""
    names = ["doc_id", "uid", "line", "words", "high", "low"]

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                ids, words, owner, line = [], [], [], []
                for i, t in enumerate(part.column(2)):
                    a, b = line_ids(t.as_buffer().to_pybytes() if t.is_valid else b"")
                    ids += a
                    words += b
                    owner += [i] * len(a)
                    line += range(len(a))
                d = pa.array(owner, pa.int64())
                halves = [pa.array(np.array([(x >> s) & 0xFFFFFFFFFFFFFFFF for x in ids], np.uint64).view(np.int64)) for s in (64, 0)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(d), part.column(1).take(d), pa.array(line, pa.int64()), pa.array(words, pa.int64()), *halves], names=names)

    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def numbered(rows: DataFrame, order: list, out: str, step: str | None = None) -> DataFrame:
    """``rows`` with ``out``: how many rows come before in the order, or the sum of their ``step``; ranges are numbered apart, then shifted."""
    names = rows.columns
    size = names.index(step) if step else None

    def run(batches):
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            by = batch.column(size).to_numpy() if step else np.ones(batch.num_rows, np.int64)
            at = done + np.cumsum(by) - by
            done += int(by.sum())
            ends = np.full(batch.num_rows, done, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int64)), pa.array(at), pa.array(ends)], names=[*names, "_part", out, "_end"])

    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, T.LongType()) for c in ("_part", out, "_end"))])
    local = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = local.groupBy("_part").agg(F.max("_end").alias("_size")).select("_part", before.alias("_before"))  # one row a partition
    return local.join(F.broadcast(shift), "_part").select(*names, (F.col(out) + F.col("_before")).alias(out))


def _grouped(batches, width: int) -> Iterator[list[np.ndarray]]:
    """Columns of the rows of each bucket, the first column, in turn."""
    rest = None
    for batch in batches:
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)]
        rest = now if rest is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
        cuts = (np.flatnonzero(np.diff(rest[0])) + 1).tolist()
        for lo, hi in zip([0, *cuts[:-1]], cuts, strict=False):
            yield [x[lo:hi] for x in rest]
        if cuts:
            rest = [x[cuts[-1] :] for x in rest]
    if rest is not None and len(rest[0]):
        yield rest


def _dealt(rows: DataFrame, overlap: int, *columns: str) -> DataFrame:
    """Rows by ranges of 2 ** ``REACH`` places, and those at the beginning of a range at the end of the one before too."""
    mine = F.shiftright("place", REACH)
    both = F.when(F.col("place") - F.shiftleft(mine, REACH) < overlap, F.array(mine, mine - 1)).otherwise(F.array(mine))
    return rows.select(F.explode(both).alias("bucket"), "place", *columns)


def _runs(active: DataFrame, least: int) -> DataFrame:
    """``place, lines, uid, line, level`` of the minimal runs in unbroken stretches of places; a run of ``lines`` is covered by two blocks of 2 ** ``level``."""
    names = ["place", "lines", "uid", "line", "level"]
    dealt = _dealt(active, least, "words", "uid", "line").repartition("bucket").sortWithinPartitions("bucket", "place")

    def run(batches):
        for bucket, place, words, uid, line in _grouped(batches, 5):
            cut = np.concatenate([[0], np.flatnonzero(np.diff(place) != 1) + 1, [len(place)]])
            size = np.diff(cut)
            a, b = minimal_runs(words, np.repeat(cut[:-1], size), np.repeat(cut[1:], size), least)
            own = place[a] >> REACH == bucket[a]
            a, m = a[own], (b - a)[own]
            level = np.floor(np.log2(m + 0.5)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (place[a], m, uid[a], line[a], level)], names=names)

    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _paired(active: DataFrame, runs: DataFrame, level: int) -> DataFrame:
    """Ranks of two blocks of 2 ** ``level`` lines each: of halves of the block at each place (``lines`` is null), and of those that cover a run."""
    h = 1 << level
    names = ["place", "lines", "uid", "line", "left", "right"]
    none = [F.lit(0).cast("long").alias(c) for c in ("lines", "uid", "line")]
    both = _dealt(active, h + 1, "rank").select("bucket", "place", "rank", *none).unionByName(runs.select(F.shiftright("place", REACH).alias("bucket"), "place", F.lit(-1).cast("long").alias("rank"), "lines", "uid", "line"))
    dealt = both.repartition("bucket").sortWithinPartitions("bucket", "place")

    def run(batches):
        for bucket, place, rank, lines, uid, line in _grouped(batches, 6):
            known = rank >= 0
            at, ranks = place[known], rank[known]

            def look(p, at=at, ranks=ranks):
                i = np.minimum(np.searchsorted(at, p), max(len(at) - 1, 0))
                return np.where(at[i] == p, ranks[i], -1) if len(at) else np.full(len(p), -1)

            own = known & (place >> REACH == bucket)
            left = np.where(own, rank, look(place))
            right = look(place + np.where(own, h, lines - h))
            ok = (own | ~known) & (left >= 0) & (right >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (place[ok], lines[ok], uid[ok], line[ok], left[ok], right[ok])], names=names)

    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def suffix_ranks(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``place, rank, words, uid, line`` of the lines that stand in several places, in order of IDs, and ``doc_id, uid, start`` of their documents."""
    ids = ["high", "low"]
    groups = materialize(numbered(lines.groupBy(*ids).agg(F.count("*").alias("n")).filter("n > 1"), ids, "rank"))
    again = materialize(join_groups(lines, groups, ids, "n", rows_of(lines)).select("doc_id", "uid", "line", "words", "rank").distinct())
    sizes = again.groupBy("doc_id", "uid").agg((F.max("line") + 2).alias("size"))  # a gap after each document
    docs = materialize(numbered(sizes, [F.col("doc_id").isNull(), "doc_id", "uid"], "start", "size"))
    placed = join_checked(again.drop("doc_id"), named_as(docs, ["uid", "start"]), "uid")
    return materialize(placed.select((F.col("start") + F.col("line")).alias("place"), "rank", "words", "uid", "line")), docs


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``uid, cuts``: for each document with later copies, the runs of lines to delete.

    ``docs`` has doc_id, uid and text.  The first copy is that with the smallest doc_id (null
    last), then uid, then place.  Copies may lie in one document and overlap.  ``min_words`` may be 2 ** ``REACH`` at most.
    """
    if min_words > 1 << REACH:
        raise ValueError(f"min_words is above {1 << REACH}")
    lines = materialize(_lines(docs.select("doc_id", "uid", "text")))
    active, _ = suffix_ranks(lines)
    discard(lines)
    runs = materialize(_runs(active, min_words))
    most = runs.agg(F.max("level")).first()[0]
    cuts = None
    for level in range(0 if most is None else most + 1):
        mine = runs.filter(F.col("level") == level).select("place", "lines", "uid", "line")
        pairs = materialize(_paired(active.select("place", "rank"), mine, level))
        found = pairs.filter("lines > 0")
        same = ["left", "right", "lines"]
        intervals = materialize(found.groupBy(*same).agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1"))
        later = join_groups(found, intervals, same, "n", rows_of(pairs)).filter("place <> first")
        later = later.select("uid", F.struct(F.col("line").alias("first"), (F.col("line") + F.col("lines")).alias("past")).alias("cut"))
        cuts = later if cuts is None else cuts.unionByName(later)
        if level < most:
            halves = pairs.filter("lines = 0").select("place", "left", "right")
            groups = materialize(numbered(halves.groupBy("left", "right").agg(F.count("*").alias("n")).filter("n > 1"), ["left", "right"], "rank"))
            discard(active)
            active = materialize(join_groups(halves, groups, ["left", "right"], "n", rows_of(pairs)).select("place", "rank"))
    if cuts is None:
        return docs.select("uid", F.array(F.struct(F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("past"))).alias("cuts")).limit(0)
    return cuts.groupBy("uid").agg(F.collect_set("cut").alias("cuts"))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of repeated runs deleted from text; see ``dedup_lines``."""
    return dedup_lines(docs, min_words, *fresh(docs, "_lines", "_removed")).select(*docs.columns)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, lines: str = "_lines", removed: str = "_removed") -> DataFrame:
    """``docs`` with later copies of repeated runs deleted from text, besides columns ``lines`` and ``removed`` (lines with words before, and deleted).

    A run is deleted where it has at least ``min_words`` words and an equal run stands in an
    earlier document, or earlier in this one; lines are equal when their words are.  Rows
    with equal doc_id and text are one document: they aren't copies of each other.  Null
    texts stay null; a text deleted whole becomes empty; a text without repeats stays as it
    is, byte for byte.  Other columns are kept, whatever their names; an empty table gives
    an empty table.
    """
    uid, cut = fresh(docs, "_uid", "_cuts")
    keyed = docs.withColumn(uid, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    cuts = materialize(repeated_runs(keyed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(uid).alias("uid"), F.col("text").cast("string").alias("text")), min_words).withColumnsRenamed({"uid": uid, "cuts": cut}))
    joined = join_checked(keyed, cuts, uid, "left").select(*docs.columns, cut)
    names, place = docs.columns, docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(lines, T.LongType()), T.StructField(removed, T.LongType())])

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                texts, before, gone_ = [], [], []
                for t, cut in zip(part.column(place), part.column(part.num_columns - 1), strict=True):
                    raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                    kept, n, gone = cut_lines(raw, [(c["first"], c["past"]) for c in cut.as_py()] if cut.is_valid else [])
                    texts.append(kept if t.is_valid else None)
                    before.append(n)
                    gone_.append(gone)
                columns = list(part.columns[:-1])
                columns[place] = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(before, pa.int64()), pa.array(gone_, pa.int64())], names=[*names, lines, removed])

    return joined.mapInArrow(run, schema)


def cut_lines(text: bytes, cuts: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The text without the runs, its lines with words, and how many of them went."""
    lines = text.split(b"\n")
    full = [i for i, line in enumerate(lines) if not line.isspace() and line]
    if not cuts:
        return text, len(full), 0
    gone = {full[k] for a, b in cuts for k in range(a, b)}
    if len(gone) == len(full):
        return b"", len(full), len(full)
    return b"\n".join(line for i, line in enumerate(lines) if i not in gone), len(full), len(gone)


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, text, n_lines, n_removed`` per row of ``docs``; see ``dedup_lines``."""
    out = dedup_lines(docs.select("doc_id", "text"), min_words)
    return out.select("doc_id", "text", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"))
