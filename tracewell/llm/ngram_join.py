"""N-gram Jaccard join: a blocked product of the sparse document by n-gram matrix.

Rows of the matrix are classes of documents with equal shingle sets.  Two rows with
Jaccard p / q or more share one of the first n - ceil(n p / q) + 1 shingles of either, in any one
order of all shingles.  The order here is that of the shingles' hashes, but with the heaviest ones last:
those are counted over all documents, among the first shingles by hash alone.  Rows that share such a
column become candidates when their sizes, the number of columns shared and the distance
of their signatures (512 parity bits, which differ in no more places than the sets do)
allow the bound.  Overlaps of candidates are then accumulated over whole rows as products of
blocks.  A row's set travels once to each block that it is in, and of a block only the
edges of a spanning forest leave the task.

Columns with many rows aren't paired off.  Each row joins the block of one such column, its
widest, together with some pivots of that column, which tie the blocks of a group of near copies
together.  Where a column's rows still belong to several components, those outside the largest meet
the other rows by signatures, and blocks of those that may link are verified.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.columns import fresh
from tracewell.llm.words import mix, pieces, shingles
from tracewell.operators.components import connected_components
from tracewell.storage import discard, join_checked, join_groups, materialize, named_as, rows_of

HEAVY = 1 << 18
SMALL = 64
BLOCK = 128
BLOCK_SHINGLES = 1 << 19
PIVOTS = 8
WIDE = 2048
COLUMNS = 4096
WORDS = 8
_SIGNATURE = [f"s{i}" for i in range(WORDS)]
_TABLE = 1 << 22


def class_ids(sh: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set; equal sets have equal ids."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(sh ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)])
    return mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def signatures(sh: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Parity bits of each set: each shingle flips one of 64 * ``WORDS``."""
    place = mix(sh ^ np.uint64(0x3C6EF372FE94F82B))
    bit = np.uint64(1) << (place & np.uint64(63))
    word = (place >> np.uint64(6)) % np.uint64(WORDS)
    out = []
    for i in range(WORDS):
        flips = np.concatenate([[np.uint64(0)], np.bitwise_xor.accumulate(np.where(word == i, bit, np.uint64(0)))]) if len(sh) else np.zeros(1, np.uint64)
        out.append((flips[at[1:]] ^ flips[at[:-1]]).view(np.int64))
    return out


def prefix_lengths(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """n - ceil(n num / den) + 1"""
    return n + (-num * n // den) + 1


def _sets(batches, k: int):
    for batch in batches:
        for part in pieces(batch, "text"):
            sh, at = shingles(part.column(part.schema.get_field_index("text")), k)
            yield part, sh, at, class_ids(sh, at)


def _first_of(seen: set[int], cid: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which sets are not empty and new to the task."""
    new = np.zeros(len(n), bool)
    for i, c in enumerate(cid.tolist()):
        if n[i] and c not in seen:
            seen.add(c)
            new[i] = True
    return new


def _rows(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``doc_id, uid, n, cid`` and signature per document, and ``key, hits``: classes of a batch by their first shingles in order of hash."""
    names = ["doc_id", "uid", "n", "cid", *_SIGNATURE, "key", "hits"]

    def run(batches):
        seen: set[int] = set()
        for part, sh, at, cid in _sets(batches, k):
            n = np.diff(at)
            none = pa.nulls(len(cid), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(cid), *map(pa.array, signatures(sh, at)), none, none], names=names)
            own = np.repeat(np.arange(len(n)), n)
            first = _first_of(seen, cid, n)[own] & (np.arange(len(sh)) - at[:-1][own] < prefix_lengths(n, num, den)[own])
            keys, hits = np.unique(sh[first], return_counts=True)
            none = pa.nulls(len(keys), pa.int64())
            yield pa.RecordBatch.from_arrays([none] * (4 + WORDS) + [pa.array(keys.view(np.int64)), pa.array(hits)], names=names)

    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _heaviest(rows: DataFrame) -> np.ndarray:
    """The keys with most hits, ``HEAVY`` at most: those above the least power of two, ``SMALL`` or more, that leaves no more."""
    counted = materialize(rows.filter("key is not null").groupBy("key").agg(F.sum("hits").alias("hits")).filter(F.col("hits") > SMALL))
    level = F.floor(F.log2(F.col("hits") - 0.5)).cast("int")  # hits > 2 ** level
    found = {r[0]: r[1] for r in counted.groupBy(level).count().collect()}
    least, total = 64, 0
    for at in sorted(found, reverse=True):
        total += found[at]
        if total > HEAVY:
            break
        least = at
    keys = counted.filter(level >= least).select("key").toArrow().column("key").to_numpy()
    discard(counted)
    return np.sort(keys.view(np.uint64))


def _prefixes(docs: DataFrame, k: int, num: int, den: int, heavy: np.ndarray) -> DataFrame:
    """``key, cid, n``: the first shingles of each class, as many as the bound asks for."""
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches):
        late = shared.value
        table = np.zeros(_TABLE, bool)
        table[(late & np.uint64(_TABLE - 1)).astype(np.int64)] = True
        seen: set[int] = set()
        for _, sh, at, cid in _sets(batches, k):
            n = np.diff(at)
            own = np.repeat(np.arange(len(n)), n)
            mine = _first_of(seen, cid, n)[own]
            sh, own = sh[mine], own[mine]
            last = table[(sh & np.uint64(_TABLE - 1)).astype(np.int64)]
            maybe = np.flatnonzero(last)
            last[maybe] = np.isin(sh[maybe], late)
            order = np.lexsort((last, own))  # within a class and weight, hashes stay ascending
            sh, own = sh[order], own[order]
            first = np.searchsorted(own, np.arange(len(n)))
            kept = np.arange(len(sh)) - first[own] < prefix_lengths(n, num, den)[own]
            sh, own = sh[kept], own[kept]
            yield pa.RecordBatch.from_arrays([pa.array(sh.view(np.int64)), pa.array(cid[own]), pa.array(n[own])], names=["key", "cid", "n"])

    return docs.mapInArrow(run, "key long, cid long, n long")


def _candidates(postings: DataFrame, num: int, den: int) -> DataFrame:
    """From postings in order of key, size and class.

    Kind 0: pairs a, b of shingles with few classes, how many such shingles they share, and how many
    they must share. Kind 1: members (a the key, b the class) of the shingles with many, by blocks,
    and each member's place.
    """
    names = ["kind", "a", "b", "block", "least"]

    def emit(kind, a, b, block, least):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(np.asarray(block, np.int64)), pa.array(np.asarray(least, np.int64))], names=names)

    def must_share(x, y):
        """Common prefix shingles without which the rest of neither row can reach the overlap that the bound asks for."""
        whole = -(-num * (x + y) // (num + den))
        beyond = -(-num * np.maximum(x, y) // den) - 1
        return np.maximum(1, whole - beyond)

    def run(batches):
        rest = [np.zeros(0, np.int64)] * 3
        hot, base, full = None, 0, 0.0
        for batch in _tail(batches):
            done = batch is None
            key, cid, n = rest if done else (np.concatenate([r, batch.column(i).to_numpy()]) for i, r in enumerate(rest))
            if not len(key):
                continue
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (cid[1:] != cid[:-1])
            key, cid, n = key[new], cid[new], n[new]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.concatenate([starts, [len(key)]]))
            cut = len(key) if done else int(starts[-1])  # the last group may go on
            out = []
            for g in np.flatnonzero((size > SMALL) | (key[starts] == hot if hot is not None else np.zeros(len(starts), bool))):
                lo, m = int(starts[g]), int(size[g])
                if key[lo] != hot:
                    hot, base, full = int(key[lo]), 0, 0.0
                if lo == cut:
                    m -= 1  # the last one stays, so that a copy of it in the next batch is seen
                    cut = lo + m
                filled = full + np.cumsum(np.maximum(1 / BLOCK, n[lo : lo + m] / BLOCK_SHINGLES))
                out.append(emit(1, key[lo : lo + m], cid[lo : lo + m], np.ceil(filled - 1e-9) - 1, base + np.arange(m)))
                base, full = base + m, float(filled[-1]) if m else full
                size[g] = 0
            whole = starts + size <= cut
            pairs = []
            for m in np.unique(size[whole & (size > 1)]).tolist():
                at = starts[whole & (size == m)]
                i, j = np.triu_indices(m, 1)
                i, j = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
                fits = n[i] * den >= n[j] * num
                i, j = i[fits], j[fits]
                pairs.append(np.stack([np.minimum(cid[i], cid[j]), np.maximum(cid[i], cid[j]), must_share(n[i], n[j])], 1))
            if pairs:
                p, shared = np.unique(np.concatenate(pairs), axis=0, return_counts=True)
                out.append(emit(0, p[:, 0].copy(), p[:, 1].copy(), shared, p[:, 2].copy()))
            rest = [key[cut:], cid[cut:], n[cut:]]
            yield from out

    return postings.mapInArrow(run, "kind int, a long, b long, block long, least long")


def _tail(batches) -> Iterator:
    yield from batches
    yield None


def overlaps(rows: list[np.ndarray]) -> np.ndarray:
    """Product of a block of the sparse matrix with itself: how many shingles each two rows share, accumulated over blocks of columns."""
    every = np.concatenate(rows)
    vocabulary, column, hits = np.unique(every, return_inverse=True, return_counts=True)
    used = hits > 1
    place = np.cumsum(used) - 1
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    keep = used[column]
    owner, column = owner[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(rows), len(rows)), np.float32)
    for lo in range(0, int(used.sum()), COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        part = np.zeros((len(rows), COLUMNS), np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        total += part @ part.T
    return total


def _forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[rx] = ry
            kept.append(i)
    return kept


def _block_links(text: DataFrame, reps: DataFrame, members: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Edges of a spanning forest of the links in each block of ``members`` (``task, cid``), all of which meet.

    Sets are made anew from the text of one document of each class.
    """
    of = materialize(members.join(reps.select("cid", "uid"), "cid").groupBy("uid", "cid").agg(F.collect_set("task").alias("tasks")))
    picked = join_checked(text.select("uid", "text"), of, "uid").select("cid", "tasks", "text")

    def sets(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                sh, at = shingles(part.column(2), k)
                rows = [sh[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, pa.binary())], names=["cid", "tasks", "sh"])

    full = picked.mapInArrow(sets, "cid long, tasks array<long>, sh binary")
    full = full.select(F.explode("tasks").alias("task"), "cid", "sh").repartition("task").sortWithinPartitions("task", "cid")

    def links(rows):
        cid, rows = np.array([r[0] for r in rows], np.int64), [r[1] for r in rows]
        n = np.array([len(r) for r in rows])
        inter = overlaps(rows).astype(np.int64)
        i, j = np.nonzero(np.triu(inter * (den + num) >= num * (n[:, None] + n[None]), 1))
        a, b = cid[i], cid[j]
        kept = _forest(a, b)
        return pa.RecordBatch.from_arrays([pa.array(a[kept], pa.int64()), pa.array(b[kept], pa.int64())], names=["src", "dst"])

    def run(batches):
        held, rows = None, []
        for batch in batches:
            task, cid = (batch.column(i).to_pylist() for i in range(2))
            for i in range(batch.num_rows):
                if task[i] != held and rows:
                    yield links(rows)
                    rows = []
                held = task[i]
                if not rows or rows[-1][0] != cid[i]:  # repeated rows of the table have one uid
                    rows.append((cid[i], np.frombuffer(batch.column(2)[i].as_py(), np.uint64)))
        if rows:
            yield links(rows)

    return full.mapInArrow(run, "src long, dst long")


def _may_link(num: int, den: int) -> Column:
    """Whether classes x and y with sizes ``x_n, y_n`` and signatures may have the similarity: sets differ in (n + m) (den - num) / (den + num) places at most."""
    apart = sum((F.bit_count(F.col(f"x_{s}").bitwiseXOR(F.col(f"y_{s}"))) for s in _SIGNATURE), F.lit(0))
    return apart * (den + num) <= (F.col("x_n") + F.col("y_n")) * (den - num)


def _joined(rows: DataFrame, column: str, reps: DataFrame, prefix: str = "") -> DataFrame:
    """``rows`` with size and signature of the class in ``column``."""
    return join_checked(rows, named_as(reps, [F.col("cid").alias(column), *(F.col(c).alias(f"{prefix}{c}") for c in ("n", *_SIGNATURE))]), column)


def _pair_tasks(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Blocks for the candidate pairs: a component of their graph is one block, or, where it is large, one for each two of its chunks that a pair joins."""
    labels = materialize(connected_components(pairs, "a", "b"))
    sizes = labels.join(reps.select(F.col("cid").alias("node"), "n"), "node").groupBy("component")
    sizes = materialize(sizes.agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("chunks"), F.count("*").alias("size")))
    of = join_groups(labels, sizes, "component", "size", rows_of(labels)).select("node", "component", "chunks")
    held = pairs.join(of.withColumnRenamed("node", "a"), "a")
    x, y = (F.pmod(F.xxhash64(F.col(c), F.lit(3)), F.col("chunks")) for c in "ab")
    task = F.xxhash64("component", F.least(x, y), F.greatest(x, y))
    return held.select(task.alias("task"), F.explode(F.array("a", "b")).alias("cid")).distinct()


def _hot_tasks(hot: DataFrame) -> DataFrame:
    """Blocks of shingles with many classes: each class in its widest shingle's, and the shingle's pivots in all of them."""
    sizes = materialize(hot.groupBy("key").agg(F.count("*").alias("m")))
    sized = materialize(join_groups(hot, sizes, "key", "m", rows_of(hot)))
    widest = sized.groupBy("cid").agg(F.max(F.struct("m", "key", "block")).alias("w")).select("cid", "w.key", "w.block", "w.m")
    own = materialize(widest.select("key", "block", "cid"))
    pivots = sized.filter(F.col("place") % F.ceil(F.col("m") / PIVOTS) == 0).select("key", "cid")
    blocks = own.select("key", "block").distinct()
    every = own.unionByName(blocks.join(pivots, "key").select("key", "block", "cid"))
    return every.select(F.xxhash64("key", "block", F.lit("hot")).alias("task"), "cid").distinct()


def _rest_tasks(hot: DataFrame, links: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """Blocks (``task, cid``) of shingles with classes in several components: the classes outside the largest with the others, as far as signatures allow a link between some of a block."""
    labels = materialize(connected_components(links).withColumnRenamed("node", "cid"))
    named = materialize(join_checked(hot.select("key", "cid"), labels, "cid", "left").select("key", "cid", F.coalesce("component", "cid").alias("label")))
    per = materialize(named.groupBy("key", "label").agg(F.count("*").alias("size")))
    keys = per.groupBy("key").agg(F.max_by("label", F.struct("size", "label")).alias("main"), F.max("size").alias("most"), F.sum("size").alias("m"), F.count("*").alias("labels"))
    keys = materialize(keys.filter("labels > 1").select("key", "main", "m", F.ceil(F.col("m") / WIDE).alias("blocks"), F.ceil((F.col("m") - F.col("most")) / WIDE).alias("parts")))
    open_ = join_groups(named, keys, "key", "m", rows_of(named))
    open_ = materialize(_joined(open_, "cid", reps))

    def dealt(rows, side, mine, others):
        at = F.pmod(F.xxhash64("cid", F.lit(side)), F.col(mine))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col(others) - 1))
        rows = rows.withColumn("_at", at).withColumn("_other", other)
        part, block = ("_at", "_other") if side == 0 else ("_other", "_at")
        return rows.select(F.xxhash64("key", part, block).alias("task"), F.lit(side).alias("side"), "cid", "label", "n", *_SIGNATURE)

    met = dealt(open_.filter("label <> main"), 0, "parts", "blocks").unionByName(dealt(open_, 1, "blocks", "parts"))
    met = met.repartition("task").sortWithinPartitions("task", "side", "cid")

    def near(rows):
        task, side, cid, label, n, *sig = rows
        sig = [s.view(np.uint64) for s in sig]  # of a negative number, numpy counts the bits of its absolute value
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        may = np.zeros((len(left), len(right)), bool)
        for k, i in enumerate(left.tolist()):
            apart = np.zeros(len(right), np.int64)
            for s in sig:
                apart += np.bitwise_count(s[right] ^ s[i])
            x, y = n[i], n[right]
            may[k] = (apart * (den + num) <= (x + y) * (den - num)) & (np.minimum(x, y) * den >= np.maximum(x, y) * num) & (label[right] != label[i])
        tasks, members = [], []
        left, right, may = left[may.any(1)], right[may.any(0)], may[may.any(1)][:, may.any(0)]
        for p, mine in enumerate(_chunks(n[left])):
            for q, others in enumerate(_chunks(n[right])):
                hit = may[np.ix_(mine, others)]
                both = np.unique(np.concatenate([cid[left[mine[hit.any(1)]]], cid[right[others[hit.any(0)]]]]))
                members.append(both)
                tasks.append(np.full(len(both), mix(np.uint64([int(task[0]) & 0xFFFFFFFFFFFFFFFF]) + np.uint64(p << 32) + np.uint64(q)).view(np.int64)[0]))
        none = np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *tasks])), pa.array(np.concatenate([none, *members]))], names=["task", "cid"])

    def run(batches):
        rest = None
        for batch in batches:
            now = [batch.column(i).to_numpy() for i in range(batch.num_columns)]
            rest = now if rest is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
            cuts = np.flatnonzero(np.diff(rest[0])) + 1
            for lo, hi in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=False):
                yield near([x[lo:hi] for x in rest])
            if len(cuts):
                rest = [x[cuts[-1] :] for x in rest]
        if rest is not None and len(rest[0]):
            yield near(rest)

    return met.mapInArrow(run, "task long, cid long")


def _chunks(n: np.ndarray) -> list[np.ndarray]:
    """Places in turn, cut where ``BLOCK`` classes or half of ``BLOCK_SHINGLES`` are full."""
    filled = np.cumsum(np.maximum(1 / BLOCK, 2 * n / BLOCK_SHINGLES))
    return np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.ceil(filled - 1e-9))) + 1) if len(n) else []


def _linked(docs: DataFrame, words: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, uid, n, cid`` per row, and links between classes."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("uid", F.xxhash64("doc_id", "text")).select("doc_id", "uid", "text")
    rows = materialize(_rows(text, words, num, den))
    every = rows.filter("n is not null").select("doc_id", "uid", "n", "cid")
    postings = _prefixes(text, words, num, den, _heaviest(rows)).repartition("key").sortWithinPartitions("key", "n", "cid")
    found = materialize(_candidates(postings, num, den))
    reps = materialize(rows.filter("n > 0").groupBy("cid").agg(F.min("uid").alias("uid"), *(F.max(c).alias(c) for c in ("n", *_SIGNATURE))))
    # a pair that shares a frequent shingle too is found with that shingle's blocks
    pairs = found.filter("kind = 0").groupBy("a", "b").agg(F.sum("block").alias("shared"), F.max("least").alias("least")).filter("shared >= least").select("a", "b")
    pairs = materialize(_joined(_joined(pairs, "a", reps, "x_"), "b", reps, "y_").filter(_may_link(num, den)).select("a", "b"))
    hot = materialize(found.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("cid"), "block", F.col("least").alias("place")))
    tasks = _pair_tasks(pairs, reps)
    many = rows_of(hot)
    if many:
        tasks = tasks.unionByName(_hot_tasks(hot))
    links = materialize(_block_links(text, reps, tasks, words, num, den).distinct())
    if many:
        rest = materialize(_rest_tasks(hot, links, reps, num, den))
        links = materialize(links.unionByName(_block_links(text, reps, rest, words, num, den)).distinct())
    for used in (found, pairs, hot):
        discard(used)
    return every, links


def _labelled(every: DataFrame, links: DataFrame) -> DataFrame:
    """Rows with words, and ``label``, the same for all rows of a component, and ``low``, its smallest doc_id."""
    labels = materialize(connected_components(links).withColumnRenamed("node", "cid"))
    classes = materialize(every.filter("n > 0").groupBy("cid").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies")))
    linked = materialize(join_checked(classes, labels, "cid"))
    lows = materialize(linked.groupBy("component").agg(F.min("low").alias("least"), F.count("*").alias("members")))
    least = materialize(join_groups(linked, lows, "component", "members", rows_of(linked)).select("cid", "component", "least"))
    named = join_checked(classes, least, "cid", "left")
    named = materialize(named.select("cid", F.coalesce("component", "cid").alias("label"), F.when(F.col("component").isNull(), F.col("low")).otherwise(F.col("least")).alias("low"), "copies"))
    return join_groups(every.filter("n > 0"), named, "cid", "copies", every.count())


def ngram_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row of ``docs``.

    A document's set: distinct ``words``-word shingles of the lower-cased (A-Z) text; with fewer
    words, the whole sequence as one; null texts and texts without words have none and
    link with nothing.  Documents link when den * intersection >= num * union; a component's
    id is its smallest doc_id.  Rows that agree in doc_id stay apart; a null doc_id is never
    smallest while another is there.  Sets are compared by 64-bit hashes of their shingles.
    An empty table gives no rows; other columns are ignored.
    """
    every, links = _linked(docs, words, num, den)
    full = _labelled(every, links).select("doc_id", F.col("n").alias("n_shingles"), F.col("low").alias("component_id"))
    return full.unionByName(every.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of ``docs`` for each component of ``ngram_components``, with its columns, whatever their names.

    The row with the smallest doc_id stays (null last; of rows that agree in doc_id that with the
    smallest hash of its text; of rows that agree in both, one).  Rows without words link with nothing and
    all stay.  An empty table gives an empty table.
    """
    every, links = _linked(docs, words, num, den)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "uid")
    best = _labelled(every, links).groupBy("label").agg(F.min(place).alias("best")).select(F.col("best.uid").alias("uid"))
    copies = every.filter("n > 0").groupBy("uid").agg(F.count("*").alias("copies"))
    uid, many, key = fresh(docs, "_uid", "_copies", "_key")
    stay = materialize(best.join(copies, "uid").unionByName(every.filter("n = 0").select("uid", F.lit(1).cast("long").alias("copies"))).distinct().withColumnsRenamed({"uid": uid, "copies": many}))
    keyed = docs.withColumn(uid, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    kept = join_checked(keyed, stay, uid)
    return kept.filter(F.col(many) == 1).select(*docs.columns).unionByName(kept.filter(F.col(many) > 1).dropDuplicates([uid]).select(*docs.columns))
