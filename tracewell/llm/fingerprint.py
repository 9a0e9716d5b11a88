"""Document fingerprints: invertible Bloom lookup tables of paragraph digests.

A text's paragraphs (lines, in runs of at most 32 words, the first run in runs of four) are
digested to 64 bits, and the distinct digests dealt to groups by their leading bits, about
``GROUP_UNITS`` to a group.  Each digest is added to three cells of its group's table: a count, the
exclusive or of the digests and that of their checks.  A table is retried larger until peeling
it alone gives back its digests, so a fingerprint, which is written out whole, is a function
of its text alone and holds all that likeness needs.

Two fingerprints are compared through their tables: groups that both have are brought to the same
size, subtracted cell by cell, so that what they share cancels, and peeled, larger again
on failure; the peeled digests are those that differ.  Everything is DataFrame functions on one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.columns import bound
from tracewell.storage import materialize

GROUP_CELLS = (12, 30, 96)
GROUP_UNITS = 4
ROUNDS = 8
BUCKET_ROWS = 5000
MAX_BUCKETS = 100_000
_WORD = "[^\\x20\\x09-\\x0D]++[\\x20\\x09\\x0B-\\x0D]*+"


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs; none without words."""
    return bound(F.regexp_extract_all(text, F.lit(f"(?:{_WORD}){{1,32}}+"), F.lit(0)), _of_runs)


def _of_runs(runs: Column) -> Column:
    head = F.regexp_extract_all(F.coalesce(F.get(runs, F.lit(0)), F.lit("")), F.lit(f"(?:{_WORD}){{1,4}}+"), F.lit(0))
    rest = F.when(F.size(runs) > 1, F.slice(runs, F.lit(2), F.greatest(F.size(runs) - 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.transform(F.concat(head, rest), lambda u: F.xxhash64(u)))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(-1)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def _placed(key: Column, sign: Column, cells: int) -> Column:
    """A digest with its sign, its check and its three cells, one in each third of the table."""
    third = cells // 3
    def place(r, bits):
        return (F.shiftrightunsigned(r, bits).bitwiseAND(F.lit(0xFFFF).cast("long")) % third).cast("int")

    return bound(F.xxhash64(key, F.lit(cells)), lambda r: F.struct(key.alias("k"), sign.cast("int").alias("s"), _check(key).alias("c"), place(r, 0).alias("h0"), place(r, 16).alias("h1"), place(r, 32).alias("h2")))


def _added(start: Column, placed: Column, i: int, j: Column, way: int = 1) -> Column:
    mine = F.filter(placed, lambda p: p[f"h{i}"] == j)
    return F.aggregate(mine, start, lambda a, p: F.struct((a["n"] + p["s"] * way).alias("n"), a["k"].bitwiseXOR(p["k"]).alias("k"), a["c"].bitwiseXOR(p["c"]).alias("c")))


def table(placed: Column, cells: int) -> Column:
    """The cells of digests that ``_placed`` has placed: count, digests and checks."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("c"))

    def part(units, i):
        return F.transform(F.sequence(F.lit(0), F.lit(cells // 3 - 1)), lambda j: _added(zero, units, i, j))

    return bound(placed, lambda units: F.concat(*(part(units, i) for i in range(3))))


def subtract(a: Column, b: Column) -> Column:
    """Cell by cell, what is in ``a`` and not in ``b``, and with negative counts the reverse."""
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["c"].bitwiseXOR(y["c"]).alias("c")))


def peel(cells: Column, size: int) -> Column:
    """The digests that a subtracted table holds, or null where it is too small to tell."""
    third = size // 3
    none = F.array().cast("array<bigint>")

    def after(state, placed):
        def part(i):
            return F.transform(F.slice(state["t"], i * third + 1, third), lambda c, j: _added(c, placed, i, j, -1))

        new = F.struct(F.concat(*map(part, range(3))).alias("t"), F.concat(state["f"], F.transform(placed, lambda p: p["k"])).alias("f"), F.lit(True).alias("go"))
        stuck = F.struct(state["t"].alias("t"), state["f"].alias("f"), F.lit(False).alias("go"))
        return F.when(F.size(placed) == 0, stuck).otherwise(new)

    def step(state, _):
        pure = F.filter(state["t"], lambda c: (F.abs(c["n"]) == 1) & (_check(c["k"]) == c["c"]))
        return F.when(~state["go"], state).otherwise(bound(F.array_distinct(F.transform(pure, lambda c: _placed(c["k"], c["n"], size))), lambda placed: after(state, placed)))

    start = F.struct(cells.alias("t"), none.alias("f"), F.lit(True).alias("go"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.when(F.forall(s["t"], lambda c: (c["n"] == 0) & (c["k"] == 0)), s["f"]))


def table_of(units: Column, size: int) -> Column:
    return table(F.transform(units, lambda u: _placed(u, F.lit(1), size)), size)


def bits_for(units: Column) -> Column:
    """log2 of the number of groups for so many digests."""
    return F.ceil(F.log2(F.greatest(F.size(units) / GROUP_UNITS, F.lit(1.0)))).cast("int")


def _leading(unit: Column, bits: Column) -> Column:
    return F.call_function("shiftrightunsigned", F.call_function("shiftrightunsigned", unit, F.lit(1)), F.lit(63) - bits)


def groups(units: Column, bits: Column) -> Column:
    """The digests by their leading bits, dealt in two steps so that work grows with units times the root of the groups."""

    def many(k):
        return F.sequence(F.lit(0).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1)

    def split(s):
        low = F.call_function("shiftleft", F.lit(1).cast("long"), s["k"] - s["half"]) - 1

        def fine(mine):
            return F.transform(many(s["k"] - s["half"]), lambda f: F.filter(mine, lambda u: _leading(u, s["k"]).bitwiseAND(low) == f))

        return F.flatten(F.transform(many(s["half"]), lambda c: bound(F.filter(s["u"], lambda u: _leading(u, s["half"]) == c), fine)))

    return bound(F.struct(units.alias("u"), bits.alias("k"), F.floor(bits / 2).cast("int").alias("half")), split)


def published(units: Column) -> Column:
    """The fingerprint of digests as text, and the digests that its tables give back."""

    def one(mine, sizes=GROUP_CELLS):
        if not sizes:  # a list: tables of any size would need more rounds
            return F.struct(F.concat(F.lit("="), F.array_join(F.transform(mine, lambda u: F.hex(u)), "-")).alias("text"), mine.alias("units"))
        size = sizes[0]

        def tried(t):
            return bound(peel(t, size), lambda got: F.when(got.isNotNull() & (F.size(got) == F.size(mine)), F.struct(written(t).alias("text"), got.alias("units"))).otherwise(one(mine, sizes[1:])))

        return bound(table_of(mine, size), tried)

    def whole(parts):
        head = F.concat(F.size(units).cast("string"), F.lit(":"), bits_for(units).cast("string"), F.lit(":"))
        return F.struct(F.concat(head, F.array_join(F.transform(parts, lambda p: p["text"]), ";")).alias("text"), F.flatten(F.transform(parts, lambda p: p["units"])).alias("units"))

    return bound(F.transform(groups(units, bits_for(units)), lambda mine: one(mine)), whole)  # noqa: PLW0108


def written(cells: Column) -> Column:
    """A table as text: each cell's count, digests and checks in hexadecimal, empty cells as nothing."""
    return F.array_join(F.transform(cells, lambda c: F.when((c["n"] == 0) & (c["k"] == 0), F.lit("")).otherwise(F.concat(F.hex(c["n"].cast("long")), F.lit("."), F.hex(c["k"]), F.lit("."), F.hex(c["c"])))), "-")


def differing(a: Column, b: Column) -> Column:
    """The digests that only one of two fingerprints has, given what their tables hold."""

    def one(p, sizes=GROUP_CELLS):
        if not sizes:
            return F.concat(F.array_except(p["a"], p["b"]), F.array_except(p["b"], p["a"]))
        size = sizes[0]
        got = peel(subtract(table_of(p["a"], size), table_of(p["b"], size)), size)
        return bound(got, lambda g: F.when(g.isNotNull(), g).otherwise(one(p, sizes[1:])))

    bits = F.greatest(bits_for(a), bits_for(b))
    return F.flatten(F.transform(F.arrays_zip(groups(a, bits).alias("a"), groups(b, bits).alias("b")), lambda p: one(p)))  # noqa: PLW0108


def likeness(a: Column, b: Column, differing: Column) -> Column:
    """Jaccard similarity of two sets of sizes a and b from how many members differ; 1 for two empty sets."""
    return F.when(a + b == 0, F.lit(1.0)).otherwise((a + b - differing) / (a + b + differing))


def _buckets(rows: DataFrame) -> Column:
    """Ranges of doc_id with about ``BUCKET_ROWS`` rows, found from quantiles; null doc_ids are in the last."""
    n = rows.count()
    many = int(min(MAX_BUCKETS, max(1, -(-n // BUCKET_ROWS))))
    if many == 1:
        return F.lit(0)
    share = [i / many for i in range(1, many)]
    bounds = rows.select(F.percentile_approx("doc_id", share, max(10_000, 10 * many))).first()[0] or []
    wide = max(1, int(len(bounds) ** 0.5))
    fine = F.array(*(F.lit(b).cast("long") for b in bounds)) if len(bounds) < 500 else F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    coarse = F.filter(fine, lambda b, i: i % wide == wide - 1)
    c = F.size(F.filter(coarse, lambda b: F.col("doc_id") > b))
    within = F.size(F.filter(F.slice(fine, c * wide + 1, F.lit(wide)), lambda b: F.col("doc_id") > b))
    return F.when(F.col("doc_id").isNull(), F.lit(many - 1)).otherwise((c * wide + within).cast("int"))


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, next_text``: each row's successor by doc_id, the last's is the first.

    Rows are dealt to ranges of doc_id; the first row of each range is copied to the end of
    the range before, so one shuffle of the texts is enough.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("bucket", _buckets(ids)).withColumn("h", F.xxhash64("text"))
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "h")
    order = Window.orderBy("bucket")
    firsts = rows.groupBy("bucket").agg(F.min(place).alias("first"))
    before = F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.partitionBy()))
    firsts = materialize(firsts.select(F.coalesce(F.col("first.doc_id"), F.lit(0)).alias("f_id"), F.col("first.n").alias("f_null"), F.col("first.h").alias("f_h"), before.cast("int").alias("f_before")))
    same = (F.coalesce("doc_id", F.lit(0)) == F.col("f_id")) & (F.col("doc_id").isNull() == F.col("f_null")) & (F.col("h") == F.col("f_h"))
    marked = rows.join(F.broadcast(firsts), same, "left")
    homes = F.when(F.col("f_before").isNull(), F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("copy")))).otherwise(F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("copy")), F.struct(F.col("f_before").alias("b"), F.lit(1).alias("copy"))))
    dealt = marked.select("doc_id", "text", "h", F.explode(homes).alias("home")).select("doc_id", "text", "h", "home.b", "home.copy")
    w = Window.partitionBy("b").orderBy("copy", F.col("doc_id").isNull(), "doc_id", "h")
    return dealt.withColumn("next_text", F.lead("text").over(w)).filter("copy = 0").select("doc_id", "text", "next_text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` per row of ``docs``.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many
    (or all) of the next document by doc_id (null last; rows with equal doc_id in the order
    of a hash of their texts); after the last comes the first, and a single document is its
    own next.  Null texts are empty.  Equal texts have equal fingerprints; repeated
    paragraphs count once.  An empty table gives no rows; other columns are ignored.
    """
    pairs = with_next(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    pairs = pairs.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.col("text").substr(F.lit(1), n - half), F.col("next_text").substr(F.lit(1), half)))
    base = pairs.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.transform(F.array("text", "edited"), lambda t: published(digests(t))).alias("made"), digests(F.col("next_text")).alias("next"))
    made = [F.col("made")[i] for i in range(2)]
    held = (made[1]["units"], F.col("next"))  # the next document's tables give back its digests, as its own row has made sure
    base = base.withColumn("apart", F.transform(F.array(*held), lambda other: F.size(differing(made[0]["units"], other))))
    near = [likeness(F.size(made[0]["units"]), F.size(held[i]), F.col("apart")[i]) for i in range(2)]
    return base.select("doc_id", "n_chars", "edited_sha256", made[0]["text"].alias("fingerprint"), made[1]["text"].alias("edited_fingerprint"), near[0].alias("near_edited"), near[1].alias("near_next"))
