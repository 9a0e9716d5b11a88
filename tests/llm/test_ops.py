"""Operators on small fixtures with awkward rows, held against brute force."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tracewell.llm import exact_dedup, fingerprint, line_dedup, mixing, ngram_join, quality, sentencepiece, toxicity, url_filter, warc, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, _uid string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPLIT = str.maketrans("", "", " \t\n\x0b\f\r")


def texts():
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choices("abcdefgh", k=rnd.randint(1, 7))) for _ in range(400)]
    base = [" ".join(rnd.choices(vocabulary, k=rnd.randint(1, 120))) for _ in range(25)]
    out = []
    for t in base:
        w = t.split()
        out += [t, t.upper() if rnd.random() < 0.3 else t.replace(" ", "  \n", 1)]
        for _ in range(3):
            v = list(w)
            v[rnd.randrange(len(v))] = "changed"
            out.append(" ".join(v))
    passage = "\n".join(" ".join(rnd.choices(vocabulary, k=20)) for _ in range(4))
    out += [f"own line {i}\n{passage}\nlast {i}" for i in range(4)] + ["é😀 ▁x \t y", "", None, " \n ", "x " * 5000]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 5}", len(t or ""), 1, "u") for i, t in enumerate(texts())]
    rows += [(3, rows[3][1], "en", "s3", 1, 1, "u"), (None, "no id here", "en", "s1", 1, 1, "u"), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text, r.source) for r in docs.collect()]


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mixing(docs, rows, none):
    got = mixing.mix_plan(docs, block=4, shards=8).collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r.size for r in got)
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(WORD.findall(t or ""))
    names = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    open_, target, left = set(names), {}, sum(size.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * size[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 3 * size[s]
            left -= target[s]
        open_ -= full
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
    for s in names:
        assert abs(sum(r.taken for r in got if r.source == s) - target[s]) <= 4 * 3
    again = mixing.mix_plan(docs.repartition(3), block=4, shards=8)
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again.collect()))
    whole = mixing.mixed(docs.filter("doc_id <> 3 and doc_id is not null"), block=4, shards=8)
    plan = mixing.mix_plan(docs.filter("doc_id <> 3 and doc_id is not null"), block=4, shards=8)
    assert sum(len(WORD.findall(r.text)) for r in whole.collect()) == plan.agg(F.sum("taken")).first()[0]
    assert whole.columns == docs.columns and mixing.mix_plan(none).count() == 0 and mixing.mixed(none).count() == 0


@pytest.mark.parametrize("size", [256, 4])
def test_mixed_gives_whole_documents(spark, size, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", size, raising=False)
    texts = {i: " ".join(f"d{i}w{k}" for k in range(20 + i % 17)) for i in range(120)}
    docs = spark.createDataFrame([(i, t, f"s{i % 4}") for i, t in texts.items()], "doc_id long, text string, source string")
    got, plan = mixing.mixed(docs).collect(), mixing.mix_plan(docs).groupBy("source").agg(F.sum("taken")).collect()
    for source, words in plan:
        rows = [r for r in got if r.source == source]
        cut = [r for r in rows if r.text != texts[r.doc_id]]
        assert len(cut) <= 1 and all(texts[r.doc_id].startswith(r.text) for r in cut)
        assert sum(len(r.text.split()) for r in rows) == words
        times = [sum(r.doc_id == i for r in rows) for i in texts if i % 4 == int(source[1])]
        assert max(times) - min(times) <= 1 and max(times) <= 3


def test_seats_go_to_highest_quotients(spark):
    rnd = random.Random(2)
    votes = [rnd.randint(1, 500) for _ in range(12)]
    parts = spark.createDataFrame([("g", i, v, 101) for i, v in enumerate(votes)], "g string, _tie long, v long, n long")
    won = {r._tie: r.won for r in mixing.apportion(parts, ["g"], "v", "n", "won").collect()}
    want = [0] * len(votes)
    for _ in range(101):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))
        want[best] += 1
    assert [won[i] for i in range(len(votes))] == want


def test_exact_dedup(docs, rows, none):
    groups = {}
    for i, t, _ in rows:
        groups.setdefault((t or "").translate(SPLIT), []).append((-len(t or ""), i is None, i))
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs).collect()), key=str)
    want = []
    for i, t, _ in rows:
        k = (t or "").translate(SPLIT)
        best = min(groups[k], key=lambda x: (x[0], x[1], x[2] or 0))[2]
        want.append((i, best, len(groups[k]), i == best, hashlib.sha256(k.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_dedup_keeps_the_longest_of_rows_with_one_id(spark):
    rows = spark.createDataFrame([(1, "a  b"), (1, "ab"), (2, "a b")], "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(rows).collect()) == [(1, 1, 3, False), (1, 1, 3, True), (2, 1, 3, False)]


@pytest.mark.parametrize(("most", "segment"), [(1 << 28, 1 << 20), (1 << 16, 1 << 12)])
def test_repeated_keys_pass_every_filter_and_few_others(spark, most, segment, monkeypatch):
    from tracewell.llm import bloom

    for name, value in (("MAX_BITS", most), ("SEGMENT", segment), ("HELD", 700)):
        monkeypatch.setattr(bloom, name, value)
    texts = [f"text {i}" for i in range(20_000)] + [f"text {i}" for i in range(0, 20_000, 100)] + ["hot"] * 5000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    shards, bits = bloom.size_for(len(texts))
    assert shards == (7 if most == 1 << 16 else 1)
    tested = exact_dedup._tested(exact_dedup.hashed(docs).withColumn("_key", F.xxhash64("text_sha256")), shards, bits).collect()
    again = [r for r in tested if r.doc_id >= 20_000 or r.doc_id % 100 == 0]
    assert len(tested) == len(texts) and all(r._maybe for r in again)
    assert sum(r._maybe for r in tested) - len(again) < 0.05 * 19_800
    groups = exact_dedup.exact_dedup(docs)
    assert groups.filter("kept").count() == 20_001 and groups.agg(F.max("group_size")).first()[0] == 5000


@pytest.mark.parametrize(("k", "num", "small"), [(3, 90, 64), (5, 80, 64), (3, 90, 3)])
def test_ngram_components(docs, rows, none, k, num, small, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "BLOCK", 2 if small == 3 else 256)
    sets = []
    for _, t, _ in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    comp = list(range(len(rows)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                comp[root(a)] = root(b)
    low = {}
    for a, (i, _, _) in enumerate(rows):
        if i is not None:
            low[root(a)] = min(low.get(root(a), i), i)
    want = sorted(((i, len(sets[a]), low.get(root(a)) if sets[a] else i) for a, (i, _, _) in enumerate(rows)), key=str)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs, k, num).collect()), key=str)
    assert got == want
    if k == 5:
        assert ngram_join.ngram_components(none).count() == 0 and ngram_join.keep_one(none).count() == 0
        kept = ngram_join.keep_one(docs)
        left = [(r.doc_id, r.text) for r in kept.collect()]
        of = {}
        for a, (i, t, _) in enumerate(rows):
            if sets[a]:
                of.setdefault(root(a), []).append((i is None, i or 0, t))
        assert kept.columns == docs.columns and sorted((i or 0, t) for i, t in left if WORD.search(t or "")) == sorted((i, t) for _, i, t in map(min, of.values()))
        assert len(left) == len(of) + sum(not s for s in sets)


def test_one_of_repeated_rows_stays(spark):
    rows = [(1, "a b c d e f g")] * 5 + [(2, "a b c d e f g"), (None, "p q r s t u v"), (None, "p q r s t u v"), (3, None), (3, "")]
    got = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string").withColumn("_uid", F.lit(1)).withColumn("n", F.lit(2)))
    assert sorted(((r.doc_id, r.text, r._uid, r.n) for r in got.collect()), key=str) == sorted([(1, "a b c d e f g", 1, 2), (None, "p q r s t u v", 1, 2), (3, None, 1, 2), (3, "", 1, 2)], key=str)


@pytest.mark.parametrize("wide", [2048, 4])
def test_ngram_groups_of_near_copies_cross_blocks(spark, wide, monkeypatch):
    for name, value in (("SMALL", 6), ("BLOCK", 4), ("PIVOTS", 2), ("WIDE", wide)):
        monkeypatch.setattr(ngram_join, name, value)
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(60)]
    other = [f"v{rnd.randrange(10**6)}" for _ in range(8)]
    texts = []
    for i in range(90):
        w = list(base) if i < 60 else base + other
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
        texts.append(" ".join(w))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 90).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sets = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in texts]
    comp = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(a):
                if comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                    comp = [min(comp[a], comp[b]) if c in (comp[a], comp[b]) else c for c in comp]
    assert got == dict(enumerate(comp))


def test_signatures_never_differ_more_than_sets():
    rnd = np.random.default_rng(3)
    sets = [np.unique(rnd.integers(0, 400, rnd.integers(0, 300)).astype(np.uint64)) for _ in range(30)]
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    sig = ngram_join.signatures(np.concatenate(sets), at)
    for a in range(30):
        for b in range(30):
            apart = sum(int(np.bitwise_count((s[a] ^ s[b]).view(np.uint64))) for s in sig)
            assert apart <= len(np.setxor1d(sets[a], sets[b])) and (a != b or not apart)


@pytest.mark.parametrize(("reach", "batch"), [(16, 10_000), (5, 7)])
def test_line_dedup(spark, docs, rows, none, reach, batch, monkeypatch):
    monkeypatch.setattr(line_dedup, "REACH", reach)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    got = sorted(((r.doc_id, r.text) for r in line_dedup.line_dedup(docs, 20).collect()), key=str)
    order = sorted({(i is None, i or 0, t or "") for i, t, _ in rows})
    seqs = [[(n, " ".join(x.split())) for n, x in enumerate(t.encode().decode().split("\n")) if x.split()] for _, _, t in order]
    out = {}
    for d, lines in enumerate(seqs):
        gone = set()
        for a in range(len(lines)):
            best = 0
            for e in range(d + 1):
                for b in range(len(seqs[e]) if e < d else a):
                    n = 0
                    while a + n < len(lines) and b + n < len(seqs[e]) and lines[a + n][1] == seqs[e][b + n][1]:
                        n += 1
                    best = max(best, n)
            if sum(len(x.split()) for _, x in lines[a : a + best]) >= 20:
                gone.update(range(a, a + best))
        text = order[d][2]
        cut = {lines[g][0] for g in gone}
        out[order[d]] = text if not gone else "" if len(gone) == len(lines) else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in cut)
    want = sorted(((i, None if t is None else out[(i is None, i or 0, t)]) for i, t, _ in rows), key=str)
    assert got == want and any(a != b for (_, a), (_, b) in zip(got, sorted(((i, t) for i, t, _ in rows), key=str), strict=True))
    assert line_dedup.line_dedup(none, 20).count() == 0
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    clash = docs.withColumn("_lines", F.lit(7))
    kept = line_dedup.without_repeats(clash, 20)
    assert kept.columns == clash.columns and {(r._uid, r._lines) for r in kept.collect()} == {("u", 7), (None, 7)}


@pytest.fixture(scope="module")
def vocabulary():
    with open(sentencepiece.MODEL, "rb") as f:
        return sentencepiece.load(f.read())


def test_ranks_are_those_of_the_sorted_suffixes(spark):
    rnd = random.Random(8)
    texts = ["\n".join(rnd.choice("abc") for _ in range(rnd.randint(0, 40))) for _ in range(12)]
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc_id long, uid long, text string")
    active, starts = line_dedup.suffix_ranks(line_dedup._lines(docs).repartition(3).transform(line_dedup.materialize))
    found = {(r.uid, r.line): (r.place, r.rank) for r in active.collect()}
    none = spark.createDataFrame([], "place long, lines long, uid long, line long")
    h = 1
    while h < 16:
        blocks = {}
        for (d, i) in found:
            block = texts[d].split("\n")[i : i + h]
            blocks.setdefault(tuple(block), []).append(found[d, i][1])
        assert all(len(set(r)) == 1 for r in blocks.values()) and len({r[0] for r in blocks.values()}) == len(blocks)
        pairs = line_dedup._paired(active.select("place", "rank"), none, h.bit_length() - 1)
        groups = line_dedup.materialize(line_dedup.numbered(pairs.groupBy("left", "right").agg(F.count("*").alias("n")).filter("n > 1"), ["left", "right"], "rank"))
        joined = pairs.join(groups, ["left", "right"]).collect()
        assert [r.rank for r in sorted(joined, key=lambda r: (r.left, r.right, r.place))] == sorted(r.rank for r in joined)
        active = line_dedup.materialize(spark.createDataFrame([(r.place, r.rank) for r in joined], "place long, rank long"))
        by_place = {r.place: r.rank for r in joined}
        found = {k: (p, by_place[p]) for k, (p, _) in found.items() if p in by_place}
        h *= 2


def best_score(v, keys, word):
    """The score of the best segmentation, by trying every pair of character boundaries."""
    chars = [0]
    for c in word.decode():
        chars.append(chars[-1] + len(c.encode()))
    best = {0: 0.0} | dict.fromkeys(chars[1:], -np.inf)
    for j, e in enumerate(chars[1:], 1):
        for i in range(max(0, j - v.longest - 1), j):
            s = chars[i]
            score = v.scores[keys[word[s:e]]] if word[s:e] in keys else v.unknown_score if i == j - 1 else -np.inf
            best[e] = max(best[e], best[s] + score)
    return best[len(word)]


def score_of(v, keys, word, ids):
    raw = sum(v.scores[i] for i in ids if i not in set(v.byte_ids.tolist()))
    return raw + v.unknown_score * sum(1 for c in word.decode() if c.encode() not in keys)


@pytest.fixture(scope="module")
def piece_keys(vocabulary):
    v = vocabulary
    return {v.surface[v.starts[i] : v.starts[i + 1]].tobytes(): i for i in range(259, len(v.scores)) if v.starts[i + 1] > v.starts[i]}


def test_viterbi_is_optimal(vocabulary, piece_keys):
    v = vocabulary
    assert np.exp([v.scores[i] for i in piece_keys.values()]).sum() == pytest.approx(1)
    for w in (b" the", b" threading", " élève".encode(), b"with", " 日x".encode(), b" " * 40, "日本語のテキスト😀".encode() * 5, b"YWJjZGVmZ2hpamtsbW5vcA==" * 4):
        ids, _ = sentencepiece.viterbi(v, [w])
        assert score_of(v, piece_keys, w, ids) == pytest.approx(best_score(v, piece_keys, w))
        assert (ids == sentencepiece.viterbi_long(v, w)).all()


@pytest.mark.parametrize("window", [1 << 18, 40])
def test_viterbi_of_whole_texts_is_optimal(vocabulary, piece_keys, window, monkeypatch):
    monkeypatch.setattr(sentencepiece, "WINDOW", window)
    encoder = sentencepiece.Encoder(vocabulary)
    for t in [t.encode() for t in texts() if t][:60:3] + ["naïve 日本 " .encode() * 30 + "x▁y\n".encode() * 9]:
        ids, _ = encoder.encode([t])
        whole = b" " + t.replace("▁".encode(), b"")  # the marker itself has no piece here
        if "▁".encode() not in t:
            assert score_of(vocabulary, piece_keys, whole, ids) == pytest.approx(best_score(vocabulary, piece_keys, whole))
        assert (sentencepiece.viterbi_long(vocabulary, b" " + t) == ids).all()


def test_scores_of_unigram_models_stay(vocabulary):
    own = np.log([0.5, 0.25, 0.25])
    assert (sentencepiece.log_scores(own, np.arange(3)) == own).all()


def test_long_texts_without_spaces(vocabulary):
    import time

    rnd = random.Random(3)
    began = time.process_time()
    t = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz日本語é", k=60_000)).encode()
    ids, starts = sentencepiece.Encoder(vocabulary).encode([t, b"", t[:50]])
    assert time.process_time() - began < 5 and sentencepiece.decode(vocabulary, ids, starts)[:2] == [t, b""]


def test_decode_skips_control_pieces(vocabulary):
    ids, starts = sentencepiece.Encoder(vocabulary).encode([b"some text"])
    wrapped = np.concatenate([[1], ids, [2, 0]])
    assert sentencepiece.decode(vocabulary, wrapped, np.array([0, len(wrapped), len(wrapped)])) == [b"some text", b""]


def test_sentencepiece_round_trip(docs, rows, none, vocabulary):
    got = sentencepiece.encode_documents(docs)
    assert got.filter("not round_trip").count() == 0 and got.count() == len(rows)
    back = sorted(((r.doc_id, r.text) for r in sentencepiece.decode_documents(got).collect()), key=str)
    assert back == sorted(((i, t or "") for i, t, _ in rows), key=str)
    assert sentencepiece.encode_documents(none).count() == 0


@pytest.mark.parametrize("chunk", [1 << 20, 64])
def test_warc_round_trip(spark, chunk):
    html = ["<p>" + "a" * 200, "<p>" + "a" * 200, "short", "short", None, "", "é" * 300, "x\r\n\r\ny" * 40, "<p>" + "a" * 200]
    pages = spark.createDataFrame([(None if i == 8 else i, "http://x\n/" if i else None, h, "x") for i, h in enumerate(html)], "page_id long, url string, html string, digest string")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages, chunk, 4000).collect()), key=str)
    want = []
    for i, h in enumerate(html):
        raw = (h or "").encode()
        first = html.index(h)
        again = len(raw) >= 100 and first != i
        want.append((None if i == 8 else i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_url_filter(spark):
    urls = ["http://A.Example.NET/en/x?q", "https://blog.x.net/y", "http://x.net", None, "nothing", "http://b.org/fr/1#t", "http://notnet/", "https://www.example.com/de/", "http://q.org/en/", "ftp://u@h.com:80/p"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls * 30)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.url_filter(pages).collect()}
    assert [got[i].rule for i in range(10)] == ["example.net/en/", "net/", None, None, None, "org/fr/", None, "example.com/de/", None, None]
    assert [got[i].host for i in (0, 3, 4, 9)] == ["a.example.net", "", "", "u@h.com:80"] and got[0].path == "/en/x" and got[2].path == ""
    assert all(r.verdict in ("allow", "block") for r in got.values()) and got[1].verdict == "block" and got[5].verdict == "allow"
    assert url_filter.url_filter(pages.limit(0)).count() == 0


def test_url_models_tell_digits_marks_and_long_words_apart(spark):
    kinds = {"en": ("1", "?", "é", "abcdefx"), "de": ("2", "#", "ü", "abcdefy")}
    judged = [f"http://{'example.net' if d == 'en' else 'example.com'}/{d}/{k}{i}-" for d, marks in kinds.items() for k in marks for i in "wxyz" * 20]
    asked = [f"http://other.org/{k}q" for marks in kinds.values() for k in marks]
    pages = spark.createDataFrame(list(enumerate(judged + asked)), "page_id long, url string")
    rules = (("allow", "example.net/en/"), ("block", "example.com/de/"))
    got = {r.page_id: r.score for r in url_filter.url_filter(pages, rules).collect()}
    allowed, blocked = ([got[len(judged) + 4 * j + i] for i in range(4)] for j in (0, 1))
    assert all(a > b for a, b in zip(allowed, blocked, strict=True)), (allowed, blocked)


def cells_of(key, size):
    h = xxhash.xxh64_intdigest(struct.pack("<i", size), xxhash.xxh64_intdigest(struct.pack("<Q", key), 42))
    return [(h >> (16 * i) & 0xFFFF) % (size // 3) + i * (size // 3) for i in range(3)]


def tables(fingerprint):
    """Groups of a written fingerprint: lists of [count, digests, checks], or a set of digests."""
    out = []
    for group in fingerprint.split(":", 2)[2].split(";"):
        if group.startswith("="):
            out.append({int(x, 16) for x in group[1:].split("-") if x})
        else:
            out.append([[int(x, 16) for x in c.split(".")] if c else [0, 0, 0] for c in group.split("-")])
    return out


def peeled(cells):
    """The digests in a table, or None where it is too small."""
    if isinstance(cells, set):
        return cells
    cells, found, more = [list(c) for c in cells], set(), True
    while more:
        more = False
        for c in cells:
            n, k = c[0], c[1]
            check = xxhash.xxh64_intdigest(struct.pack("<i", -1), xxhash.xxh64_intdigest(struct.pack("<Q", k), 42)) & 0xFFFFFFFF
            if abs(n) == 1 and check == c[2]:
                found.add(k)
                more = True
                for j in cells_of(k, len(cells)):
                    cells[j] = [cells[j][0] - n, cells[j][1] ^ k, cells[j][2] ^ check]
    return found if all(c == [0, 0, 0] for c in cells) else None


def test_likeness_follows_from_the_written_fingerprints_alone(docs):
    got = fingerprint.fingerprints(docs.filter("doc_id is not null and doc_id <> 3")).orderBy("doc_id").collect()
    own = [set().union(*map(peeled, tables(r.fingerprint))) for r in got]
    subtracted = 0
    for i, r in enumerate(got):
        edited = set().union(*map(peeled, tables(r.edited_fingerprint)))
        for other, near in ((edited, r.near_edited), (own[(i + 1) % len(got)], r.near_next)):
            assert near == pytest.approx(len(own[i] & other) / len(own[i] | other) if own[i] | other else 1)
        assert int(r.fingerprint.split(":")[0]) == len(own[i])
        a, b = tables(r.fingerprint), tables(r.edited_fingerprint)
        if list(map(len, a)) == list(map(len, b)) and not any(isinstance(x, set) for x in a + b):
            apart = [peeled([[x - y, k ^ l, c ^ d] for (x, k, c), (y, l, d) in zip(s, t, strict=True)]) for s, t in zip(a, b, strict=True)]
            if None not in apart:
                subtracted += 1
                assert set().union(*apart) == own[i] ^ edited
    assert subtracted > 20


def test_groups_too_full_for_their_tables(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "GROUP_CELLS", (3,))
    texts = [" ".join(f"w{i}x{k}" for k in range(150)) for i in range(3)]
    got = fingerprint.fingerprints(spark.createDataFrame(list(enumerate([*texts, texts[0]])), "doc_id long, text string")).orderBy("doc_id").collect()
    assert all("=" in r.fingerprint for r in got) and got[3].near_next == 1 and got[0].near_next == 0 and got[3].fingerprint == got[0].fingerprint
    assert len(set().union(*map(peeled, tables(got[0].fingerprint)))) == 12


@pytest.mark.parametrize("size", [5000, 20])
def test_fingerprints(docs, rows, none, size, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", size)
    unique = docs.filter("doc_id is not null and doc_id <> 3")
    t = [x or "" for i, x, _ in sorted((r for r in rows if r[0] is not None and r[0] != 3), key=lambda r: r[0])]
    got = fingerprint.fingerprints(unique).orderBy("doc_id").collect()
    run = r"(?:[^\x20\x09-\x0D]+[\x20\x09\x0B-\x0D]*){1,%d}"

    def units(x):
        a = re.findall(run % 32, x)
        return set((re.findall(run % 4, a[0]) if a else []) + a[1:])

    same = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    for i, r in enumerate(got):
        nxt, half = t[(i + 1) % len(t)], len(t[i]) // 2
        edited = t[i][: len(t[i]) - half] + nxt[:half]
        assert r.n_chars == len(t[i]) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(same(units(t[i]), units(edited))) and r.near_next == pytest.approx(same(units(t[i]), units(nxt)))
    assert fingerprint.fingerprints(none).count() == 0 and fingerprint.fingerprints(docs).count() == len(rows)


def test_classifiers_find_planted_words(spark):
    rnd = random.Random(1)
    vocabulary = ["".join(rnd.choices("abcdefgh", k=6)) for _ in range(300)]
    rows, labels = [], []
    for i in range(500):
        w = rnd.choices(vocabulary, k=rnd.randint(5, 60))
        bad = i % 5 == 0
        if bad:
            w[rnd.randrange(len(w))] = rnd.choice(("vile", "rotten", "nasty"))
        junk = i % 4 == 0
        rows.append((i, " ".join(w) if not junk else "!! ".join([w[0]] * len(w)) + (" vile" if bad else "")))
        labels.append((i, int(not junk), int(bad)))
    rows += [(1000, None), (1001, ""), (None, "vile text")]
    d, l = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    truth = {i: (q, x) for i, q, x in labels}
    tox = toxicity.toxicity(d, l).collect()
    held = [r for r in tox if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in tox if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id][1] for r in held if r.doc_id in truth]) > 0.95 and len(tox) == len(rows)
    good = quality.quality(d, l).collect()
    assert np.mean([r.predicted == truth[r.doc_id][0] for r in good if r.held_out and r.doc_id in truth]) > 0.95 and len(good) == len(rows)
    assert all(0 <= r.score <= 1 for r in [*tox, *good])
    assert toxicity.toxicity(d.limit(0), l).count() == 0 and quality.quality(d, l.limit(0)).count() == len(rows)


def test_segments_are_all_maximal_ones():
    rnd = random.Random(4)
    for _ in range(200):
        s = [rnd.choice((-0.5, -0.5, -0.5, 1.5, 3.5)) for _ in range(14)]
        at = [i for i, x in enumerate(s) if x > 0]
        got = toxicity.segments(np.array(at), np.array([s[i] + 0.5 for i in at]))
        want = []

        def scan(lo, hi):
            best = max(((sum(s[a:b]), -(b - a), a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0, 0))
            if best[0] > 0:
                scan(lo, best[2])
                want.append((best[2], best[3] - 1, best[0]))
                scan(best[3], hi)

        scan(0, len(s))
        assert sum(x[2] for x in got) == pytest.approx(sum(x[2] for x in want)) and max((x[2] for x in got), default=0) == pytest.approx(max((x[2] for x in want), default=0))


def test_words_do_not_depend_on_segments(monkeypatch):
    t = pa.array(["Some words here", None, "", "x" * 50, "a b\tc\nd", "é é"])
    whole = words.word_hashes(t)
    monkeypatch.setattr(words, "SEGMENT", 7)
    cut = words.word_hashes(t)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all() and len(whole[0]) == 10


def test_at_most_so_many_rows_train(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(i, "other") for i in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, toxic int")
    assert toxicity.training_rows(docs, labels, "toxic", 1).count() == 1
    assert toxicity.training_rows(docs, labels, "toxic", 1000).count() == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(1, 40))


def test_mixed_emits_what_it_plans_where_rows_repeat(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice([1, 2, 3, None]), " ".join(f"w{rnd.randrange(99)}" for _ in range(rnd.randint(1, 20))), rnd.choice(["a", "b", None])) for _ in range(60)]
    docs = spark.createDataFrame([*rows, *rows[:10], (4, None, "a"), (5, "", "b")], "doc_id long, text string, source string").withColumn("_source", F.lit("x")).withColumn("size", F.lit(1))
    plan = {r.source: r.taken for r in mixing.mix_plan(docs, shards=4).groupBy("source").agg(F.sum("taken").alias("taken")).collect()}
    got = {}
    for r in mixing.mixed(docs, shards=4).collect():
        got[r.source] = got.get(r.source, 0) + len(r.text.split())
        assert r._source == "x" and r["size"] == 1
    assert got == {k: v for k, v in plan.items() if v}


def test_toxic_rows_go_and_all_columns_stay(spark):
    words = [f"word{i}" for i in range(40)]
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choices(words, k=20)) + (" vileword" if i % 4 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "word1 vileword"), *rows[:3]], "doc_id long, text string").withColumn("score", F.lit("s")).withColumn("label", F.lit(3))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows] + [(None, 1), (7777, 1)], "doc_id long, toxic int")
    kept = toxicity.without_toxic(docs, labels)
    left = kept.collect()
    assert kept.columns == docs.columns and not any("vileword" in (r.text or "") for r in left) and len(left) == 300 + 2 + 2
    assert {(r.score, r.label) for r in left} == {("s", 3)}
    assert toxicity.without_toxic(docs, labels.limit(0)).count() == docs.count() and toxicity.without_toxic(docs.limit(0), labels).count() == 0


def mixture(counted, order):
    """Log ratio of a gram by Witten and Bell's mixture of orders 0 to ``order``; ``counted``: gram -> [allow, block]."""
    levels = {order + 1: counted}
    for size in range(order, 0, -1):
        level = {}
        for g, c in levels[size + 1].items():
            old = level.setdefault(g[-size:], [0, 0])
            level[g[-size:]] = [old[0] + c[0], old[1] + c[1]]
        levels[size] = level

    def chance(g, v):
        level = levels[len(g)]
        if len(g) == 1:
            return (level[g][v] + 0.5) / (sum(c[v] for c in level.values()) + 0.5 * (len(level) + 1))
        after = [c[v] for x, c in level.items() if x[:-1] == g[:-1]]
        kinds = sum(c > 0 for c in after) + 1
        return (level[g][v] + kinds * chance(g[1:], v)) / (sum(after) + kinds)

    return lambda g: round(1000 * max(-20, min(20, np.log(chance(g, 0)) - np.log(chance(g, 1))))) / 1000


def test_url_scores_are_those_of_the_mixture(spark):
    rules = (("allow", "good.org/"), ("block", "bad.org/"))
    judged = [(0, f"http://good.org/a{i}news") for i in range(12)] + [(1, f"http://bad.org/b{i}spam") for i in range(12)]
    urls = [u for _, u in judged] + ["http://x.com/news", "http://x.com/spam", "http://x.com/é?", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.url_filter(pages, rules).collect()}
    left_out = {r.url for r in pages.filter(url_filter._held_out()).collect()}

    def grams(u):
        t = "\x02" * url_filter.ORDER + u
        return [t[i : i + url_filter.ORDER + 1] for i in range(len(u))]

    counted = {}
    for i, u in enumerate(urls):
        for g in grams(u or ""):
            c = counted.setdefault(g, [0, 0])
            if i < len(judged) and u not in left_out:
                c[judged[i][0]] += 1
    ratio = mixture(counted, url_filter.ORDER)
    for i, u in enumerate(urls):
        assert got[i].score == pytest.approx(np.mean([ratio(g) for g in grams(u)]) if u else 0, abs=1.1e-3), u
    assert got[24].score > got[25].score and got[27].score == 0
    bins = [(v, got[i].score) for i, (v, u) in enumerate(judged) if u in left_out]
    if {v for v, _ in bins} == {0, 1}:
        limit = url_filter.threshold(spark.createDataFrame([("allow" if v == 0 else "block", x) for v, x in bins], "verdict string, score double"))
        assert all(got[i].verdict == ("block" if got[i].score < limit else "allow") for i in (24, 25, 26, 27))


def test_toxicity_counts_and_log_odds_by_hand(spark):
    rows = [("vile foul word", 1), ("vile word word", 1), ("vile thing", 1), ("nice word", 0), ("nice thing", 0)] * 4
    counts = toxicity._counts(spark.createDataFrame(rows, "text string, label int"))
    hashes, _ = words.letter_hashes(pa.array(["vile", "word", "nice", "thing", "foul"]), toxicity.PREFIXES)
    found = {(r["level"], r["key"]): (r["toxic"], r["hits"]) for r in counts["rows"].to_pylist()}
    for k, want in enumerate([(12, 12), (8, 12), (0, 8), (4, 8), (4, 4)]):
        mine = found.get((2, int(hashes[2][k].view(np.int64))))
        assert mine == want or (mine is None and want[0] < 2 and want[1] < 20)
    model = toxicity._log_odds(counts)
    score = toxicity.token_scores(model, hashes)
    assert score[0] > 0 and score[2] == 0
    got = toxicity.evidence(model, pa.array(["nice vile vile nice", "nice", "", None]))
    assert got[0][0] > 0 and (got[0][1:] == 0).all() and got[3].tolist() == [4, 1, 0, 0]


def test_rules_compile_to_what_they_say(spark):
    rnd = np.random.default_rng(4)
    x = rnd.random((600, len(quality.NAMES)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] <= 0.7)).astype(float)
    fitted = quality.fit(x, y)

    def by_hand(row):
        z = fitted.intercept
        for rule, weight in zip(fitted.rules, fitted.weights, strict=True):
            z += weight * all((row[f] > cut) == above for f, above, cut in rule)
        return 1 / (1 + np.exp(-z))

    p = np.array([by_hand(r) for r in x])
    assert ((p > 0.5) == (y > 0)).mean() > 0.97
    frame = spark.createDataFrame(x[:50].tolist(), list(quality.NAMES))
    compiled = [r[0] for r in frame.select(quality.probability(fitted, {n: F.col(n) for n in quality.NAMES})).collect()]
    assert compiled == pytest.approx(p[:50].tolist(), abs=1e-9)


def test_every_maximal_segment_and_no_other():
    rnd = random.Random(11)
    for _ in range(300):
        s = [rnd.uniform(0.1, 4) if rnd.random() < 0.4 else -0.5 for _ in range(16)]
        at = [i for i, x in enumerate(s) if x > 0]
        got = toxicity.segments(np.array(at), np.array([s[i] + 0.5 for i in at]))

        def scan(lo, hi):
            best = max(((sum(s[a:b]), -(b - a), a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0, 0))
            return [] if best[0] <= 0 else [*scan(lo, best[2]), (best[2], best[3] - 1, best[0]), *scan(best[3], hi)]

        want = scan(0, len(s))
        assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want])
