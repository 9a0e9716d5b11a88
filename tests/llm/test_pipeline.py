"""The pipeline as a whole, on a small table."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_ops import WORD, best_score, score_of

from tracewell.llm import sentencepiece


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    text = F.concat_ws(" ", *(F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(500)).cast("string")) for k in range(40)))
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 50, text).otherwise("same words again and again in all of these rows").alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("source"), F.lit(1).cast("long").alias("n_chars"))
    docs.write.parquet(f"{d}/documents.parquet")
    spark.range(40).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{d}/labels.parquet")
    return d


def test_pipeline(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, folder)
        assert kept.columns == docs.columns, name
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == list(range(51))  # clean documents stay; of the ten copies one does
    out = corpus_pipeline.run(spark, folder).collect()
    assert out and all(r.round_trip for r in out) and {r.doc_id for r in out} <= set(ids)


def test_pipeline_takes_an_empty_table(spark, folder, tmp_path):
    import corpus_pipeline

    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def toxic_rows():
    """Documents of every kind: toxic ones (doc_id 200 and up), repeated passages, near copies, empty and null texts."""
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7))) for _ in range(300)]
    passage = "\n".join(" ".join(rnd.choices(vocabulary, k=20)) for _ in range(3))
    out = []
    for i in range(150):
        words = rnd.choices(vocabulary, k=rnd.randint(30, 90))
        text = " ".join(words)
        if i % 10 == 1:
            text = f"{text}\n{passage}\nend of {i}"
        if i % 10 == 2:
            text = out[-2][1]  # an exact copy
        if i % 10 == 4:
            text = out[-1][1] + " changed at the end"  # a near one
        out.append((i, text, "en", None if i % 9 == 0 else f"s{i % 5}", len(text)))
    out += [(150, "", "en", "s1", 0), (151, None, "en", "s2", None), (152, " \n ", "en", "s1", 3), (153, "Ünïcode 日本語 ▁ 😀 x", None, "s3", 1)]
    for i in range(200, 260):
        out.append((i, " ".join([*rnd.choices(vocabulary, k=40), *rnd.choices(["zvile", "zgross", "zfoul"], k=12), *rnd.choices(vocabulary, k=20)]), "en", f"s{i % 5}", 1))
    return out


def without_later_runs(rows, least):
    """Texts by doc_id with later copies of line runs of ``least`` words gone, by comparing every pair of places."""
    lines = {i: [(n, tuple(x.split())) for n, x in enumerate((t or "").split("\n")) if x.split()] for i, t in rows}
    out = {}
    for i, t in rows:
        gone = set()
        for a in range(len(lines[i])):
            for e in lines:
                if e > i:
                    continue
                for b in range(len(lines[e]) if e < i else a):
                    n = 0
                    while a + n < len(lines[i]) and b + n < len(lines[e]) and lines[i][a + n][1] == lines[e][b + n][1]:
                        n += 1
                    if sum(len(x) for _, x in lines[i][a : a + n]) >= least:
                        gone.update(x for x, _ in lines[i][a : a + n])
        out[i] = t if not gone else "" if len(gone) == len(lines[i]) else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone)
    return out


def smallest_of_groups(texts):
    """The doc_ids that stay of texts linked by 0.8 of their 5-word shingles, by comparing all pairs."""
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(t or "")
        sets[i] = {tuple(w[a : a + 5]) for a in range(len(w) - 4)} or ({tuple(w)} if w else set())
    group = {i: i for i in texts}
    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    return {i for i in ids if group[i] == i}


def highest_quotients(votes, seats):
    """Seats of each key, one by one to the highest quotient; ties go to the smaller key."""
    got = dict.fromkeys(votes, 0)
    for _ in range(seats):
        won = min((k for k in votes if votes[k] > 0), key=lambda k: (-votes[k] / (2 * got[k] + 1), k))
        got[won] += 1
    return got


def mix_by_hand(rows):
    """(doc_id, text) of the mix as a Counter, seat by seat and word by word."""
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    order = {i: hashlib.md5(f"42:{i}".encode()).hexdigest() for i, _, _ in rows}
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    of = {s: [i for i, _, x in rows if x == s] for s in names}
    total = {s: sum(size[i] for i in of[s]) for s in names}
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(names)}
    target, free, left = {}, set(names), sum(total.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 3 * total[s]} or free
        for s in full:
            target[s] = min(share[s], 3.0 * total[s])
        left -= sum(target[s] for s in full)
        free -= full
    key = {s: "~" if s is None else s.encode().hex().upper() for s in names}
    quota = highest_quotients({key[s]: target[s] for s in names}, int(sum(target.values()) / 8 + 0.5))
    text = {i: t for i, t, _ in rows}
    mix = Counter()
    for s in names:
        shard = {}
        for i in of[s]:
            n = int(order[i][:8], 16) % 1024
            shard[n] = shard.get(n, 0) + size[i]
        seats = highest_quotients(shard, quota[key[s]])
        words = sum(min(8 * seats[n], 3 * shard[n]) for n in shard)
        for i in sorted(of[s], key=order.get) * 3:
            n = min(words, size[i])
            words -= n
            if n:
                mix[i, text[i] if n == size[i] else "".join(re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", text[i])[:n])] += 1
        assert words == 0
    return mix


def test_every_stage_by_hand(spark, tmp_path):
    import corpus_pipeline

    rows = toxic_rows()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 200)) for i, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at = [spark.read.parquet(f"{tmp_path}/documents.parquet")]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at[-1], str(tmp_path)).write.parquet(f"{tmp_path}/stage{n}")
        at.append(spark.read.parquet(f"{tmp_path}/stage{n}"))
    got = [[r.asDict() for r in f.collect()] for f in at[1:]]

    want = {i: (t, s) for i, t, _, s, _ in rows if i < 200}  # the toxic words were planted in the others
    assert sorted(r["doc_id"] for r in got[0]) == sorted(want)
    assert all((r["text"], r["source"]) == want[r["doc_id"]] for r in got[0])

    cut = without_later_runs([(i, t) for i, (t, _) in sorted(want.items())], 50)
    assert {r["doc_id"]: r["text"] for r in got[1]} == cut and len(got[1]) == len(cut)
    assert any(cut[i] != want[i][0] for i in cut) and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got[1])

    stay = smallest_of_groups(cut)
    assert sorted(r["doc_id"] for r in got[2]) == sorted(stay) and len(stay) < len(cut)

    mix = mix_by_hand([(i, cut[i], want[i][1]) for i in sorted(stay)])
    assert Counter((r["doc_id"], r["text"]) for r in got[3]) == mix and max(mix.values()) > 1

    with open(sentencepiece.MODEL, "rb") as f:
        v = sentencepiece.load(f.read())
    keys = {v.surface[v.starts[i] : v.starts[i + 1]].tobytes(): i for i in range(259, len(v.scores)) if v.starts[i + 1] > v.starts[i]}
    back = sentencepiece.decode_documents(at[5]).collect()
    assert Counter((r.doc_id, r.text) for r in back) == mix and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in got[4])
    of = {}
    for r in got[4]:
        of.setdefault((r["doc_id"], r["n_tokens"]), r["ids"])
    checked = 0
    for i, t in sorted(mix)[:25]:
        options = [ids for (d, _), ids in of.items() if d == i]
        if "▁" not in t and len(options) == 1:
            whole = b" " + t.encode()
            assert score_of(v, keys, whole, options[0]) == pytest.approx(best_score(v, keys, whole))
            checked += 1
    assert checked > 5
