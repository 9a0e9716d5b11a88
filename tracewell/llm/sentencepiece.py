"""SentencePiece encoding and decoding: a unigram Viterbi over a double-array trie.

A unigram model's file has a log probability for each piece, and these are used.  A merge model's
has the pieces in order of their merges, most frequent first, and no probabilities; these follow
from the rank by Zipf's law, log p = -log(rank) - log(sum of all 1 / rank), so nothing is
trained and no pass over the corpus is needed.

The trie holds the bytes of all pieces, with the whitespace marker as a plain space.  No piece goes on
over a space or a line's end, so a text falls into chunks whose best segmentations are
independent; each distinct chunk of a batch is segmented once, all of them side by side:
position by position, every chunk walks the trie and relaxes the ends of its pieces.  In a
long chunk, such as a text without spaces, all positions of a window walk the trie side by side, and
one pass over the pieces found relaxes their ends; time is linear and memory a few bytes a byte.
Characters without a piece fall back to the pieces of their bytes.  Decoding joins the
pieces' bytes.  A marker character that stands in the text itself falls back to bytes, so
that decoding restores every text exactly.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.words import pieces as slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_COST = 10.0
CACHED = 200_000
CACHED_BYTES = 32 << 20
LONG = 96
WINDOW = 1 << 15
_CHUNK = re.compile(rb"\n| +[^ \n]*|[^ \n]+")
_CHUNK_OPEN = re.compile(rb"(?s).+")


@dataclass
class Trie:
    """base + byte leads to a child, check tells whose child it is, value is the piece that ends there or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray


@dataclass
class Vocabulary:
    trie: Trie
    scores: np.ndarray
    byte_ids: np.ndarray
    surface: np.ndarray
    starts: np.ndarray
    unknown_score: float
    unknown_id: int
    dummy_prefix: bool
    parted: bool
    longest: int


def build_trie(keys: dict[bytes, int]) -> Trie:
    """A double array of the keys.

    A node's children go to a base where their places are free: an only child to the first
    free place, several to one of the first free places that fits, or else past all others.
    """
    children: list[dict[int, int]] = [{}]
    ends = {}
    for key, value in keys.items():
        node = 0
        for b in key:
            if b not in children[node]:
                children[node][b] = len(children)
                children.append({})
            node = children[node][b]
        ends[node] = value
    taken = bytearray(1024)
    taken[0] = 1
    base, check, value = {}, {}, {0: ends.get(0, -1)}
    low, top, queue = 1, 1, [(0, 0)]
    for node, at in queue:
        found = sorted(children[node])
        if not found:
            continue
        low = taken.find(0, low)
        slot, b = low, 0
        for _ in range(32):
            slot = taken.find(0, slot)
            b = slot - found[0]
            if b > 0 and not any(taken[b + c] for c in found if b + c < len(taken)):
                break
            slot += 1
        else:
            b = top
        base[at] = b
        top = max(top, b + found[-1] + 1)
        if top + 512 > len(taken):
            taken.extend(bytes(len(taken)))
        for c in found:
            taken[b + c] = 1
            check[b + c], value[b + c] = at, ends.get(children[node][c], -1)
            queue.append((children[node][c], b + c))
    out = [np.full(top + 512, -1, np.int32) for _ in range(3)]
    for array, part in zip(out, (base, check, value), strict=True):
        array[list(part)] = list(part.values())
    return Trie(*out)


def load(model: bytes, dummy_prefix: bool = True) -> Vocabulary:
    """The vocabulary of a serialized SentencePiece model, with log scores: its own, or, of a merge model, those by rank."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    keys, surface = {}, []
    scores = np.zeros(sp.get_piece_size())
    byte_ids = np.full(256, sp.unk_id(), np.int64)
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        scores[i] = sp.get_score(i)
        raw = b""
        if sp.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            raw = bytes([int(piece[3:5], 16)])
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            raw = piece.replace(MARK, " ").encode()
            keys[raw] = i
        surface.append(raw)
    scores = log_scores(scores, np.array(sorted(keys.values()), np.int64))
    parted = not any(re.search(rb"[^ ] |\n.|.\n", k) for k in keys)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in surface])])
    least = min((scores[i] for i in keys.values()), default=0.0)
    return Vocabulary(build_trie(keys), scores, byte_ids, np.frombuffer(b"".join(surface), np.uint8), starts, least - UNKNOWN_COST, sp.unk_id(), dummy_prefix, parted, max(map(len, keys), default=1))


def log_scores(scores: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """``scores`` as they are where those of ``pieces`` are log probabilities, which sum to about 1; else by the pieces' rank."""
    if not len(pieces) or 0.5 < np.exp(scores[pieces]).sum() < 1.5:
        return scores
    out, rank = scores.copy(), np.arange(1, len(pieces) + 1)
    out[pieces] = -np.log(rank) - np.log((1 / rank).sum())
    return out


def viterbi(v: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The best pieces of each word, as ``(ids, where each word's begin)``; of equal paths the first found stays."""
    length = np.array([len(w) for w in words])
    n, most = len(words), int(length.max())
    buf = np.zeros((n, most + 4), np.uint8)
    flat = np.frombuffer(b"".join(words), np.uint8)
    row = np.repeat(np.arange(n), length)
    buf[row, np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    best = np.full((n, most + 5), -np.inf)
    best[:, 0] = 0
    back = np.zeros((n, most + 5), np.int32)
    piece = np.full((n, most + 5), -1, np.int32)
    wide = np.ones(256, np.int64)
    wide[0xC0:0xE0], wide[0xE0:0xF0], wide[0xF0:] = 2, 3, 4
    base, check, value = v.trie.base, v.trie.check, v.trie.value
    for s in range(most):
        rows = np.flatnonzero((length > s) & (best[:, s] > -np.inf))
        if not len(rows):
            continue
        here = best[rows, s]
        char = np.minimum(wide[buf[rows, s]], length[rows] - s)
        alone = np.zeros(len(rows), bool)
        live, node, d = np.arange(len(rows)), np.zeros(len(rows), np.int64), 0
        while len(live):
            live_rows = rows[live]
            inside = length[live_rows] > s + d
            live, node, live_rows = live[inside], node[inside], live_rows[inside]
            step = base[node] + buf[live_rows, s + d]
            ok = (base[node] >= 0) & (check[step] == node)
            live, node, live_rows = live[ok], step[ok], live_rows[ok]
            d += 1
            got = value[node] >= 0
            at, ids = live[got], value[node[got]]
            alone[at[char[at] == d]] = True
            cand = here[at] + v.scores[ids]
            better = cand > best[rows[at], s + d]
            r = rows[at[better]]
            best[r, s + d], back[r, s + d], piece[r, s + d] = cand[better], s, ids[better]
        r, c, h = rows[~alone], char[~alone], here[~alone] + v.unknown_score
        better = h > best[r, s + c]
        r, c = r[better], c[better]
        best[r, s + c], back[r, s + c], piece[r, s + c] = h[better], s, -1
    pos, out_row, out_id = length.copy(), [], []
    rows = np.flatnonzero(pos > 0)
    while len(rows):
        end, start = pos[rows], back[rows, pos[rows]]
        ids = piece[rows, end]
        known = ids >= 0
        one = np.where(known, ids, v.byte_ids[buf[rows, end - 1]])
        out_row.append(rows)
        out_id.append(one)
        pos[rows] = np.where(known, start, end - 1)
        # a character without a piece goes byte by byte: its inner ends lead back to its start
        inner = ~known & (end - 1 > start)
        back[rows[inner], end[inner] - 1] = start[inner]
        piece[rows[inner], end[inner] - 1] = -1
        rows = rows[pos[rows] > 0]
    row, ids = np.concatenate(out_row)[::-1], np.concatenate(out_id)[::-1]
    order = np.argsort(row, kind="stable")
    return ids[order].astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])


def _edges(v: Vocabulary, buf: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, length, id`` of all pieces that begin in ``buf[lo:hi]``, in order; id -1 for a character that is no piece."""
    base, check, value = v.trie.base, v.trie.check, v.trie.value
    head = buf[lo:hi]
    char = np.where(head < 0x80, 1, np.where(head < 0xC0, 0, np.where(head < 0xE0, 2, np.where(head < 0xF0, 3, 4))))
    live = np.flatnonzero(char)
    char = np.minimum(char, len(buf) - lo - np.arange(hi - lo))
    alone = np.zeros(hi - lo, bool)
    node, d, found = np.zeros(len(live), np.int64), 0, []
    while len(live):
        inside = live + lo + d < len(buf)
        live, node = live[inside], node[inside]
        step = base[node] + buf[live + lo + d]
        ok = (base[node] >= 0) & (check[step] == node)
        live, node = live[ok], step[ok]
        d += 1
        got = value[node] >= 0
        at = live[got]
        alone[at[char[at] == d]] = True
        found.append((at, np.full(len(at), d), value[node[got]]))
    rest = np.flatnonzero(~alone & (char > 0))
    found.append((rest, char[rest], np.full(len(rest), -1)))
    start, length, ids = (np.concatenate([f[i] for f in found]) for i in range(3))
    order = np.argsort(start, kind="stable")
    return start[order], length[order], ids[order]


def viterbi_long(v: Vocabulary, word: bytes) -> np.ndarray:
    """The best pieces of one long word; the same as ``viterbi`` finds, which relaxes in the same order."""
    n, reach = len(word), max(4, v.longest)
    buf = np.frombuffer(word, np.uint8).astype(np.int64)
    back, piece = bytearray(n + 1), array("i", bytes(4 * (n + 1)))  # no piece of a file is longer than 255 bytes
    best = [0.0] + [-np.inf] * (WINDOW + reach)
    scores = np.append(v.scores, v.unknown_score)
    for lo in range(0, n, WINDOW):
        start, length, ids = _edges(v, buf, lo, min(lo + WINDOW, n))
        for s, d, i, x in zip(start.tolist(), length.tolist(), ids.tolist(), scores[ids].tolist(), strict=True):
            x += best[s]
            if x > best[s + d]:
                best[s + d] = x
                back[lo + s + d], piece[lo + s + d] = d, i
        best = best[WINDOW:] + [-np.inf] * WINDOW
    out = []
    while n:
        d, i = back[n], piece[n]
        if i >= 0:
            out.append(i)
        else:
            out += [int(v.byte_ids[b]) for b in reversed(word[n - d : n])]
        n -= d
    return np.array(out[::-1], np.int32)


class Encoder:
    """Encodes texts; keeps the segmentations of the last ``CACHED`` distinct chunks, or ``CACHED_BYTES``, or so."""

    def __init__(self, v: Vocabulary):
        self.v, self.split = v, (_CHUNK if v.parted else _CHUNK_OPEN)
        self._clear()

    def _clear(self):
        self.known: dict[bytes, int] = {}
        self.held = 0
        self.ids, self.starts = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, where each text's begin)``; an empty text has no ids."""
        if len(self.known) > CACHED or self.held > CACHED_BYTES:
            self._clear()
        chunks, count = [], []
        prefix = b" " if self.v.dummy_prefix else b""
        for t in texts:
            got = self.split.findall(prefix + t) if t else []
            chunks += got
            count.append(len(got))
        if not chunks:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        known = self.known
        new = sorted({c for c in chunks if c not in known}, key=len)
        lo = 0
        while lo < len(new):
            hi = lo
            while hi < len(new) and len(new[hi]) <= LONG and (hi == lo or (len(new[hi]) + 8) * (hi - lo + 1) <= 2_000_000):
                hi += 1
            if hi > lo:
                ids, starts = viterbi(self.v, new[lo:hi])
            else:
                hi = lo + 1
                ids = viterbi_long(self.v, new[lo])
                starts = np.array([0, len(ids)])
            self.held += sum(map(len, new[lo:hi]))
            done = self.starts[-1][-1]
            self.ids.append(ids)
            self.starts.append(starts[1:] + done)
            for i, c in enumerate(new[lo:hi], len(known)):
                known[c] = i
            lo = hi
        self.ids, self.starts = [np.concatenate(self.ids)], [np.concatenate(self.starts)]
        ids, starts = self.ids[0], self.starts[0]
        word = np.fromiter((known[c] for c in chunks), np.int64, len(chunks))
        size = starts[word + 1] - starts[word]
        ends = np.cumsum(size)
        out = ids[np.arange(ends[-1]) - np.repeat(ends - size - starts[word], size)]
        return out, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(count)])]


def decode(v: Vocabulary, ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """The texts of ids; pieces without a text, such as control pieces, vanish."""
    size = v.starts[ids + 1] - v.starts[ids]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    buf = v.surface[np.arange(total) - np.repeat(ends - size - v.starts[ids], size)].tobytes()
    cut = np.concatenate([[0], ends])[starts]
    skip = 1 if v.dummy_prefix else 0
    return [buf[a + skip if buf[a : a + 1] == b" " else a : b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def _model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, model_path: str = MODEL, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of ``docs``, ``n_tokens``, ``ids`` and ``round_trip`` (whether decoding restores the text).

    The driver reads the model; executors get its arrays.  Whole texts are encoded; null
    counts as empty, and an empty text has no ids.  Equal texts have equal ids; an empty
    table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(_model(model_path)))
    chosen = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])

    def run(batches):
        encoder = Encoder(shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t.as_buffer().to_pybytes() for t in part.column(part.num_columns - 1)]
                ids, starts = encoder.encode(texts)
                back = decode(shared.value, ids, starts)
                same = pa.array([a == b for a, b in zip(texts, back, strict=True)])
                lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(np.diff(starts)), lists, same], names=[*keep, "n_tokens", "ids", "round_trip"])

    return chosen.mapInArrow(run, (fields + ", " if fields else "") + "n_tokens long, ids array<int>, round_trip boolean")


def decode_documents(encoded: DataFrame, model_path: str = MODEL, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of ``encoded`` and ``text``, decoded from ``ids``; null ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(_model(model_path)))
    chosen = encoded.select(*keep, F.coalesce(F.col("ids").cast("array<int>"), F.expr("array()")).cast("array<int>").alias("ids"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])

    def run(batches):
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            count = np.array([len(x) for x in lists])
            back = decode(shared.value, lists.flatten().to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(count)]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([b.decode("utf-8", "replace") for b in back])], names=[*keep, "text"])

    return chosen.mapInArrow(run, fields + ", text string")
