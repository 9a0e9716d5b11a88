"""Words of whole texts as hashes, for all texts of an Arrow batch at once.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``.  Texts are cut at white space into
segments of about half a megabyte, so that memory doesn't follow the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_APART = ~np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, at - at[0]


def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(n, SEGMENT)
    if size not in _powers:
        up, down = np.full(size + 1, _BASE), np.full(size + 1, _INVERSE)
        up[0] = down[0] = 1
        made = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > SEGMENT:
            return made
        _powers[size] = made
    return _powers[size]


def segments(buf: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of ``buf`` that split no word."""
    edges = at
    pos, n = 0, len(buf)
    while pos < n:
        end = min(pos + SEGMENT, n)
        if end < n:
            nxt = int(edges[np.searchsorted(edges, end)])
            step = end
            while step < nxt:
                hit = np.flatnonzero(_SPACE[buf[step : min(step + 65536, nxt)]])
                if len(hit):
                    nxt = step + int(hit[0])
                    break
                step += 65536
            end = nxt
        yield pos, end
        pos = end


def spans(buf: np.ndarray, at: np.ndarray, lo: int, hi: int, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and past-last byte of each word in ``buf[lo:hi]``, from ``lo``, and its text's number; ``apart`` tells which bytes part words."""
    ink = ~apart[buf[lo:hi]]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    inside = at[np.searchsorted(at, lo, "right") : np.searchsorted(at, hi, "left")] - lo
    first[inside] = ink[inside]
    last[inside - 1] = ink[inside - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(at, starts + lo, "right") - 1


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """``(hash of each word, number of its text)`` in order; A-Z count as a-z where ``lower``."""
    buf, at = raw(texts)
    hashes, owners = [], []
    for lo, hi in segments(buf, at):
        starts, ends, owner = spans(buf, at, lo, hi)
        part = buf[lo:hi]
        up, down = _powers_of(hi - lo)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((_LOWER[part] if lower else part).astype(np.uint64) * up[: hi - lo], out=sums[1:])
        h = (sums[ends] - sums[starts]) * down[starts]
        hashes.append(mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        owners.append(owner.astype(np.int64))
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def letter_hashes(texts: pa.Array, prefixes: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """As ``word_hashes``, of runs of ASCII letters, digits and bytes above 127; besides whole words, their first so many bytes."""
    buf, at = raw(texts)
    hashes: list[list[np.ndarray]] = [[] for _ in range(len(prefixes) + 1)]
    owners = []
    for lo, hi in segments(buf, at):
        starts, ends, owner = spans(buf, at, lo, hi, _APART)
        up, down = _powers_of(hi - lo)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_LOWER[buf[lo:hi]].astype(np.uint64) * up[: hi - lo], out=sums[1:])
        for level, n in enumerate((*prefixes, None)):
            stop = ends if n is None else np.minimum(ends, starts + n)
            h = (sums[stop] - sums[starts]) * down[starts]
            hashes[level].append(mix(h ^ np.uint64(0x5851F42D4C957F2D >> level)))
        owners.append(owner.astype(np.int64))
    if not owners:
        return [np.zeros(0, np.uint64)] * (len(prefixes) + 1), np.zeros(0, np.int64)
    return [np.concatenate(h) for h in hashes], np.concatenate(owners)


def pieces(batch: pa.RecordBatch, column: str, limit: int = 2 * SEGMENT) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each."""
    _, at = raw(batch.column(batch.schema.get_field_index(column)))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``k``-word shingles of each text, as ``(hashes, where each text's begin)``, ascending.

    A text with fewer words has the whole sequence as its only shingle; one without words has none.
    """
    words, owner = word_hashes(texts)
    n = len(texts)
    count = np.bincount(owner, minlength=n)
    run = np.zeros(0, np.uint64)
    own = np.zeros(0, np.int64)
    if len(words) >= k:
        m = len(words) - k + 1
        run = np.zeros(m, np.uint64)
        for i in range(k):
            run = run * _BASE + words[i : i + m]
        fits = owner[:m] == owner[k - 1 :]
        run, own = mix(run[fits]), owner[:m][fits]
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        first = np.cumsum(count) - count
        total = np.zeros(len(few), np.uint64)
        for i in range(k - 1):
            has = count[few] > i
            total[has] = total[has] * _BASE + words[first[few][has] + i]
        run = np.concatenate([run, mix(total ^ count[few].astype(np.uint64))])
        own = np.concatenate([own, few])
    order = np.lexsort((run, own))
    run, own = run[order], own[order]
    keep = np.ones(len(run), bool)
    keep[1:] = (run[1:] != run[:-1]) | (own[1:] != own[:-1])
    run, own = run[keep], own[keep]
    return run, np.concatenate([[0], np.cumsum(np.bincount(own, minlength=n))])
