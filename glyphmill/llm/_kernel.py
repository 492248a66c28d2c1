"""Vectorised text kernels over Arrow string columns, shared by the operators."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Text bytes that a kernel takes at once; one longer text still goes whole.
SLICE_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _constants(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


_PLACE = _constants(64, 29)
#: Bytes that a word has of eight, as masks, and the longest word that is hashed eight bytes at a time.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U64)
LONG_WORD = 64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words end at these bytes.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about limit bytes of text each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(size) - size) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows], strict=True):
            yield batch.slice(int(a), int(b - a))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, end to end, and n + 1 offsets; null counts as empty."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def words(raw: np.ndarray, at: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each text the index of its first word (n + 1 values)."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    inside = ~separator[raw]
    new = np.zeros(len(raw) + 1, dtype=bool)
    new[at] = True
    before = np.r_[False, inside[:-1]]
    after = np.r_[inside[1:], False]
    starts = np.flatnonzero(inside & (~before | new[:-1]))
    ends = np.flatnonzero(inside & (~after | new[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; equal words, equal hashes wherever they stand."""
    size = ends - starts
    if not len(size):
        return np.zeros(0, U64)
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place
    out = mix((eight[starts] & _MASK[np.minimum(size, 8)]) + size.astype(U64) * U64(0x9E3779B97F4A7C15))
    for at in range(8, LONG_WORD, 8):
        rest = np.flatnonzero(size > at)
        if not len(rest):
            break
        out[rest] = mix(out[rest] ^ (eight[starts[rest] + at] & _MASK[np.minimum(size[rest] - at, 8)]) * _PLACE[at // 8])
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def shingles(word: np.ndarray, width: int) -> np.ndarray:
    """Hashes of each run of width words; of the whole sequence if it is shorter; none without words."""
    n = len(word)
    if n == 0:
        return np.zeros(0, U64)
    k = min(n, width)
    total = np.full(n - k + 1, k, dtype=U64)
    for j in range(k):
        total += word[j : n - k + 1 + j] * _PLACE[j]
    return mix(total)


_STEPS = mix(np.arange(1, (1 << 12) + 1, dtype=U64))


def _steps(n: int) -> np.ndarray:
    return _STEPS[:n] if n <= len(_STEPS) else mix(np.arange(1, n + 1, dtype=U64))


def fold(values: np.ndarray) -> int:
    """One signed 64-bit hash of a sequence, by value and place."""
    total = (mix(values ^ _PLACE[0]) * _steps(len(values))).sum(dtype=U64)
    return int(mix(np.array([(int(total) + len(values)) & ((1 << 64) - 1)], dtype=U64)).view(np.int64)[0])


def folds(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """fold() of each of the sequences that stand end to end, first the index of each one's first value."""
    size = np.diff(first)
    step = np.arange(len(values)) - np.repeat(first[:-1], size)
    total = np.concatenate((np.zeros(1, U64), np.cumsum(mix(values ^ _PLACE[0]) * mix(step.astype(U64) + U64(1)))))
    return mix(total[first[1:]] - total[first[:-1]] + size.astype(U64)).view(np.int64)


def runs(key: np.ndarray) -> np.ndarray:
    """First index of each run of equal values, then the length."""
    if not len(key):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))


def shared_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (h, part, fp, place): those of a part above 0, or whose h has more than one fp; equal rows come once.

    Keeps the rows of one h only as long as they have a single fp, then one row.
    """
    kept: pa.RecordBatch | None = None
    done = False  # kept is one row of a run that is known to be shared, and has been given
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = batch if kept is None else pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0]
        h, part, fp, place = (batch.column(c).to_numpy() for c in ("h", "part", "fp", "place"))
        new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (part[1:] != part[:-1]) | (fp[1:] != fp[:-1]) | (place[1:] != place[:-1])])
        h, part, fp = h[new], part[new], fp[new]
        cut = np.append(np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (part[1:] != part[:-1])]), len(h))
        shared = (fp[cut[:-1]] != fp[cut[1:] - 1]) | (part[cut[:-1]] > 0)
        shared[0] |= done
        out = np.repeat(shared, np.diff(cut))
        out[0] &= not done
        done = bool(shared[-1])
        kept = batch.take(pa.array(new[-1:] if done else new[cut[-2] :]))
        if out.any():
            yield batch.take(pa.array(new[out]))


def lines(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts end to end: m + 1 offsets of their lines, the text and the number of each line."""
    feed = np.flatnonzero(raw == 10)
    start = np.concatenate((at[:-1], feed + 1))
    text = np.concatenate((np.arange(len(at) - 1), np.searchsorted(at, feed, "right") - 1))
    order = np.lexsort((start, text))
    text = text[order]
    first = np.searchsorted(text, np.arange(len(at) - 1))
    return np.append(start[order], len(raw)), text, np.arange(len(text)) - first[text]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of rows sorted by keys (longs), cut anew so that rows with equal keys come together.

    Holds a batch and the last group, so a group must fit in memory.
    """
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [batch.column(k).to_numpy() for k in keys]
        differs = np.zeros(batch.num_rows, bool)
        for v in own:
            differs[1:] |= v[1:] != v[:-1]
        differs[0] = not kept or any(kept[-1].column(k)[-1].as_py() != v[0] for k, v in zip(keys, own, strict=True))
        cut = np.flatnonzero(differs)
        if len(cut):
            kept.append(batch.slice(0, int(cut[-1])))
            if sum(b.num_rows for b in kept):
                yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            kept = [batch.slice(int(cut[-1]))]
        else:
            kept.append(batch)
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
