"""Benchmark passages in documents, by q-gram counts in diagonal bands and banded alignment.

Texts are compared as bytes after lower-casing A-Z and turning each run of ASCII
blanks and punctuation into one blank. A benchmark item of m such bytes occurs
in a document if some stretch of it is at most e = m / 10 edits away (fewer where
the lemma below would say nothing). Items of more than PIECE bytes are searched
by overlapping pieces; items under LEAST bytes are searched as they are, without
edits, from word bound to word bound. So part of an item is found only if it holds
a whole piece.

Q-gram lemma: such an occurrence shares at least t = m - q + 1 - q e q-grams with
the item, on diagonals that lie within e of the one it starts on. The k most
frequent places of an item are left out of the index and t is lowered by k,
which loses nothing. Hits are counted in bands of 4 e + 1 diagonals that overlap
by 2 e, so one band holds any occurrence whole. A band with t hits is verified by
an alignment of the item that stays on the band's diagonals, many bands at once.

The item list is sent to the executors in blocks of BLOCK bytes, each with one
pass over the documents; there is no shuffle.

Defined results: null and empty texts hold nothing, null items are passed over;
ids may be null or repeat, on either side; equal rows give equal rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._kernel import U64, flat, mix, slices, word_hashes

Q, PIECE, STRIDE, LEAST, BLOCK = 8, 400, 200, 24, 4 << 20
#: Edits that an occurrence may have are one in so many bytes.
RATE = 10
#: log2 of the bits of the first test, bands that are aligned at once, and hits that are listed at once.
SIEVE, TOGETHER, HITS = 22, 1024, 1 << 20
#: Added to diagonals to make them positive.
SHIFT = PIECE * 4

_NORMAL = np.arange(256, dtype=np.uint8)
_NORMAL[65:91] += 32
_NORMAL[[c for c in range(128) if not chr(c).isalnum()]] = 32


def normalize(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes to compare, offsets of the texts, and where each byte stood."""
    x = _NORMAL[raw]
    blank = x == 32
    before = np.r_[True, blank[:-1]][: len(x)]
    before[at[:-1][at[:-1] < len(x)]] = True
    keep = ~(blank & before)
    return x[keep], np.concatenate(([0], np.cumsum(keep)))[at], np.flatnonzero(keep)


def qgrams(x: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one integer."""
    n = len(x) - Q + 1
    out = np.empty(max(n, 0), U64)
    for r in range(min(Q, max(n, 0))):
        many = (n - r + Q - 1) // Q
        out[r::Q] = np.frombuffer(x[r : r + many * Q].tobytes(), dtype="<u8")
    return out


@dataclass
class Index:
    """Pieces of items: their bytes, edit bounds and thresholds, and the places of each q-gram."""

    items: list
    pieces: list[np.ndarray]
    #: The pieces end to end, and where each begins and how long it is.
    data: np.ndarray
    start: np.ndarray
    size: np.ndarray
    edits: np.ndarray
    need: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    piece: np.ndarray
    place: np.ndarray
    sieve: np.ndarray
    #: Items of less than LEAST bytes by their bytes, and of those the numbers of words and the sorted hashes.
    short: dict[bytes, list] = field(default_factory=dict)
    spans: list[int] = field(default_factory=list)
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))


def _short(index: Index, short: dict[bytes, list]) -> Index:
    if short:
        size = np.array([len(k) for k in short])
        index.short, index.spans = short, sorted({k.count(b" ") + 1 for k in short})
        index.hashes = np.sort(word_hashes(np.frombuffer(b"".join(short), np.uint8), np.cumsum(size) - size, np.cumsum(size)))
    return index


def build(items: list, texts: list[str | None]) -> Index:
    """The index of a block of items."""
    ids, pieces, short = [], [], {}
    for item, text in zip(items, texts, strict=True):
        raw, at = flat(pa.array([text], pa.string()))
        x, _, _ = normalize(raw, at)
        x = x[:-1] if len(x) and x[-1] == 32 else x
        if 0 < len(x) < LEAST:
            short.setdefault(x.tobytes(), []).append(item)
        starts = list(range(0, max(1, len(x) - PIECE + 1), STRIDE))
        if starts[-1] + PIECE < len(x):
            starts.append(len(x) - PIECE)
        for part in [x[a : a + PIECE] for a in starts]:
            if len(part) >= LEAST:
                ids.append(item)
                pieces.append(part)
    every = [qgrams(p) for p in pieces]
    known, times = np.unique(np.concatenate([np.zeros(0, U64), *every]), return_counts=True)
    edits, need, grams, piece, place = [], [], [], [], []
    for i, (p, own) in enumerate(zip(pieces, every, strict=True)):
        e = max(0, min(len(p) // RATE, (len(own) - 4) // Q))
        t = len(own) - Q * e
        drop = t // 2
        rare = np.argsort(times[np.searchsorted(known, own)], kind="stable")[: len(own) - drop]
        edits.append(e)
        need.append(t - drop)
        grams.append(own[rare])
        piece.append(np.full(len(rare), i))
        place.append(rare)
    none = np.zeros(0, np.int64)
    grams, piece, place = np.concatenate([np.zeros(0, U64), *grams]), np.concatenate([none, *piece]), np.concatenate([none, *place])
    order = np.argsort(grams, kind="stable")
    unique, first = np.unique(grams[order], return_index=True)
    sieve = np.zeros(1 << SIEVE, bool)
    sieve[(mix(unique) >> U64(64 - SIEVE)).astype(np.int64)] = True
    size = np.array([len(p) for p in pieces], np.int64)
    data = np.concatenate([np.zeros(0, np.uint8), *pieces])
    return _short(Index(ids, pieces, data, np.cumsum(size) - size, size, np.array(edits, np.int64), np.array(need, np.int64), unique, np.r_[first, len(grams)].astype(np.int64), piece[order].astype(np.int32), place[order].astype(np.int16), sieve), short)


def _bands(piece: np.ndarray, i: np.ndarray, j: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Keys (band, piece) of hits at place i of the text and j of the piece, and how many hits each has."""
    width = 2 * index.edits[piece] + 1
    diagonal = i - j + SHIFT
    band = diagonal // width
    # band b holds the diagonals from b * width, 4 e + 1 of them: its own and the next band's but the last
    shared = diagonal % width < 2 * index.edits[piece]
    return np.unique(np.concatenate((band, band[shared] - 1)) * len(index.pieces) + np.concatenate((piece, piece[shared])), return_counts=True)


def _candidates(x: np.ndarray, index: Index) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Piece and first diagonal of the bands that have enough hits, some at a time.

    Hits are listed for HITS of them at once; a band is passed on when no later
    place can lie in it, so what is held follows the places of one piece's length.
    """
    own = qgrams(x)
    at = np.flatnonzero(index.sieve[(mix(own) >> U64(64 - SIEVE)).astype(np.int64)])
    i = np.minimum(np.searchsorted(index.grams, own[at]), len(index.grams) - 1)
    good = index.grams[i] == own[at]
    at, i = at[good], i[good]
    many = index.first[i + 1] - index.first[i]
    total = np.cumsum(many)
    cut = np.unique(np.append(np.searchsorted(total, np.arange(0, total[-1], HITS), "right"), len(at))) if len(at) else np.zeros(0, np.int64)
    cut = np.unique(np.append(0, cut))
    key, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        size = many[a:b]
        inner = np.repeat(index.first[i[a:b]] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        new, times = _bands(index.piece[inner].astype(np.int64), np.repeat(at[a:b], size), index.place[inner].astype(np.int64), index)
        key, back = np.unique(np.concatenate((key, new)), return_inverse=True)
        n = np.bincount(back, weights=np.concatenate((n, times))).astype(np.int64)
        piece = key % len(index.pieces)
        first = key // len(index.pieces) * (2 * index.edits[piece] + 1) - SHIFT
        done = np.full(len(key), True) if b == len(at) else first + 4 * index.edits[piece] + 1 + PIECE <= at[b]
        enough = done & (n >= index.need[piece])
        if enough.any():
            yield piece[enough], first[enough]
        key, n = key[~done], n[~done]


def align(x: np.ndarray, low: np.ndarray, high: np.ndarray, first: np.ndarray, piece: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """For each piece the fewest edits to a stretch of x between low and high, and the stretch's end; on 4 e + 1 diagonals from first.

    first is the lowest diagonal (place in x less place in the piece) of the band.
    Row i holds, for each diagonal k, the cost of i bytes of the piece against
    text that ends at place first + k + i. Pairs whose row exceeds the bound go.
    """
    edits, size = index.edits[piece], index.size[piece]
    wide, deep = int(4 * edits.max() + 1), int(size.max())
    big = np.int16(1 << 13)
    k = np.arange(wide)
    steps = np.arange(deep)
    padded = np.where(steps < size[:, None], index.data[np.minimum(index.start[piece][:, None] + steps, len(index.data) - 1)], np.int16(0)).astype(np.int16)
    place = first[:, None] + np.arange(wide + deep)
    room = np.where((place >= low[:, None]) & (place < high[:, None]), x[np.clip(place, 0, len(x) - 1)], np.int16(-1)).astype(np.int16)
    # place - low and high - place of text that ends on diagonal k, before the first byte
    before, after = first[:, None] + k - low[:, None], high[:, None] - first[:, None] - k
    live = k < (4 * edits + 1)[:, None]
    k16 = k.astype(np.int16)
    row = np.where(live & (before >= 0) & (after >= 0), np.int16(0), big)
    best, where = np.full(len(piece), int(big)), np.zeros(len(piece), np.int64)
    alive = np.arange(len(piece))
    for i in range(1, deep + 1):
        outside = ~live | (before < -i) | (after < i)
        same = room[:, i - 1 : i - 1 + wide] == padded[:, i - 1 : i]
        new = row + ~same
        np.minimum(new[:, :-1], row[:, 1:] + np.int16(1), out=new[:, :-1])
        new[outside] = big
        row = np.minimum.accumulate(new - k16, axis=1) + k16
        row[outside] = big
        if (done := size[alive] == i).any():
            at = row[done].argmin(axis=1)
            best[alive[done]] = row[done, at]
            where[alive[done]] = first[alive[done]] + at + i
        if i % 8 == 0:
            stay = (row.min(axis=1) <= edits[alive]) & (size[alive] > i)
            if not stay.any():
                break
            if stay.mean() < 0.7:
                alive, padded, room, before, after, live, row = (c[stay] for c in (alive, padded, room, before, after, live, row))
    return best, where


@dataclass
class Match:
    """An occurrence of an item: its edits, and the end of the stretch in the text's own bytes."""

    text: int
    item: object
    start: int
    end: int
    edits: int


def _search_short(x: np.ndarray, bounds: np.ndarray, origin: np.ndarray, at: np.ndarray, index: Index) -> list[Match]:
    """The places of each short item in each text."""
    word = x != 32
    edge = np.zeros(len(x) + 1, bool)
    edge[bounds] = True
    starts = np.flatnonzero(word & (edge[:-1] | ~np.r_[False, word[:-1]]))
    ends = np.flatnonzero(word & (edge[1:] | ~np.r_[word[1:], False])) + 1
    text = np.searchsorted(bounds, starts, "right") - 1
    found: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
    for many in index.spans:
        a, b = starts[: max(0, len(starts) - many + 1)], ends[many - 1 :]
        own = np.flatnonzero((text[: len(a)] == text[many - 1 :]) & (b - a < LEAST))
        h = word_hashes(x, a[own], b[own])
        some = own[index.hashes[np.minimum(np.searchsorted(index.hashes, h), len(index.hashes) - 1)] == h]
        for i in some.tolist():
            if (key := x[a[i] : b[i]].tobytes()) in index.short:
                places = found.setdefault((int(text[i]), key), [])
                if not places or a[i] >= places[-1][1]:
                    places.append((int(a[i]), int(b[i])))
    return [Match(t, item, int(origin[a] - at[t]), int(origin[b - 1] + 1 - at[t]), 0) for (t, key), places in sorted(found.items()) for item in index.short[key] for a, b in places]


def search(batch: pa.RecordBatch, index: Index) -> list[Match]:
    """The occurrences of each item in each text of the batch; of those that overlap the one of fewest edits."""
    raw, at = flat(batch.column("text"))
    x, bounds, origin = normalize(raw, at)
    short = _search_short(x, bounds, origin, at, index) if index.short and len(x) else []
    if not index.pieces or len(x) < Q:
        return short
    found: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for piece, first in _candidates(x, index):
        # the texts that the band lies in; one at a border is tried in both
        ends = [np.searchsorted(bounds, np.clip(first + o, 0, len(x) - 1), "right") - 1 for o in (0, 4 * index.edits[piece] + index.size[piece])]
        many = ends[1] - ends[0] + 1
        text = np.repeat(ends[0] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        piece, first = np.repeat(piece, many), np.repeat(first, many)
        order = np.argsort(index.size[piece], kind="stable")
        for a in range(0, len(order), TOGETHER):
            own = order[a : a + TOGETHER]
            cost, stop = align(x, bounds[text[own]], bounds[text[own] + 1], first[own], piece[own], index)
            for j in np.flatnonzero(cost <= index.edits[piece[own]]).tolist():
                found.setdefault((int(text[own[j]]), int(piece[own[j]])), []).append((int(cost[j]), int(stop[j])))
    out = []
    for (t, p), ends in sorted(found.items()):
        kept: list[int] = []
        for cost, stop in sorted(set(ends)):  # fewest edits first; stretches that overlap a better one go
            if all(abs(stop - other) >= index.size[p] - cost for other in kept):
                kept.append(stop)
                a = max(int(bounds[t]), stop - int(index.size[p]))
                where = [int(origin[min(max(q, bounds[t]), bounds[t + 1] - 1)]) - int(at[t]) for q in (a, stop - 1)]
                out.append(Match(t, index.items[p], where[0], where[1] + 1, cost))
    return out + short


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list, list]]:
    """The item list in blocks, one at a time on the driver."""
    items, texts, size = [], [], 0
    for r in benchmark.toLocalIterator():
        if r[1] is None:
            continue
        items.append(r[0])
        texts.append(r[1])
        size += len(r[1].encode())
        if size >= BLOCK:
            yield items, texts
            items, texts, size = [], [], 0
    yield items, texts


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, start, end, edits: each place of a document where a benchmark piece occurs.

    start and end are byte offsets in the document's UTF-8; the stretch's start
    is exact up to the edits.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kinds = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    arrow = benchmark.select(benchmark[item_col]).limit(0).toArrow().schema.types[0]
    schema = f"doc_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, start long, end long, edits long"
    made = None
    for items, texts in _blocks(benchmark.select(benchmark[item_col], benchmark[item_text])):
        shared = spark.sparkContext.broadcast(build(items, texts))

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                if found := search(batch, shared.value):
                    ids = batch.column("doc_id").take(pa.array([m.text for m in found]))
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array([m.item for m in found], arrow), *[pa.array([getattr(m, c) for m in found], pa.int64()) for c in ("start", "end", "edits")]],
                        names=["doc_id", "item_id", "start", "end", "edits"],
                    )

        part = rows.mapInArrow(work, schema)
        made = part if made is None else made.unionAll(part)
    return made


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that hold a benchmark item; the test runs beside each row, so ids need not be unique."""
    spark = docs.sparkSession
    names = docs.columns
    kept = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)])
    text = f"c{names.index(text_col)}"
    for items, texts in _blocks(benchmark.select("item_id", "text")):
        shared = spark.sparkContext.broadcast(build(items, texts))

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text):
                bad = {m.text for m in search(pa.RecordBatch.from_arrays([batch.column(text)], names=["text"]), shared.value)}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)]))

        kept = kept.mapInArrow(work, kept.schema)
    return kept.toDF(*names)
