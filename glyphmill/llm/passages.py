"""Fuzzy passages that repeat across documents, by seeds, collinear chains and alignment.

1. A run of K words is a seed if its hash is a multiple of KEEP, or if it comes again
   within K words: a property of the words there, so every text keeps or leaves the
   same runs. One that a text repeats is told apart by its rank, so that periodic
   text stays linear.
   Equal texts are one node, known by a fingerprint of its words.
2. Seeds are shuffled by hash, sorted and streamed; those of one text only are
   dropped. The least text of a run is its hub. Seeds of a large share of the texts
   (as a look at some of each slice has it; a hint that changes no pair) are dealt out by text as well, each part with
   a hub of its own, and the parts' hubs are joined to the least of them.
3. Text by text, a seed pairs its text with the hub if some WIDE places around it
   hold MANY shared seeds, SPAN places apart, that are no rarer than itself. Of the
   seeds that two texts share in a stretch the rarest does so, in both. Seeds of a
   common line do not: what is as frequent spans less.
4. The text and the hub meet around that place. Their matching runs are merged along
   diagonals and chained: the best predecessor of each, ending before it in both
   texts, comes from a Fenwick tree of prefix maxima over places in the second text,
   swept along the first; a gap costs GAP for each word it skips in either text.
5. A chain's gaps are aligned by edit distance and its ends extended over words
   that match but for few. A passage is at least LEAST words long on both sides,
   with at most one edit in SLOPPY words, and so are its ends.
6. Texts with a passage between them are one class. A hub whose seeds lie inside
   those of another one there is tried only if its class is still another. Two texts
   that share a passage and are in different classes still share parts of it with
   different hubs, since a hub that has all its seeds, over LEAST words, has a passage
   with either. So of the texts that meet the same two hubs in turn in one stretch, as far
   apart, each is tried with the least one of another class: it has both parts, too.
   All of this is linear in the rows. What can be left out is a link between texts
   whose passage no two hubs cover. Pairs within a class are not listed.

Defined results: null and wordless texts have no passages; texts equal in
their words are copies: each copy but the one of least id is paired with that
one over its whole length if it has LEAST words, and that one with the copy of
greatest id; null ids come first in that order and rows that repeat an id are
rows of their own; an empty table has no passages; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._kernel import LOWER, U64, flat, folds, mix, runs, shingles, slices, whole_groups, word_hashes, words
from ._store import likely, materialize, once_each, settle

K, KEEP = 5, 3
LEAST, SLOPPY = 50, 5
#: Words that a text needs to have any passage.
SHORTEST = LEAST
#: The places of a stretch; the shared seeds that it must hold and the places from the first to the last of them.
WIDE, MANY, SPAN = 51, 3, 18
#: Words that a chain must match.
COVER = 10
GAP = 0.1
#: Words on either side of a chain or stretch that the alignment may extend over; matching words that an edit there must be followed by.
MARGIN, FIRM = 64, 4
#: Steps of the distance between two places, twice what edits may change it by.
GRID = 32
#: How far an end may fall behind one edit in SLOPPY words.
DROP = 15
#: A seed that one in SHARE of the first LOOK texts of slices have is dealt out over PARTS by text; runs longer than LONG rows count as equally frequent.
SHARE, LOOK, PARTS, LONG = 16, 64, 64, 1 << 20


def ranked(seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys, and their places, under which a text's runs meet those of others: the r-th of equal ones meets the r-th, the last also the first."""
    order = np.argsort(seed, kind="stable")
    keys = seed[order]
    cut = runs(keys)
    if len(cut) == len(keys) + 1:
        return keys, order
    many = np.diff(cut)
    rank = np.arange(len(seed)) - np.repeat(cut[:-1], many)
    last = cut[1:][many > 1] - 1
    return np.concatenate((np.where(rank > 0, mix(keys + rank.astype(U64)), keys), keys[last])), np.concatenate((order, order[last]))


def seeds(token: np.ndarray, first: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts as words end to end, first the index of each one's first: text, key, place, and whether it repeats, of the seeds of those wanted."""
    none = np.zeros(0, np.int64)
    if len(token) < K:
        return none, none.astype(U64), none, none.astype(bool)
    text = np.repeat(np.arange(len(wanted)), np.diff(first))
    h = shingles(token, K)
    inside = text[: len(h)] == text[K - 1 :]
    keep = h % U64(KEEP) == 0
    for q in range(1, min(K, len(h))):  # runs that come again at once are too few to leave any out
        keep[q:] |= (h[q:] == h[:-q]) & (text[: len(h) - q] == text[q : len(h)])
    at = np.flatnonzero(keep & inside & wanted[text[: len(h)]])
    text, h = text[at], h[at]
    place = at - first[text]
    own = h + mix(text.astype(U64) + U64(1))  # tells texts apart
    order = np.argsort(own, kind="stable")
    cut = runs(own[order])
    many = np.diff(cut)
    rank = np.empty(len(at), np.int64)
    rank[order] = np.arange(len(at)) - np.repeat(cut[:-1], many)
    last = order[cut[1:][many > 1] - 1] if len(at) else none
    key = np.where(rank > 0, mix(h + rank.astype(U64)), h)
    return np.concatenate((text, text[last])), np.concatenate((key, h[last])), np.concatenate((place, place[last])), np.concatenate((rank > 0, np.ones(len(last), bool)))


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes of all texts, end to end, and the index of each one's first."""
    raw, at = flat(batch.column("text"))
    raw = LOWER[raw]
    starts, ends, first = words(raw, at)
    return word_hashes(raw, starts, ends), first


def _unseen(token: np.ndarray, first: np.ndarray, seen: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint of each text, and whether it is long enough and not in seen, where it goes then."""
    fp = folds(token, first)
    fresh = np.diff(first) >= SHORTEST
    for i in np.flatnonzero(fresh).tolist():
        if (ident := int(fp[i])) in seen:
            fresh[i] = False
        seen.add(ident)
    return fp, fresh


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text; then, with seed, how many of the first LOOK texts of a slice have a seed that one in SHARE of them has, and under 0 how many there are."""
    seen: set[int] = set()
    for batch in slices(batches, "text"):
        token, first = _words(batch)
        fp, fresh = _unseen(token, first, seen)
        some = np.zeros(len(fresh), bool)
        some[np.flatnonzero(fresh)[:LOOK]] = True
        text, key, _, _ = seeds(token, first, some)
        pairs = np.unique(np.stack([key, text.astype(U64)]), axis=1)[0] if len(key) else key
        seed, times = np.unique(pairs, return_counts=True)
        often = np.flatnonzero((times * SHARE >= some.sum()) & (times > 2))
        ids, m = batch.column("doc_id"), len(often) + 1
        ids = pa.concat_arrays([ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids, pa.nulls(m, ids.type)])
        n = np.concatenate((np.diff(first), [some.sum()], times[often]))
        yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(np.concatenate((fp, [0], seed[often].view(np.int64)))), pa.array(np.arange(len(n)) >= len(fp))], names=["doc_id", "n_words", "fp", "seed"])


def _seed_rows(hot: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each text's seeds; those that are hot (sorted) with a part above 0, by text. place: twice the place, and 1 for one that repeats."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, "text"):
            token, first = _words(batch)
            fp, fresh = _unseen(token, first, seen)
            text, key, place, again = seeds(token, first, fresh)
            if not len(key):
                continue
            part = np.zeros(len(key), np.int16)
            if len(hot):
                some = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
                part[some] = 1 + fp[text[some]] % PARTS
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(part), pa.array(fp[text]), pa.array(2 * place + again)], names=["h", "part", "fp", "place"])

    return work


_RUN = "h long, part short, fp long, place long, n int, hub long, hub_place long"


def _starts(*columns: np.ndarray) -> np.ndarray:
    """First index of each run of rows that agree in all columns, then the number of rows."""
    differs = np.zeros(len(columns[0]), bool)
    for c in columns:
        differs[1:] |= c[1:] != c[:-1]
    differs[:1] = True
    return np.append(np.flatnonzero(differs), len(differs))


def _hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by h: those of runs (h, part) with more than one text, or of a part, with their number and the least of them by (fp, place).

    Holds the rows of an h up to LONG; more are passed on as they come, with the
    least of those so far. They, and all parts, count LONG + 1 rows.
    """
    kept: list[np.ndarray] = []
    long: dict[int, tuple[int, int]] = {}  # of the h that is being passed on: each part's hub
    now = None

    def made(own: list[np.ndarray], n: np.ndarray, hub: np.ndarray, hub_place: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*map(pa.array, own), pa.array(n.astype(np.int32)), pa.array(hub), pa.array(hub_place)], names=["h", "part", "fp", "place", "n", "hub", "hub_place"])

    def passed(own: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        cut = _starts(own[1])
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            hub = long.setdefault(int(own[1][a]), (own[2][a], own[3][a]))
            many = np.ones(b - a, np.int64)
            yield made([c[a:b] for c in own], many * (LONG + 1), many * hub[0], many * hub[1])

    def work(own: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal kept, now
        order = np.lexsort((own[3], own[2], own[1], own[0]))
        own = [c[order] for c in own]
        new = _starts(*own)[:-1]
        own, kept = [c[new] for c in own], []
        if now is not None:
            many = int((own[0] == now).sum())  # they come first
            yield from passed([c[:many] for c in own]) if many else ()
            own = [c[many:] for c in own]
            if not len(own[0]):
                return
            now = None
            long.clear()
        h, part, fp, place = own
        end = len(h) if last else int(np.searchsorted(h, h[-1]))  # rows of h that have ended
        cut = _starts(h[:end], part[:end])
        first, size = cut[:-1], np.diff(cut)
        shared = (fp[cut[1:] - 1] != fp[first]) | (part[first] > 0)
        some = np.flatnonzero(np.repeat(shared, size))
        if len(some):
            run = np.repeat(np.arange(len(first)), size)[some]
            n = np.where(part[first] > 0, LONG + 1, np.minimum(size, LONG + 1))
            yield made([c[some] for c in own], n[run], fp[first][run], place[first][run])
        kept = [c[end:] for c in own]
        if len(kept[0]) > LONG:
            now = kept[0][0]
            yield from passed(kept)
            kept = []

    for batch in batches:
        if batch.num_rows:
            own = [batch.column(c).to_numpy() for c in ("h", "part", "fp", "place")]
            yield from work([np.concatenate(c) for c in zip(kept, own, strict=True)] if kept else own, False)
    if kept and len(kept[0]):
        yield from work(kept, True)


def _needed(pos: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether a row's place and key stand, in some WIDE places, with MANY rows in all of no lower key, SPAN places apart.

    Places of different texts are WIDE apart and more; pos is sorted, keys are above 0.
    """
    first = runs(pos)[:-1]
    dense = np.zeros(int(pos[-1]) + WIDE + 1 if len(pos) else 0, np.int32)
    dense[pos[first]] = np.maximum.reduceat(key, first) if len(pos) else 0
    out = np.zeros(len(pos), bool)
    step = np.arange(2 * WIDE - 1, dtype=np.int16)
    near = np.flatnonzero(np.searchsorted(pos, pos + WIDE) - np.searchsorted(pos, pos - WIDE, "right") >= MANY)
    for a in range(0, len(near), 1 << 12):
        rows = near[a : a + (1 << 12)]
        own, least = pos[rows], key[rows]
        high = dense[own[:, None] + (step - (WIDE - 1))[None, :]] >= least[:, None]
        count = np.zeros((len(own), 2 * WIDE), np.int16)
        np.cumsum(high, axis=1, out=count[:, 1:])
        last = np.maximum.accumulate(np.where(high, step, np.int16(-1)), axis=1)[:, WIDE - 1 :]
        begin = np.minimum.accumulate(np.where(high, step, np.int16(4 * WIDE))[:, ::-1], axis=1)[:, ::-1][:, :WIDE]
        out[rows] = ((count[:, WIDE:] - count[:, :WIDE] >= MANY) & (last - begin >= SPAN - 1)).any(axis=1)
    return out


_PAIR = "a long, b long, lo_a long, hi_a long, lo_b long, hi_b long, later boolean, h long"


def _window(place: np.ndarray, other: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """Where the other text may match places low to high of this one, by places where they meet."""
    begin = int((other - (place - low) * (SLOPPY + 1) // SLOPPY).min()) - MARGIN
    return max(0, begin), int((other + (high - place) * (SLOPPY + 1) // SLOPPY).max()) + K + MARGIN


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows by (fp, place): the windows in which texts meet hubs, and each two hubs that a text meets in one stretch.

    In a stretch the hub with most rows comes first; one whose rows lie between
    those of others before it comes later, and so does the least hub of a seed's parts.
    """
    for batch in whole_groups(batches, ["fp"]):
        h, fp, place, n, hub, hub_place, top, top_place = (batch.column(c).to_numpy() for c in ("h", "fp", "place", "n", "hub", "hub_place", "top", "top_place"))
        again, place, hub_place, top_place = place & 1, place >> 1, hub_place >> 1, top_place >> 1
        order = np.lexsort((h, n))
        cut = runs(h[order])
        key = np.empty(len(h), np.int32)
        key[order] = np.repeat(np.arange(1, len(cut), dtype=np.int32), np.diff(cut))
        texts = _starts(fp)
        pos = place + np.repeat(np.r_[0, np.cumsum(place[texts[1:] - 1] + 2 * WIDE)[:-1]] + WIDE, np.diff(texts))
        needed = _needed(pos, key)
        some = np.flatnonzero(needed)
        if not len(some):
            continue
        few = (n > 2) & (again == 0)  # what a text repeats meets many hubs, by rank, and says no more
        every = [c[few] for c in (pos, fp, top, place, place - top_place, needed)]
        pos, fp, place, hub, hub_place, top, top_place = (c[some] for c in (pos, fp, place, hub, hub_place, top, top_place))
        cut = np.append(np.flatnonzero(np.r_[True, np.diff(pos) > WIDE]), len(pos))
        low, high = place[cut[:-1]], place[cut[1:] - 1]
        begin, end = np.maximum(low - MARGIN, 0), high + K + MARGIN
        out: list[tuple] = []
        for j, (s, e) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
            free = np.ones(e - s, bool)
            names, at, times = np.unique(hub[s:e], return_inverse=True, return_counts=True)
            for i in np.argsort(-times, kind="stable").tolist():
                if names[i] != fp[s]:
                    own = np.flatnonzero(at == i)
                    later = not free[own].any()
                    free[own[0] : own[-1] + 1] = False
                    out.append((fp[s], names[i], begin[j], end[j], *_window(place[s:e][own], hub_place[s:e][own], int(low[j]), int(high[j])), later))
            for z in np.unique(top[s:e][top[s:e] != hub[s:e]]):
                if z != fp[s]:
                    own = s + np.flatnonzero(top[s:e] == z)
                    out.append((fp[s], z, begin[j], end[j], *_window(place[own], top_place[own], int(low[j]), int(high[j])), True))
        name = ["a", "b", "lo_a", "hi_a", "lo_b", "hi_b", "later", "h"]
        if out:
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:6]], pa.array(columns[6], pa.bool_()), pa.nulls(len(out), pa.int64())], names=name)
        # the stretch that a row of few lies in, or near
        at = np.searchsorted(pos[cut[:-1]] - WIDE, every[0], "right") - 1
        near = (at >= 0) & (every[0] <= pos[cut[1:] - 1][at] + WIDE)
        if near.any():
            yield from _both(*[c[near] for c in every[1:]], at[near], begin, end, name)


def _both(fp: np.ndarray, top: np.ndarray, place: np.ndarray, diagonal: np.ndarray, needed: np.ndarray, stretch: np.ndarray, begin: np.ndarray, end: np.ndarray, name: list[str]) -> Iterator[pa.RecordBatch]:
    """A row for each two hubs, b and then h, that a text meets within WIDE places of a stretch, one of them at a seed that pairs texts.

    lo_b, hi_b: the steps, on two grids, of how much farther apart the text has
    the places than the hubs. Texts that share both places in a passage have a
    step in common.
    """
    some = np.flatnonzero(top != fp)
    cut = _starts(stretch[some], top[some], needed[some])
    first, last = some[cut[:-1]], some[cut[1:] - 1]
    out: set[tuple] = set()
    seen: dict[tuple[int, bool], tuple[int, int]] = {}
    before = -1
    for own, at, z, good, now, d, until in zip(*(c[first].tolist() for c in (fp, stretch, top, needed, place, diagonal)), place[last].tolist(), strict=True):
        if at != before:
            seen, before = {}, at
        for (y, other), (then, e) in seen.items():
            if y != z and (good or other) and now - then <= WIDE:
                out.add((own, y, z, at, (d - e) // GRID, (d - e + GRID // 2) // GRID))
        seen[z, good] = until, d
    if out:
        a, b, h, at, one, two = (np.array(c, np.int64) for c in zip(*sorted(out), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(begin[at]), pa.array(end[at]), pa.array(one), pa.array(two), pa.nulls(len(a), pa.bool_()), pa.array(h)], names=name)


def segments(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches of K words, merged along diagonals: start in y, start in x, length; by start in y."""
    order = np.lexsort((y, y - x))
    y, x = y[order], x[order]
    cut = np.flatnonzero(np.concatenate(([True], (np.diff(y - x) != 0) | (np.diff(y) > K))))
    last = np.append(cut[1:] - 1, len(y) - 1)
    size = y[last] + K - y[cut]
    by = np.lexsort((x[cut], y[cut]))
    return y[cut][by], x[cut][by], size[by]


def chains(y: np.ndarray, x: np.ndarray, size: np.ndarray) -> list[list[int]]:
    """The best collinear chains of segments, disjoint, best first; segments by start in y."""
    n = len(y)
    if n == 1:
        return [[0]]
    ends = np.unique(x + size)
    rank_end = (np.searchsorted(ends, x + size) + 1).tolist()
    rank_start = np.searchsorted(ends, x, "right").tolist()  # ends at or before the start
    tree: list[tuple[float, int]] = [(-np.inf, -1)] * (len(ends) + 1)
    score, before = [0.0] * n, [-1] * n
    by_end = np.argsort(y + size, kind="stable").tolist()
    ys, xs, ln = y.tolist(), x.tolist(), size.tolist()
    done = 0
    for i in range(n):
        while done < n and ys[by_end[done]] + ln[by_end[done]] <= ys[i]:  # ends before i starts in y: can precede it
            j = by_end[done]
            value = (score[j] + GAP * (ys[j] + xs[j] + 2 * ln[j]), j)
            r = rank_end[j]
            while r <= len(ends):
                if tree[r] < value:
                    tree[r] = value
                r += r & -r
            done += 1
        best, r = (-np.inf, -1), rank_start[i]
        while r:
            best = max(best, tree[r])
            r -= r & -r
        gain = best[0] - GAP * (ys[i] + xs[i])
        score[i] = ln[i] + max(0.0, gain)
        before[i] = best[1] if gain > 0 else -1
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


def _distance(u: list, v: list) -> int:
    """Edits from u to v; of more than MARGIN words, as many as the longer one has."""
    if max(len(u), len(v)) > MARGIN or not (u and v):
        return max(len(u), len(v))
    row = list(range(len(v) + 1))
    for i, p in enumerate(u, 1):
        left = row[0]
        row[0] = i
        for j, q in enumerate(v, 1):
            left, row[j] = row[j], min(left + (p != q), row[j] + 1, row[j - 1] + 1)
    return row[-1]


_STEPS = ((1, 1, 1), (1, 1, 0), (1, 0, 1), (2, 2, 2), (2, 2, 1), (2, 1, 2), (2, 2, 0), (2, 0, 2), (3, 3, 3))


def _extend(u: list, v: list) -> tuple[int, int, int]:
    """How far u and v match from their start, in each, over edits that FIRM equal words follow; and the edits."""
    i = j = edits = 0
    n, m = len(u), len(v)
    while True:
        while i < n and j < m and u[i] == v[j]:
            i += 1
            j += 1
        for cost, di, dj in _STEPS:
            p = u[i + di : i + di + FIRM]
            if len(p) == FIRM and p == v[j + dj : j + dj + FIRM]:
                i, j, edits = i + di, j + dj, edits + cost
                break
        else:
            return i, j, edits


def align_chain(u: list, v: list, ys: list[int], xs: list[int], size: list[int]) -> list[tuple[int, int, int, int, int]]:
    """The passages in a chain of segments of u and v: start and end in u, in v, and edits.

    A chain with too many edits is cut at its worst gap.
    """
    gap = [_distance(u[ys[k - 1] + size[k - 1] : ys[k]], v[xs[k - 1] + size[k - 1] : xs[k]]) for k in range(1, len(ys))]
    todo, out = [(0, len(ys))], []
    while todo:
        a, b = todo.pop()
        s, e, t, f, edits = _passage(u, v, ys[a:b], xs[a:b], size[a:b], sum(gap[a : b - 1]))
        long = min(e - s, f - t)
        if long < LEAST:
            s, e, t, f, edits = _stretched(u, v, ys[a:b], xs[a:b], size[a:b], sum(gap[a : b - 1]))
            long = min(e - s, f - t)
        if long >= LEAST and edits * SLOPPY <= long:
            out.append((s, e, t, f, edits))
        elif b - a > 1:
            worst = max(range(a, b - 1), key=gap.__getitem__) + 1
            todo += [(a, worst), (worst, b)]
    return out


def _passage(u: list, v: list, ys: list[int], xs: list[int], size: list[int], edits: int) -> tuple[int, int, int, int, int]:
    i, j, e = _extend(u[: ys[0]][::-1], v[: xs[0]][::-1])
    p, q, f = _extend(u[ys[-1] + size[-1] :], v[xs[-1] + size[-1] :])
    return ys[0] - i, ys[-1] + size[-1] + p, xs[0] - j, xs[-1] + size[-1] + q, edits + e + f


def _reaches(u: list, v: list) -> list[tuple[int, int, int]]:
    """How far u and v match from their start, in each, with e edits, and e; while one edit in SLOPPY words is in reach."""
    far, out = {}, [(0, 0, 0)]
    for e in range(LEAST // SLOPPY + 1):
        new, best = {}, -1
        for d in range(-e, e + 1):  # v's place less u's
            i = max(far.get(d, -2) + 1, far.get(d - 1, -1), far.get(d + 1, -2) + 1) if e else 0
            i = min(i, len(u), len(v) - d)
            if i < 0 or i + d < 0:
                continue
            start = i
            while i < len(u) and i + d < len(v) and u[i] == v[i + d]:
                i += 1
            new[d] = i
            best = max(best, min(i, i + d))
            if i > start and min(i, i + d) >= SLOPPY * e:  # ends on a match, with no more edits than a passage has
                out.append((i, i + d, e))
        far = new
        if best < SLOPPY * e - DROP:
            break
    return out


def _stretched(u: list, v: list, ys: list[int], xs: list[int], size: list[int], edits: int) -> tuple[int, int, int, int, int]:
    """As _passage, by the longest ends that have one edit in SLOPPY words themselves, for chains that FIRM ends leave too short."""
    y, x = ys[-1] + size[-1], xs[-1] + size[-1]
    before = _reaches(u[max(0, ys[0] - MARGIN) : ys[0]][::-1], v[max(0, xs[0] - MARGIN) : xs[0]][::-1])
    after = _reaches(u[y : y + MARGIN], v[x : x + MARGIN])
    i, j, e = max(before, key=lambda r: (min(r[:2]), -r[2]))
    p, q, f = max(after, key=lambda r: (min(r[:2]), -r[2]))
    return ys[0] - i, y + p, xs[0] - j, x + q, edits + e + f


def matches(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in u and in v of the runs of K words that both have, repeats met as ranked() says."""
    if min(len(u), len(v)) < K:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    (h, y), (g, x) = (ranked(shingles(s, K)) for s in (u, v))
    if len(g) + len(h) == len(u) + len(v) - 2 * (K - 1):  # no repeats: keys are sorted and each is there once
        at = np.minimum(np.searchsorted(g, h), len(g) - 1)
        same = g[at] == h
        return y[same], x[at[same]]
    order = np.argsort(g, kind="stable")
    g, x = g[order], x[order]
    low, high = np.searchsorted(g, h, "left"), np.searchsorted(g, h, "right")
    many = high - low  # 2 at most on either side: keys tell repeats apart
    inner = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    return np.repeat(y, many), x[inner]


def passages(u: np.ndarray, v: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """The passages between two word sequences: start and end in u, in v, and edits."""
    y, x = matches(u, v)
    if len(y) < MANY:
        return []
    own, out = segments(y, x), []
    u, v = u.tolist(), v.tolist()
    for chain in chains(*own):
        s, t, n = (c[chain] for c in own)
        if n.sum() < COVER or any(a <= s[0] and s[-1] + n[-1] <= b for a, b, *_ in out):
            continue
        out += align_chain(u, v, s.tolist(), t.tolist(), n.tolist())
    return out


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with their windows' words: each passage."""
    for batch in batches:
        good = []
        scalar = [batch.column(c).to_pylist() for c in ("a", "b", "lo_a", "lo_b")]
        listed = [(batch.column(c).offsets.to_numpy(), batch.column(c).values.to_numpy().view(np.uint32).astype(U64)) for c in ("u", "v")]
        for i, (a, b, lo_a, lo_b) in enumerate(zip(*scalar, strict=True)):
            u, v = (c[at[i] : at[i + 1]] for at, c in listed)
            good += [(a, b, lo_a + s, lo_a + e, lo_b + t, lo_b + f, edits) for s, e, t, f, edits in passages(u, v)]
        if good:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*good, strict=True)], names=["a", "b", "start_a", "end_a", "start_b", "end_b", "edits"])


_FOUND = "a long, b long, start_a long, end_a long, start_b long, end_b long, edits long"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in slices(batches, "text"):
        token, first = _words(batch)
        fp, fresh = _unseen(token, first, seen)
        if fresh.any():
            size = np.diff(first)[fresh]
            own = (token[np.repeat(fresh, np.diff(first))] >> U64(32)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(fp[fresh]), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(own))], names=["fp", "values"])


def _between(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """The passages in the windows of pairs (a, b, lo_a, hi_a, lo_b, hi_b)."""
    cut = lambda side: F.slice("values", F.col(f"lo_{side}").cast("int") + 1, (F.col(f"hi_{side}") - F.col(f"lo_{side}")).cast("int"))
    one = pairs.join(tokens.withColumnRenamed("fp", "a"), "a").withColumn("u", cut("a")).drop("values")
    two = one.join(tokens.withColumnRenamed("fp", "b"), "b").withColumn("v", cut("b"))
    return materialize(two.select("a", "b", "lo_a", "lo_b", "u", "v").mapInArrow(_aligned, _FOUND))


def _class_of(rows: DataFrame, classes: DataFrame, side: str) -> DataFrame:
    """rows with the class of the text in column side, as class_<side>."""
    named = classes.select(F.col("node").alias(side), F.col("component").alias(f"class_{side}"))
    return rows.join(named, side, "left").withColumn(f"class_{side}", F.coalesce(f"class_{side}", side))


def _apart(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of rows (a, b) whose texts are of different classes."""
    return _class_of(_class_of(rows, classes, "a"), classes, "b").filter("class_a <> class_b").drop("class_a", "class_b")


def repeated(texts: DataFrame, hot: np.ndarray) -> DataFrame:
    """Passages between the distinct texts of texts (text), by fingerprint: a, b, their word spans, edits.

    hot: sorted hashes of seeds that are dealt out over PARTS.
    """
    found = texts.select("text").mapInArrow(_seed_rows(hot), "h long, part short, fp long, place long")
    shared = materialize(found.repartition("h", "part").sortWithinPartitions("h").mapInArrow(_hubs, _RUN))
    settle(texts.sparkSession)
    # the hubs of a seed's parts meet the least of them; there are few such seeds, whatever the corpus
    tops = shared.filter("part > 0 AND fp = hub")
    least = F.broadcast(tops.groupBy("h").agg(F.min(F.struct("fp", "place")).alias("top")).select("h", F.col("top.fp").alias("top"), F.col("top.place").alias("top_place")))
    rows = shared.drop("part").withColumns({"top": F.col("hub"), "top_place": F.col("hub_place")})
    if len(hot):
        rows = shared.drop("part").join(least, "h", "left").withColumns({"top": F.coalesce("top", "hub"), "top_place": F.coalesce("top_place", "hub_place")})
        rows = rows.unionByName(tops.drop("part").join(least, "h").withColumns({"hub": F.col("top"), "hub_place": F.col("top_place")}))
    met = materialize(rows.repartition("fp").sortWithinPartitions("fp", "place").mapInArrow(_pairs, _PAIR))
    settle(texts.sparkSession)
    pairs = met.filter("h IS NULL").drop("h")
    wanted = pairs.select(F.col("a").alias("fp")).unionAll(pairs.select("b")).distinct()
    tokens = once_each(likely(texts.select("text").mapInArrow(_tokens, "fp long, values array<int>"), wanted))
    settle(texts.sparkSession)
    made = _between(pairs.filter("NOT later"), tokens)
    classes = components(made.select("a", "b"))
    rest = materialize(_apart(pairs.filter("later"), classes))
    if not rest.isEmpty():
        made = made.unionAll(_between(rest, tokens))
        classes = components(made.select("a", "b"))
    # texts that meet the same two hubs in turn, as far apart, meet the least of them
    step = F.explode(F.array(F.struct(F.lit(0).alias("grid"), F.col("lo_b").alias("at")), F.struct(F.lit(1).alias("grid"), F.col("hi_b").alias("at"))))
    members = _class_of(met.filter("h IS NOT NULL").select("a", "b", "h", F.col("lo_a").alias("lo"), F.col("hi_a").alias("hi"), step.alias("step")), classes, "a")
    first = members.groupBy("b", "h", "step").agg(F.min(F.struct("a", "lo", "hi", "class_a")).alias("k")).select("b", "h", "step", "k.*")
    named = first.withColumnsRenamed({"a": "to", "lo": "lo_b", "hi": "hi_b", "class_a": "class_b"})
    across = members.join(named, ["b", "h", "step"]).filter("class_a <> class_b").groupBy("a", F.col("to").alias("b"))
    across = materialize(across.agg(F.min("lo").alias("lo_a"), F.max("hi").alias("hi_a"), F.min("lo_b").alias("lo_b"), F.max("hi_b").alias("hi_b")))
    return made if across.isEmpty() else made.unionAll(_between(across, tokens))


def find_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, other_id, start_word, end_word, other_start, other_end, edits, kind, class_id.

    kind `passage`: between the documents of least id of two different texts, a row
    for either; kind `copy`: a document whose words equal those of other_id throughout.
    class_id: the least id of all documents that passages and copies connect with this one.
    """
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    made = materialize(texts.mapInArrow(_fingerprints, f"doc_id {kind}, n_words long, fp long, seed boolean"))
    rows = made.filter("NOT seed").drop("seed")
    # few seeds, whatever the corpus: SHARE times those of a text. They only say what is dealt out
    often = made.filter("seed").groupBy(F.col("fp").alias("h")).agg(F.sum("n_words").alias("n"))
    often = materialize(often)
    looked = often.filter("h = 0").agg(F.sum("n")).first()[0] or 0
    hot = np.sort(np.array([r["h"] for r in often.filter(F.col("n") * SHARE >= looked).filter("h <> 0").select("h").toLocalIterator()], np.int64).view(U64))
    found = repeated(texts, hot)
    classes = components(found.select("a", "b"))
    # written, so that the joins are of two plain shuffles and a text of very many copies can be split
    first = rows.filter(F.col("n_words") >= SHORTEST).groupBy("fp").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("greatest"), F.count("*").alias("n"))
    first = materialize(_class_of(first, classes, "fp"))
    ids = materialize(first.groupBy("class_fp").agg(F.min("least").alias("class_id")))
    first = materialize(first.join(ids, "class_fp"))
    name = lambda side: first.select(F.col("fp").alias(side), F.col("least").alias(f"{side}_id"), F.col("class_id").alias(f"{side}_class"))
    pairs = found.join(name("a"), "a").join(name("b"), "b")
    turned = lambda x, y: pairs.select(F.col(f"{x}_id").alias("doc_id"), F.col(f"{y}_id").alias("other_id"), F.col(f"start_{x}").alias("start_word"), F.col(f"end_{x}").alias("end_word"), F.col(f"start_{y}").alias("other_start"), F.col(f"end_{y}").alias("other_end"), "edits", F.lit("passage").alias("kind"), F.col(f"{x}_class").alias("class_id"))
    zero = F.lit(0).cast("long")
    copies = rows.filter(F.col("n_words") >= LEAST).join(first.filter("n > 1"), "fp")
    other = F.when(F.col("doc_id").eqNullSafe(F.col("least")), F.col("greatest")).otherwise(F.col("least"))
    copies = copies.select("doc_id", other.alias("other_id"), zero.alias("start_word"), F.col("n_words").alias("end_word"), zero.alias("other_start"), F.col("n_words").alias("other_end"), zero.alias("edits"), F.lit("copy").alias("kind"), "class_id")
    return turned("a", "b").unionAll(turned("b", "a")).unionAll(copies)
