"""Line deduplication within an edit bound, by a deletion-neighbourhood join.

A line's symbols are its lower-cased words. Lines of at least MIN_WORDS words
are near copies if one word replaced, inserted or deleted makes them equal;
shorter lines only if they are equal. Of lines that are equal or near copies,
one that has an earlier partner (by id, then line number) goes.

1. Equal lines become one, with its first place; counts are combined before the
   shuffle.
2. With one edit, two lines agree in their first or in their last words, as many
   as half of the longer one's rest. Only lines that share such a half with a
   different line go on. A key's least and greatest line tell whether it is shared,
   so a common one is combined before the shuffle and split when rows meet it.
3. Those emit their deletion neighbourhood: the hash of the line without word i,
   for each i, and of the line itself. Equal keys are joined. Lines that leave
   the same rest at the same i differ in that word alone; a line that is another
   one's rest lacks that one word. So in each (key, i) every line is paired with
   the earliest, and that with the line that is the key: no pair within a bucket
   is missed that could decide whether a line goes, and none else is listed.
4. Pairs meet their words and are verified by edit distance.
5. Documents meet the numbers of the lines they keep.

Defined results: lines without a word are kept as they are; null text stays
null and has no lines; rows that repeat both id and text keep the same lines;
a null id counts as earliest; columns of the input pass through, but for those
named n_lines and n_kept, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._kernel import LOWER, U64, flat, lines, mix, slices, word_hashes, words
from ._store import likely, materialize, once_each, shared_keys

MIN_WORDS = 8
_BASE = np.array([0x9FB21C651E98DF25], dtype=U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse, modulo 2^64."""
    inverse = U64(pow(int(_BASE[0]), -1, 1 << 64))
    up, down = np.full(n + 1, _BASE[0]), np.full(n + 1, inverse)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class _Ranges:
    """Hashes of ranges of a word sequence: equal words, equal hash, wherever the range stands."""

    def __init__(self, token: np.ndarray):
        self.up, self.down = _powers(len(token))
        self.sums = np.concatenate((np.zeros(1, U64), np.cumsum(mix(token) * self.up[:-1])))

    def raw(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.down[a]

    def of(self, a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
        return mix(self.raw(a, b) + (b - a).astype(U64) * U64(0x9E3779B97F4A7C15) + U64(salt))

    def without(self, a: np.ndarray, b: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Of [a, b) without i: the same as of() gives for the rest standing by itself."""
        rest = self.raw(a, i) + self.raw(i + 1, b) * self.up[i - a]
        return mix(rest + (b - a - 1).astype(U64) * U64(0x9E3779B97F4A7C15))


def _parse(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes; of lines with words: first word, end, text and number."""
    raw, at = flat(batch.column("text"))
    raw = LOWER[raw]
    bounds, text, number = lines(raw, at)
    starts, ends, first = words(raw, bounds)
    token = word_hashes(raw, starts, ends)
    a, b = first[:-1], first[1:]
    some = b > a
    return token, a[some], b[some], text[some], number[some]


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        token, a, b, text, number = _parse(batch)
        if not len(a):
            continue
        span = _Ranges(token)
        fp = span.of(a, b).view(np.int64)
        n = b - a
        long = n >= MIN_WORDS
        columns = [pa.array(fp), pa.array(n, pa.int64())]
        for c in ((n - 1) // 2, n // 2):  # as the longer or an equal line, as the shorter by one
            for side in (1, 2):
                key = span.of(a, a + c, 1) if side == 1 else span.of(b - c, b, 2)
                columns.append(pa.array(key.view(np.int64), mask=~long))
        where = pa.array(text)
        columns += [batch.column("doc_id").take(where), batch.column("th").take(where), pa.array(number, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["fp", "n", "k1", "k2", "k3", "k4", "doc_id", "th", "line"])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in slices(batches, "text"):
        token, a, b, _, _ = _parse(batch)
        if not len(a):
            continue
        fp = _Ranges(token).of(a, b).view(np.int64)
        keep = np.zeros(len(a), bool)
        for i in np.flatnonzero(b - a >= MIN_WORDS):
            if (x := int(fp[i])) not in seen:
                keep[i] = True
                seen.add(x)
        a, b = a[keep], b[keep]
        size = b - a
        inner = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        yield pa.RecordBatch.from_arrays([pa.array(fp[keep]), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), pa.array(token[inner].view(np.int64)))], names=["fp", "values"])


def _neighbourhood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each line's keys: without word i as (h, fp, i), itself as (h, fp, -1)."""
    for batch in batches:
        column = batch.column("values")
        at, token = column.offsets.to_numpy().astype(np.int64), column.values.to_numpy().view(U64)
        token, at = token[at[0] : at[-1]], at - at[0]
        a, b = at[:-1], at[1:]
        span, size, fp = _Ranges(token), b - a, batch.column("fp").to_numpy()
        line = np.repeat(np.arange(len(a)), size)
        i = np.arange(len(token))
        keys = np.concatenate((span.without(a[line], b[line], i), span.of(a, b)))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.concatenate((fp[line], fp))), pa.array(np.concatenate((i - a[line], np.full(len(a), -1))))], names=["h", "fp", "place"])


def edit_distance(a: list, b: list, bound: int) -> int:
    """Edits from a to b, or bound + 1 if there are more."""
    if abs(len(a) - len(b)) > bound:
        return bound + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        low, high = max(1, i - bound), min(len(b), i + bound)
        new = [bound + 1] * (len(b) + 1)
        if i <= bound:
            new[0] = i
        for j in range(low, high + 1):
            new[j] = min(row[j - 1] + (x != b[j - 1]), row[j] + 1, new[j - 1] + 1)
        row = new
    return min(row[len(b)], bound + 1)


def _near(u: np.ndarray, v: np.ndarray) -> bool:
    """Whether one edit or none makes u and v equal: what is left between common ends decides."""
    m = min(len(u), len(v))
    differ = np.flatnonzero(u[:m] != v[:m])
    head = int(differ[0]) if len(differ) else m
    differ = np.flatnonzero(u[len(u) - m :][::-1] != v[len(v) - m :][::-1])
    tail = min(int(differ[0]) if len(differ) else m, m - head)
    return edit_distance(u[head : len(u) - tail].tolist(), v[head : len(v) - tail].tolist(), 1) <= 1


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        (ax, x), (ay, y) = ((batch.column(c).offsets.to_numpy(), batch.column(c).values.to_numpy()) for c in ("x", "y"))
        good = [_near(x[ax[i] : ax[i + 1]], y[ay[i] : ay[i + 1]]) for i in range(batch.num_rows)]
        yield batch.select(["later", "earlier"]).filter(pa.array(good, pa.bool_()))


def near_pairs(texts: DataFrame, known: DataFrame) -> DataFrame:
    """later, earlier: fingerprints of verified near copies, for each line that has an earlier one.

    texts has text; known has fp, k1 to k4 and the ordering columns doc_id, th, line.
    """
    halves = known.select("fp", F.explode(F.array_distinct(F.array("k1", "k2", "k3", "k4"))).alias("h")).filter("h IS NOT NULL")
    like = materialize(shared_keys(halves).select("fp").distinct())
    tokens = once_each(likely(texts.mapInArrow(_tokens, "fp long, values array<long>"), like))
    tokens = tokens.join(like, "fp", "left_semi")
    met = shared_keys(materialize(tokens.mapInArrow(_neighbourhood, "h long, fp long, place long")))
    order = F.struct("doc_id", "th", "line").alias("o")
    met = materialize(met.join(known.select("fp", order), "fp"))
    left = met.filter("place >= 0")
    leaders = left.groupBy("h", "place").agg(F.min(F.struct("o", "fp")).alias("lead")).select("h", "place", F.col("lead.fp").alias("lead"), F.col("lead.o").alias("lead_o"))
    itself = met.filter("place < 0").select("h", F.col("fp").alias("whole"), F.col("o").alias("whole_o"))
    same_place = left.join(leaders, ["h", "place"]).filter("fp <> lead").select(F.col("fp").alias("later"), F.col("lead").alias("earlier"))
    first = F.col("lead_o") < F.col("whole_o")
    one_less = leaders.join(itself, "h").select(F.when(first, F.col("whole")).otherwise(F.col("lead")).alias("later"), F.when(first, F.col("lead")).otherwise(F.col("whole")).alias("earlier"))
    pairs = same_place.unionAll(one_less).distinct()
    side = lambda name, own: tokens.select(F.col("fp").alias(name), F.col("values").alias(own))
    return pairs.join(side("later", "x"), "later").join(side("earlier", "y"), "earlier").select("later", "earlier", "x", "y").mapInArrow(_verified, "later long, earlier long")


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, total, kept = [], [], []
        for text, own in zip(batch.column("text").to_pylist(), batch.column("kept").to_pylist(), strict=True):
            parts = [] if text is None else text.split("\n")
            chosen = set(own or ())
            # str.split() also splits at separators that are no word ends here, so blank is told by the word ends
            rest = [p for i, p in enumerate(parts) if i in chosen or not p.strip(" \t\n\x0b\x0c\r")]
            some = len(rest) if chosen else 0
            texts.append(None if text is None else "\n".join(rest) if some or len(rest) == len(parts) else "")
            total.append(len(parts))
            kept.append(len(rest))
        names = batch.schema.names
        columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names if c != "kept"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(kept, pa.int64())], names=[*[c for c in names if c != "kept"], "n_lines", "n_kept"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines that have an earlier copy or near copy taken out of text, and n_lines, n_kept.

    A text all of whose lines with words go becomes empty.
    """
    other = [c for c in docs.columns if c not in (id_col, text_col, "n_lines", "n_kept")]
    plain = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("th"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    found = plain.mapInArrow(_occurrences, f"fp long, n long, k1 long, k2 long, k3 long, k4 long, doc_id {kind}, th long, line long")
    firsts = found.groupBy("fp").agg(F.min(F.struct("doc_id", "th", "line")).alias("o"), *[F.max(k).alias(k) for k in ("k1", "k2", "k3", "k4")])
    firsts = materialize(firsts.select("fp", "o.*", "k1", "k2", "k3", "k4"))
    gone = materialize(near_pairs(plain.select("text"), firsts).select(F.col("later").alias("fp")).distinct())
    stay = firsts.join(gone, "fp", "left_anti")
    kept = stay.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_list(F.col("line").cast("int")).alias("kept"))
    # the columns that pass through get positions for names, so that no name can clash
    named = [docs[c].alias(f"c{i}") for i, c in enumerate(other)]
    full = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), *named).withColumn("_hash", F.xxhash64("text"))
    joined = full.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_th")), "left").drop("_id", "_th", "_hash")
    schema = joined.drop("kept").schema.add("n_lines", "long").add("n_kept", "long")
    back = {"doc_id": id_col, "text": text_col} | {f"c{i}": c for i, c in enumerate(other)}
    made = joined.mapInArrow(_rebuild, schema)
    order = [*docs.columns, "n_lines", "n_kept"]
    forth = {v: k for k, v in back.items()}
    return made.select(*[made[forth.get(c, c)].alias(c) for c in dict.fromkeys(order)])
