"""Exact Jaccard self-join of documents on word n-grams, by rare-first prefixes.

1. A fixed-size sketch counts all shingles; shingles are ordered by (sketched
   count, hash), the same order everywhere, so any order is right and a good
   one puts rare shingles first.
2. Of a set of n shingles the first n - ceil(t n) + 1 are its prefix; two sets
   that are similar share a shingle of their prefixes. Prefixes are shuffled by
   shingle and sorted there; runs of one shingle are streamed, never held, and
   those with one set only are dropped. Shingles of a large share of the texts, as
   the sketch has it, are dealt out by set as well, and stay.
3. Candidates pass the length filter and the positional filter (enough must
   follow the common shingle, in both sets) and are made distinct. The suffix
   filter takes what follows that shingle in either set's order: the parities of
   two small hash tables of the suffixes differ in at most as many cells as the
   suffixes in values, and what stands before adds the difference of its lengths.
   What passes meets the sets and is verified by intersection, each pair once.
4. For components not every pair is needed: in each run, all sets are first
   paired with one hub, the set with the fewest rarer shingles. Only where a
   run still holds sets of different components, the pairs across components
   follow, all of them that length and position let through: a set is joined with
   the sizes that they leave it, in steps, so that what no filter lets through
   is not listed. No link between different texts is lost; pairs within a
   component are never listed.

Equal sets are one node, known by a 64-bit fingerprint, so copies cost nothing.

Defined results: null and wordless texts have no shingles and are alone, each
its own component; fewer words than the width are one shingle; rows that repeat
an id or a text are rows of the same component; null ids are passed over when
the component's least id is taken (null if it has no other).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._graph import components
from ._kernel import LOWER, U64, flat, fold, shared_runs, shingles, slices, word_hashes, words
from ._store import likely, materialize, once_each

WIDTH, PERCENT = 5, 75
#: Counters of the sketch, and how many a row of partial counts holds.
COUNTERS, CHUNK = 1 << 22, 1 << 18
#: A shingle that one in SHARE texts has is dealt out over PARTS. Steps of size a doubling by which sets across components are joined.
SHARE, PARTS, STEPS = 128, 64, 8


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw, at = flat(batch.column("text"))
    raw = LOWER[raw]
    starts, ends, first = words(raw, at)
    token = word_hashes(raw, starts, ends)
    for a, b in zip(first[:-1], first[1:], strict=True):
        yield np.unique(shingles(token[a:b], width))


def _partial_counts(width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.uint32)
        any_rows = False
        for batch in slices(batches, "text"):
            every = np.concatenate([np.zeros(0, U64), *_sets(batch, width)])
            slots, n = np.unique(every & U64(COUNTERS - 1), return_counts=True)
            total[slots.astype(np.int64)] += n.astype(np.uint32)
            any_rows = True
        if any_rows:
            for i in range(0, COUNTERS, CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array([i // CHUNK], pa.int32()), pa.array([zlib.compress(total[i : i + CHUNK].tobytes(), 1)], pa.binary())], names=["chunk", "counts"])

    return work


def _add_counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the partial counts of each chunk; holds one chunk's sum for each chunk that the task has."""
    total: dict[int, np.ndarray] = {}
    for batch in parts:
        for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts"), strict=True):
            own = np.frombuffer(zlib.decompress(counts.as_py()), np.uint32)
            total[chunk] = total.get(chunk, 0) + own.astype(np.uint64)
    for chunk, n in total.items():
        rank = _rank(n)
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([zlib.compress(rank.tobytes(), 1)], pa.binary())], names=["chunk", "ranks"])


def _rank(n: np.ndarray) -> np.ndarray:
    return np.minimum(255, np.round(8 * np.log2(1.0 + n))).astype(np.uint8)


def sketch(texts: DataFrame, width: int = WIDTH) -> np.ndarray:
    """An eight-bit rank for each counter, by how many sets of all rows have a shingle there."""
    parts = texts.select("text").mapInArrow(_partial_counts(width), "chunk int, counts binary")
    rows = parts.repartition(COUNTERS // CHUNK, "chunk").mapInArrow(_add_counts, "chunk int, ranks binary").collect()
    ranks = np.zeros(COUNTERS, np.uint8)
    for r in rows:
        ranks[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(zlib.decompress(bytes(r["ranks"])), np.uint8)
    return ranks


def prefix_size(n: int, percent: int = PERCENT) -> int:
    """How many of n ordered shingles must be looked at."""
    return n - (percent * n + 99) // 100 + 1


def _ordered(own: np.ndarray, ranks: np.ndarray, many: int) -> np.ndarray:
    """The first many of a set's sorted values by (rank, value)."""
    return own[np.argsort(ranks[(own & U64(COUNTERS - 1)).astype(np.int64)], kind="stable")[:many]]


def _postings(shared, width: int, percent: int, hot: int):
    """Each set's prefix; shingles of rank hot and above with a part above 0, by set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        for batch in slices(batches, "text"):
            out: list[tuple[np.ndarray, ...]] = []
            seen: set[int] = set()
            for own in _sets(batch, width):
                n = len(own)
                if not n or (ident := fold(own)) in seen:
                    continue
                seen.add(ident)
                p = prefix_size(n, percent)
                first = _ordered(own, ranks, p)
                part = np.where(ranks[(first & U64(COUNTERS - 1)).astype(np.int64)] >= hot, 1 + ident % PARTS, 0).astype(np.int16)
                out.append((first.view(np.int64), part, np.full(p, ident, np.int64), (np.int64(n) << 32) + np.arange(p, dtype=np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["h", "part", "fp", "place"])

    return work


_BACK = (1 << 32) - 1


def _size(side: str) -> Column:
    return F.shiftright(f"place{side}", 32)


def _place(side: str) -> Column:
    return F.col(f"place{side}").bitwiseAND(F.lit(_BACK))


def _most(side: str, percent: int) -> Column:
    """The largest set that can be similar to this one, by what follows the common shingle here."""
    return F.floor((100 + percent) * (_size(side) - _place(side)) / F.lit(percent)).cast("long") - _size(side)


def _candidates(both: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs from rows with (fp, place) of two sets under one shingle, by length and position, with a place of either.

    The first shingle that two similar sets have in common leaves enough behind
    it in both; what does so under no common shingle is not similar.
    """
    n, m = _size("1"), _size("2")
    ok = (F.col("fp1") != F.col("fp2")) & (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (m <= _most("1", percent)) & (n <= _most("2", percent))
    at = lambda first, second: F.shiftleft(_place(first), 32) + _place(second)
    rows = both.filter(ok).select(F.least("fp1", "fp2").alias("a"), F.greatest("fp1", "fp2").alias("b"), F.when(F.col("fp1") < F.col("fp2"), at("1", "2")).otherwise(at("2", "1")).alias("at"))
    return rows.groupBy("a", "b").agg(F.min("at").alias("at")).select("a", "b", F.shiftright("at", 32).alias("p"), F.col("at").bitwiseAND(F.lit(_BACK)).alias("q"))


def _across(left: DataFrame, percent: int) -> DataFrame:
    """Pairs under one shingle of rows (h, fp, place, component) of different components, the smaller set first.

    The smaller one is joined by the steps of size from its own to the largest
    that its place leaves it; so pairs that length or position rules out meet
    only within a step.
    """
    step = lambda n: F.floor(F.log2(n.cast("double")) * STEPS)
    side = lambda s: left.select("h", *[F.col(c).alias(f"{c}{s}") for c in ("fp", "place", "component")])
    one = side("1").withColumns({"n1": _size("1"), "most": _most("1", percent)}).filter("most >= n1")
    one = one.withColumn("step", F.explode(F.sequence(step(F.col("n1")), step(F.col("most")))))
    two = side("2").withColumns({"n2": _size("2"), "least2": _most("2", percent)}).withColumn("step", step(F.col("n2")))
    met = one.join(two, ["h", "step"]).filter("(n1 < n2 OR n1 = n2 AND fp1 < fp2) AND n2 <= most AND n1 <= least2 AND component1 <> component2")
    return met.select("fp1", "place1", "fp2", "place2")


def _verify(percent: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("x", "y"):
                column = batch.column(name)
                sides.append((column.offsets.to_numpy(), column.values.to_numpy().view(U64)))
            (ax, x), (ay, y) = sides
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                u, v = x[ax[i] : ax[i + 1]], y[ay[i] : ay[i + 1]]
                common = len(np.intersect1d(u, v, assume_unique=True))
                good[i] = 100 * common >= percent * (len(u) + len(v) - common)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return work


def _sets_of(wanted: DataFrame, texts: DataFrame, width: int, percent: int, shared) -> DataFrame:
    """fp, values, cells, head, size for each fp of wanted: a written table, each fp once. A task passes each fp on once.

    cells: the parity of all values; head: those of the prefix, in order.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, "text"):
            ids, own, cells, heads = [], [], [], []
            for s in _sets(batch, width):
                if len(s) and (ident := fold(s)) not in seen:
                    seen.add(ident)
                    ids.append(ident)
                    own.append(s.view(np.int64))
                    cells.append(parity(s))
                    heads.append(_ordered(s, shared.value, prefix_size(len(s), percent)).view(np.int64))
            if ids:
                listed = lambda parts: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), listed(own), pa.array(cells, pa.binary()), listed(heads), pa.array([len(s) for s in own], pa.int64())], names=["fp", "values", "cells", "head", "size"])

    return once_each(likely(texts.select("text").mapInArrow(emit, "fp long, values array<long>, cells binary, head array<long>, size long"), wanted))


def parity(values: np.ndarray) -> bytes:
    """Whether each cell of a hash table holds an odd number of a set's values; at least two cells a value."""
    cells = max(256, 1 << int(2 * len(values) - 1).bit_length())
    return np.packbits(np.bincount((values & U64(cells - 1)).astype(np.int64), minlength=cells) & 1, bitorder="little").tobytes()


def without(cells: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Parities after values of the set have left it."""
    cells = cells.copy()
    at = (values & U64(8 * len(cells) - 1)).astype(np.int64)
    np.bitwise_xor.at(cells, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return cells


def parity_distance(u: np.ndarray, v: np.ndarray) -> int:
    """At most the number of values that one set has and the other lacks: each turns one cell over."""
    while len(u) != len(v):  # the larger table is folded: cells that agree in the lower bits fall together
        u, v = (u, v) if len(u) > len(v) else (v, u)
        u = u[: len(u) // 2] ^ u[len(u) // 2 :]
    return int(np.bitwise_count(u ^ v).sum())


def _close(percent: int):
    """Suffix filter: pairs whose suffixes' parities leave room for the overlap."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            heads = [(batch.column(c).offsets.to_numpy(), batch.column(c).values.to_numpy().view(U64)) for c in ("s", "t")]
            rows = zip(*[batch.column(c).to_pylist() for c in ("x", "y", "m", "n", "p", "q")], strict=True)
            for i, (x, y, m, n, p, q) in enumerate(rows):
                u, v = (without(np.frombuffer(c, np.uint8), own[at[i] : at[i] + k]) for c, (at, own), k in zip((x, y), heads, (p, q), strict=True))
                room = m + n - 2 * -(-percent * (m + n) // (100 + percent))
                good[i] = abs(p - q) + parity_distance(u, v) <= room
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return work


def _linked(pairs: DataFrame, texts: DataFrame, width: int, percent: int, shared) -> DataFrame:
    """The pairs (a, b, p, q) that are similar."""
    sets = _sets_of(pairs.select(F.col("a").alias("fp")).unionAll(pairs.select("b")), texts, width, percent, shared)
    short = lambda side, own, head, n: sets.select(F.col("fp").alias(side), F.col("cells").alias(own), F.col("head").alias(head), F.col("size").alias(n))
    met = pairs.join(short("a", "x", "s", "m"), "a").withColumn("s", F.slice("s", 1, F.col("p").cast("int")))
    met = met.join(short("b", "y", "t", "n"), "b").withColumn("t", F.slice("t", 1, F.col("q").cast("int")))
    close = materialize(met.select("a", "b", "x", "y", "s", "t", "m", "n", "p", "q").mapInArrow(_close(percent), "a long, b long"))
    both = close.join(sets.select(F.col("fp").alias("a"), F.col("values").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("values").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_verify(percent), "a long, b long")


def link_components(texts: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """node, component of the fingerprints of all sets that are linked with another."""
    spark = texts.sparkSession
    ranks = spark.sparkContext.broadcast(sketch(texts, width))
    hot = int(_rank(np.array([texts.count() / SHARE]))[0])
    postings = texts.select("text").mapInArrow(_postings(ranks, width, percent, max(hot, 1)), "h long, part short, fp long, place long")
    runs = materialize(postings.repartition("h", "part").sortWithinPartitions("h", "part", "fp", "place").mapInArrow(shared_runs, "h long, part short, fp long, place long")).drop("part")
    # the hub has fewest rarer shingles before the common one
    rank = F.shiftleft(F.col("place").bitwiseAND(F.lit(_BACK)), 32) + F.shiftrightunsigned("fp", 32)
    hubs = runs.groupBy("h").agg(F.min_by("fp", rank).alias("fp1"), F.min_by("place", rank).alias("place1"))
    members = runs.select("h", F.col("fp").alias("fp2"), F.col("place").alias("place2"))
    tried = materialize(_candidates(members.join(hubs, "h"), percent))
    links = materialize(_linked(tried, texts, width, percent, ranks))
    # what a run still holds of different components
    found = materialize(components(links))
    named = runs.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    mixed = named.groupBy("h").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least <> most").select("h")
    left = named.join(mixed, "h", "left_semi")
    more = materialize(_candidates(_across(left, percent), percent).join(tried, ["a", "b"], "left_anti"))
    if more.isEmpty():
        return found
    return components(links.unionAll(_linked(more, texts, width, percent, ranks)))


def _fingerprints(width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            own = [(len(s), fold(s)) for s in _sets(batch, width)]
            n, fp = np.array(own, dtype=np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in batch.schema.names if c != "text"], pa.array(n), pa.array(fp)], names=[*[c for c in batch.schema.names if c != "text"], "n_shingles", "fp"])

    return work


def _named(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, fp, component for each row; component is null without shingles."""
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    found = link_components(texts, width, percent)
    rows = materialize(texts.mapInArrow(_fingerprints(width), f"doc_id {kind}, n_shingles long, fp long"))
    own = F.when(F.col("n_shingles") > 0, F.coalesce("component", "fp"))
    return rows.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("doc_id", "n_shingles", "fp", own.alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs."""
    named = _named(docs, id_col, text_col, width, percent)
    # written, so that the join is of two plain shuffles and a component of very many rows can be split
    least = materialize(named.filter("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("least")))
    return named.join(least, "component", "left").select("doc_id", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component, that of least id, then of least columns in order; rows without shingles all stay."""
    named = _named(docs, id_col, text_col, width, percent)
    first = named.filter("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc_id", "fp")).alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k.fp").alias("_fp"))
    names = docs.columns
    plain = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)], docs[text_col].alias("text"))
    schema = plain.drop("text").schema.add("n_shingles", "long").add("fp", "long")
    marked = plain.mapInArrow(_fingerprints(width), schema)
    own = f"c{names.index(id_col)}"
    alone = marked.filter("n_shingles = 0")
    chosen = marked.filter("n_shingles > 0").join(first, (F.col("fp") == F.col("_fp")) & F.col(own).eqNullSafe(F.col("_id")), "left_semi")
    # of rows that repeat the id and the set, the least of all columns stays
    every = [f"c{i}" for i in range(len(names))]
    order = [F.col(c) if _orders(docs.schema[n].dataType) else F.to_json(F.struct(c)) for c, n in zip(every, names, strict=True)]
    chosen = chosen.groupBy("fp", F.col(own).alias("_own")).agg(F.min_by(F.struct(*every), F.struct(*order)).alias("k")).select("k.*")
    return chosen.unionByName(alone.select(*every)).toDF(*names)


def _orders(kind: T.DataType) -> bool:
    """Whether Spark can sort values of this type."""
    if isinstance(kind, T.StructType):
        return all(_orders(f.dataType) for f in kind.fields)
    return _orders(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))
