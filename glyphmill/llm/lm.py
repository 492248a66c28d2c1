"""Document scores under two models of the corpus: unigrams of words, and PPM over bytes.

PPM. The trie holds the byte contexts of orders 0 to 3 with the counts of the
symbols that follow (256 bytes and one end of text); a text starts after line
feeds. In a context with n symbols of d kinds, a kind seen m times has
probability m / (n + d) and escape has d / (n + d) (method C). After an escape,
the symbols of the longer context are excluded: they no longer count in n and d
of the shorter one. What no order knows is uniform over the symbols left. The
model is pretrained on the training rows, and every node counted there takes part.
Up to order 2 the trie is broadcast, at most 257 * (2^16 + 2^8 + 1) nodes whatever
the corpus; so are the most frequent contexts of order 3, whole, while their nodes
are at most NODES. A worker lays out the code lengths of order 2 as one table;
order 3 corrects them by two lookups a byte. The other contexts of order 3 grow
with the corpus; they are joined, in rows that carry one document's occurrences of
one symbol in one such context.

Unigrams. Every distinct word of the corpus has its count; that table grows with
the corpus and is never collected. The most frequent words, at most HEAD of them,
are broadcast; the others' counts are joined by hash, in rows that carry one
document's occurrences of one rare word.

Defined results: null counts as the empty text, of one token, the end; rows
with a null id belong to the training rows; each input row is scored by itself,
so repeated rows and repeated ids each get a row; without training rows N and V
are 0. Further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._kernel import LOWER, U64, flat, runs, slices, whole_groups, word_hashes, words
from ._store import materialize

SYMBOLS, END, START = 257, 256, 10
#: Most words whose counts are broadcast; distinct keys that a task gathers before it passes them on.
HEAD, GATHER = 1 << 17, 1 << 20
#: Most nodes of order 3 that are broadcast.
NODES = 1 << 21
#: Kinds of rows that are scored: a text's rare word, its own, its symbol in a rare context.
WORD, OWN, NODE = range(3)
#: Stands for the end of a text among word hashes.
END_HASH = -1


def held_out(doc_id: Column, folds: int = 7) -> Column:
    """Whether the id's checksum keeps its row out of training."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == 2, F.lit(False))


def _symbols(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each byte, and of the end after each text's bytes: its key of order 2, its context of order 3, itself."""
    n = len(at) - 1
    text = np.repeat(np.arange(n, dtype=np.int32), np.diff(at) + 1)
    place = np.arange(len(raw) + n, dtype=np.int64) + 3 * (text + 1)  # three line feeds before each text
    stream = np.full(len(raw) + 4 * n, START, np.int32)
    stream[np.arange(len(raw)) + 4 * np.repeat(np.arange(n), np.diff(at)) + 3] = raw
    stream[at[1:] + 4 * np.arange(n) + 3] = END
    symbol, one, two, three = (stream[place - k] for k in range(4))
    low = two << 8 | one
    return low * SYMBOLS + symbol, three << 16 | low, symbol


class _Gather:
    """Counts by key, passed on as (kind, key, n) rows when many keys have come together."""

    def __init__(self, kind: int):
        self.kind, self.parts, self.size = kind, [], 0

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(np.unique(keys, return_counts=True))
        self.size += len(self.parts[-1][0])
        if self.size > GATHER:
            self._merge()

    def _merge(self) -> None:
        keys, back = np.unique(np.concatenate([p[0] for p in self.parts]), return_inverse=True)
        self.parts = [(keys, np.bincount(back, weights=np.concatenate([p[1] for p in self.parts])).astype(np.int64))]
        self.size = len(keys)

    def full(self) -> bool:
        return self.size > GATHER

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        self._merge()
        keys, n = self.parts[0]
        self.parts, self.size = [], 0
        for a in range(0, len(keys), 1 << 16):
            k = keys[a : a + (1 << 16)].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), self.kind, np.int8)), pa.array(k), pa.array(n[a : a + (1 << 16)])], names=["kind", "key", "n"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens, grams, longer, texts = _Gather(0), _Gather(1), _Gather(2), 0
    for batch in slices(batches, "text"):
        raw, at = flat(batch.column("text"))
        raw = LOWER[raw]
        texts += batch.num_rows
        starts, ends, _ = words(raw, at)
        tokens.add(word_hashes(raw, starts, ends).view(np.int64))
        low, context, symbol = _symbols(raw, at)
        grams.add(low)
        longer.add(context.astype(np.int64) * SYMBOLS + symbol)
        for own in (tokens, longer):
            if own.full():
                yield from own.rows()
    if texts:
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int8()), pa.array([END_HASH], pa.int64()), pa.array([texts], pa.int64())], names=["kind", "key", "n"])
    for own in (tokens, grams, longer):
        yield from own.rows()


def code_lengths(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """log10 of the probability of each symbol in each context of two bytes, float32, context-major."""
    ctx, sym = keys // SYMBOLS, keys % SYMBOLS
    low = ctx % 256
    one = np.bincount(low * SYMBOLS + sym, weights=counts, minlength=256 * SYMBOLS).reshape(256, SYMBOLS)
    zero = one.sum(axis=0)
    n0, d0 = zero.sum(), (zero > 0).sum()
    n1, d1 = one.sum(axis=1), (one > 0).sum(axis=1)
    n2, d2 = np.bincount(ctx, weights=counts, minlength=1 << 16), np.bincount(ctx, minlength=1 << 16)
    # what the longer context's symbols take away from the shorter one
    n1x = n1[np.arange(1 << 16) % 256] - np.bincount(ctx, weights=one[low, sym], minlength=1 << 16)
    d1x = d1[np.arange(1 << 16) % 256] - d2
    n0x, d0x = n0 - ((one > 0) * zero).sum(axis=1), d0 - d1

    def escape(n: np.ndarray, d: np.ndarray) -> np.ndarray:
        return np.where(d > 0, d / np.maximum(n + d, 1), 1.0)

    e2, e1, e0 = escape(n2, d2), escape(n1x, d1x), escape(n0x, d0x)
    left = max(SYMBOLS - d0, 1)
    below = np.where(zero > 0, zero / np.maximum(n0x + d0x, 1)[:, None], (e0 / left)[:, None])
    table = np.empty((1 << 16, SYMBOLS), dtype=np.float32)
    for c in range(256):  # the contexts (c, 0) to (c, 255)
        rows = slice(c * 256, c * 256 + 256)
        p = np.where(one > 0, one / np.maximum(n1x[rows] + d1x[rows], 1)[:, None], e1[rows][:, None] * below) * e2[rows][:, None]
        table[rows] = np.log10(np.maximum(p, 1e-300))
    table.reshape(-1)[keys] = np.log10(counts / (n2 + d2)[ctx])
    return table.reshape(-1)


@dataclass
class Head:
    """What is sent to every worker: the frequent words by hash with their counts, N, V and the trie's counts by sorted key; whether contexts are left to the join."""

    hashes: np.ndarray
    counts: np.ndarray
    total: int
    kinds: int
    keys: np.ndarray
    key_counts: np.ndarray
    nodes: np.ndarray
    node_counts: np.ndarray
    more: bool


class Model:
    """The trie, laid out for scoring."""

    def __init__(self, head: Head):
        self.table = code_lengths(head.keys, head.key_counts)
        self.seen = np.zeros(len(self.table), bool)
        self.seen[head.keys] = True
        self.more, self.nodes = head.more, head.nodes
        self.contexts, _, self.node_cost, self.if_seen, self.if_not = corrections(head, head.nodes, head.node_counts)

    def costs(self, low: np.ndarray, context: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the probability of each symbol; which of them are those of order 2, to be corrected by the join."""
        cost = self.table[low]
        rest = np.full(len(cost), self.more)
        if not len(self.nodes):
            return cost, rest
        at = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        some = np.flatnonzero(self.contexts[at] == context)
        rest[some] = False
        at = at[some]
        key = context[some].astype(np.int64) * SYMBOLS + symbol[some]
        node = np.minimum(np.searchsorted(self.nodes, key), len(self.nodes) - 1)
        lower = cost[some] + np.where(self.seen[low[some]], self.if_seen[at], self.if_not[at])
        cost[some] = np.where(self.nodes[node] == key, self.node_cost[node], lower)
        return cost, rest


def corrections(head: Head, nodes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of whole contexts of order 3, nodes by sorted key: the contexts, the index of each node's, each node's cost, and what
    a context adds to the cost at order 2 of a symbol that it has not seen, where order 2 has seen it and where not."""
    n2, d2 = np.bincount(head.keys // SYMBOLS, weights=head.key_counts, minlength=1 << 16), np.bincount(head.keys // SYMBOLS, minlength=1 << 16)
    contexts, inverse = np.unique(nodes // SYMBOLS, return_inverse=True)
    n3, d3 = np.bincount(inverse, weights=counts), np.bincount(inverse)
    low = contexts & 0xFFFF
    cost = np.log10(counts / (n3 + d3)[inverse]).astype(np.float32)
    # order 2 without the symbols that order 3 has told apart
    same = np.searchsorted(head.keys, low[inverse] * SYMBOLS + nodes % SYMBOLS)
    n2x = n2[low] - np.bincount(inverse, weights=head.key_counts[same])
    d2x = d2[low] - d3
    left = np.maximum(n2x + d2x, 1)
    escape = np.log10(d3 / (n3 + d3))
    e2x, e2 = np.where(d2x > 0, d2x / left, 1.0), d2[low] / (n2[low] + d2[low])
    if_seen = (escape + np.log10((n2[low] + d2[low]) / left)).astype(np.float32)
    if_not = (escape + np.log10(np.maximum(e2x, 1e-300) / e2)).astype(np.float32)
    return contexts, inverse, cost, if_seen, if_not


def _context_rows(batches: Iterator[pa.RecordBatch], head: Head) -> Iterator[pa.RecordBatch]:
    """Of nodes (context, key, n) by (context, key): a row for each context."""
    for batch in whole_groups(batches, ["context"]):
        nodes, n = batch.column("key").to_numpy(), batch.column("n").to_numpy().astype(np.float64)
        contexts, inverse, cost, if_seen, if_not = corrections(head, nodes, n)
        at = pa.array(runs(inverse), pa.int32())
        symbols, costs = pa.array((nodes % SYMBOLS).astype(np.int32)), pa.array(cost)
        yield pa.RecordBatch.from_arrays([pa.array(contexts), pa.array(if_seen), pa.array(if_not), pa.ListArray.from_arrays(at, symbols), pa.ListArray.from_arrays(at, costs)], names=["key", "if_seen", "if_not", "symbols", "costs"])


_laid: dict[int, Model] = {}


def _model(ident: int, head: Head) -> Model:
    """The model, laid out once in each Python worker."""
    if ident not in _laid:
        _laid.clear()
        _laid[ident] = Model(head)
    return _laid[ident]


def _slice_rows(batch: pa.RecordBatch, head: Head, model: Model, uid: int) -> pa.RecordBatch:
    """One row for each text with what is broadcast gives, then one for each rare word of each text and for each symbol in a rare context."""
    raw, at = flat(batch.column("text"))
    raw = LOWER[raw]
    n = batch.num_rows
    low, context, symbol = _symbols(raw, at)
    each, rest = model.costs(low, context, symbol)
    bounds = at + np.arange(n + 1)  # each text has its end besides its bytes
    rest = np.flatnonzero(rest)
    rest_text, rest_node = np.searchsorted(bounds, rest, "right") - 1, context[rest].astype(np.int64) * SYMBOLS + symbol[rest]
    order = np.lexsort((rest_node, rest_text))
    rest, rest_text, rest_node = rest[order], rest_text[order], rest_node[order]
    node_cut = np.flatnonzero(np.r_[True, (rest_text[1:] != rest_text[:-1]) | (rest_node[1:] != rest_node[:-1])]) if len(rest) else np.zeros(0, np.int64)
    node_times, node = np.diff(np.r_[node_cut, len(rest)]), rest[node_cut]
    node_cost, node_seen = each[node].astype(np.float64), model.seen[low[node]]
    each[rest] = 0
    cost = np.concatenate(([0.0], np.cumsum(each, dtype=np.float64)))
    score = cost[bounds[1:]] - cost[bounds[:-1]]
    starts, ends, first = words(raw, at)
    token = word_hashes(raw, starts, ends).view(np.int64)
    text = np.repeat(np.arange(n), np.diff(first))
    floor = np.log10(head.total + head.kinds + 1)
    if len(head.hashes):
        where = np.minimum(np.searchsorted(head.hashes, token), len(head.hashes) - 1)
        frequent = head.hashes[where] == token
    else:
        where, frequent = np.zeros(len(token), np.int64), np.zeros(len(token), bool)
    known = np.bincount(text[frequent], minlength=n)
    base = np.bincount(text[frequent], weights=np.log10(head.counts[where[frequent]] + 1.0) - floor, minlength=n) if frequent.any() else np.zeros(n)
    size = np.diff(first) + 1
    order = np.lexsort((token[~frequent], text[~frequent]))
    rare_text, rare = text[~frequent][order], token[~frequent][order]
    cut = np.flatnonzero(np.r_[True, (rare_text[1:] != rare_text[:-1]) | (rare[1:] != rare[:-1])]) if len(rare) else np.zeros(0, np.int64)
    times = np.diff(np.r_[cut, len(rare)])
    m, k = len(cut), len(node)
    uids = np.concatenate((np.arange(uid, uid + n), uid + rare_text[cut], uid + rest_text[node_cut]))
    # a text's own row is joined with nothing: its key spreads it over all tasks
    keys = np.concatenate(((np.arange(uid, uid + n).astype(U64) * U64(0x9E3779B97F4A7C15)).view(np.int64), rare[cut], context[node]))
    kinds = np.repeat(np.array([OWN, WORD, NODE], np.int8), (n, m, k))

    def only(values: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.concat_arrays([pa.array(values, kind), pa.nulls(m + k, kind)])

    def of_node(values: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.concat_arrays([pa.nulls(n + m, kind), pa.array(values, kind)])

    ids = batch.column("doc_id")
    ids = pa.concat_arrays([ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids, pa.nulls(m + k, ids.type)])
    held = pa.concat_arrays([batch.column("held_out"), pa.nulls(m + k, pa.bool_())])
    return pa.RecordBatch.from_arrays(
        [pa.array(uids, pa.int64()), pa.array(keys, pa.int64()), pa.array(kinds), pa.array(np.concatenate((np.ones(n, np.int64), times, node_times)), pa.int64()), ids, held, only(size, pa.int64()), only(known, pa.int64()), only(base, pa.float64()), only(score, pa.float64()), only(np.diff(at), pa.int64()), of_node(symbol[node], pa.int32()), of_node(node_cost, pa.float64()), of_node(node_seen, pa.bool_())],
        names=["uid", "key", "kind", "times", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_bytes", "symbol", "cost", "seen"],
    )


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes for each row of docs.

    training says which rows are learned from. Two passes over docs; the corpus
    counts are one written table.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), (~training).alias("held_out"))
    counted = rows.filter(~F.col("held_out")).select("text").mapInArrow(_count, "kind tinyint, key long, n long")
    counts = materialize(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")))
    vocabulary = counts.filter("kind = 0").select("key", "n")
    # frequent words: whole steps of an eighth of a doubling, from the top, while they fit
    steps = vocabulary.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count("*").alias("kinds"), F.sum("n").alias("total"), F.min("n").alias("least")).collect()
    total, kinds = sum(r["total"] for r in steps), sum(r["kinds"] for r in steps)
    least, fits = None, 0
    for r in sorted(steps, key=lambda r: -r["step"]):
        if (fits := fits + r["kinds"]) > HEAD:
            break
        least = r["least"]
    frequent = vocabulary.filter(F.col("n") >= least).toPandas() if least is not None else vocabulary.limit(0).toPandas()
    end = vocabulary.filter(F.col("key") == END_HASH).collect()
    frequent = frequent[frequent.key != END_HASH].sort_values("key")
    trie = counts.filter("kind = 1").select("key", "n").toPandas().sort_values("key")
    # frequent contexts: as with words, while their nodes fit
    grams = counts.filter("kind = 2").select(F.floor(F.col("key") / SYMBOLS).alias("context"), "key", "n")
    contexts = grams.groupBy("context").agg(F.sum("n").alias("all"), F.count("*").alias("nodes"))
    common, fits, more = None, 0, False
    for r in sorted(contexts.groupBy(F.floor(F.log2("all") * 8).alias("step")).agg(F.sum("nodes").alias("nodes"), F.min("all").alias("least")).collect(), key=lambda r: -r["step"]):
        if (fits := fits + r["nodes"]) > NODES:
            more = True
            break
        common = r["least"]
    split = grams if not more else materialize(grams.join(contexts.select("context", "all"), "context"))
    nodes = (split if not more else split.limit(0) if common is None else split.filter(F.col("all") >= common)).select("key", "n").toPandas().sort_values("key")
    arrays = [x for df in (trie, nodes) for x in (df.key.to_numpy(np.int64), df.n.to_numpy(np.float64))]
    head = Head(frequent.key.to_numpy(np.int64), frequent.n.to_numpy(np.int64), total, kinds, *arrays, more)
    shared = spark.sparkContext.broadcast(head)
    ident = shared._jbroadcast.id() if shared._jbroadcast is not None else id(head)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        model = _model(ident, own)
        uid = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text"):
            yield _slice_rows(batch, own, model, uid)
            uid += batch.num_rows

    kind = rows.schema["doc_id"].dataType.simpleString()
    parts = rows.mapInArrow(work, f"uid long, key long, kind tinyint, times long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long, symbol int, cost double, seen boolean")
    rest = vocabulary if least is None else vocabulary.filter(F.col("n") < least)
    table = rest.select(F.lit(WORD).cast("tinyint").alias("kind"), "key", F.col("n").alias("c"))
    if more:
        left = split if common is None else split.filter(F.col("all") < common)
        made = left.select("context", "key", "n").repartition("context").sortWithinPartitions("context", "key").mapInArrow(lambda batches: _context_rows(batches, shared.value), "key long, if_seen float, if_not float, symbols array<int>, costs array<float>")
        table = table.unionByName(made.withColumn("kind", F.lit(NODE).cast("tinyint")), allowMissingColumns=True)
    joined = parts.join(table, ["kind", "key"], "left").withColumn("own", F.col("kind") == OWN)
    of_score = F.when(F.col("own"), F.col("score"))
    if more:
        at = F.array_position("symbols", F.col("symbol"))
        lower = F.col("cost") + F.coalesce(F.when(F.col("seen"), F.col("if_seen")).otherwise(F.col("if_not")), F.lit(0.0))
        of_score = of_score.when(F.col("kind") == NODE, F.col("times") * F.when(at > 0, F.get("costs", at.cast("int") - 1)).otherwise(lower))
    floor = F.log10(F.lit(float(total + kinds + 1)))
    log = F.when(F.col("own"), F.col("base_score")).when(F.col("kind") == WORD, F.col("times") * (F.log10(F.coalesce(F.col("c"), F.lit(0)) + 1) - floor))
    known = F.when(F.col("own"), F.col("n_known")).otherwise(F.when((F.col("kind") == WORD) & F.col("c").isNotNull(), F.col("times")).otherwise(0))
    first = lambda c: F.max(F.when(F.col("own"), F.col(c))).alias(c)
    summed = joined.groupBy("uid").agg(first("doc_id"), first("held_out"), first("n_tokens"), F.sum(known).alias("n_known"), F.sum(log).alias("base_score"), F.sum(of_score).alias("score"), first("n_bytes"))
    ends = end[0]["n"] if end else 0
    return summed.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.log10(F.lit(ends + 1.0)) - floor).alias("base_score"),
        "score",
        "n_bytes",
    )
