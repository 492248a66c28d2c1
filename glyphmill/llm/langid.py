"""Language identification by interpolated Kneser-Ney character models.

One model for each language, over letters of lower-cased words (a word is a
run of letters with a start and an end mark; contexts stay inside a word).
Counts of the highest order are raw, those of lower orders count the different
letters before (raw at a word's start), each order has one absolute discount
from its counts of counts. A model is, for each order, a sorted array of 64-bit
n-gram hashes with two columns a language: the interpolated log-probability and
the back-off weight of the n-gram as a context; the languages share the hashes,
and an n-gram that one of them lacks holds what its back-off gives. A text's score in a language is its
cross-entropy in bits a symbol; the lowest wins, ties by name.

Calibration uses a fifth of the sample that no model has seen: the mean and the
spread of the cross-entropy under the right language set the rejection limit
(wider for short texts), and the sharpness of the posterior that is reported
as score is the one with the best likelihood there.

The models are fitted on a bounded sample: about SAMPLE rows a language, those
with the smallest hashes of their ids. Prediction takes every whole text.

Defined results: null texts and texts without a letter give `und` and score 0;
without a labelled row every text does. Rows with a null id are never learned
from. Repeated rows are predicted alike; further columns are not looked at.
"""

from __future__ import annotations

import io
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._kernel import U64, mix, slices

UNKNOWN = "und"
#: Rows of a language that the models are fitted on, on average; the bound of the sample.
SAMPLE = 1500
ORDER = 5
#: Words whose scores a worker keeps.
CACHE = 3 << 17
#: Spreads above the mean cross-entropy at which a text is rejected.
SLACK = 8.0
_START, _END = 2, 3
_find = regex.compile(r"\p{L}+").findall
_PLACE = mix(np.arange(11, 11 + 16, dtype=U64)) | U64(1)


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    return _find(text.lower())


def _grams(words: list[str], order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order the hash of the n-gram that ends at each symbol; each symbol's place in its word; the word's index."""
    joined = "".join(f"\x02{w}\x03" for w in words)
    code = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(U64)
    first = np.flatnonzero(code == _START)
    size = np.diff(np.r_[first, len(code)])
    word = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(code)) - np.repeat(first, size)
    part, total, made = mix(code), np.zeros(len(code), U64), []
    for k in range(order):
        total = total + np.r_[np.zeros(k, U64), part[: len(part) - k]] * _PLACE[k] + U64(k)
        made.append(mix(total))
    return made, place, word


Fitted = list[dict[str, np.ndarray]]


def fit(counts: Counter, order: int = ORDER) -> Fitted:
    """For each order: sorted hashes, log2-probabilities, log2 back-off weights, and the hashes of context and suffix."""
    words = sorted(counts)
    grams, place, word = _grams(words, order)
    weight = np.array([counts[w] for w in words], dtype=np.float64)[word]
    types = []  # for each order: hash, one position, raw count
    for k, g in enumerate(grams):
        real = np.flatnonzero(place >= k)
        keys, at, back = np.unique(g[real], return_index=True, return_inverse=True)
        types.append((keys, real[at], np.bincount(back, weights=weight[real])))
    made: Fitted = []
    for k, (keys, at, raw) in enumerate(types):
        n = raw
        if k + 1 < order:  # different letters before; at a word's start nothing stands before
            left = np.searchsorted(keys, grams[k][types[k + 1][1]])
            n = np.where(place[at] == k, raw, np.bincount(left, minlength=len(keys)))
        predicted = place[at] > 0  # the start mark itself is given
        once, twice = (n[predicted] == 1).sum(), (n[predicted] == 2).sum()
        cut = once / (once + 2 * twice) if once and twice else 0.5
        own = {"keys": keys, "weight": np.zeros(len(keys))}
        if k == 0:
            total, kinds = n[predicted].sum(), predicted.sum()
            own["floor"] = np.array([np.log2(cut * kinds / (kinds + 1) / total)])
            p = np.where(predicted, (np.maximum(n - cut, 0) + cut * kinds / (kinds + 1)) / total, 1.0)
        else:
            before, lower = grams[k - 1], made[-1]
            own["context"], own["suffix"] = before[at - 1], before[at]
            ctx, inv = np.unique(own["context"], return_inverse=True)
            mass, kinds = np.bincount(inv, weights=n), np.bincount(inv)
            share = cut * kinds / mass
            p = np.maximum(n - cut, 0) / mass[inv] + share[inv] * np.exp2(lower["logp"][np.searchsorted(lower["keys"], own["suffix"])])
            lower["weight"][np.searchsorted(lower["keys"], ctx)] = np.log2(share)
        own["logp"] = np.log2(p)
        made.append(own)
    return made


def union(models: list[Fitted]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: the sorted hashes of all models, and a column a model of probabilities and back-off weights."""
    tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for k in range(len(models[0])):
        keys, at = np.unique(np.concatenate([m[k]["keys"] for m in models]), return_index=True)
        logp, weight = np.empty((len(keys), len(models)), np.float32), np.zeros((len(keys), len(models)), np.float32)
        if k:
            low, low_p, low_w = tables[-1]
            context, suffix = (np.searchsorted(low, np.concatenate([m[k][c] for m in models])[at]) for c in ("context", "suffix"))
        for j, m in enumerate(models):
            own = m[k]
            i = np.minimum(np.searchsorted(own["keys"], keys), len(own["keys"]) - 1)
            seen = own["keys"][i] == keys
            other = low_w[context, j] + low_p[suffix, j] if k else own["floor"][0]
            logp[:, j] = np.where(seen, own["logp"][i], other)
            weight[seen, j] = own["weight"][i[seen]]
        tables.append((keys, logp, weight))
    return tables


def bits(words: list[str], tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]], floor: np.ndarray) -> np.ndarray:
    """The code length of each word in bits, a column a model; its end mark counts."""
    grams, place, word = _grams(words, len(tables))
    score, before = np.broadcast_to(floor, (len(place), len(floor))).astype(np.float32), None
    for k, (keys, logp, weight) in enumerate(tables):
        at = np.minimum(np.searchsorted(keys, grams[k]), len(keys) - 1)
        seen = (keys[at] == grams[k]) & (place >= k)
        if k:  # the context is the n-gram of the order below that ends one symbol before
            some = np.flatnonzero((place >= k) & ~seen)
            score[some] += before[some - 1]
        score[seen] = logp[at[seen]]
        if k + 1 < len(tables):
            before = np.where(seen[:, None], weight[at], np.float32(0))
    score[place == 0] = 0
    first = np.flatnonzero(place == 0)
    return -np.add.reduceat(score, first, axis=0) if len(first) else np.zeros((0, len(floor)), np.float32)


def _pack(fitted: Fitted) -> bytes:
    out = io.BytesIO()
    np.savez(out, **{f"{k}_{name}": a for k, own in enumerate(fitted) for name, a in own.items()})
    return out.getvalue()


def _unpack(blob: bytes) -> Fitted:
    made: Fitted = []
    with np.load(io.BytesIO(blob)) as f:
        for name in f.files:
            k, _, own = name.partition("_")
            while len(made) <= int(k):
                made.append({})
            made[int(k)][own] = f[name]
    return made


class Identifier:
    """Models by language, with what calibration has found."""

    def __init__(self, models: dict[str, Fitted]):
        self.names = sorted(models)
        self.tables = union([models[x] for x in self.names]) if models else []
        self.floor = np.array([models[x][0]["floor"][0] for x in self.names], np.float32)
        self.sharp, self.limits = 16.0, {}
        self.forget()

    def forget(self) -> None:
        """Empties the cache of words."""
        self.known: dict[str, int] = {}
        self.rows = [np.zeros((0, len(self.names)), np.float32)]

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in bits a symbol for each text and language; symbols of each text."""
        listed = [words_of(t) for t in texts]
        sizes = np.array([len(x) for x in listed], dtype=np.int64)
        coded = pa.array([w for x in listed for w in x], pa.string()).dictionary_encode()
        unique = coded.dictionary.to_pylist()
        if len(self.known) + len(unique) > CACHE:
            self.forget()
        new = [w for w in unique if w not in self.known]
        if new:
            start = len(self.known)
            self.known.update(zip(new, range(start, start + len(new)), strict=True))
            self.rows.append(bits(new, self.tables, self.floor))
            if len(self.rows) > 16:
                self.rows = [np.concatenate(self.rows)]
        of_unique = np.concatenate(self.rows)[np.array([self.known[w] for w in unique], dtype=np.int64)] if unique else self.rows[0][:0]
        index = coded.indices.to_numpy().astype(np.int64)
        text = np.repeat(np.arange(len(texts)), sizes)
        symbols = np.bincount(text, weights=np.array([len(w) + 1 for w in unique], dtype=np.float64)[index], minlength=len(texts)) if len(index) else np.zeros(len(texts))
        cost = np.stack([np.bincount(text, weights=of_unique[index, j], minlength=len(texts)) if len(index) else np.zeros(len(texts)) for j in range(len(self.names))], axis=1)
        return cost / np.maximum(symbols, 1)[:, None], symbols

    def calibrate(self, texts: list[str], langs: list[str]) -> None:
        """Limits and sharpness from labelled texts that the models have not seen."""
        entropy, symbols = self.entropies(texts)
        use = symbols > 0
        entropy, symbols, langs = entropy[use], symbols[use], [x for x, u in zip(langs, use, strict=True) if u]
        true = np.array([self.names.index(x) for x in langs], dtype=np.int64)
        own = entropy[np.arange(len(true)), true]
        for j, name in enumerate(self.names):
            mine = true == j
            mean = float(np.average(own[mine], weights=symbols[mine])) if mine.any() else 8.0
            # squared distance times length: what one symbol adds to the variance
            spread = float(np.sqrt(np.quantile((own[mine] - mean) ** 2 * symbols[mine], 0.95))) if mine.any() else 8.0
            self.limits[name] = (mean, max(spread, 1.0))
        if len(true):
            best = min((float(np.mean(_nll(entropy, true, s))), s) for s in 2.0 ** np.arange(0, 9))
            self.sharp = best[1]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool, float]]:
        """Language, posterior, rejection and cross-entropy of each text."""
        blank = [not t or not _find(t) for t in texts]
        if not self.names:
            return [(UNKNOWN, 0.0, True, 0.0)] * len(texts)
        entropy, symbols = self.entropies([t or "" for t in texts])
        odds = -entropy * self.sharp
        odds = np.exp2(odds - odds.max(axis=1, keepdims=True))
        odds /= odds.sum(axis=1, keepdims=True)
        out = []
        for i, j in enumerate(entropy.argmin(axis=1)):
            if blank[i]:
                out.append((UNKNOWN, 0.0, True, 0.0))
                continue
            mean, spread = self.limits.get(self.names[j], (8.0, 8.0))
            far = entropy[i, j] > mean + SLACK * (0.25 + spread / np.sqrt(symbols[i]))
            out.append((self.names[j], float(odds[i, j]), bool(far), float(entropy[i, j])))
        return out


def _nll(entropy: np.ndarray, true: np.ndarray, sharp: float) -> np.ndarray:
    odds = -entropy * sharp
    odds -= odds.max(axis=1, keepdims=True)
    return np.log2(np.exp2(odds).sum(axis=1)) - odds[np.arange(len(true)), true]


def _train(group: pd.DataFrame) -> pd.DataFrame:
    counts: Counter = Counter()
    for text in group.loc[group.fold != 0, "text"]:
        counts.update(words_of(text or ""))
    if not counts:
        for text in group.text:
            counts.update(words_of(text or ""))
    return pd.DataFrame({"lang": [group.lang.iloc[0]], "model": [_pack(fit(counts)) if counts else None]})


def learn(rows: DataFrame, sample: int = SAMPLE) -> Identifier:
    """The identifier fitted on rows (doc_id, text, lang).

    Only the counts of languages, the sampled rows' models and the held-out
    fifth of the sample come to the driver; all are bounded by the number of
    languages times sample.
    """
    rows = rows.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    share = {r["lang"]: min(1.0, sample / r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return Identifier({})
    part = F.coalesce(F.create_map(*[F.lit(x) for kv in share.items() for x in kv])[F.col("lang")], F.lit(0.0))
    unit = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    picked = rows.filter(unit < part).select("lang", "text", F.pmod(F.xxhash64(F.lit("fold"), F.col("doc_id").cast("string")), F.lit(5)).alias("fold"))
    models = picked.groupBy("lang").applyInPandas(_train, "lang string, model binary").filter("model IS NOT NULL").collect()
    made = Identifier({r["lang"]: _unpack(bytes(r["model"])) for r in models})
    held = picked.filter((F.col("fold") == 0) & F.col("text").isNotNull()).select("lang", "text").collect()
    held = [r for r in held if r["lang"] in made.names]
    made.calibrate([r["text"] for r in held], [r["lang"] for r in held])
    made.forget()
    return made


def identify(docs: DataFrame, model: Identifier, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep (all columns but those of the same names) with lang_pred, score, rejected, cross_entropy. No shuffle."""
    added = ("lang_pred", "score", "rejected", "cross_entropy")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*[docs[c] for c in keep], docs[text_col].alias("_text_to_identify"))
    schema = source.drop("_text_to_identify").schema
    for name, kind in zip(added, ("string", "double", "boolean", "double"), strict=True):
        schema = schema.add(name, kind)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, "_text_to_identify"):
            found = own.predict(batch.column("_text_to_identify").to_pylist())
            more = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.string(), pa.float64(), pa.bool_(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *more], names=[*keep, *added])
        own.forget()  # a worker and its broadcasts outlive the task

    return source.mapInArrow(work, schema)


def held_out(doc_id: Column, folds: int = 4) -> Column:
    """Whether the id's checksum puts its row among those never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == 2, F.lit(False))
