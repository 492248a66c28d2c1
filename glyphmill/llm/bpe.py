"""Byte-level BPE as a bounded-lookahead streaming transducer.

Encoding. From the merge list alone, `sufficient_lookahead` computes how many
bytes to the right of a token's end can still change whether a merge crosses
that end: a merge (u, v) is undone only by an earlier merge whose left operand
lies on the right spine of v and which reaches past v, and that one by a still
earlier one, so ranks fall strictly along a chain and one pass over the list in
rank order finds the longest. `Transducer` therefore holds at most that many
bytes besides one block, emits tokens once they are stable, and never looks
back: a boundary that no merge crosses splits the problem in two. Words shorter
than a block are encoded once and kept in a bounded cache.

Decoding. `Decoder` maps ids to bytes and drives an incremental UTF-8 machine;
invalid sequences become U+FFFD, maximal subparts at a time.

Long texts are cut for the word pattern before a blank that follows a
non-blank: no match of the pattern can span that place.

Defined results: null counts as the empty text, which has no tokens; special
tokens' strings inside a text become their ids, as in the library's default;
other columns are left out; ids of documents may be null or repeated.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._kernel import slices

#: Fixed by the byte-level vocabulary: the pattern that splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a text that the pattern takes at once, bytes of a word between emissions, words kept.
CUT, BLOCK, CACHE = 1 << 16, 1 << 12, 1 << 18


def byte_letters() -> dict[str, int]:
    """The printable stand-in for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class Vocabulary:
    """Tokens by id, the id of each byte, and for a pair of ids its rank and result."""

    tokens: list[bytes]
    single: list[int]
    merges: dict[tuple[int, int], tuple[int, int]]
    special: dict[str, int] = field(default_factory=dict)
    lookahead: int = 0

    def __post_init__(self) -> None:
        self.rank = {pair: rank for pair, (rank, _) in self.merges.items()}
        self.made = {rank: made for rank, made in self.merges.values()}

    @classmethod
    def from_json(cls, text: str) -> Vocabulary:
        spec, letter = json.loads(text), byte_letters()
        ids = spec["model"]["vocab"]
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        tokens = [b""] * (1 + max([*ids.values(), *special.values()]))
        for token, i in ids.items():
            tokens[i] = bytes(letter[c] for c in token)
        for content, i in special.items():
            tokens[i] = content.encode()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in reversed(list(enumerate(pairs)))}
        by_byte = {b: ids[c] for c, b in letter.items()}
        made = cls(tokens, [by_byte[b] for b in range(256)], merges, special)
        made.lookahead = sufficient_lookahead(made)
        return made


def sufficient_lookahead(vocabulary: Vocabulary) -> int:
    """Bytes beyond a token's end after which no merge across that end can come or go."""
    parts = {made: pair for pair, (_, made) in vocabulary.merges.items()}
    reach: dict[int, int] = {}  # by left operand: the farthest byte that a merge seen so far depends on
    for (u, v), _ in sorted(vocabulary.merges.items(), key=lambda x: x[1][0]):
        beyond, spine = 0, v
        while True:
            beyond = max(beyond, reach.get(spine, 0))
            if spine not in parts:
                break
            spine = parts[spine][1]
        reach[u] = max(reach.get(u, 0), len(vocabulary.tokens[v]) + beyond)
    return max(reach.values(), default=0)


def merge_bytes(data: bytes, vocabulary: Vocabulary) -> list[int]:
    """Token ids of one whole word: the lowest rank merges first, leftmost among equals."""
    ids = [vocabulary.single[b] for b in data]
    merges = vocabulary.merges
    if len(ids) < 64:
        none = 1 << 60
        rank, made = vocabulary.rank, vocabulary.made
        ranks = [rank.get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            at = ranks.index(best)
            ids[at] = made[best]
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank.get((ids[at - 1], ids[at]), none)
            if at < len(ranks):
                ranks[at] = rank.get((ids[at], ids[at + 1]), none)
        return ids
    after = list(range(1, len(ids) + 1))
    before = list(range(-1, len(ids) - 1))
    heap = [(merges[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in merges]
    heapify(heap)
    end = len(ids)
    while heap:
        _, i, pair = heappop(heap)
        j = after[i]
        if ids[i] != pair[0] or j >= end or ids[j] != pair[1]:
            continue  # one side has merged since
        ids[i], ids[j] = merges[pair][1], -1
        after[i] = k = after[j]
        if k < end:
            before[k] = i
            if (p := (ids[i], ids[k])) in merges:
                heappush(heap, (merges[p][0], i, p))
        if (h := before[i]) >= 0 and (p := (ids[h], ids[i])) in merges:
            heappush(heap, (merges[p][0], h, p))
    return [x for x in ids if x >= 0]


class Transducer:
    """Takes a word's bytes piece by piece and gives tokens as soon as they are stable."""

    def __init__(self, vocabulary: Vocabulary, block: int = BLOCK):
        self.vocabulary, self.block, self.held = vocabulary, block, bytearray()

    def feed(self, data: bytes) -> Iterator[int]:
        self.held += data
        size = self.vocabulary.lookahead + self.block
        while len(self.held) > size:
            end, done = 0, 0
            for token in merge_bytes(bytes(self.held[:size]), self.vocabulary):
                end += len(self.vocabulary.tokens[token])
                if end > size - self.vocabulary.lookahead:
                    break
                done = end
                yield token
            if not done:  # a token longer than the block
                size *= 2
                continue
            del self.held[:done]

    def finish(self) -> Iterator[int]:
        yield from merge_bytes(bytes(self.held), self.vocabulary)
        self.held.clear()


class Encoder:
    """Texts to ids, with a bounded cache of words."""

    def __init__(self, vocabulary: Vocabulary, cache: int = CACHE):
        self.vocabulary, self.room = vocabulary, cache
        self.words: dict[str, bytes] = {}
        self.split = regex.compile(PATTERN).findall
        marks = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None

    def word(self, word: str) -> bytes:
        """The word's ids as little-endian 32-bit integers."""
        data = word.encode()
        if len(data) <= BLOCK:
            if len(self.words) >= self.room:
                self.words.clear()
            found = self.words[word] = np.array(merge_bytes(data, self.vocabulary), dtype="<u4").tobytes()
            return found
        machine, out = Transducer(self.vocabulary), []
        for at in range(0, len(data), BLOCK):
            out.append(np.fromiter(machine.feed(data[at : at + BLOCK]), dtype="<u4").tobytes())
        out.append(np.fromiter(machine.finish(), dtype="<u4").tobytes())
        return b"".join(out)

    def _plain(self, text: str) -> Iterator[bytes]:
        known, at = self.words, 0
        while at < len(text):
            end = at + CUT
            while end < len(text) and not (text[end].isspace() and not text[end - 1].isspace()):
                end += 1
            found = self.split(text[at:end] if at or end < len(text) else text)
            yield b"".join([known.get(w) or self.word(w) for w in found])
            at = end

    def pieces(self, text: str) -> Iterator[bytes]:
        """The ids of text, as bytes, in order and in bounded pieces."""
        for i, part in enumerate(self.special.split(text) if self.special else [text]):
            if i % 2:
                yield np.array([self.vocabulary.special[part]], dtype="<u4").tobytes()
            else:
                yield from self._plain(part)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(self.pieces(text)), dtype="<u4").tolist()


class Decoder:
    """Ids to text, piece by piece; bytes of an unfinished character are held back."""

    def __init__(self, vocabulary: Vocabulary):
        self.token = vocabulary.tokens.__getitem__
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.token, ids)))

    def finish(self) -> str:
        text = self.state.decode(b"", True)
        self.state.reset()
        return text


_loaded: dict[str, Encoder] = {}


def _load(text: str) -> Encoder:
    """The encoder of a vocabulary, made once in each Python worker."""
    if text not in _loaded:
        _loaded.clear()
        _loaded[text] = Encoder(Vocabulary.from_json(text))
    return _loaded[text]


def read_vocabulary(path: str) -> str:
    """The vocabulary file's text; read on the driver and sent to the executors, so it need not lie there."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_decode(docs: DataFrame, vocabulary_json: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, ids (array of int), decoded (text read back from ids), and the columns of keep. No shuffle."""
    return _mapped(docs, vocabulary_json, id_col, text_col, True, keep or [])


def digests(docs: DataFrame, vocabulary_json: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: as encode_decode, but a document's tokens are never held together."""
    return _mapped(docs, vocabulary_json, id_col, text_col, False, [])


def _mapped(docs: DataFrame, vocabulary_json: str, id_col: str, text_col: str, whole: bool, keep: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_json)

    def steps(encoder: Encoder, text: str) -> Iterator[tuple[bytes, str]]:
        machine = Decoder(encoder.vocabulary)
        for piece in encoder.pieces(text):
            yield piece, machine.feed(np.frombuffer(piece, dtype="<u4").tolist())
        yield b"", machine.finish()

    def values(encoder: Encoder, batch: pa.RecordBatch) -> Iterator[pa.Array]:
        sizes, ids, texts = [0], [], []
        for text in batch.column("_encoded"):
            n, out = 0, []
            for piece, decoded in steps(encoder, text.as_py() or ""):
                n += len(piece) // 4
                ids.append(piece)
                out.append(decoded)
            sizes.append(sizes[-1] + n)
            texts.append("".join(out))
        yield pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))
        yield pa.array(texts, pa.string())

    def hashes(encoder: Encoder, batch: pa.RecordBatch) -> Iterator[pa.Array]:
        found = []
        for text in batch.column("_encoded"):
            n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
            for piece, decoded in steps(encoder, text.as_py() or ""):
                n += len(piece) // 4
                of_ids.update(piece)
                of_text.update(decoded.encode())
            found.append((n, of_ids.hexdigest(), of_text.hexdigest()))
        for column, kind in zip(zip(*found, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True):
            yield pa.array(column, kind)

    source = docs.select(docs[id_col].alias("doc_id"), *[docs[c] for c in keep], docs[text_col].alias("_encoded"))
    schema = source.drop("_encoded").schema
    for name, column in (("ids", T.ArrayType(T.IntegerType())), ("decoded", "string")) if whole else (("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")):
        schema = schema.add(name, column)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _load(shared.value)
        for batch in slices(batches, "_encoded"):
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", *keep)], *(values if whole else hashes)(encoder, batch)], names=names)
        encoder.words.clear()  # a worker outlives the task

    names = schema.names
    return source.mapInArrow(work, schema)
