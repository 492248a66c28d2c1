import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import tokens

from glyphmill.llm import _kernel as k


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aAbé \n\t", max_size=25)), max_size=8))
def test_words_and_lines(texts):
    raw, at = k.flat(pa.array(texts, pa.string()))
    raw = k.LOWER[raw]
    starts, ends, first = k.words(raw, at)
    for i, t in enumerate(texts):
        got = [raw[a:b].tobytes().decode() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)]
        assert got == tokens(t)
    hashes = k.word_hashes(raw, starts, ends)
    known = {}
    for h, a, b in zip(hashes.tolist(), starts, ends, strict=True):
        assert known.setdefault(raw[a:b].tobytes(), h) == h
    assert len(set(known.values())) == len(known)
    bounds, text, number = k.lines(raw, at)
    got = {}
    for a, b, t, n in zip(bounds[:-1], bounds[1:], text.tolist(), number.tolist(), strict=True):
        got.setdefault(t, {})[n] = raw[a:b].tobytes().decode().removesuffix("\n")
    for i, t in enumerate(texts):
        assert [got[i][n] for n in range(len(got[i]))] == "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split("\n")


def test_hashes_of_long_words_and_folds():
    rng = np.random.default_rng(1)
    every = {bytes(rng.integers(97, 99, n, dtype=np.uint8)) for n in range(1, 200) for _ in range(3)} | {b"a" * n for n in range(1, 200)}
    raw = np.frombuffer(b" ".join(every) + b" " + b" ".join(every), np.uint8)
    starts, ends, _ = k.words(raw, np.array([0, len(raw)]))
    h = k.word_hashes(raw, starts, ends)
    assert len(set(h.tolist())) == len(every) and np.array_equal(h[: len(every)], h[len(every) :])
    values, first = rng.integers(0, 2**63, 9000).astype(np.uint64), np.array([0, 0, 3, 3, 5000, 9000, 9000])
    assert k.folds(values, first).tolist() == [k.fold(values[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    assert k.folds(values[:0], np.zeros(1, np.int64)).tolist() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 1), st.integers(0, 3), st.integers(0, 2)), max_size=40), st.integers(1, 7))
def test_shared_runs(rows, size):
    rows = sorted(rows)
    kinds = [pa.int64(), pa.int16(), pa.int64(), pa.int64()]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + size], strict=True), kinds, strict=True)], names=["h", "part", "fp", "place"]) for i in range(0, len(rows), size)]
    got = [tuple(r.values()) for b in k.shared_runs(iter(batches)) for r in b.to_pylist()]
    fps = {}
    for h, part, fp, _ in rows:
        fps.setdefault((h, part), set()).add(fp)
    assert got == [r for r in sorted(set(rows)) if r[1] or len(fps[r[:2]]) > 1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=30), st.integers(1, 6))
def test_whole_groups(keys, size):
    keys = sorted(keys)
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + size], pa.int64())], names=["a"]) for i in range(0, len(keys), size)]
    got = [b.column("a").to_pylist() for b in k.whole_groups(iter(batches), ["a"])]
    assert [x for g in got for x in g] == keys
    assert not any(set(a) & set(b) for i, a in enumerate(got) for b in got[i + 1 :])


def test_slices_keep_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 50, "", "c"])], names=["text"])
    got = [b.column("text").to_pylist() for b in k.slices(iter([batch, batch.slice(0, 0)]), "text", 12)]
    assert sum(got, []) == batch.column("text").to_pylist() and len(got) > 1
    assert np.array_equal(k.shingles(np.zeros(0, np.uint64), 5), np.zeros(0, np.uint64))
