"""Lines, leaks, passages, near duplicates, and the pipeline, against brute force."""

import collections
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import ODD, tokens
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphmill.llm import _graph, _store, line_dedup, ngram_join, passages
from glyphmill.llm import decontaminate as dc


def _find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, i) for i in range(101, 140)] + [(i, i + 1) for i in range(200, 230)]
    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        a, b = _find(parent, a), _find(parent, b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in _graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: _find(parent, x) for e in edges if e[0] != e[1] for x in e}
    assert _graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_likely_loses_nothing(spark):
    rows = spark.range(2000).selectExpr("id * 7919 - 5000000 as fp")
    wanted = rows.limit(300)
    assert _store.likely(rows, wanted).join(wanted, "fp").count() == 300
    assert _store.once_each(rows.unionAll(rows)).count() == 2000


# ---- n-grams


def _sets(rows):
    out = []
    for _, text in rows:
        w = tokens(text)
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def _jaccard_components(rows):
    sets = _sets(rows)
    parent = {i: i for i in range(len(rows))}
    for i, j in itertools.combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
            parent[_find(parent, j)] = _find(parent, i)
    members = collections.defaultdict(list)
    for i in range(len(rows)):
        members[_find(parent, i)].append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return [(rows[i][0], len(sets[i]), rows[i][0] if not sets[i] else least[_find(parent, i)]) for i in range(len(rows))]


def _copies(rng, n, words="a b c d e f g h".split()):
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) for _ in range(n)]
    for _ in range(n):
        t = rng.choice(texts).split()
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
    return texts


@pytest.mark.parametrize("seed", range(2))
def test_near_duplicates(spark, docs, seed):
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(40)]
    near = [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(0, 40, 3)]
    rows = [(i, t) for i, t in enumerate([*ODD, *_copies(rng, 25), *near, " ".join(base)])] + [(None, "some five words or six"), (None, "a b"), (3, "a"), (3, "a")]
    got = ngram_join.near_duplicates(docs(rows, extra=True)).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(_jaccard_components(rows), key=key)


def test_near_duplicates_of_nothing(spark, docs):
    assert ngram_join.near_duplicates(docs([])).count() == 0
    assert [tuple(r) for r in ngram_join.near_duplicates(docs([None])).collect()] == [(0, 0, 0)]


def test_keep_one(spark, docs):
    rows = [(5, "one two three four five six"), (2, "One two three four five six"), (2, "one two three four five six"), (7, None), (8, None), (None, "one two three four five six"), (9, "else"), (4, "")]
    got = ngram_join.keep_one(docs(rows, extra=True))
    assert got.columns == ["doc_id", "text", "fp", "n_lines", "lang"]
    assert [r.text for r in got.collect() if r.doc_id is None] == ["one two three four five six"]
    kept = sorted([(r.doc_id, tokens(r.text)) for r in got.collect()], key=str)
    assert kept == sorted([(None, tokens(rows[0][1])), (7, []), (8, []), (9, ["else"]), (4, [])], key=str)


@settings(max_examples=150, deadline=None)
@given(st.sets(st.integers(0, 500), min_size=1, max_size=200), st.sets(st.integers(0, 500), min_size=1, max_size=200), st.data())
def test_parity_bounds_the_distance_of_suffixes(a, b, data):
    u, v = (np.array(sorted(s), np.uint64) * np.uint64(0x9E3779B97F4A7C15) for s in (a, b))
    p, q = (data.draw(st.integers(0, len(s))) for s in (a, b))
    cells = [ngram_join.without(np.frombuffer(ngram_join.parity(s), np.uint8), s[:k]) for s, k in ((u, p), (v, q))]
    assert ngram_join.parity_distance(*cells) <= len(set(u[p:].tolist()) ^ set(v[q:].tolist()))


def test_sets_that_position_rules_out_do_not_meet(spark):
    n, at = 48, 12  # of equal sizes, with too little behind the common shingle
    rows = [(7, i, (n << 32) + at, i) for i in range(500)]
    left = spark.createDataFrame(rows, "h long, fp long, place long, component long")
    assert ngram_join._across(left, 75).count() == 0
    rng = random.Random(5)
    rows = [(rng.randrange(3), i, (rng.randint(5, 60) << 32) + rng.randint(0, 12), rng.randrange(40)) for i in range(300)]
    left = spark.createDataFrame(rows, "h long, fp long, place long, component long")
    got = {(r.a, r.b) for r in ngram_join._candidates(ngram_join._across(left, 75), 75).collect()}
    want = set()
    for (h, a, x, c), (g, b, y, d) in itertools.combinations(rows, 2):
        n, m, p, q = x >> 32, y >> 32, x & 0xFFFFFFFF, y & 0xFFFFFFFF
        overlap = -(-75 * (n + m) // 175)
        if h == g and c != d and 100 * min(n, m) >= 75 * max(n, m) and min(n - p, m - q) >= overlap:
            want.add((a, b))
    assert got == want and want


def test_shared_keys(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (2, 5, "c"), (2, 6, "d"), (3, 7, "e"), (-2, 1, "f"), (-2, 9, "g")], "h long, fp long, x string")
    assert sorted(r.x for r in _store.shared_keys(rows).collect()) == ["c", "d", "f", "g"]
    assert _store.shared_keys(rows.limit(0)).count() == 0


def test_keep_one_takes_the_least_row(spark):
    rows = [(1, t, x, m) for t, x, m in (("b a c d e F", "x", {"k": 1}), ("B a c d e f", "y", {"k": 2}), ("B a c d e f", "x", {"k": 2}), ("B a c d e f", "x", {"k": 1}))]
    for order in (rows, rows[::-1]):
        table = spark.createDataFrame(order, "doc_id long, text string, source string, more map<string,int>").repartition(3, "source")
        assert [tuple(r) for r in ngram_join.keep_one(table).collect()] == [(1, "B a c d e f", "x", {"k": 1})]


# ---- lines


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


@pytest.mark.parametrize("seed", range(2))
def test_lines(spark, docs, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("a b c a a".split()) for _ in range(rng.randint(1, 12))) for _ in range(12)]
    made = []
    for _ in range(20):
        own = []
        for _ in range(rng.randint(0, 6)):
            w = rng.choice(pool).split()
            if w and rng.random() < 0.5:
                i = rng.randrange(len(w))
                w[i : i + rng.randint(0, 1)] = [[rng.choice("abcz")], []][rng.randint(0, 1)]
            own.append(rng.choice(["", " "]) + " ".join(w))
        made.append("\n".join(own))
    rows = [(i, t) for i, t in enumerate([*ODD, *made])]
    place, texts = {}, {i: t for i, t in rows}
    for i, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            if w := tuple(tokens(line)):
                place[w] = min(place.get(w, (i, n)), (i, n))
    gone = {w for w in place for v in place if min(len(v), len(w)) >= line_dedup.MIN_WORDS and place[v] < place[w] and abs(len(v) - len(w)) <= 1 and _edits(v, w) <= 1}
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs(rows, extra=True)).collect()}
    assert len(got) == len(rows)
    for i, t in texts.items():
        parts = [] if t is None else t.split("\n")
        keep = [x for n, x in enumerate(parts) if not tokens(x) or (place[tuple(tokens(x))] == (i, n) and tuple(tokens(x)) not in gone)]
        whole = any(tokens(x) for x in keep) or len(keep) == len(parts)
        assert got[i].text == (None if t is None else "\n".join(keep) if whole else ""), (t, keep)
        assert got[i].n_lines == len(parts) and got[i].fp == "k"


def test_lines_of_odd_ids(spark, docs):
    rows = [(None, "x y\nz"), (1, "x y\nq"), (1, "x y\nq"), (1, "r\nx y")]
    got = sorted((str(r.doc_id), r.text) for r in line_dedup.dedup_lines(docs(rows)).collect())
    assert got == sorted([("None", "x y\nz"), ("1", "q"), ("1", "q"), ("1", "r")])
    assert line_dedup.dedup_lines(docs([])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=9), st.lists(st.integers(0, 2), max_size=9))
def test_edit_distances(a, b):
    assert line_dedup.edit_distance(a, b, 3) == min(4, _edits(a, b))
    assert line_dedup._near(np.array(a, np.int64), np.array(b, np.int64)) == (_edits(a, b) <= 1)


# ---- benchmark passages


def _stretch_edits(p, t):
    row = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        new = [i]
        for j, y in enumerate(t, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("hits", [1 << 20, 50])
@pytest.mark.parametrize("seed", range(8))
def test_leaks_are_those_of_brute_force(seed, hits, monkeypatch):
    monkeypatch.setattr(dc, "HITS", hits)
    rng = random.Random(seed)
    vocabulary = "the erha onthe tion re and wh eré not x ingly".split()
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [make(rng.randint(5, 90)) for _ in range(4)]
    index = dc.build(list(range(4)), items)
    texts = []
    for _ in range(6):
        item = list(rng.choice(items))
        for _ in range(rng.randint(0, len(item) // 8)):
            at = rng.randrange(len(item))
            item[at : at + rng.randint(0, 1)] = rng.choice([[], ["z"]])
        texts.append(make(rng.randint(0, 40)) + rng.choice([" ", ", ", "\n"]) + "".join(item).upper() + " " + make(rng.randint(0, 40)))
    got = {(m.text, m.item) for m in dc.search(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]), index)}
    want = set()
    for i, t in enumerate(texts):
        x, _, _ = dc.normalize(*dc.flat(pa.array([t])))
        want |= {(i, index.items[k]) for k, p in enumerate(index.pieces) if _stretch_edits(p.tolist(), x.tolist()) <= index.edits[k]}
    assert got == want and got


def test_leak_tables(spark, docs):
    item = "Where does the old river bend before it meets the sea, and who has seen it do so?"
    long = " ".join(f"word{i}" for i in range(200))
    benchmark = spark.createDataFrame([(1, item), (2, None), (3, "short"), (4, ""), (5, long)], "item_id long, text string")
    rows = [(i, t) for i, t in enumerate([*ODD, "So: " + item.upper() + " Yes.", item.replace("river", "rivver"), "Where does the old river go?", "é " + long])] + [(None, item)]
    got = {(r.doc_id, r.item_id): r for r in dc.find_leaks(docs(rows, extra=True), benchmark).collect()}
    n = len(ODD)
    assert set(got) == {(n, 1), (n + 1, 1), (n + 3, 5), (None, 1)}
    assert rows[n][1].encode()[got[n, 1].start : got[n, 1].end].decode().startswith("WHERE") and got[n + 1, 1].edits == 1
    kept = dc.decontaminate(docs(rows, extra=True), benchmark)
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(n + 4) if i not in (n, n + 1, n + 3)] and kept.columns == docs([], extra=True).columns
    assert dc.find_leaks(docs(rows), benchmark.limit(0)).count() == 0 and dc.find_leaks(docs([]), benchmark).count() == 0


def test_many_items_that_share_a_phrase():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    phrase = "which of the following statements is the best answer"
    items = [" ".join([*(word() for _ in range(5)), phrase, *(word() for _ in range(5))]) for _ in range(2000)]
    index = dc.build(list(range(2000)), items)
    texts = [" ".join([*(word() for _ in range(80)), phrase, *(word() for _ in range(80))]), f"x {items[7]} y {items[7].upper()} z {items[1999]}", "z" * 20000]
    got = [(m.text, m.item) for m in dc.search(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]), index)]
    assert got == [(1, 7), (1, 7), (1, 1999)]
    assert dc.search(pa.RecordBatch.from_arrays([pa.array(["z" * 20000])], names=["text"]), dc.build([1], ["z" * 93]))


@pytest.mark.parametrize("kind", ["int", "smallint", "string", "decimal(5,0)", "date"])
def test_ids_of_any_type(spark, docs, kind):
    item = "Where does the old river bend before it meets the sea, and who has seen it do so?"
    own = "date'2020-01-02'" if kind == "date" else "7"
    benchmark = spark.sql(f"SELECT cast({own} AS {kind}) AS item_id, '{item}' AS text UNION ALL SELECT NULL, 'short one'")
    rows = docs(["a " + item + " b", "nothing", "A short one."]).selectExpr(f"cast({'date_add(cast(0 as timestamp), cast(doc_id as int))' if kind == 'date' else 'doc_id'} AS {kind}) AS doc_id", "text")
    got = dc.find_leaks(rows, benchmark)
    assert got.schema["item_id"].dataType.simpleString() == got.schema["doc_id"].dataType.simpleString() == kind
    assert sorted((r.item_id is None, r.end - r.start) for r in got.collect()) == [(False, len(item) - 1), (True, len("short one"))]


def test_short_items_are_found_whole(spark, docs):
    benchmark = spark.createDataFrame([(1, "Who is it?"), (2, "it"), (3, "is it"), (4, " "), (5, "WHO is it"), (6, "éa")], "item_id long, text string")
    texts = ["So - who IS  it, then; who is it", "whois it", "its", "", None, "it", "who is", "it éa", "éab"]
    got = sorted((r.doc_id, r.item_id, texts[r.doc_id].encode()[r.start : r.end].decode()) for r in dc.find_leaks(docs(texts), benchmark).collect())
    first = [(0, i, t) for i, t in ((1, "who IS  it"), (1, "who is it"), (2, "it"), (2, "it"), (3, "IS  it"), (3, "is it"), (5, "who IS  it"), (5, "who is it"))]
    assert got == [*first, (1, 2, "it"), (5, 2, "it"), (7, 2, "it"), (7, 6, "éa")]
    assert sorted(r.doc_id for r in dc.decontaminate(docs(texts), benchmark).collect()) == [2, 3, 4, 6, 8]


def test_pieces_cover_long_items():
    for n in (399, 400, 401, 600, 601, 799, 800, 1300):
        text = "".join(random.Random(n).choices("abcdefghij", k=n))
        index = dc.build([7], [text])
        covered = np.zeros(n, bool)
        for p in index.pieces:
            at = text.find(bytes(p).decode())
            covered[at : at + len(p)] = True
            assert len(p) <= dc.PIECE
        assert covered.all()


# ---- passages


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60), st.integers(8, 12)), min_size=1, max_size=9))
def test_best_chain(rows):
    rows = sorted(set(rows))
    y, x, n = (np.array(c) for c in zip(*rows, strict=True))
    value = {}
    for i in range(len(rows)):  # the plain quadratic recurrence
        before = [value[j] - passages.GAP * (y[i] - y[j] - n[j] + x[i] - x[j] - n[j]) for j in range(i) if y[j] + n[j] <= y[i] and x[j] + n[j] <= x[i]]
        value[i] = n[i] + max([0.0, *before])
    found = passages.chains(y, x, n)
    assert sorted(i for c in found for i in c) == list(range(len(rows)))
    score = lambda c: sum(n[i] for i in c) - sum(passages.GAP * (y[b] - y[a] - n[a] + x[b] - x[a] - n[a]) for a, b in itertools.pairwise(c))
    assert score(found[0]) == pytest.approx(max(value.values()))
    assert all(y[a] + n[a] <= y[b] and x[a] + n[a] <= x[b] for c in found for a, b in itertools.pairwise(c))


def _seeds(*texts):
    first = np.cumsum([0, *map(len, texts)])
    return [c.tolist() for c in passages.seeds(np.concatenate([np.zeros(0, np.uint64), *texts]), first, np.ones(len(texts), bool))]


def test_seeds_depend_on_their_words_alone():
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 0, 4, 5, 60, 300, 7)]
    every = list(zip(*_seeds(*texts), strict=True))
    assert len(every) > 60 and not any(r[3] for r in every)
    for t, key, at, _ in every:
        assert passages.shingles(texts[t][at : at + passages.K], passages.K)[0] == key and key % passages.KEEP == 0 and at + passages.K <= len(texts[t])
    for t, own in enumerate(texts):  # the same alone, or behind other words
        alone = {(k, p) for _, k, p, _ in zip(*_seeds(own), strict=True)}
        assert alone == {(k, p) for i, k, p, _ in every if i == t}
        later = {(k, p - 7) for _, k, p, _ in zip(*_seeds(np.concatenate((texts[6], own))), strict=True)}
        assert alone <= later
    periodic = np.full(400, 5, np.uint64)
    _, key, at, again = _seeds(periodic)
    assert len(set(key)) == 396 - (key[0] % passages.KEEP != 0) and set(at) >= set(range(1, 396)) and sum(again) >= 394
    _, key, _, _ = _seeds(periodic, periodic[:300])
    assert len(key) > len(set(key)) >= 395  # ranks meet across texts


def _needed_by_hand(pos, key):
    out = []
    for p, k in zip(pos, key, strict=True):
        high = sorted({q for q, j in zip(pos, key, strict=True) if j >= k})
        windows = [[q for q in high if a <= q < a + passages.WIDE] for a in range(p - passages.WIDE + 1, p + 1)]
        out.append(any(len(w) >= passages.MANY and w[-1] - w[0] >= passages.SPAN - 1 for w in windows))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(51, 220), st.integers(1, 6)), max_size=40))
def test_the_seeds_that_pair_texts(rows):
    rows = sorted(rows)
    pos, key = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
    assert passages._needed(pos, key.astype(np.int32)).tolist() == _needed_by_hand(pos.tolist(), key.tolist())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 1), st.integers(0, 3), st.integers(0, 2)), max_size=60), st.integers(1, 7))
def test_hubs_are_the_least_of_runs(rows, size):
    rows = sorted(rows, key=lambda r: r[0])
    table = pa.table({c: pa.array([r[i] for r in rows], pa.int16() if c == "part" else pa.int64()) for i, c in enumerate(("h", "part", "fp", "place"))})
    got = [tuple(r.values()) for b in passages._hubs(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]
    want = []
    for _, run in itertools.groupby(sorted(set(rows)), key=lambda r: r[:2]):
        run = list(run)
        if run[0][1] or run[0][2] != run[-1][2]:
            want += [(*r, passages.LONG + 1 if r[1] else len(run), run[0][2], run[0][3]) for r in run]
    assert got == want


def test_long_runs_are_passed_on(monkeypatch):
    monkeypatch.setattr(passages, "LONG", 5)
    rows = [(1, 0, 1, 0)] + [(2, i % 2, i, 0) for i in range(30)] + [(3, 0, 1, 0), (3, 0, 2, 0)]
    table = pa.table({c: pa.array([r[i] for r in rows], pa.int16() if c == "part" else pa.int64()) for i, c in enumerate(("h", "part", "fp", "place"))})
    got = [tuple(r.values()) for b in passages._hubs(iter(table.to_batches(max_chunksize=4))) for r in b.to_pylist()]
    assert sorted(got) == sorted([(*r, 6, r[1], 0) for r in rows[1:31]] + [(*r, 2, 1, 0) for r in rows[31:]])


def test_passages(spark, docs):
    rng = random.Random(4)
    fresh = iter(f"u{i}" for i in itertools.count())
    filler = lambda n: [next(fresh) for _ in range(n)]
    passage = [f"p{i}" for i in range(60)]
    hot = [f"h{i}" for i in range(11)]
    rows = []
    for k in range(12):
        own = list(passage)
        for at in rng.sample(range(5, 55), k % 3):
            own[at] = f"e{k}{at}"
        rows.append((k, " ".join([*filler(30 + k), *own, *filler(25)])))
    rows += [(20 + k, " ".join([*filler(40), *hot, *filler(40)])) for k in range(15)]
    rows += [(40, rows[0][1].upper()), (41, " ".join(passage[:35] + filler(60))), (42, "r " * 300), (43, "r " * 200 + "end")]
    rows += [(100 + i, t) for i, t in enumerate(ODD)]
    got = passages.find_passages(docs(rows, extra=True)).collect()
    met = collections.defaultdict(set)
    for r in got:
        met[r.doc_id].add(r.other_id)
        met[r.other_id].add(r.doc_id)
        assert r.end_word - r.start_word >= 50 and r.kind in ("passage", "copy")
    reached, todo = set(), [0]
    while todo:
        if (x := todo.pop()) not in reached:
            reached.add(x)
            todo += met[x]
    assert reached == {*range(12), 40} and set(met) == {*range(12), 40, 42, 43}
    assert {r.kind for r in got if {r.doc_id, r.other_id} == {0, 40}} == {"copy"} and {r.doc_id for r in got} == set(met)
    assert {r.class_id for r in got if r.doc_id in reached} == {0} and {r.class_id for r in got if r.doc_id in (42, 43)} == {42}
    for r in got:
        if r.kind == "passage" and r.doc_id < 12 and r.other_id < 12:
            assert abs(r.start_word - (30 + r.doc_id)) <= 4 and abs(r.end_word - r.start_word - 60) <= 8
    assert passages.find_passages(docs([])).count() == 0


def _linked(rows):
    """Pairs of documents with a passage between them or one that overlaps at a third."""
    spans = collections.defaultdict(list)
    for r in rows:
        spans[r.doc_id].append((r.other_id, r.start_word, r.end_word))
    out = {frozenset((r.doc_id, r.other_id)) for r in rows}
    for own in spans.values():
        out |= {frozenset((x[0], y[0])) for x, y in itertools.combinations(own, 2) if x[1] < y[2] and y[1] < x[2]}
    return out


def test_no_link_is_lost_in_a_common_run(spark, docs):
    fresh = iter(f"u{i}" for i in itertools.count())
    filler = lambda n: [next(fresh) for _ in range(n)]
    heads, tails = ([[f"{c}{i}x{j}" for j in range(30)] for i in range(5)] for c in "pq")
    rows, want = [], set()
    for k, (head, tail) in enumerate(itertools.product(heads, tails)):  # each half stands in ten texts, both in two
        rows += [(2 * k + side, " ".join([*filler(30), *head, *filler(1), *tail, *filler(30)])) for side in (0, 1)]
        want.add(frozenset((2 * k, 2 * k + 1)))
    got = _linked(passages.find_passages(docs(rows)).collect())
    assert got == want


def _pairs_with_edits(rate, n, seed=1):
    """n pairs of texts with a passage of 50 to 150 words, replaced, inserted and deleted words in it at the rate."""
    rng = random.Random(seed)
    fresh = iter(f"u{i}" for i in itertools.count())
    filler = lambda n: [next(fresh) for _ in range(n)]
    rows = []
    for k in range(n):
        own = filler(rng.randint(56, 150))
        other = []
        bad = set(rng.sample(range(len(own)), int(rate * len(own))))
        for i, w in enumerate(own):
            other += [w] if i not in bad else rng.choice([[next(fresh)], [], [w, next(fresh)]])
        rows += [(2 * k, " ".join([*filler(25), *own, *filler(25)])), (2 * k + 1, " ".join([*filler(25), *other, *filler(25)]))]
    return rows


@pytest.mark.parametrize(("rate", "least"), [(0.0, 1.0), (0.03, 1.0), (0.06, 1.0), (0.1, 0.97), (0.14, 0.9)])
def test_passages_with_edits_are_found(spark, docs, rate, least):
    rows = _pairs_with_edits(rate, 100)
    got = {tuple(sorted((r.doc_id, r.other_id))) for r in passages.find_passages(docs(rows)).collect()}
    want = {(2 * k, 2 * k + 1) for k in range(100)}
    assert got <= want and len(got) >= least * len(want), len(got)


def test_hot_seeds_are_dealt_out(spark, docs, monkeypatch):
    rng = random.Random(3)
    fresh = iter(f"u{i}" for i in itertools.count())
    passage = [next(fresh) for _ in range(70)]
    rows = [(k, " ".join([*(next(fresh) for _ in range(rng.randint(5, 30))), *passage, *(next(fresh) for _ in range(20))])) for k in range(300)]
    got = passages.find_passages(docs(rows)).collect()
    assert {r.doc_id for r in got} == set(range(300)) and {r.class_id for r in got} == {0}
    assert all(r.end_word - r.start_word == 70 for r in got)


# ---- pipeline


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    speech = {"xx": "the cat sat on a mat and then it ran off to find some more food in old house".split(), "yy": "der hund lief schnell durch das haus und bellte sehr laut als er die katze sah".split()}
    say = lambda lang, n: "\n".join(" ".join(rng.choice(speech[lang]) for _ in range(12)) for _ in range(n))
    rows = [(i, say(lang, 6), lang, "s", 0) for i, lang in enumerate(["xx", "yy"] * 30)]
    item = "an item that no clean document would ever hold by chance in its own words"
    rows += [(60, rows[0][1], "xx", "s", 0), (61, "12 34", "xx", "s", 0), (62, None, "xx", "s", 0), (63, say("xx", 3) + "\n" + item, "xx", "s", 0)]
    near = rows[4][1].split()
    near[40] = "dog"
    rows.append((64, " ".join(near), "xx", "s", 0))
    rows.append((65, " ".join(rows[4][1].split()), "xx", "s", 0))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, counts = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = _store.materialize(stage(spark, docs, str(tmp_path)))
        assert docs.schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString(), name
        counts[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert counts["language"] == set(range(66)) - {61, 62}
    assert 60 not in counts["lines"] and counts["lines"] >= set(range(60))
    assert 65 not in counts["lines"] and 64 in counts["lines"] - counts["near_duplicates"] and 4 in counts["near_duplicates"]
    assert 63 in counts["near_duplicates"] and 63 not in counts["benchmark"]
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in final} == counts["benchmark"] and all(r.intact and r.n_tokens == len(r.ids) for r in final)


def test_pipeline_of_odd_tables(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    words = "the cat sat on a mat and then it ran off to find some more food in old house".split()
    rng = random.Random(3)
    full = [(i, " ".join(rng.choice(words) for _ in range(40)), "xx", None, None) for i in range(12)]
    odd = [(None, full[0][1], None, "s", 1), (None, None, None, None, None), (3, full[3][1], "xx", "t", 2), (20, "", "xx", "s", 0), (21, full[1][1] + " " + "food " * 30000, "xx", "s", 0)]
    for n, rows in enumerate(([], odd[1:2], full + odd)):
        folder = tmp_path / str(n)
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(None, None), (1, "")] if n else [], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, str(folder)).collect()
        if n < 2:
            assert got == []
        else:
            ids = [r.doc_id for r in got]
            assert len(ids) == len(set(ids)) and all(r.intact for r in got)
            # a null id is the earliest: its copy of the first text stays, the first one's own lines go
            assert None in ids and 0 not in ids and set(range(1, 12)) <= set(ids) and 20 not in ids
