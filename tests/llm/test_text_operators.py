"""Language identification, licences, media, scores, tokens, chats."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from llm_helpers import ODD, lower, tokens
from pyspark.sql import functions as F

from glyphmill.llm import bpe, chat, langid, licenses, lm, media, queries
from glyphmill.llm.license_rules import BASE, rules
from glyphmill.llm.queries import vocabulary_path

LANGUAGES = {"xx": "the cat sat on a mat and then it ran off to find some more food in the old house".split(), "yy": "der hund lief schnell durch das haus und bellte sehr laut als er die katze sah".split()}


def _speech(rng, lang, n):
    return " ".join(rng.choice(LANGUAGES[lang]) for _ in range(n))


def test_language(spark):
    rng = random.Random(2)
    rows = [(i, _speech(rng, x, 60), x) for i, x in enumerate(["xx", "yy"] * 40)]
    table = spark.createDataFrame([*rows, (900, None, "xx"), (901, "?! 12", "yy"), (None, "lost", "xx"), (903, "x", None)], "doc_id long, text string, lang string")
    model = langid.learn(table)
    assert model.names == ["xx", "yy"]
    probe = spark.createDataFrame([(0, "The Cat sat on the mat"), (1, "DER hund sah das haus"), (2, None), (3, "12 !"), (4, "жшщ " * 60), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(probe, model).collect()}
    assert [got[i].lang_pred for i in range(4)] == ["xx", "yy", "und", "und"] and got[5].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in got.values()) and got[4].rejected and not got[0].rejected and got[2].score == 0
    right = [r for r in langid.identify(table.select("doc_id", "text", F.col("lang").alias("true")), model).collect() if r.doc_id is not None and r.doc_id < 80]
    assert all(r.lang_pred == r.true for r in right)


def test_language_without_labels(spark, docs):
    model = langid.learn(docs(ODD).withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.identify(docs(ODD), model).collect()} == {"und"}
    assert langid.identify(docs([]), model).count() == 0
    few = spark.createDataFrame([(1, "ein kleiner hund", "yy")], "doc_id long, text string, lang string")  # nothing left to calibrate with
    assert [r.lang_pred for r in langid.identify(few, langid.learn(few)).collect()] == ["yy"]


def test_kneser_ney_is_a_distribution():
    fitted = langid.fit(collections.Counter({"abab": 3, "abc": 2, "ca": 1, "b": 4}), order=3)
    tables = langid.union([fitted])
    floor = np.array([fitted[0]["floor"][0]], np.float32)
    every = ["".join(x) for n in range(1, 9) for x in itertools.product("abc", repeat=n)]
    total = float(np.exp2(-langid.bits(every, tables, floor)[:, 0].astype(float)).sum())
    assert 0.7 < total <= 1  # the rest: other letters, longer words, no letter at all
    seen, other = langid.bits(["abab", "cccc"], tables, floor)[:, 0]
    assert seen < other


def _kneser_ney(counts, order):
    """The probability of a gram's last symbol after the others, from the definition."""
    raw = [collections.Counter() for _ in range(order)]
    for w, c in counts.items():
        own = f"\x02{w}\x03"
        for k in range(order):
            for i in range(len(own) - k):
                raw[k][own[i : i + k + 1]] += c
    n, cut = [], []
    for k in range(order):
        n.append({g: c if k + 1 == order or g[0] == "\x02" else sum(x[1:] == g for x in raw[k + 1]) for g, c in raw[k].items()})
        once, twice = ([c for g, c in n[k].items() if g[-1] != "\x02"].count(x) for x in (1, 2))
        cut.append(once / (once + 2 * twice) if once and twice else 0.5)
    given = [c for g, c in n[0].items() if g != "\x02"]

    def p(g):
        k = len(g) - 1
        if k == 0:
            return (max(n[0].get(g, 0) - cut[0], 0) + cut[0] * len(given) / (len(given) + 1)) / sum(given)
        after = [c for x, c in n[k].items() if x[:-1] == g[:-1]]
        if not after:
            return p(g[1:])
        return max(n[k].get(g, 0) - cut[k], 0) / sum(after) + cut[k] * len(after) / sum(after) * p(g[1:])

    return p


def _bits_by_hand(word, p, order):
    own = f"\x02{word}\x03"
    return -sum(math.log2(p(own[max(0, i - order + 1) : i + 1])) for i in range(1, len(own)))


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_kneser_ney_is_that_of_the_definition(order):
    rng = random.Random(order)
    known = [collections.Counter("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(60)) for letters in ("aabcd", "abbce")]
    models = [langid.fit(c, order) for c in known]
    tables, floor = langid.union(models), np.array([m[0]["floor"][0] for m in models], np.float32)
    words = [*list(known[0])[:20], *list(known[1])[:20], "a", "zz", "abz", "eeeee", "dcbaabcd"]
    got = langid.bits(words, tables, floor)
    for j, counts in enumerate(known):
        p = _kneser_ney(counts, order)
        for w, b in zip(words, got[:, j].tolist(), strict=True):
            assert b == pytest.approx(_bits_by_hand(w, p, order), rel=1e-4), (w, j)


def test_lowest_cross_entropy_wins():
    rng = random.Random(11)
    known = {x: collections.Counter(_speech(rng, x, 200).split()) for x in LANGUAGES}
    found = langid.Identifier({x: langid.fit(c) for x, c in known.items()})
    texts = [_speech(rng, rng.choice(list(LANGUAGES)), rng.randint(1, 5)) for _ in range(30)] + ["zzz qqq", "catze das", "und and"]
    got, symbols = found.entropies(texts)
    by_hand = {x: _kneser_ney(c, langid.ORDER) for x, c in known.items()}
    for i, t in enumerate(texts):
        size = sum(len(w) + 1 for w in t.split())
        assert symbols[i] == size
        want = [sum(_bits_by_hand(w, by_hand[x], langid.ORDER) for w in t.split()) / size for x in found.names]
        assert got[i].tolist() == pytest.approx(want, rel=1e-4)


def test_language_of_long_texts_and_other_columns(spark):
    rng = random.Random(2)
    rows = [(i, _speech(rng, x, 60), x) for i, x in enumerate(["xx", "yy"] * 40)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    long = _speech(rng, "yy", 100000)
    probe = spark.createDataFrame([(1, long, "a", 0.5), (1, long, "b", 0.5), (None, "the cat", None, None)], "doc_id long, text string, rejected string, cross_entropy double")
    got = langid.identify(probe.select("doc_id", "text"), model).collect()
    assert sorted((r.doc_id or 0, r.lang_pred, r.rejected) for r in got) == [(0, "xx", False), (1, "yy", False), (1, "yy", False)]
    clashing = langid.identify(probe, model, keep=["doc_id"])
    assert sorted((r.doc_id or 0, r.lang_pred) for r in clashing.collect()) == [(0, "xx"), (1, "yy"), (1, "yy")]


def _scan_by_hand(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    joined = " ".join(words)
    found = []
    for phrase, label in BASE:
        own = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(own)] == own]
    return words, joined, sorted(found)


def test_licences(spark, docs):
    texts = [*ODD, "Under the MIT License; under  the mit-license!", "Apache License, Version 2.0 (CC BY-NC 4.0)", "ccby-nc cc by nc", "SPDX-License-Identifier: GPL-2.0-only", "under the mit licenseé", "licensed under the GNU Lesser General Public License v2.1", "Code released under CC0. All rights reserved."]
    got = {r.doc_id: r for r in licenses.scan(docs(texts, extra=True)).collect()}
    for i, text in enumerate(texts):
        words, joined, base = _scan_by_hand(text)
        assert got[i].n_words == len(words), text
        assert sorted((p["first"], p["label"]) for p in got[i].base) == base, text
        places = [(p["first"], p["last"]) for p in got[i].detections]
        assert places == sorted(places) and all(a[1] < b[0] for a, b in zip(places, places[1:], strict=False))
        for p in got[i].detections:
            rule = next(r for r in rules() if r.name == p["rule"])
            assert re.fullmatch(rule.pattern.replace("(?<![^ ])", "").replace("(?![^ ])", ""), " ".join(words[p["first"] : p["last"] + 1]))
    label = lambda i: [p["label"] for p in got[len(ODD) + i].detections]
    assert label(3) == ["gpl-2"] and label(5) == ["lgpl-2.1"] and label(6) == ["cc0", "proprietary"] and label(1) == ["apache-2", "cc-by-nc"]
    assert len(rules()) > 200 and all(re.compile(r.pattern) for r in rules())
    assert got[0].fp == "k" and licenses.scan(docs([])).count() == 0


def test_every_rule_holds_its_keyword():
    gate = re.compile(licenses.GATE)
    samples = {"licensed under the mit license": "mit", "eclipse public license 2 0": "epl-2", "same terms as perl itself": "perl", "openrail": "openrail", "creative commons zero": "cc0"}
    for text, label in samples.items():
        assert gate.search(text)
        assert any(r.label == label and r.keyword in text and re.search(r.pattern, text) for r in rules())


def _every(parsed):
    """All strings that a parsed pattern matches."""
    out = [""]
    for op, arg in parsed:
        kind = str(op)
        if kind == "LITERAL":
            own = [chr(arg)]
        elif kind == "IN":
            own = [chr(c) for k, x in arg for c in ([x] if str(k) == "LITERAL" else range(x[0], x[1] + 1))]
        elif kind == "SUBPATTERN":
            own = _every(arg[3])
        elif kind == "BRANCH":
            own = [x for branch in arg[1] for x in _every(branch)]
        elif kind == "MAX_REPEAT":
            assert arg[:2] == (0, 1)
            own = ["", *_every(arg[2])]
        else:
            assert kind == "ASSERT_NOT"
            own = [""]
        out = [a + b for a in out for b in own]
    return out


def test_every_alternative_holds_its_keyword():
    gate = re.compile(licenses.GATE)
    for r in rules():
        if not r.name.startswith("notice"):  # a notice ends in the name, whose keyword it has
            for text in _every(re._parser.parse(r.pattern)):
                assert r.keyword in text and gate.search(text), (r.name, text)
    assert {r.keyword for r in rules() if r.name.startswith("notice")} <= {r.keyword for r in rules() if r.name.startswith("name")}


def test_licences_of_every_wording(spark, docs):
    want = {"BSD-style license": "bsd", "Open RAIL-M license": "openrail", "modified BSD license": "bsd-3", "MIT X11 license": "mit", "BSD 2-clause plus patent": "bsd-patent", "GNU GPL version 1": "gpl-1"}
    got = {r.doc_id: [p["label"] for p in r.detections] for r in licenses.scan(docs(list(want))).collect()}
    assert got == {i: [label] for i, label in enumerate(want.values())}


def _resolved(places):
    kept = []
    for p in sorted(places, key=lambda p: (-p[2], p[0], -p[1], p[3])):
        if all(q[0] > p[1] or p[0] > q[1] for q in kept):
            kept.append(p)
    return sorted(kept)


def test_overlaps_are_resolved_by_priority(spark):
    rng = random.Random(7)
    rows = [[(0, 4, 50, 0), (3, 8, 70, 1), (7, 9, 90, 2)]]  # the last overrules the second, which frees the first
    for _ in range(40):
        rows.append([(a, a + rng.randint(0, 6), rng.choice((50, 70, 80, 90)), n) for n, a in enumerate(rng.randrange(30) for _ in range(rng.randint(0, 12)))])
    place = "array<struct<first:int,last:int,priority:int,order:int,rule:string,label:string>>"
    table = spark.createDataFrame([(i, [(*p, "r", "l") for p in r]) for i, r in enumerate(rows)], f"i int, found {place}")
    made = table.select("i", licenses._clusters(licenses._ordered(F.col("found"))).alias("c")).select("i", F.flatten(F.transform("c", licenses._strongest)).alias("d"))
    got = {r.i: [(p["first"], p["last"], p["priority"], p["order"]) for p in r.d] for r in made.collect()}
    assert got == {i: _resolved(r) for i, r in enumerate(rows)} and got[0] == [(0, 4, 50, 0), (7, 9, 90, 2)]


def test_media(spark, docs):
    got = {r.doc_id: r for r in media.to_media(docs(ODD, extra=True)).collect()}
    for i, text in enumerate(ODD):
        data = (text or "").encode()
        payload = bytes(got[i].payload)
        assert payload == data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data)) and got[i].n_bytes == len(data)
        assert bytes(got[i].media)[:8] == b"\x89PNG\r\n\x1a\n" and re.fullmatch("[0-9a-f]{16}", got[i].feature)
    assert got[7].media == got[8].media
    assert media.to_media(docs([])).count() == 0


def test_png_damage_and_filters():
    made = media.encode_png(media.pad(b"some text" * 100))
    for at in (0, 20, 40, len(made) - 20):
        broken = bytearray(made)
        broken[at] ^= 1
        with pytest.raises(media.MediaError):
            media.decode_png(bytes(broken))
    for cut in (10, len(made) - 5):
        with pytest.raises(media.MediaError):
            media.decode_png(made[:cut])
    rng = np.random.default_rng(0)
    want = rng.integers(0, 256, (6, 12), dtype=np.uint8)
    lines, above = [], np.zeros(12, np.int64)
    for y, row in enumerate(want.astype(np.int64)):
        left, corner = np.r_[0, 0, 0, row[:-3]], np.r_[0, 0, 0, above[:-3]]
        base = left + above - corner
        paeth = np.where((abs(base - left) <= abs(base - above)) & (abs(base - left) <= abs(base - corner)), left, np.where(abs(base - above) <= abs(base - corner), above, corner))
        guess = [0 * row, left, above, (left + above) // 2, paeth][y % 5]
        lines.append(np.r_[y % 5, (row - guess) % 256].astype(np.uint8))
        above = row
    assert np.array_equal(media.unfilter(np.array(lines), 3), want)
    assert media.cosine_hash(media.decode_png(made)) == media.cosine_hash(media.decode_png(made))


@pytest.mark.parametrize("head", [1 << 17, 3, 0])
def test_scores(spark, docs, head, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", head)
    rows = [(i, t) for i, t in enumerate([*ODD, "b c d", "new words only here", "B b a", "a b"])]
    table = docs(rows)
    got = {r.doc_id: r for r in lm.score(table, ~lm.held_out(F.col("doc_id"))).collect()}
    count, ends = collections.Counter(), 0
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    for i, t in rows:
        if not held[i]:
            count.update(tokens(t))
            ends += 1
    n, v = sum(count.values()) + ends, len(count) + 1
    for i, t in rows:
        own = tokens(t)
        base = sum(math.log10((c + 1) / (n + v + 1)) for c in [*(count[w] for w in own), ends])
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens, got[i].held_out) == (len(own) + 1, sum(count[w] > 0 for w in own) + 1, n, held[i])
        assert got[i].base_score == pytest.approx(base) and got[i].score < 0


def test_scores_of_odd_tables(spark, docs):
    assert lm.score(docs([]), ~lm.held_out(F.col("doc_id"))).count() == 0
    rows = [(None, "a b a"), (None, "a b a"), (4, "b c"), (4, "b c"), (4, None), (5, "")]
    got = lm.score(docs(rows, extra=True).withColumn("score", F.lit("s")), ~lm.held_out(F.col("doc_id"))).collect()
    assert len(got) == 6 and sorted(r.n_tokens for r in got) == [1, 1, 3, 3, 4, 4]
    for a, b in itertools.combinations(got, 2):
        if a.n_tokens == b.n_tokens:
            assert (a.score, a.base_score) == pytest.approx((b.score, b.base_score))
    unlearned = lm.score(docs(["x y", None]), F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.held_out for r in unlearned)


def _ppm_by_hand(counts, context, symbol):
    p, gone = 1.0, set()
    for order in (3, 2, 1, 0):
        own = {s: c for s, c in counts.get(context[3 - order :], {}).items() if s not in gone}
        if own:
            n, d = sum(own.values()), len(own)
            if symbol in own:
                return p * own[symbol] / (n + d)
            p *= d / (n + d)
            gone |= set(own)
    return p / (257 - len(gone))


def test_ppm_is_that_of_the_definition(spark, docs):
    text = "abracadabra cad abra"
    padded = [10, 10, 10, *text.encode(), 256]
    counts = {}
    for i in range(3, len(padded)):
        for order in range(4):
            own = counts.setdefault(tuple(padded[i - order : i]), collections.Counter())
            own[padded[i]] += 1
    probes = [text, "abz", "", "zzz", "rab", "abrr", "cadd a"]
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2]
    learned = next(i for i in range(200) if i not in held)
    rows = [(learned, text), *zip(held, probes, strict=False)]
    got = {r.doc_id: r.score for r in lm.score(docs(rows), ~lm.held_out(F.col("doc_id"))).collect()}
    for i, probe in rows:
        own = [10, 10, 10, *probe.encode(), 256]
        want = sum(math.log10(_ppm_by_hand(counts, tuple(own[j - 3 : j]), own[j])) for j in range(3, len(own)))
        assert got[i] == pytest.approx(want, rel=1e-5), probe
    for context in ("", "abr", "a c", "zzz", "rab"):
        before = [10, 10, 10, *context.encode()][-3:]
        total = sum(_ppm_by_hand(counts, tuple(before), s) for s in range(257))
        assert total == pytest.approx(1)


@pytest.mark.parametrize("nodes", [0, 4, 40])
def test_scores_do_not_depend_on_what_is_broadcast(spark, docs, nodes, monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aaaabbc d") for _ in range(rng.randint(0, 60))) for _ in range(40)] + ["", "zq zq", "éé"]
    score = lambda: {r.doc_id: (r.score, r.base_score, r.n_known) for r in lm.score(docs(texts), ~lm.held_out(F.col("doc_id"))).collect()}
    whole = score()
    monkeypatch.setattr(lm, "NODES", nodes)
    got = score()
    assert len(got) == len(texts)
    for i, want in whole.items():
        assert got[i] == pytest.approx(want, rel=1e-5)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.from_json(bpe.read_vocabulary(vocabulary_path()))


def test_bpe_is_that_of_the_library(spark, docs, vocabulary):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(vocabulary_path())
    rng = random.Random(5)
    letters = "abc ething\n\t 1239éñ's'll-—　\x00\x85\U0001f600"
    texts = [*[t for t in ODD], "<|endoftext|>a <|endoftext|>", *["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(200)]]
    made = docs(texts)
    encoded = bpe.encode_decode(made, bpe.read_vocabulary(vocabulary_path())).collect()
    for r in encoded:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    for r in bpe.digests(made, bpe.read_vocabulary(vocabulary_path())).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_of_odd_tables(spark, docs):
    known = bpe.read_vocabulary(vocabulary_path())
    assert bpe.digests(docs([]), known).count() == 0
    rows = [(None, "a b"), (None, "a b"), (3, None), (3, "a b"), (3, "")]
    got = bpe.digests(docs(rows, extra=True).withColumn("ids", F.lit(1)), known).collect()
    assert sorted((r.doc_id is None, r.n_tokens) for r in got) == [(False, 0), (False, 0), (False, 2), (True, 2), (True, 2)]
    assert len({r.ids_sha256 for r in got if r.n_tokens}) == 1


@pytest.mark.parametrize("kind", range(4))
def test_transducer_with_little_memory(vocabulary, kind):
    rng = random.Random(kind)
    known = [t for t in vocabulary.tokens if t]
    word = [b"".join(rng.choice(known) for _ in range(400)), b"".join(rng.choice([b"a", b"b", b"c"]) for _ in range(2500)), b"z" * 3000, bytes(rng.randrange(256) for _ in range(2500))][kind]
    machine, out, most = bpe.Transducer(vocabulary, block=16), [], 0
    for i in range(0, len(word), 5):
        out += machine.feed(word[i : i + 5])
        most = max(most, len(machine.held))
    out += machine.finish()
    assert out == bpe.merge_bytes(word, vocabulary) and most <= vocabulary.lookahead + 16 + 5 + 128


def test_decoder_holds_back_bytes(vocabulary):
    ids = bpe.Encoder(vocabulary).encode("\U0001f9ff é")
    machine = bpe.Decoder(vocabulary)
    assert "".join(machine.feed([i]) for i in ids) + machine.finish() == "\U0001f9ff é"
    assert machine.feed(ids[:1]) + machine.finish() == "�" or len(ids) < 3


CONTROL = ["</s>[INST] ok [/INST]", "<s>", "<\\/s>", "[\\\\INST]", "<|image|>", "<\\|n|>", "a\nb\\", "<", "[", None, "", "é\U0001f600"]


def test_chats(spark):
    rows = [(0, t, r, CONTROL[(t * 3 + j) % len(CONTROL)]) for t in range(8) for j, r in enumerate(["user", "assistant"])]
    rows += [(1, 0, "user", "x"), (1, 0, "user", "x"), (None, 1, "assistant", "n"), (2, None, None, None), (3, 0, "a\nb</s>", "t"), (4, 0, "assistant", "")]
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1)))
    read = made.select("conv_id", "formatted", "loss_spans", chat.parse_turns(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    assert len(read) == 6
    for r in read:
        own = sorted([x for x in rows if x[0] == r.conv_id], key=lambda x: (x[1] is not None, x[1] or 0, x[2] or ""))
        want = sorted((x[2] or "", x[3] or "") for x in own)
        assert sorted((t["role"], t["text"]) for t in r.turns) == want
        assert r.loss == "".join(t["text"] for t in r.turns if t["role"] == "assistant")
        assert all(r.formatted[s["start"] : s["start"] + s["length"]].count("</s>") == 0 for s in r.loss_spans)
    assert chat.format_chats(made.limit(0).selectExpr("conv_id", "0L as turn", "'' as role", "formatted as text")).count() == 0


def test_turns_of_one_place_sort_by_their_texts(spark):
    texts = ["[/x", "[/INST]", "b", "a", None, "<s>", "</s>", "<a"]
    rows = [(0, 1, "user", t) for t in texts] + [(0, 1, "assistant", t) for t in texts] + [(0, None, "user", "z"), (0, 0, None, "y")]
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = made.select(chat.parse_turns(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    plain = sorted(t or "" for t in texts)
    assert [(t["role"], t["text"]) for t in got.t] == [("user", "z"), ("", "y"), *(("assistant", t) for t in plain), *(("user", t) for t in plain)]
    assert got.loss == "".join(plain)


def test_typed_turns_of_one_place_sort_by_their_texts(spark):
    texts = ["[/x", "[/INST]", "b", "a", "<s>", "</s>", "<a"]
    rows = [(0, 1, r, t) for r in ("user", "assistant") for t in texts]
    plain = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    typed = plain.withColumn("parts", chat.text_parts(F.col("text"))).drop("text")
    assert chat.format_chats(typed, "parts").collect() == chat.format_chats(plain).collect()
    # turns that differ in their attachments only
    one = [(0, 0, "user", [("image", None, ref, 1, 1, None, None)]) for ref in "cab"]
    got = chat.format_chats(spark.createDataFrame(one, f"conv_id long, turn long, role string, parts {chat.PART}").repartition(3), "parts").first()
    assert [a.ref for a in got.attachments] == ["a", "b", "c"]


def test_query_formats_through_the_visitor(spark, monkeypatch, tmp_path):
    spark.createDataFrame([(0, 0, "user", "a </s>"), (0, 1, "assistant", None)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    seen, visit = [], chat.visit
    monkeypatch.setattr(chat, "visit", lambda *a: seen.append(a) or visit(*a))
    made = queries.op10_chat_format(spark, str(tmp_path))
    assert seen
    assert {r.conv_id: (r.n_turns, r.loss_chars) for r in made.collect()} == {0: (2, 0), -1: (2, len(queries.CHAT_PROBE))}


def test_very_long_turn(spark):
    text = "</s>[INST] long " * 30000
    made = chat.format_chats(spark.createDataFrame([(0, 0, "assistant", text)], "conv_id long, turn long, role string, text string"))
    assert made.select(chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("t")).first().t == text


def test_chat_parts(spark):
    parts = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
    rows = [(0, 0, "user", [("text", "see <s> ", None, None, None, None, None), ("image", None, "i.png", 56, 29, None, None), ("audio", None, "a.wav", None, None, 2.0, None)]), (0, 1, "assistant", [("document", None, "d.pdf", None, None, None, 2), ("text", "done", None, None, None, None, None)]), (0, 2, "user", None)]
    got = chat.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {parts}"), "parts").first()
    assert got.formatted == "<s>[INST]user\nsee <\\s> <|image|><|audio|>[/INST]</s><s>assistant\n<|document|>done</s><s>[INST]user\n[/INST]</s>"
    assert [tuple(a) for a in got.attachments] == [(0, "image", "i.png", 4), (1, "audio", "a.wav", 50), (2, "document", "d.pdf", 1024)]
