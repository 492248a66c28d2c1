import math
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphmill.functions.metrics import macro_metrics, pair_by_position, score_rows
from glyphmill.functions.text import edit_distance, edits_and_words, is_blank, words

CASES = [
    ("", "", 0.0, 0.0),
    ("x", "", 1.0, 1.0),
    (" ", "", 1.0, 0.0),
    ("", "abc", 1.0, 1.0),
    ("", " ", 1.0, 0.0),
    ("kitten", "sitting", 3 / 7, 1.0),
    ("aaaa", "a", 3.0, 1.0),
    ("a b c d", "a", 6.0, 3.0),
    ("the brown cat fox x", "the quick brown fox", None, 3 / 4),
    ("한국", "한글", 0.5, 1.0),
    ("A", "a", 1.0, 1.0),
    ("a　b", "a b", 1 / 3, 0.0),
    ("é", "é", 2.0, 1.0),
]
BLANKS = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def slow(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_rates(spark):
    rows = spark.createDataFrame([(i, p, r) for i, (p, r, _, _) in enumerate(CASES)], "i int, pred string, ref string")
    for got in score_rows(rows).collect():
        p, r, cer, wer = CASES[got.i]
        assert got.cer == pytest.approx(slow(p, r) / len(r) if cer is None else cer), (p, r)
        assert got.wer == pytest.approx(wer), (p, r)


def test_macro_average(spark):
    rows = spark.createDataFrame([("x", "y"), ("a" * 99, "a" * 99)], "pred string, ref string")
    got = macro_metrics(score_rows(rows)).first()
    assert (got.cer, got.num_samples) == (0.5, 2)
    none = macro_metrics(score_rows(rows.limit(0))).first()
    assert tuple(none) == (0.0, 0.0, 0)


def test_unequal_lengths_raise(spark):
    preds = spark.createDataFrame([(0, "a")], "row_idx long, pred string")
    refs = spark.createDataFrame([(0, "a"), (1, "b")], "row_idx long, ref string")
    assert pair_by_position(preds, refs.limit(1)).count() == 1
    with pytest.raises(Exception, match="differ in number"):
        pair_by_position(preds, refs).collect()


def test_white_space(spark):
    rows = spark.createDataFrame([(c, f"a{chr(c)}b", chr(c)) for c in BLANKS], "c int, t string, b string")
    got = rows.select("c", words(rows.t).alias("w"), is_blank(rows.b).alias("blank")).collect()
    assert all(r.w == ["a", "b"] and r.blank for r in got) and len(got) == 29


@settings(max_examples=200, deadline=None)
@given(st.text("abé\U0001f600 ", max_size=90), st.text("abé\U0001f600 ", max_size=90))
def test_distance_is_the_slow_one(a, b):
    assert edit_distance(a, b) == slow(a, b)
    assert edit_distance(a.split(), b.split()) == slow(a.split(), b.split())


@settings(max_examples=60, deadline=None)
@given(*[st.lists(st.sampled_from("abc"), max_size=20)] * 3)
def test_distance_laws(a, b, c):
    assert edit_distance(a, a) == 0 and edit_distance(a, b) == edit_distance(b, a)
    assert edit_distance(a, c) <= edit_distance(a, b) + edit_distance(b, c)


def test_long_texts_are_quick():
    a = "the quick brown fox " * 2000
    assert edit_distance(a, a.replace("e ", "c ")) == 2000 and math.isfinite(len(a))


ODD_PAIRS = [
    ("", ""), ("a", ""), ("", " "), ("a b", "a b"), ("ab cd", "xb cy"), ("ab", "ba"), ("a b", "a　b"), ("a b", "acb"), ("ab ab", "xb ab"), ("xb ab", "ab ab"),
    ("aa ba", "ab bb"), ("、a b", "、a c"), ("\U0001f600 a", "é a"), ("\ud800x y", "\ud800z y"), (" a\x1cb ", " c\x1cb "), ("th\ue000 old on\ue000 ", "the old one "),
]


@pytest.mark.parametrize(("a", "b"), ODD_PAIRS)
def test_edits_of_letters_and_words(a, b):
    assert edits_and_words(a, b) == (slow(a, b), slow(a.split(), b.split()), len(a.split()), len(b.split()))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab 　é"), st.sampled_from("abx 　\U0001f600")), max_size=40))
def test_edits_of_texts_of_one_length(pairs):
    a, b = ("".join(p[i] for p in pairs) for i in (0, 1))
    assert edits_and_words(a, b) == (slow(a, b), slow(a.split(), b.split()), len(a.split()), len(b.split()))


def test_replaced_letters_take_linear_time():
    a = "the quick brown fox " * 25_000
    start = time.process_time()
    assert edits_and_words(a.replace("e ", "\ue000 "), a) == (25_000, 25_000, 100_000, 100_000)
    assert edit_distance(a.replace("e ", "\ue000 "), a) == 25_000
    assert time.process_time() - start < 5


def test_rates_of_nulls(spark):
    rows = spark.createDataFrame([(0, None, "a b"), (1, "a", None), (2, None, ""), (3, "a c", "a b")], "i int, pred string, ref string")
    got = [(r.cer, r.wer) for r in score_rows(rows).orderBy("i").collect()]
    assert got == [(None, None), (None, None), (1.0, 1.0), (1 / 3, 0.5)]
