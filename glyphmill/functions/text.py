"""Words and edit distances over whole texts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space that separates words, as a Java character class.
WHITESPACE = r"[\u0009-\u000D\u001C-\u0020\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def words(text: Column) -> Column:
    """The words of text; runs of any Unicode white space separate, none is empty."""
    return F.filter(F.split(text, WHITESPACE + "+"), lambda w: w != "")


def is_blank(text: Column) -> Column:
    """Whether text has nothing but white space."""
    return F.rlike(text, F.lit(f"^{WHITESPACE}*$"))


#: Whether a code point is white space; all from U+3001 on are not.
_SPACE = np.zeros(0x3002, dtype=bool)
_SPACE[[c for c in range(0x3001) if chr(c).isspace()]] = True


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _differing(a: Sequence, b: Sequence) -> tuple[list, list]:
    """What stands in a and in b at the places where they differ; both have one length."""
    if isinstance(a, str):
        x, y = _points(a), _points(b)
        at = np.flatnonzero(x != y)
        return x[at].tolist(), y[at].tolist()
    pairs = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return [x for x, _ in pairs], [y for _, y in pairs]


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Insertions, deletions and replacements that turn a into b.

    Sequences of one length need at most as many edits as places differ, and at
    least as many as a has members, repeats counted, that b lacks. The bounds meet
    if no member stands at differing places of both; this takes linear time.
    All else is bit-parallel: a column of the distance matrix is two integers of len(a)
    bits, so a step costs len(a) / 64 machine words rather than len(a) cells.
    """
    if a == b:
        return 0
    if len(a) == len(b):
        x, y = _differing(a, b)
        if set(x).isdisjoint(y):
            return len(x)
    if len(a) > len(b):
        a, b = b, a
    n = 0
    while n < len(a) and a[n] == b[n]:
        n += 1
    a, b = a[n:], b[n:]
    n = 0
    while n < len(a) and a[-1 - n] == b[-1 - n]:
        n += 1
    a, b = a[: len(a) - n], b[: len(b) - n]
    if not a:
        return len(b)
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    every, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = every, 0, len(a)
    for x in b:
        same = places.get(x, 0)
        level = same | down
        cross = (((same & up) + up) ^ up) | same
        more = down | (every & ~(cross | up))
        less = up & cross
        score += bool(more & last) - bool(less & last)
        more = more << 1 | 1
        up = (less << 1 | ~(level | more)) & every
        down = more & level & every
    return score


@F.pandas_udf(T.LongType())
def char_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edits between two strings, by code point. The built-in distance takes minutes for one long text."""
    return pd.Series([None if x is None or y is None else edit_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


@F.pandas_udf(T.LongType())
def word_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edits between the words of two strings."""
    return pd.Series([None if x is None or y is None else edit_distance(x.split(), y.split()) for x, y in zip(a, b, strict=True)], dtype="Int64")


def _replaced_only(a: str, b: str) -> tuple[int, int, int, int] | None:
    """edits_and_words where a and b have one length, white space at the same places, and the differing letters of one are not in the other.

    Then each such letter, and each word that holds one, is an edit. None for other texts.
    """
    if len(a) != len(b):
        return None
    x, y = _points(a), _points(b)
    at = np.flatnonzero(x != y)
    old, new = set(x[at].tolist()), set(y[at].tolist())
    if any(chr(c).isspace() for c in old | new) or (any(chr(c) in b for c in old) and any(chr(c) in a for c in new)):
        return None
    space = np.ones(len(x) + 1, dtype=bool)
    np.take(_SPACE, x, mode="clip", out=space[1:])
    starts = np.flatnonzero(space[:-1] > space[1:])
    word = np.searchsorted(starts, at, "right")
    hit = np.count_nonzero(word[1:] != word[:-1]) + 1 if len(at) else 0
    return len(at), hit, len(starts), len(starts)


def edits_and_words(a: str, b: str) -> tuple[int, int, int, int]:
    """Edits between the letters of a and b, between their words, and how many words either has."""
    if found := _replaced_only(a, b):
        return found
    p, r = a.split(), b.split()
    return edit_distance(a, b), edit_distance(p, r), len(p), len(r)


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("chars", "words", "pred_words", "ref_words")]))
def text_edits(pred: pd.Series, ref: pd.Series) -> pd.DataFrame:
    """edits_and_words of each row; of a null nothing but the other's words is known."""
    many = lambda t: None if t is None else len(t.split())
    rows = [(None, None, many(x), many(y)) if x is None or y is None else edits_and_words(x, y) for x, y in zip(pred, ref, strict=True)]
    return pd.DataFrame(rows, columns=["chars", "words", "pred_words", "ref_words"], dtype="Int64")
