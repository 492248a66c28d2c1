"""Licence scans by ordered signature rules, in DataFrame expressions only.

A text passes a gate of keywords first; only then are its words joined by
single blanks and matched. Rules whose literal keyword occurs there are tried,
and each one's places are found by bracketing its matches with two control
characters that no word holds, so word positions come out in linear time.
Overlaps are resolved in each cluster of places that overlap one another, by
(priority, start, longest first): a place stays if it overlaps none before it that
stays. So a place inside another goes unless its priority is higher, of two that
overlap partly the one of higher priority stays, the earlier on a tie, and what a
place that goes had in its way comes back.

Defined results: null and empty texts have no words and no labels; nothing else
of a row is looked at, so null or repeated ids, repeated rows and clashing
column names do not matter; a row in gives a row out, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import BASE, rules

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, before lower-casing A-Z.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: What every rule's match, and every base phrase, holds, in words joined by blanks.
GATE = r"(?i)licen[cs]|spdx|commercial use|rights reserved|public domain|creative commons|attribution|cc by|cc0|gpl|bsd|open ?rail|confidential|same terms as"

_PLACE = "array<struct<first:int,last:int,priority:int,order:int,rule:string,label:string>>"


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, all else as it is."""
    return F.translate(text, _UPPER, _LOWER)


def plain_words(text: Column) -> Column:
    """The words of text, one blank between."""
    return F.trim(F.regexp_replace(text, _GAP, " "))


def count_words(plain: Column) -> Column:
    """How many words plain_words gave."""
    return F.when(plain == "", 0).otherwise(F.octet_length(plain) - F.octet_length(F.replace(plain, F.lit(" "), F.lit(""))) + 1).cast("long")


def places(joined: Column, pattern: Column) -> Column:
    """struct(first, last) of word positions of each match in joined words."""
    marked = F.split(F.regexp_replace(joined, F.concat(F.lit("("), pattern, F.lit(")")), F.lit("\x01$1\x02")), " ")
    starts = F.filter(F.transform(marked, lambda w, i: F.when(F.startswith(w, F.lit("\x01")), i)), lambda i: i.isNotNull())
    ends = F.filter(F.transform(marked, lambda w, i: F.when(F.endswith(w, F.lit("\x02")), i)), lambda i: i.isNotNull())
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("first"), b.alias("last")))


def _table() -> tuple[Column, Column]:
    """The keywords, and the rules, as literal arrays."""
    known = rules()
    words = F.array(*[F.lit(k) for k in dict.fromkeys(r.keyword for r in known)])
    table = F.array(*[F.struct(F.lit(r.order).alias("order"), F.lit(r.name).alias("rule"), F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(r.keyword).alias("keyword"), F.lit(r.pattern).alias("pattern")) for r in known])
    return words, table


def _found(joined: Column, hit: Column, table: Column) -> Column:
    live = F.filter(table, lambda r: F.array_contains(hit, r["keyword"]) & F.rlike(joined, r["pattern"]))

    def of(r: Column) -> Column:
        return F.transform(places(joined, r["pattern"]), lambda p: F.struct(p["first"].alias("first"), p["last"].alias("last"), r["priority"].alias("priority"), r["order"].alias("order"), r["rule"].alias("rule"), r["label"].alias("label")))

    return F.flatten(F.transform(live, of)).cast(_PLACE)


def _ordered(found: Column) -> Column:
    """Places by start, longest first, highest priority first, rule."""
    return F.transform(F.array_sort(F.transform(found, lambda p: F.struct(p["first"].alias("a"), (-p["last"]).alias("b"), (-p["priority"]).alias("c"), p["order"].alias("d"), p.alias("p")))), lambda x: x["p"])


def _clusters(in_order: Column) -> Column:
    """Runs of places that overlap one another, by position."""
    runs = f"array<{_PLACE}>"
    first = F.get(in_order, F.lit(0))
    state = F.struct(F.array().cast(runs).alias("done"), F.array().cast(_PLACE).alias("now"), first["last"].alias("until"))

    def step(s: Column, p: Column) -> Column:
        apart = p["first"] > s["until"]
        return F.struct(
            F.when(apart, F.array_append(s["done"], s["now"])).otherwise(s["done"]).alias("done"),
            F.when(apart, F.array(p)).otherwise(F.array_append(s["now"], p)).alias("now"),
            F.greatest(s["until"], p["last"]).alias("until"),
        )

    return F.when(F.size(in_order) == 0, F.array().cast(runs)).otherwise(F.aggregate(in_order, state, step, lambda s: F.array_append(s["done"], s["now"])))


def _strongest(cluster: Column) -> Column:
    """Of places by precedence, each that overlaps none before it that stays."""

    def step(kept: Column, p: Column) -> Column:
        meets = F.exists(kept, lambda q: (q["first"] <= p["last"]) & (p["first"] <= q["last"]))
        return F.when(meets, kept).otherwise(F.array_append(kept, p))

    ranked = F.array_sort(F.transform(cluster, lambda p: F.struct((-p["priority"]).alias("a"), p["first"].alias("b"), (-p["last"]).alias("c"), p["order"].alias("d"), p.alias("p"))))
    stay = F.aggregate(F.transform(ranked, lambda x: x["p"]), F.array().cast(_PLACE), step)
    return F.when(F.size(cluster) == 1, cluster).otherwise(F.transform(F.array_sort(F.transform(stay, lambda p: F.struct(p["first"].alias("a"), p.alias("p")))), lambda x: x["p"]))


def _base(joined: Column) -> Column:
    """struct(first, last, label) of the base phrases' places."""

    def of(phrase: str, label: str) -> Column:
        return F.transform(places(joined, F.lit(rf"(?<![^ ]){phrase}(?![^ ])")), lambda p: F.struct(p["first"].alias("first"), p["last"].alias("last"), F.lit(label).alias("label")))

    return F.flatten(F.array(*[of(*x) for x in BASE]))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs' columns (but those of the same names) with n_words, base and detections.

    base: places of the base phrases; detections: kept places of all rules, with
    rule, label and priority, by position in words.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    words, table = _table()
    own = ("n_words", "base", "detections", "_plain", "_joined", "_hit", "_found")
    # One select a step, and no step's column used once only: the optimizer would move it into the
    # lambda that uses it, to be evaluated at each call.
    step = docs.select(*[docs[c] for c in docs.columns if c not in own], plain_words(text).alias("_plain"))
    plain, joined = F.col("_plain"), F.col("_joined")
    step = step.withColumns({"n_words": count_words(plain), "_joined": F.when(F.rlike(plain, F.lit(GATE)), lower_ascii(plain))}).drop("_plain")
    step = step.withColumn("_hit", F.filter(words, lambda k: F.contains(joined, k)))
    none = F.array().cast("array<struct<first:int,last:int,label:string>>")
    some = F.array().cast(_PLACE)
    step = step.withColumns({"base": F.when(joined.isNotNull(), _base(joined)).otherwise(none), "_found": F.when(F.size("_hit") > 0, _found(joined, F.col("_hit"), table)).otherwise(some)})
    step = step.withColumn("_found", _ordered(F.col("_found"))).withColumn("_found", _clusters(F.col("_found")))
    return step.withColumn("detections", F.flatten(F.transform("_found", _strongest))).drop("_joined", "_hit", "_found")
