"""What a model or endpoint answers, as text."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WHITESPACE

#: The fields that may hold a result's text, by precedence.
TEXT_FIELDS = ("text", "result", "prediction", "pred")


def coerce_result(answer: Any) -> str:
    """A predictor's answer as text: a string as it is, of a dict the first field that holds a string, else str()."""
    if isinstance(answer, dict):
        return next((answer[k] for k in TEXT_FIELDS if isinstance(answer.get(k), str)), str(answer))
    return answer if isinstance(answer, str) else str(answer)


def coerce_json(answer: Column) -> Column:
    """coerce_result for an answer that comes as JSON text; an object without such a field stays JSON text."""
    value = F.try_parse_json(answer)
    kind = F.schema_of_variant(value)
    field = lambda k: F.when(F.schema_of_variant(F.try_variant_get(value, f"$.{k}", "variant")) == "STRING", F.try_variant_get(value, f"$.{k}", "string"))
    found = F.coalesce(*[field(k) for k in TEXT_FIELDS], answer)
    whole = F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).when(kind == "VOID", "None")
    return whole.when(F.startswith(kind, F.lit("OBJECT")), found).otherwise(answer)


def message_text(response: Column) -> Column:
    """The first choice's message of a chat response; the whole response if it has none."""
    return F.coalesce(F.get_json_object(response, "$.choices[0].message.content"), response)


def split_list(text: Column) -> Column:
    """The trimmed, non-empty entries of a comma-separated list."""
    bare = F.transform(F.split(text, ","), lambda x: F.regexp_replace(x, f"^{WHITESPACE}+|{WHITESPACE}+$", ""))
    return F.filter(bare, lambda x: x != "")


def id_set(text: Column) -> Column:
    """The distinct integers of a comma-separated list."""
    return F.array_distinct(F.transform(split_list(text), lambda x: x.cast("int")))
