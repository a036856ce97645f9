"""Response parsing: scores, thinking split, generated JSON, confidences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocab
from .text import BLANK, ustrip


def _unicode_blanks(pattern: str) -> str:
    """Blanks of any script, digits of ASCII only."""
    return pattern.replace(r"\s", BLANK).replace(r"\d", "[0-9]")


def extract_score(response: Column) -> Column:
    """First pattern (in order) that matches decides; its leftmost digits are
    the score. No match, empty/NULL text or an out-of-range int -> 999.

    Each pattern's regex is evaluated once per row and only when the earlier
    patterns did not match (``coalesce`` is lazy)."""
    digits = F.coalesce(*[F.nullif(F.regexp_extract(response, "(?i)" + _unicode_blanks(pat), 1), F.lit(""))
                          for pat in vocab.SCORE_PATTERNS])
    return F.coalesce(digits.try_cast("int"), F.lit(vocab.NO_SCORE)).cast("int")


THINK_END = "</think>"


def split_thinking(text: Column) -> tuple[Column, Column]:
    """(reasoning, content): reasoning is everything up to the last
    ``</think>``; both have newlines stripped at the ends. No marker ->
    reasoning ``''`` and the whole text as content."""
    content = F.substring_index(text, THINK_END, -1)  # the whole text without a marker
    before = F.length(text) - F.length(content) - len(THINK_END)
    reasoning = F.substring(text, F.lit(1), F.greatest(before, F.lit(0)))
    nl = F.lit("\n")
    return F.btrim(reasoning, nl), F.btrim(content, nl)


GENERATED_SCHEMA = T.StructType([
    T.StructField("question", T.StringType(), True),
    T.StructField("error_label", T.StringType(), True),
])


def strip_fences(text: Column) -> Column:
    """Remove a leading code fence (with or without a ``json`` tag) and a
    trailing fence, after stripping whitespace."""
    t = ustrip(text)
    tagged = F.regexp_replace(F.regexp_replace(t, r"^```json", ""), r"```$", "")
    bare = t.substr(F.lit(4), F.length(t))
    bare = F.when(bare.endswith("```"), bare.substr(F.lit(1), F.length(bare) - 3)
                  ).otherwise(bare)
    return (F.when(t.startswith("```json"), tagged)
            .when(t.startswith("```"), bare)
            .otherwise(t))


def parse_generated_json(text: Column, schema: T.StructType = GENERATED_SCHEMA) -> Column:
    """Struct of the generated fields; NULL when the text is not one JSON
    object and nothing else (single-quoted objects are accepted). Read as the
    only element of an array, so that anything behind the object is an error."""
    found = F.from_json(F.concat(F.lit("["), strip_fences(text), F.lit("]")), T.ArrayType(schema),
                        {"mode": "PERMISSIVE", "allowSingleQuotes": "true"})
    return F.when(F.size(found) == 1, found[0])


def parse_confidence(text: Column) -> Column:
    """Reviewer reply -> double in text; NULL on bad text and on NaN."""
    v = ustrip(text).try_cast("double")
    return F.when(~F.isnan(v), v)
