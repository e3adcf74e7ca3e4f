"""Prompt routing and answer clean-up as column expressions.

The (?U) flag makes \\s, \\b and \\d follow Unicode; (?d) makes only \\n end a line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from rasterloom import fixed_values as fixed

# white space as a text strip understands it: Unicode blanks and the four information separators
_BLANK = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A{_BLANK}+|{_BLANK}+\z", "")


def _one_of(words: list[str]) -> str:
    return "|".join(words)


def location_text(text: Column) -> Column:
    """Place name left after the leading verb and the filler words are dropped."""
    lowered = F.lower(text)
    longest_first = [
        (lowered.startswith(verb), F.substring(text, len(verb) + 1, 1 << 30)) for verb in fixed.SCENE_VERBS
    ]
    rest = F.coalesce(*[F.when(hit, tail) for hit, tail in longest_first], text)
    fewer = F.regexp_replace(rest, rf"(?iU)\b({_one_of(fixed.FILLER_WORDS)})\b", "")
    return strip(F.regexp_replace(fewer, rf"(?U){_BLANK}+", " "))


def route(prompt: Column) -> Column:
    """struct<intent, location, operation, question>; fields that do not apply are null."""
    text = strip(F.coalesce(prompt, F.lit("")))
    lowered = F.lower(text)
    nothing = F.lit(None).cast("string")

    asks_scene = reduce(lambda a, b: a | b, [lowered.startswith(verb) for verb in fixed.SCENE_VERBS])
    operation = F.coalesce(
        *[F.when(lowered.contains(phrase), F.lit(name)) for phrase, name in fixed.PROMPT_OPERATIONS], nothing
    )
    intent = (
        F.when(asks_scene, "fetch_satellite").when(operation.isNotNull(), "process_image").otherwise("ask_question")
    )
    return F.struct(
        intent.alias("intent"),
        F.when(asks_scene, location_text(text)).otherwise(nothing).alias("location"),
        F.when(asks_scene, nothing).otherwise(operation).alias("operation"),
        F.when(~asks_scene & operation.isNull(), text).otherwise(nothing).alias("question"),
    )


def clean_answer(text: Column) -> Column:
    """Answer of a model without its reasoning; null and empty give '' (T3)."""
    start = F.coalesce(text, F.lit(""))
    cleaned = reduce(lambda column, step: F.regexp_replace(column, *step), fixed.ANSWER_CLEANING, start)
    return strip(cleaned)
