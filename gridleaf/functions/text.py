"""Text rules of OCR words and lines, and answer names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that begin a question; bounds of an option.
QUESTION_WORDS = ("what", "how", "when", "where", "why", "which")
OPTION_CHARS, OPTION_CONFIDENCE = 50, 60

#: Names of the answers in row order, and the order of the output columns.
ANSWER_NAMES = [
    "1_yes", "1_no",
    "1b_1", "1b_2", "1b_3", "1b_4", "1b_5", "1b_6", "1b_7", "1b_8",
    "1b_9", "1b_10", "1b_11", "1b_12", "1b_13", "1b_14", "1b_15", "1b_16",
    "2_1", "2_2", "2_3", "2_4", "2_5",
    "3_1", "6_1", "3_2", "6_2", "3_3", "6_3", "3_4",
    "4_1", "7_1", "4_2", "4_3", "7_2", "4_4", "4_5", "7_3", "7_4",
    "5_1", "7_5", "5_2",
]


def answer_columns() -> list[str]:
    """Question by question; by number within a question, yes before no."""
    return sorted(ANSWER_NAMES, key=lambda n: (n.split("_")[0], {"yes": 0, "no": 1}.get(n.split("_")[1]) if not n.split("_")[1].isdigit() else int(n.split("_")[1])))


def clean(text: Column) -> Column:
    """One space for runs of white space, trimmed; only word characters and .,?!-()[] stay. Unicode classes."""
    spaced = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.regexp_replace(spaced, r"(?U)[^\w\s.,?!\-()\[\]]", "")


def category(text: Column, confidence: Column) -> Column:
    question = (F.instr(text, "?") > 0) | F.lower(text).rlike("^(" + "|".join(QUESTION_WORDS) + ")")
    option = (F.length(text) < OPTION_CHARS) & (confidence > OPTION_CONFIDENCE)
    return F.when(question, "question").when(option, "option").otherwise("other")


def clean_name(name: Column) -> Column:
    """Spaces and hyphens become underscores; letters, digits and underscores stay."""
    return F.regexp_replace(F.translate(name, " -", "__"), r"[^\p{L}\p{N}_]", "")


def short_label(text: Column) -> Column:
    return F.when(F.length(text) > 20, F.concat(F.substring(text, 1, 20), F.lit("..."))).otherwise(text)


def confidence_colour(confidence: Column) -> Column:
    return F.when(confidence >= 80, "green").when(confidence >= 50, "yellow").otherwise("red")


def grade(score: Column) -> Column:
    return F.when(score >= 0.9, "A").when(score >= 0.8, "B").when(score >= 0.7, "C").when(score >= 0.6, "D").otherwise("F")
