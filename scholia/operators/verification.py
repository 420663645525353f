"""Checks of built datasets: one pass gives a table of check names and how many rows fail each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.questions import GENERAL_NODE, MARKS, has_option_traces

LETTER, LINE = rf"(?m)^\s*([A-Ja-j])\s*{MARKS}\s*\S", rf"(?m)^\s*([A-Ja-j])\s*{MARKS}\s*(\S[^\n]*)$"


def option_letters(text: Column) -> Column:
    """Distinct letters, in upper case, that start a line as an option's."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(LETTER), 1), lambda x: F.upper(x)))


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def verified(rows: DataFrame, lang: str, expected: int = 0, answers: bool = True) -> DataFrame:
    """name and failures of each check of rows (uid, content, gt_label, gt_answer, gt_explanation, curriculum_node, lang).

    Of all: the expected number (0: any), repeated ids, labels that aren't one letter A to E, empty answers and
    explanations. Of question and answer rows: fewer than two option letters in the content, a label that isn't among
    them, and answers that aren't their letter's text. Of open questions instead: traces of options, nodes of no field,
    other languages. Nulls count as empty; no rows fail only the expected number.
    """
    text = F.coalesce(F.col("content"), F.lit(""))
    checks = {
        "label": ~F.coalesce(F.col("gt_label").rlike("^[A-E]$"), F.lit(False)),
        "answer": _blank("gt_answer"),
        "explanation": _blank("gt_explanation"),
    }
    if answers:
        letters, label = option_letters(text), F.left(F.coalesce(F.col("gt_label"), F.lit("")), F.lit(1))
        lines = F.arrays_zip(F.regexp_extract_all(text, F.lit(LINE), 1).alias("k"), F.regexp_extract_all(text, F.lit(LINE), 2).alias("v"))
        own = F.exists(lines, lambda x: (F.upper(x["k"]) == label) & (F.trim(x["v"]) == F.trim(F.coalesce(F.col("gt_answer"), F.lit("")))))
        checks |= {"letters": F.size(letters) < 2, "label_in_letters": (F.size(letters) >= 2) & ~F.array_contains(letters, label), "answer_text": ~own}
    else:
        node = F.coalesce(F.col("curriculum_node"), F.lit(""))
        checks |= {"traces": has_option_traces(text, F.lit(lang)), "node": ~(node.startswith("ophthalmology/") | (node == GENERAL_NODE)), "language": F.coalesce(F.col("lang"), F.lit("zh")) != lang}
    one = rows.agg(
        F.when((F.lit(expected) > 0) & (F.count("*") != expected), F.abs(F.count("*") - expected)).otherwise(0).cast("long").alias("rows"),
        (F.count("*") - F.countDistinct(F.coalesce("uid", F.lit("")))).alias("repeated"),
        *[F.count_if(c).alias(k) for k, c in checks.items()],
    )
    return one.unpivot([], one.columns, "name", "failures")
