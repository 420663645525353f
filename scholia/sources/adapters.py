"""Adapters of question sources to one record: stem, options, answer, explanation, image, label, metadata."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import answer_letters, mapped, options_block, parsed_options

# Grades of retinopathy by code.
GRADES = {"0": "无糖尿病视网膜病变(No DR)", "1": "轻度非增殖期糖尿病视网膜病变(Mild NPDR)", "2": "中度非增殖期糖尿病视网膜病变(Moderate NPDR)", "3": "重度非增殖期糖尿病视网膜病变(Severe NPDR)", "4": "增殖期糖尿病视网膜病变(Proliferative DR, PDR)"}
OTHER_GRADE = "糖尿病视网膜病变分级 "

RECORD = ["source", "question_type", "stem", "options", "answer_letter", "answer", "explanation", "image", "gt_label", "label_extra", "meta"]
_MAP = "map<string,string>"


def picked(rows: DataFrame, columns: Mapping[str, str], key: str, default: str) -> Column:
    """The trimmed text of a source's column, by its mapped or usual name; empty where there is none."""
    name = columns.get(key, default)
    return F.trim(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))) if name in rows.columns else F.lit("")


def renamed(rows: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """The rows with columns under the names that others expect; names that aren't there are left out."""
    return rows.withColumnsRenamed({v: k for k, v in columns.items() if v in rows.columns})


def _record(rows: DataFrame, keep: Sequence[str], **given: Column | str) -> DataFrame:
    empty = {"question_type": "text", "stem": "", "answer_letter": "", "answer": "", "explanation": "", "gt_label": ""}
    values = {k: F.lit(v) if isinstance(v, str) else v for k, v in (empty | given).items()}
    values.setdefault("options", F.map_from_arrays(F.array(), F.array()).cast(_MAP))
    for name in ("label_extra", "meta"):
        values.setdefault(name, F.map_from_arrays(F.array(), F.array()).cast(_MAP))
    values.setdefault("image", F.lit(None).cast("string"))
    # Under names of their own first: a source's column may have the name of a field that is made of others.
    own = {name: f"record {name}" for name in RECORD}
    return rows.select(*keep, *[values[name].alias(own[name]) for name in RECORD]).withColumnsRenamed({v: k for k, v in own.items()})


def exam_records(rows: DataFrame, source: str, columns: Mapping[str, str], names: Mapping[str, str] | None = None, options: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Records of exam questions, one for each row that has a stem.

    columns: names of a source that differ from names (those of the CSV form unless given). The answer is the texts of
    its letters, or what stands there if no letter has one. A subject goes to the metadata.
    """
    names = names or {"question": "Question", "options": "Options", "answer": "Answer", "explanation": "Explanation", "subject": "Subject"}
    field = lambda key: picked(rows, columns, key, names[key])
    subject = columns.get("subject", names.get("subject", "")) in rows.columns
    # Columns of their own, so that options, letters and answer are worked out once.
    parsed = parsed_options(field("options")) if options is None else options
    rows = rows.where(field("question") != "").select("*", parsed.alias("own options"), answer_letters(field("answer")).alias("own letters"))
    own, letters = F.col("own options"), F.col("own letters")
    # Letters are distinct and in order, as the sorted entries are.
    texts = F.array_join(F.transform(F.filter(F.array_sort(F.map_entries(own)), lambda e: letters.contains(e["key"])), lambda e: e["value"]), "; ")
    rows = rows.withColumn("own texts", texts)
    rows = rows.withColumn("own answer", F.when(F.col("own texts") != "", F.col("own texts")).otherwise(field("answer")))
    answer = F.col("own answer")
    more = {"meta": F.create_map(F.lit("exam_subject"), field("subject"))} if subject else {}
    return _record(rows, keep, source=source, stem=field("question"), options=own, answer_letter=letters, answer=answer, explanation=field("explanation"), gt_label=answer, **more)


#: Names of exam questions in JSON.
JSON_NAMES = {"question": "question", "options": "option", "answer": "answer", "explanation": "detail", "subject": "exam_subject"}


def generic_records(rows: DataFrame, columns: Mapping[str, str], options: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Records whose answer is a text: its letter is that of the first option with this text, or empty."""
    field = lambda key: picked(rows, columns, key, key)
    rows = rows.where(field("question") != "").withColumn("own options", parsed_options(field("options")) if options is None else options)
    own = F.col("own options")
    hit = F.filter(F.map_entries(own), lambda e: e["value"] == field("answer"))
    letter = F.coalesce(F.get(hit, F.lit(0))["key"], F.lit(""))
    return _record(rows, keep, source="generic_jsonl", stem=field("question"), options=own, answer_letter=letter, answer=field("answer"), explanation=field("explanation"), gt_label=field("answer"))


def graded_images(rows: DataFrame, columns: Mapping[str, str], folder: str = "", keep: Sequence[str] = ()) -> DataFrame:
    """Records of images with a grade: its name as the label; rows without an id or a grade are left out."""
    name, grade = picked(rows, columns, "id", "Image Name"), picked(rows, columns, "grade", "Retinopathy grade")
    label = F.when(grade == "", "").when(grade.isin(*GRADES), mapped(grade, GRADES, "")).otherwise(F.concat(F.lit(OTHER_GRADE), grade))
    extra = F.create_map(F.lit("grade_code"), grade, F.lit("dme_risk"), picked(rows, columns, "dme", "Risk of macular edema"))
    image = F.concat(F.lit(folder.rstrip("/") + "/" if folder else ""), name, F.lit(".jpg"))
    return _record(rows.where((name != "") & (grade != "")), keep, source="idrid", question_type="image", answer=label, image=image, gt_label=label, label_extra=extra, meta=F.create_map(F.lit("image_kind"), F.lit("fundus")))


def write_exam_csv(records: DataFrame, path: str) -> None:
    """Question, Options (one a line, by letter), Answer and Explanation as CSV with a header."""
    rows = records.select(F.col("stem").alias("Question"), options_block(F.col("options")).alias("Options"), F.col("answer_letter").alias("Answer"), F.col("explanation").alias("Explanation"))
    rows.write.option("header", True).option("escape", '"').mode("overwrite").csv(path)
