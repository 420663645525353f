"""Lookups with fallbacks, and tables of spreadsheets: imports by header, exports in sheets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import mapped, trajectory_key
from ..shared import written
from .relational import fresh

#: A text of so many characters may be found by its end.
SUFFIX = 32


def trajectories(asked: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """key and id (null: none) of the stored trajectory that each row asked (key, uid, text, texts) means.

    stored: id (in the order sealed), uid and texts. In this order: the trajectory of uid and last text, of several the
    one with all of texts, else the last sealed; else the first of the user's whose last text equals text or, from SUFFIX
    characters on, ends with it or is its end.
    """
    last = F.trim(F.coalesce(F.try_element_at("texts", F.lit(-1)), F.lit("")))
    own = stored.select("id", F.col("uid").alias("u"), F.col("texts").alias("t"), last.alias("last"), trajectory_key(F.col("uid").cast("string"), last).alias("k"))
    rows = asked.select(key, "uid", F.trim("text").alias("text"), "texts").withColumn("k", trajectory_key(F.col("uid").cast("string"), F.col("text")))
    exact = rows.select(key, "k", "texts").join(own.select("id", "k", "t"), "k")
    exact = exact.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("texts") == F.col("t"), F.col("id"))), F.max("id")).alias("by_key"))
    long = F.length("text") >= SUFFIX
    alike = (F.col("last") == F.col("text")) | (long & (F.endswith("last", F.col("text")) | F.endswith("text", F.col("last"))))
    by_end = rows.where("text <> ''").join(own.where("last <> ''"), F.col("uid") == F.col("u")).where(alike).groupBy(key).agg(F.min("id").alias("by_end"))
    return asked.select(key).join(exact, key, "left").join(by_end, key, "left").select(key, F.coalesce("by_key", "by_end").alias("id"))


def imported(sheet: DataFrame, fields: Mapping[str, tuple[str, str, Mapping[str, str] | None]]) -> DataFrame:
    """A sheet's rows under fields: name to (header, type, codes by label or None).

    Texts are trimmed and cast, what doesn't cast is null, labels become their codes (an unknown one null); headers that
    the sheet lacks give nulls, and rows that are blank throughout are left out.
    """
    out, blank = [], F.lit(True)
    for name, (header, kind, codes) in fields.items():
        if header not in sheet.columns:
            out.append(F.lit(None).cast(kind).alias(name))
            continue
        text = F.trim(F.col(f"`{header}`").cast("string"))
        blank = blank & (F.coalesce(text, F.lit("")) == "")
        out.append((F.nullif(mapped(text, codes, ""), F.lit("")) if codes else text).try_cast(kind).alias(name))
    return sheet.where(~blank).select(*out)


def exported(rows: DataFrame, order: str, size: int, label: str, totals: Sequence[str], place: str | None = None) -> DataFrame:
    """sheet (from 0), label and totals of the rows in order, size to a sheet, and at the end a row of totals.

    Places come from counts of ranges of order; place names a column for them, null for the totals. Values that aren't
    numbers count as nothing. No rows: a total of zeros.
    """
    part, at, n = (fresh(rows, c) for c in ("range_part", "range_place", "range_rows"))
    ranged = written(rows.repartitionByRange(order).withColumn(part, F.spark_partition_id()), "sheet-rows")
    counts = ranged.groupBy(part).agg(F.count("*").alias(n))
    base = F.coalesce(F.sum(n).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy(part).orderBy(order)) - 1
    placed = ranged.withColumn(at, own).join(F.broadcast(counts.select(part, base.alias(n))), part)  # one row a task
    out = placed.select(F.floor((F.col(n) + F.col(at)) / size).alias("sheet"), label, *totals, *([(F.col(n) + F.col(at)).alias(place)] if place else []))
    number = lambda c: F.coalesce(F.round(F.sum(F.col(c).try_cast("double")), 2), F.lit(0.0)).alias(c)
    total = ranged.agg(F.greatest(F.ceil(F.count("*") / size) - 1, F.lit(0)).alias("sheet"), F.lit("total").alias(label), *[number(c) for c in totals], *([F.lit(None).cast("long").alias(place)] if place else []))
    return out.unionByName(total)
