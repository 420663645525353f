"""Tolerant scans and sinks. Every reader takes a path that Spark's own sources open."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD = "_corrupt_record"
# Extensions of images, and encodings in the order tried (each reads an optional byte order mark).
IMAGES = ("jpg", "jpeg", "png", "tif", "tiff", "bmp", "webp")
ENCODINGS = ("UTF-8", "GBK")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of valid lines; blank and invalid ones are left out, a missing file gives no rows."""
    wide = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    try:
        rows = spark.read.schema(wide).option("columnNameOfCorruptRecord", BAD).json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)
    # Spark refuses a query of the bad column alone, as a count would be: always true, but not folded.
    read = F.hash(F.isnull(F.col(f"`{schema.names[0]}`"))) >= F.lit(-(2**31))
    return rows.where(F.col(BAD).isNull() & read).select(*[F.col(f"`{name}`") for name in schema.names])


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_json_any(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a JSON array, of the first list in an object, of one object, or of lines, whichever the file holds."""
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("t"))
    many = T.ArrayType(schema)
    # A line break between objects makes lines of them, which one parse would cut off at the first.
    whole = F.when(~F.col("t").rlike(r"(?s)\}\s*\n\s*\{"), F.expr("try_parse_json(t)"))
    lines = F.transform(F.filter(F.split("t", "\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, schema))
    inner = F.try_element_at(F.filter(F.map_values(F.from_json("t", "map<string,string>")), lambda v: F.ltrim(v).startswith("[")), F.lit(1))
    rows = (
        F.when(F.col("t").startswith("["), F.from_json("t", many))
        .when(whole.isNotNull() & inner.isNotNull(), F.from_json(inner, many))
        .when(whole.isNotNull(), F.array(F.from_json("t", schema)))
        .otherwise(lines)
    )
    return text.select(F.explode(rows).alias("r")).where("r IS NOT NULL").select("r.*")


def read_csv(spark: SparkSession, path: str, encodings: Sequence[str] = ENCODINGS) -> DataFrame:
    """A table with a header; the first encoding in which no field holds a replacement character.

    A file that fits none gives no rows, under the columns of the last one tried. Encodings beyond Spark's own need the
    session's spark.sql.legacy.javaCharsets, which is set when one is tried and stays, as rows are read later.
    """
    for encoding in encodings:
        if not encoding.upper().startswith(("UTF", "ISO", "US-")):
            spark.conf.set("spark.sql.legacy.javaCharsets", "true")
        df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding).csv(path)
        broken = F.lit(False)
        for name in df.columns:
            broken = broken | F.coalesce(F.col(f"`{name}`").contains("�"), F.lit(False)) | F.lit("�" in name)
        if df.where(broken).isEmpty():
            return df.withColumnsRenamed({name: name.lstrip("\ufeff") for name in df.columns})
    return df.limit(0)


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """id, title and abstract of articles in XML, gzip included; abstracts are joined, articles without one left out."""
    schema = "PMID string, Article struct<ArticleTitle:string, Abstract:struct<AbstractText:array<string>>>"
    rows = spark.read.format("xml").option("rowTag", "MedlineCitation").schema(schema).load(path)
    abstract = F.array_join(F.col("Article.Abstract.AbstractText"), " ")
    return rows.select(F.col("PMID").alias("id"), F.col("Article.ArticleTitle").alias("title"), abstract.alias("abstract")).where("abstract <> ''")


def list_files(spark: SparkSession, path: str, extensions: Sequence[str] = IMAGES) -> DataFrame:
    """path, name and parent of files below path by extension, without their content."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    parts = F.split("path", "/")
    return rows.where(F.lower(F.substring_index("path", ".", -1)).isin(list(extensions))).select("path", F.element_at(parts, -1).alias("name"), F.element_at(parts, -2).alias("parent")).orderBy("path")


def labelled(files: DataFrame, labels: DataFrame) -> DataFrame:
    """files with the label (path, label) of their path, else of their name, else their folder's name."""
    by_path = labels.select(F.col("path").alias("p"), F.col("label").alias("a")).dropDuplicates(["p"])
    by_name = labels.select(F.substring_index("path", "/", -1).alias("n"), F.col("label").alias("b")).dropDuplicates(["n"])
    rows = files.join(by_path, files["path"] == by_path["p"], "left").join(by_name, files["name"] == by_name["n"], "left")
    return rows.select(*[files[c] for c in files.columns], F.coalesce(by_path["a"], by_name["b"], F.nullif(files["parent"], F.lit("")), F.lit("unlabeled")).alias("label"))


def renamed(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Columns by another name; names that df doesn't have are passed over."""
    return df.withColumnsRenamed({a: b for a, b in columns.items() if a in df.columns})


def decisions(rows: DataFrame) -> DataFrame:
    """pos, question, answer and why a row is rejected (null: it isn't) of pos, question, long_answer, final_decision.

    In this order: an invalid decision, an empty question, an empty answer, a question that an earlier row has; a row
    rejected for another reason doesn't make a later one a repeat.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    why = F.when(~F.coalesce(F.lower(F.trim("final_decision")).isin("yes", "no", "maybe"), F.lit(False)), "decision").when(blank("question"), "question").when(blank("long_answer"), "answer")
    rows = rows.withColumn("why", why)
    first = F.min(F.when(F.col("why").isNull(), F.col("pos")))
    firsts = rows.groupBy(F.trim("question").alias("k")).agg(first.alias("first"))
    rows = rows.join(firsts, F.trim("question").eqNullSafe(F.col("k")))
    return rows.select("pos", "question", F.lower(F.trim("final_decision")).alias("answer"), F.coalesce("why", F.when(F.col("pos") > F.col("first"), "repeat")).alias("why"))


def two_sided(rows: DataFrame, key: str, left: str, right: str, flags: Sequence[str]) -> DataFrame:
    """key, side and label of each side of a wide row; a blank label is the flags that are set, else normal."""
    named = F.concat_ws(",", *[F.when(F.col(f) == 1, F.lit(f)) for f in flags])
    other = F.when(named == "", "normal").otherwise(named)
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.when(F.coalesce(F.trim(c), F.lit("")) == "", other).otherwise(F.col(c)).alias("label")) for s, c in (("left", left), ("right", right))])
    return rows.select(key, F.inline(sides))


def upserted_catalog(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries of a catalogue by source: new ones replace old ones, of several new ones the last (pos) counts."""
    rest = [c for c in new.columns if c not in ("source", "pos")]
    last = new.groupBy("source").agg(F.max_by(F.struct(*rest), "pos").alias("r")).select("source", *[F.col("r")[c].alias(c) for c in rest])
    return old.join(last.select("source"), "source", "left_anti").unionByName(last)


def append_daily(df: DataFrame, path: str, day: str = "day") -> None:
    """Rows to an append-only log in one folder a day."""
    df.write.mode("append").partitionBy(day).parquet(path)


#: Readers by type of source.
READERS: dict[str, Callable[..., DataFrame]] = {"jsonl": read_jsonl, "json": read_json_any, "csv": read_csv, "xml": read_articles, "images": list_files}


def load(spark: SparkSession, kind: str, path: str, *rest: T.StructType) -> DataFrame:
    """By a source's type; an unknown one is an error."""
    if kind not in READERS:
        raise ValueError(f"no such kind of source: {kind}")
    return READERS[kind](spark, path, *rest)
