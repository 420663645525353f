"""Queries of readers, sinks and adapters: the given tables are written in a source's format, faults included, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rowwise import moderation
from ..functions.text import listed_options, message_key, options_block
from ..operators.dialogue import medical_point
from ..operators.rewards import final_evaluation
from ..shared import shared_folder
from ..sources import adapters as A
from ..sources import readers as R
from .registry import Tables, query

CITATION = "<MedlineCitation><PMID>{}</PMID><Article><ArticleTitle>{}</ArticleTitle>{}</Article></MedlineCitation>"


def _filled(template: str, *values: Column) -> Column:
    """A text with values in the places of {}; null if one of them is."""
    texts = template.split("{}")
    return F.concat(F.lit(texts[0]), *[c for v, x in zip(values, texts[1:]) for c in (v.cast("string"), F.lit(x))])


@query("""SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN lang END AS lang, source, text FROM documents WHERE doc_id % 7 > 0 AND doc_id % 11 > 0""")
def src_jsonl(t: Tables) -> DataFrame:
    """Documents as lines, some blank and some cut off; the valid ones are written again, with their nulls, and read."""
    spark, k = t.spark, F.col("doc_id")
    rows = t.documents.select("doc_id", F.when(k % 5 > 0, F.col("lang")).alias("lang"), "source", "text")
    whole = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    lines = rows.select(F.when(k % 7 == 0, "").when(k % 11 == 0, _filled('{"doc_id": {}, "text": "', k)).otherwise(whole).alias("value"))
    first, second = shared_folder(spark, "jsonl"), shared_folder(spark, "jsonl")
    lines.write.text(first)
    R.write_jsonl(R.load(spark, "jsonl", first, rows.schema), second)
    return R.read_jsonl(spark, second, rows.schema)


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def src_json_shapes(t: Tables) -> DataFrame:
    """Customers in files of at most 500: an array, a list within an object, lines, one after the other."""
    rows = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    one = F.to_json(F.struct(*rows.columns))
    files = rows.groupBy(F.floor(F.col("c_custkey") / 500).alias("file")).agg(F.collect_list(one).alias("x"))
    array = F.concat(F.lit("["), F.array_join("x", ", "), F.lit("]"))
    shape = F.when(F.col("file") % 3 == 0, array).when(F.col("file") % 3 == 1, _filled('{"total": {}, "data": {}}', F.size("x"), array)).otherwise(F.array_join("x", "\n"))
    path = shared_folder(t.spark, "json")
    files.select("file", shape.alias("value")).write.partitionBy("file").text(path)
    return R.load(t.spark, "json", path, rows.schema)


@query("""WITH p AS (SELECT p_partkey, p_size, [p_brand, p_type, p_name] AS o FROM part WHERE p_size % 9 > 0)
SELECT 'No. ' || p_partkey || chr(10) || 'says "so", or not' AS stem, CASE p_size % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'BC' WHEN 2 THEN 'AC' ELSE '' END AS answer_letter,
CASE p_size % 4 WHEN 0 THEN o[1] WHEN 1 THEN o[2] || '; ' || o[3] WHEN 2 THEN o[1] || '; ' || o[3] ELSE '' END AS answer, o[2] AS second, 'because of ' || p_size AS explanation FROM p""")
def src_exam_csv(t: Tables) -> DataFrame:
    """Exam questions of the JSON form to CSV, with quotes, commas and line breaks, and back through other column names."""
    k, n = F.col("p_partkey"), F.col("p_size")
    rows = t.part.select(
        F.when(n % 9 > 0, _filled('No. {}\nsays "so", or not', k)).otherwise(" ").alias("question"),
        options_block(F.create_map(F.lit("A"), F.col("p_brand"), F.lit("B"), F.col("p_type"), F.lit("C"), F.col("p_name"))).alias("option"),
        F.when(n % 4 == 0, "a").when(n % 4 == 1, "C, B").when(n % 4 == 2, "ACA").otherwise("").alias("answer"),
        _filled("because of {}", n).alias("why"))
    path = shared_folder(t.spark, "csv")
    A.write_exam_csv(A.exam_records(rows, "json", {"explanation": "why"}, A.JSON_NAMES), path)
    read = R.renamed(R.load(t.spark, "csv", path), {"Question": "Stem", "no such": "x"})
    found = A.exam_records(read, "csv", {"question": "Stem"})
    return found.select("stem", "answer_letter", "answer", F.try_element_at("options", F.lit("B")).alias("second"), "explanation")


@query("""SELECT p_partkey, 'Which is ' || p_partkey || '?' AS stem, CASE p_size % 3 WHEN 0 THEN p_type WHEN 1 THEN p_name ELSE 'none' END AS answer,
CASE p_size % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'C' ELSE '' END AS answer_letter, 'generic_jsonl' AS source FROM part WHERE p_size % 7 > 0""")
def src_generic(t: Tables) -> DataFrame:
    """Records of questions that give their answer as a text, under columns of other names."""
    n = F.col("p_size")
    rows = t.part.select(
        "p_partkey", F.when(n % 7 > 0, _filled(" Which is {}?", F.col("p_partkey"))).alias("asked"),
        _filled("A. {}\nB) {}\nc: {}", F.col("p_brand"), F.col("p_type"), F.col("p_name")).alias("options"),
        F.when(n % 3 == 0, F.col("p_type")).when(n % 3 == 1, F.col("p_name")).otherwise("none").alias("correct"))
    return A.generic_records(rows, {"question": "asked", "answer": "correct"}, keep=["p_partkey"]).select("p_partkey", "stem", "answer", "answer_letter", "source")


@query("""SELECT p_partkey, 'eyes/' || p_name || '.jpg' AS image, CASE p_size % 7 WHEN 0 THEN '无糖尿病视网膜病变(No DR)' WHEN 1 THEN '轻度非增殖期糖尿病视网膜病变(Mild NPDR)' WHEN 2 THEN '中度非增殖期糖尿病视网膜病变(Moderate NPDR)'
WHEN 3 THEN '重度非增殖期糖尿病视网膜病变(Severe NPDR)' WHEN 4 THEN '增殖期糖尿病视网膜病变(Proliferative DR, PDR)' ELSE '糖尿病视网膜病变分级 5' END AS gt_label, CAST(p_size % 3 AS VARCHAR) AS dme FROM part WHERE p_size % 7 < 6""")
def src_graded(t: Tables) -> DataFrame:
    """Records of graded images; a grade without a name is given as it stands, rows without one are left out."""
    n = F.col("p_size")
    rows = t.part.select("p_partkey", F.col("p_name").alias("Image Name"), F.when(n % 7 < 6, (n % 7).cast("string")).alias("level"), (n % 3).alias("Risk of macular edema"))
    found = A.graded_images(rows, {"grade": "level"}, "eyes/", ["p_partkey"])
    return found.select("p_partkey", "image", "gt_label", F.col("label_extra")["dme_risk"].alias("dme"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || ' & ' || p_size AS title, p_brand || ' ' || p_type AS abstract FROM part WHERE p_size % 3 > 0""")
def src_articles(t: Tables) -> DataFrame:
    """Articles in compressed XML files of at most 500, some without an abstract."""
    n = F.col("p_size")
    abstract = F.when(n % 3 == 0, "").otherwise(_filled("<Abstract><AbstractText>{}</AbstractText><AbstractText>{}</AbstractText></Abstract>", F.col("p_brand"), F.col("p_type")))
    rows = t.part.select(F.floor(F.col("p_partkey") / 500).alias("file"), _filled(CITATION, F.col("p_partkey"), _filled("{} &amp; {}", F.col("p_name"), n), abstract).alias("x"))
    files = rows.groupBy("file").agg(_filled("<Set>\n{}\n</Set>", F.array_join(F.collect_list("x"), "\n")).alias("value"))
    path = shared_folder(t.spark, "xml")
    files.write.partitionBy("file").option("compression", "gzip").text(path)
    return R.load(t.spark, "xml", path)


@query("""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, count(*) FILTER (event_type = 'click') AS clicks, min(event_id) AS first FROM events GROUP BY 1""")
def src_daily(t: Tables) -> DataFrame:
    """A log of days, appended to twice."""
    rows = t.events.select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    path = shared_folder(t.spark, "daily")
    for part in ("event_type = 'click'", "event_type <> 'click' OR event_type IS NULL"):
        R.append_daily(rows.where(part), path)
    days = t.spark.read.schema(rows.schema).parquet(path).groupBy("day")
    return days.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.min("event_id").alias("first"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'A=' || p_brand || '|B=' || p_type WHEN 1 THEN 'A=' || p_type || '|C=' || p_name ELSE 'A=' || p_type || '|B=' || p_brand END AS options FROM part""")
def str_listed(t: Tables) -> DataFrame:
    """Options of a list by their own letters, else by place; a null keeps its place, of equal letters the last counts."""
    n, brand, kind, name = F.col("p_size"), F.col("p_brand"), F.col("p_type"), F.col("p_name")
    third = F.array(_filled("A: {}", kind), F.lit(None).cast("string"), _filled("c. {}", name))
    values = F.when(n % 3 == 0, F.array(_filled("b. {}", brand), _filled("B) {}", kind), _filled(" a、{} ", brand))).when(n % 3 == 1, third).otherwise(F.array(_filled("B) {}", brand), _filled("A.{}", kind)))
    entries = F.array_sort(F.map_entries(listed_options(values)))
    return t.part.select("p_partkey", F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), "|").alias("options"))


@query("""SELECT doc_id, CASE WHEN doc_id % 7 IN (0, 6) THEN true WHEN doc_id % 7 = 1 THEN false END AS approved FROM documents""")
def str_moderation(t: Tables) -> DataFrame:
    """Decisions in JSON, plain or fenced; a further, repeated, missing or wrongly typed field makes none."""
    k, reason = F.col("doc_id") % 7, F.to_json(F.struct(F.col("text").alias("reason")), {"ignoreNullFields": "false"})
    rest = F.expr("substr(r, 2)")
    head = lambda x: F.concat(F.lit("{" + x + ", "), rest)
    reply = (
        F.when(k == 0, head('"approved": true')).when(k == 1, head('"approved": false')).when(k == 2, head('"approved": true, "x": 1'))
        .when(k == 3, head('"approved": 1')).when(k == 4, F.col("r")).when(k == 5, head('"approved": true, "approved": false'))
        .otherwise(F.concat(F.lit("```json\n"), head('"approved": true'), F.lit("\n```")))
    )
    return t.documents.withColumn("r", reason).select("doc_id", moderation(reply).alias("approved"))


@query("""SELECT conv_id, turn, sha1('[' || to_json({'role': role, 'content': text}) || ']#' || (conv_id % 5) || '#small#' || turn) AS key FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL""")
def hsh_message_keys(t: Tables) -> DataFrame:
    """Cache keys of calls with one message."""
    rows = t.conversations.where("role IS NOT NULL AND text IS NOT NULL")
    message = F.array(F.struct("role", F.col("text").alias("content")))
    return rows.select("conv_id", "turn", message_key(message, F.col("conv_id") % 5, F.lit("small"), F.col("turn")).alias("key"))


@query("""WITH s AS (SELECT l_orderkey, arg_max({'m': l_discount, 'e': CASE WHEN l_linenumber % 3 > 0 THEN l_tax END, 's': CASE WHEN l_suppkey % 2 > 0 THEN l_quantity END}, (l_linenumber, l_partkey, l_suppkey, l_quantity)) FILTER (l_returnflag <> 'R') AS x FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, coalesce(x.m, 0.3) AS mastery, coalesce(x.e, 0.7) AS engagement, coalesce(x.s, 1.0) AS severity FROM s""")
def seq_final(t: Tables) -> DataFrame:
    """The last state of an order's lines, with values for what is missing; returned lines have no state."""
    n = F.col("l_linenumber")
    state = F.struct(F.col("l_discount").alias("mastery"), F.when(n % 3 > 0, F.col("l_tax")).alias("engagement"), F.when(F.col("l_suppkey") % 2 > 0, F.col("l_quantity")).alias("misconception_severity"))
    kept = F.when(F.col("l_returnflag") != "R", state)
    steps = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", kept.alias("state"))))
    last = t.lineitem.groupBy("l_orderkey").agg(final_evaluation(F.transform(steps, lambda s: s["state"])).alias("r"))
    return last.select("l_orderkey", "r.mastery", "r.engagement", F.col("r.misconception_severity").alias("severity"))


@query("""WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN role ELSE coalesce(text, '') END AS x, trim(coalesce(text, '')) = '' AND turn % 2 = 0 AS blank FROM conversations)
SELECT conv_id, turn, CASE WHEN conv_id % 4 = 0 THEN true WHEN blank THEN false WHEN conv_id % 4 = 1 THEN contains(lower(x), 'user') OR contains(lower(x), 'th')
WHEN conv_id % 4 = 2 THEN contains(lower(x), 'old cataract') OR contains(lower(x), 'in th') OR contains(lower(x), 'assist') OR len(list_filter(['O', 'l', 'd', 'C', 'a', 't', 'r', 'c'], lambda k: contains(x, k))) >= 4.8
ELSE contains(lower(x), 'zq') END AS covered FROM c""")
def str_points(t: Tables) -> DataFrame:
    """Whether a turn covers its label: by its correct body, else by its text."""
    k = F.col("conv_id") % 4
    label = F.when(k == 0, "Maybe").when(k == 1, " TH ").when(k == 2, "Old Cataract").otherwise("zq")
    text = F.when(F.col("turn") % 2 == 1, _filled("<correct>{}</correct> in th", F.col("role"))).otherwise(F.col("text"))
    return t.conversations.select("conv_id", "turn", medical_point(label, text, {"cataract": ["In th", "assist"], "th": ["user"]}).alias("covered"))
