"""Queries of source adapters and catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import readers as R
from .registry import Tables, query

Q = """SELECT event_id AS pos, CASE WHEN event_id % 11 = 0 THEN ' ' ELSE 'q' || (user_id * 7 + event_id % 40) END AS question, CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS long_answer,
CASE event_id % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN ' no' WHEN 2 THEN 'maybe' ELSE 'unsure' END AS final_decision FROM events"""


@query(f"""WITH q AS ({Q}), w AS (SELECT *, CASE WHEN NOT lower(trim(final_decision)) IN ('yes', 'no', 'maybe') THEN 'decision' WHEN trim(question) = '' THEN 'question' WHEN coalesce(long_answer, '') = '' THEN 'answer' END AS why FROM q)
SELECT pos, question, lower(trim(final_decision)) AS answer, coalesce(why, CASE WHEN pos > min(CASE WHEN why IS NULL THEN pos END) OVER (PARTITION BY trim(question)) THEN 'repeat' END) AS why FROM w""")
def src_decisions(t: Tables) -> DataFrame:
    """Question rows with the reason of their rejection."""
    k = F.col("event_id")
    rows = t.events.select(
        k.alias("pos"),
        F.when(k % 11 == 0, " ").otherwise(F.concat(F.lit("q"), (F.col("user_id") * 7 + k % 40).cast("string"))).alias("question"),
        F.when(k % 13 != 0, F.col("event_type")).alias("long_answer"),
        F.when(k % 4 == 0, "Yes").when(k % 4 == 1, " no").when(k % 4 == 2, "maybe").otherwise("unsure").alias("final_decision"))
    return R.decisions(rows)


@query("""WITH w AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand END AS l, p_type AS r, p_size % 3 = 0 AS d, p_size % 5 = 0 AS g FROM part),
o AS (SELECT *, CASE WHEN d AND g THEN 'd,g' WHEN d THEN 'd' WHEN g THEN 'g' ELSE 'normal' END AS other FROM w)
SELECT p_partkey, 'left' AS side, coalesce(l, other) AS label FROM o UNION ALL SELECT p_partkey, 'right', r FROM o""")
def src_two_sided(t: Tables) -> DataFrame:
    """A wide table of two sides, one row each."""
    n = F.col("p_size")
    rows = t.part.select("p_partkey", F.when(n % 2 == 0, F.col("p_brand")).alias("l"), F.col("p_type").alias("r"), (n % 3 == 0).cast("int").alias("d"), (n % 5 == 0).cast("int").alias("g"))
    return R.two_sided(rows, "p_partkey", "l", "r", ["d", "g"])


@query("""WITH f AS (SELECT page_id, 'x/' || (page_id % 9) || '/' || page_id || '.png' AS path, page_id || '.png' AS name, CASE WHEN page_id % 9 > 0 THEN (page_id % 9) || '' ELSE '' END AS parent FROM pages)
SELECT path, name, parent, CASE WHEN page_id % 2 = 0 THEN 'p' || page_id WHEN page_id % 3 = 0 THEN 'n' || page_id WHEN parent <> '' THEN parent ELSE 'unlabeled' END AS label FROM f""")
def src_labels(t: Tables) -> DataFrame:
    """Files to labels by path, name or folder."""
    k = F.col("page_id").cast("string")
    name, folder = F.concat(k, F.lit(".png")), (F.col("page_id") % 9).cast("string")
    path = F.concat(F.lit("x/"), folder, F.lit("/"), name)
    files = t.pages.select(path.alias("path"), name.alias("name"), F.when(F.col("page_id") % 9 > 0, folder).otherwise("").alias("parent"))
    labels = t.pages.where("page_id % 2 = 0").select(path.alias("path"), F.concat(F.lit("p"), k).alias("label"))
    labels = labels.unionByName(t.pages.where("page_id % 2 = 1 AND page_id % 3 = 0").select(F.concat(F.lit("elsewhere/"), name).alias("path"), F.concat(F.lit("n"), k).alias("label")))
    return R.labelled(files, labels)


@query("""WITH n AS (SELECT source, arg_max(n_chars, doc_id) AS n_items FROM documents WHERE doc_id % 2 = 0 AND source <> 'src1' GROUP BY source), o AS (SELECT source, count(*) AS n_items FROM documents GROUP BY source)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE source NOT IN (SELECT source FROM n)""")
def src_catalogue(t: Tables) -> DataFrame:
    """A catalogue with entries replaced."""
    old = t.documents.groupBy("source").agg(F.count("*").alias("n_items"))
    new = t.documents.where("doc_id % 2 = 0 AND source <> 'src1'").select("source", F.col("n_chars").alias("n_items"), F.col("doc_id").alias("pos"))
    return R.upserted_catalog(old, new)
