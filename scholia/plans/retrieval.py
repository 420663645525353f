"""Queries of chunking, retrieval and rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators.graph_index import build_graph, graph_nearest
from .registry import Tables, query


@query("""WITH d AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS t FROM documents), s AS (SELECT doc_id, t, CAST(i AS INTEGER) AS chunk FROM d, range(0, 100000) r(i) WHERE t <> '' AND 800 * i + 1 <= greatest(length(t) - 200, 1))
SELECT doc_id, chunk, doc_id || '_' || chunk AS id, substr(t, 800 * chunk + 1, 1000) AS content FROM s""")
def txt_chunks(t: Tables) -> DataFrame:
    """Whole texts in windows of 1000 characters that share 200."""
    return R.fixed_chunks(t.documents, "doc_id")


@query("""WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM q, embeddings e WHERE e.vec_id <> q.vec_id)
SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 32""")
def ret_vectors(t: Tables) -> DataFrame:
    """The 32 vectors of largest inner product with every fiftieth one."""
    queries = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.nearest(t.embeddings, queries, "vec_id", "query_id", "embedding", 32)


@query("""WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM q, embeddings e WHERE e.vec_id <> q.vec_id)
SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10""")
def ret_distances(t: Tables) -> DataFrame:
    """The 10 vectors of smallest distance to every fiftieth one, nearest first."""
    queries = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.nearest(t.embeddings, queries, "vec_id", "query_id", "embedding", 10, "l2")


@query("""WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_inner_product(v, e.embedding::DOUBLE[]) / sqrt(list_inner_product(v, v)), 6) AS score FROM q, embeddings e WHERE e.vec_id <> q.vec_id)
SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10""")
def ret_images(t: Tables) -> DataFrame:
    """The 10 vectors of largest inner product with normalised queries."""
    queries = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.nearest(t.embeddings, queries, "vec_id", "query_id", "embedding", 10, unit=True)


@query("SELECT doc_id, lpad(CAST((row_number() OVER (ORDER BY doc_id) - 1) // 10000 AS VARCHAR), 6, '0') AS shard FROM documents")
def txt_shards(t: Tables) -> DataFrame:
    """Names of the files of ten thousand documents each."""
    return R.sharded_names(t.documents, "doc_id")


@query("SELECT item_id, item_id * 3 AS doc_id, lang, n_chars FROM benchmark LEFT JOIN documents d ON d.doc_id = item_id * 3")
def ret_lookup(t: Tables) -> DataFrame:
    """What is known of the documents that an id list names."""
    ids = t.benchmark.select("item_id", (F.col("item_id") * 3).alias("doc_id"))
    return R.looked_up(ids, t.documents.select("doc_id", "lang", "n_chars"), "doc_id").select("item_id", "doc_id", "lang", "n_chars")


BM25 = """WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pN]+'), lambda w: w <> '') AS w FROM documents), c AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM t),
q AS (SELECT DISTINCT item_id, w AS term FROM benchmark, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pN]+'), lambda w: w <> '')) AS x(w)),
h AS (SELECT doc_id, len(t.w) AS length, x.w AS term, count(*) AS tf FROM t, unnest(t.w) AS x(w) WHERE x.w IN (SELECT term FROM q) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM h GROUP BY term),
s AS (SELECT item_id, doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf / (tf + 0.9::DOUBLE * (0.6::DOUBLE + 0.4::DOUBLE * length / mean))), 6) AS score FROM h JOIN f USING (term) JOIN q USING (term), c GROUP BY ALL),
bm AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s)"""


@query(BM25 + " SELECT * FROM bm WHERE rank <= 10")
def ret_bm25(t: Tables) -> DataFrame:
    """The ten best documents of each benchmark item by BM25."""
    return R.bm25(t.documents, t.benchmark, "doc_id", "item_id", 10)


@query(BM25 + """, o AS (SELECT item_id, doc_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY tf DESC, doc_id) AS INTEGER) AS rank FROM (SELECT item_id, doc_id, sum(tf) AS tf FROM h JOIN q USING (term) GROUP BY ALL)),
u AS (SELECT item_id, doc_id, rank FROM bm WHERE rank <= 100 UNION ALL SELECT item_id, doc_id, rank FROM o WHERE rank <= 100),
f2 AS (SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (100 + rank)), 9) AS score FROM u GROUP BY ALL)
SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM f2 QUALIFY rank <= 32""")
def ret_fusion(t: Tables) -> DataFrame:
    """Two rankings fused by reciprocal ranks."""
    best, overlap = R.bm25_and_counts(t.documents, t.benchmark, "doc_id", "item_id", R.over_fetched(32))
    return R.fused([best, overlap], "item_id", "doc_id", 32)


@query("""WITH r AS (SELECT conv_id, turn, role, text, row_number() OVER w - 1 AS i, len(regexp_split_to_array(trim(text), '\\s+')) AS n, 200 - coalesce(sum(len(regexp_split_to_array(trim(text), '\\s+'))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, string_agg('Document [' || i || '] (Title: ' || role || ') ' || CASE WHEN n <= room THEN text ELSE array_to_string(regexp_split_to_array(trim(text), '\\s+')[:CAST(room AS BIGINT)], ' ') END, chr(10) ORDER BY turn) AS context FROM r WHERE room > 0 GROUP BY conv_id""")
def ret_context(t: Tables) -> DataFrame:
    """Numbered passages to one context of at most 200 words, in order."""
    return R.context(t.conversations, "conv_id", "turn", F.col("role"), F.col("text"), 200)


@query("""WITH d AS (SELECT doc_id, text AS t FROM documents), k AS (SELECT doc_id, CAST(i AS INTEGER) AS child, substr(t, 1080 * i + 1, 1080) AS c FROM d, range(0, 100000) r(i) WHERE 1080 * i < length(t))
SELECT DISTINCT doc_id, child // 2 AS parent FROM k WHERE contains(c, 'the')""")
def ret_parents(t: Tables) -> DataFrame:
    """Parent chunks of 2160 characters whose children of 1080 are hits."""
    n = F.ceil(F.length("text") / 1080).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("text"), i * 1080 + 1, F.lit(1080)).contains("the"))
    hit = t.documents.where("text <> ''").select("doc_id", F.posexplode(parts).alias("child", "hit")).where("hit")
    return hit.select("doc_id", F.floor(F.col("child") / 2).cast("int").alias("parent")).distinct()


@query()
def txt_sections(t: Tables) -> DataFrame:
    """Documents as articles of sections, paragraphs, subtitles and lists, and their chunks."""
    from ..operators.sections import section_chunks

    safe = lambda c: F.replace(F.replace(F.regexp_replace(c, r"[^\P{Cc}]", " "), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    body = F.transform(lines, lambda x, i: F.when(i % 5 == 3, F.concat(F.lit("<p><bold>"), safe(F.left(x, F.lit(40))), F.lit("</bold></p>"))).when(i % 5 == 4, F.concat(F.lit("<list><item>"), F.regexp_replace(safe(x), r"\. ", ".</item><item>"), F.lit("</item></list>"))).otherwise(F.concat(F.lit("<p>"), safe(x), F.lit("</p>"))))
    xml = F.concat(F.lit("<article><title>T "), F.col("doc_id"), F.lit("</title><sec><title>S</title>"), F.array_join(body, ""), F.lit("</sec></article>"))
    return section_chunks(t.documents.select(F.col("doc_id").cast("string").alias("name"), xml.alias("xml")))


@query()
def ret_graph(t: Tables) -> DataFrame:
    """The 32 vectors of largest inner product with every fiftieth one, as a graph index finds them, and how many it measured."""
    queries = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return graph_nearest(build_graph(t.embeddings, "vec_id", "embedding"), queries, "query_id", "embedding", "vec_id", 32)
