"""Queries of scalar functions over text, numbers and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import rowwise as W
from ..functions import text as T
from .registry import Tables, query

CJK = "[\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{F900}-\\x{FAFF}\\x{3000}-\\x{303F}]"


@query(f"""WITH b AS (SELECT doc_id, regexp_replace(text, '\\s', '', 'g') AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) = 0 THEN 'zh' WHEN (length(t) - length(regexp_replace(t, '{CJK}', '', 'g'))) / length(t) >= 0.25 THEN 'zh' ELSE 'en' END AS lang FROM b""")
def str_language(t: Tables) -> DataFrame:
    """Chinese or not, by the share of characters of whole texts."""
    return t.documents.select("doc_id", T.detect_lang(F.col("text")).alias("lang"))


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all(upper(p_name), '[A-J]'))), '') AS letters,
translate(regexp_replace(upper(p_name), '[^A-F]', '', 'g'), 'ABCDEF', '123456') AS numbers, CASE WHEN trim(lower(p_brand)) = 'en' THEN 'en' ELSE 'zh' END AS lang FROM part""")
def str_answers(t: Tables) -> DataFrame:
    """Answer letters and numbers."""
    up = F.upper("p_name")
    return t.part.select("p_partkey", T.answer_letters(F.col("p_name")).alias("letters"), T.answer_numbers(up).alias("numbers"), T.norm_lang(F.col("p_brand")).alias("lang"))


@query("""SELECT p_partkey, 'A. ' || p_brand || chr(10) || 'B. ' || p_name || CASE WHEN p_size > 20 THEN chr(10) || 'C. ' || p_type ELSE '' END AS block FROM part""")
def str_options(t: Tables) -> DataFrame:
    """Options to a block, parsed again and written once more: a round trip."""
    given = F.map_from_arrays(F.array(*map(F.lit, "CAB")), F.array(F.when(F.col("p_size") > 20, F.col("p_type")).otherwise(F.lit(" ")), F.col("p_brand"), F.col("p_name")))
    return t.part.select("p_partkey", T.options_block(T.parsed_options(T.options_block(given))).alias("block"))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(p_type, 'BRASS|COPPER') THEN 'metal' WHEN regexp_matches(p_name, 'ring|bolt') THEN 'shape' ELSE 'other' END AS node,
CASE p_brand WHEN 'Brand#11' THEN 'low' WHEN 'Brand#22' THEN 'high' ELSE 'mid' END AS tier FROM part""")
def str_rules(t: Tables) -> DataFrame:
    """The first rule that matches, and a table lookup with a default."""
    node = F.coalesce(F.when(F.col("p_type").rlike("BRASS|COPPER"), F.lit("metal")), F.when(F.col("p_name").rlike("ring|bolt"), F.lit("shape")), F.lit("other"))
    return t.part.select("p_partkey", node.alias("node"), T.mapped(F.col("p_brand"), {"Brand#11": "low", "Brand#22": "high"}, "mid").alias("tier"))


@query("""SELECT event_id, regexp_extract('note ' || props || ' end', '(\\{.*\\})', 1) AS json, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events""")
def str_json(t: Tables) -> DataFrame:
    """A JSON object out of talk around it, and its field."""
    said = T.json_object(F.concat(F.lit("note "), "props", F.lit(" end")))
    return t.events.select("event_id", said.alias("json"), F.get_json_object(said, "$.k").cast("int").alias("k"))


@query("""SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS t, CASE WHEN regexp_matches(trim(lang), '[.?!]$') THEN lang || ' ' || source ELSE lang || '. ' || source END AS titled FROM documents""")
def str_collapsed(t: Tables) -> DataFrame:
    """White space collapsed in whole texts; a title and content as sentences."""
    return t.documents.select("doc_id", T.collapsed(F.col("text")).alias("t"), T.sentence_joined(F.col("lang"), F.col("source")).alias("titled"))


@query("""SELECT page_id, regexp_extract(html, '<title>((?s:.*?))</title>', 1) AS title, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)(?:[?#].*)?$', 1)) AS ext FROM pages""")
def str_tags(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.tagged(F.col("html"), "title").alias("title"), T.file_extension(F.col("url")).alias("ext"))


@query("""SELECT c_custkey, substr(p, 1, 3) || '****' || substr(p, 8) AS phone, CASE WHEN length(c_name) > 0 THEN lower(c_name[1]) || '****@x.org' END AS email, repeat('*', length(c_name)) AS password,
CASE length(v) WHEN 7 THEN substr(v, 1, 3) || '***' || substr(v, 7) WHEN 8 THEN substr(v, 1, 3) || '****' || substr(v, 8) ELSE v END AS plate,
'**** **** **** **** ' || substr(d, 16, 3) AS bank, CASE WHEN c_custkey % 2 = 0 THEN substr(d, 1, 4) || '** **** ****' || substr(d, 15, 4) ELSE substr(d, 1, 17) || 'X' END AS card, substr(c_name, 1, 1) || '*' || substr(c_name, 3) AS name
FROM (SELECT *, lpad(CAST(c_custkey * 7919 AS VARCHAR), 11, '1') AS p, substr('AB1234567', 1, CAST(6 + c_custkey % 4 AS INTEGER)) AS v, lpad(CAST(c_custkey * 104729 AS VARCHAR), 18, '6222021') AS d FROM customer)""")
def str_masks(t: Tables) -> DataFrame:
    """Personal data masked, of every kind."""
    k = F.col("c_custkey")
    phone, email = F.lpad((k * 7919).cast("string"), 11, "1"), F.concat(F.lower("c_name"), F.lit("@x.org"))
    digits = F.lpad((k * 104729).cast("string"), 18, "6222021")
    plate, card = F.left(F.lit("AB1234567"), 6 + k % 4), F.when(k % 2 == 0, digits).otherwise(F.concat(F.left(digits, F.lit(17)), F.lit("X")))
    return t.customer.select("c_custkey", T.masked(phone, "phone").alias("phone"), T.masked(email, "email").alias("email"), T.masked(F.col("c_name"), "password").alias("password"), T.masked(plate, "plate").alias("plate"), T.masked(digits, "bank_card").alias("bank"), T.masked(card, "id_card").alias("card"), T.masked(F.col("c_name"), "username").alias("name"))


@query("""SELECT doc_id, CAST(('0x' || substr(sha1('doc-' || doc_id), 1, 8)) AS BIGINT) % 100000 AS seed, sha1('doc-' || doc_id || '||' || trim(text)) AS trajectory, md5(text) AS digest, sha256(text) AS wide FROM documents""")
def str_hashes(t: Tables) -> DataFrame:
    """Seeds and keys from digests."""
    uid = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    return t.documents.select("doc_id", T.persona_seed(uid).alias("seed"), T.trajectory_key(uid, F.col("text")).alias("trajectory"), F.md5("text").alias("digest"), F.sha2("text", 256).alias("wide"))


@query("""SELECT p_partkey, lower(regexp_replace('pName' || replace(p_name, ' ', 'X'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS snake, right('0000' || p_partkey, 4) AS padded,
[p_size % 9, p_size % 7] AS section FROM part""")
def str_names(t: Tables) -> DataFrame:
    """Names, paddings and section numbers."""
    name = F.concat(F.lit("pName"), F.replace("p_name", F.lit(" "), F.lit("X")))
    title = F.concat(F.lit("Section "), (F.col("p_size") % 9).cast("string"), F.lit("."), (F.col("p_size") % 7).cast("string"))
    return t.part.select("p_partkey", T.camel_to_snake(name).alias("snake"), T.padded_left(F.col("p_partkey").cast("string"), 4, "0").alias("padded"), T.section_numbers(title).alias("section"))


@query("""SELECT p_partkey, p_name AS back, length(p_name) AS chars, CASE WHEN p_size % 3 = 0 THEN true WHEN p_size % 3 = 1 THEN false END AS flag,
CASE WHEN p_size % 4 = 0 THEN p_size ELSE -1 END AS number, CASE WHEN p_size % 4 = 1 THEN [p_size, NULL, 7] ELSE [p_size] END AS numbers FROM part""")
def str_widths(t: Tables) -> DataFrame:
    """To full width and back; words to booleans and texts to numbers."""
    n = F.col("p_size")
    number = F.when(n % 4 == 0, F.concat(F.lit(" "), n)).when(n % 4 == 1, F.concat(n, F.lit("x"))).when(n % 4 == 2, " ")
    numbers = F.when(n % 4 == 1, F.concat(n, F.lit(", x, ,7"))).otherwise(n.cast("string"))
    wide = T.full_width(F.col("p_name"))
    word = F.when(F.col("p_size") % 3 == 0, " Yes").when(F.col("p_size") % 3 == 1, "NO").otherwise("maybe")
    return t.part.select("p_partkey", T.half_width(wide).alias("back"), F.length(wide).cast("long").alias("chars"), T.true_word(word).alias("flag"), T.converted(number, "int", -1).alias("number"), T.converted_list(numbers, "int").alias("numbers"))


@query("""WITH e AS (SELECT o_orderkey, o_orderdate, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d %H:%M') WHEN 2 THEN strftime(o_orderdate, '%Y.%m') ELSE 'n/a' END AS s FROM orders)
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN date_trunc('day', o_orderdate) WHEN 1 THEN date_trunc('minute', o_orderdate) WHEN 2 THEN date_trunc('month', o_orderdate)::TIMESTAMP END AS parsed,
abs(epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1995-06-17')) // 86400000000 AS days FROM e""")
def dat_parsed(t: Tables) -> DataFrame:
    """Dates of many forms; whole days to a date."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    s = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "yyyy/MM/dd HH:mm")).when(k == 2, F.date_format(d, "yyyy.MM")).otherwise("n/a")
    return t.orders.select("o_orderkey", N.parsed_date(s).cast("timestamp_ntz").alias("parsed"), N.whole_days(d.cast("timestamp"), F.lit("1995-06-17").cast("timestamp")).alias("days"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, (s // 86400) || ' days ' || (s % 86400 // 3600) || ' hours ' || (s % 3600 // 60) || ' minutes' AS span FROM (SELECT *, CAST(l_partkey * 977 AS BIGINT) AS s FROM lineitem)""")
def dat_span(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", N.spelled_span(F.col("l_partkey") * 977).alias("span"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CAST((200 * CAST(round(l_extendedprice * 100) AS BIGINT) + CAST(l_quantity AS BIGINT)) // (2 * CAST(l_quantity AS BIGINT)) AS DOUBLE) / 10000 AS unit, greatest(0.0, least(1.0, l_discount * 12)) AS share,
CASE WHEN l_discount * 10 < 0.34 THEN 'L' WHEN l_discount * 10 < 0.67 THEN 'M' ELSE 'H' END AS lvl, round(1.0 + (0.05 - 1.0) * least(1.0, l_linenumber / 5.0), 6) AS eps FROM lineitem""")
def mth_scores(t: Tables) -> DataFrame:
    """Half-up division, clamps, levels and a schedule."""
    unit = N.divided(F.col("l_extendedprice"), F.col("l_quantity"), 4).cast("double")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", unit.alias("unit"), N.clamp(F.col("l_discount") * 12).alias("share"), N.level(F.col("l_discount") * 10).alias("lvl"), F.round(N.epsilon(F.col("l_linenumber"), 1.0, 0.05, 5), 6).alias("eps"))


@query()
def str_sanitized(t: Tables) -> DataFrame:
    """Pages as HTML of a few kept tags; the stack of open tags needs Python, in Arrow batches."""
    return t.pages.select("page_id", W.sanitize("html").alias("clean"), W.unescape(W.escape("url")).alias("url"))


@query()
def str_amounts(t: Tables) -> DataFrame:
    """Balances in Chinese capitals."""
    return t.customer.select("c_custkey", "c_acctbal", W.amount_in_words("c_acctbal").alias("words"))


@query()
def txt_recursive_chunks(t: Tables) -> DataFrame:
    """Whole texts cut at paragraphs, lines, words or characters."""
    rows = t.documents.select("doc_id", F.posexplode(W.chunked("text")).alias("chunk", "content"))
    return rows.select("doc_id", "chunk", F.concat_ws("_", F.col("doc_id").cast("string"), F.col("chunk").cast("string")).alias("id"), T.collapsed(F.col("content")).alias("content"))
