"""Queries that build questions from records: nodes, difficulties, languages, templates, options, contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import questions as Q
from ..functions import text as T
from .registry import Tables, query

#: Records made of parts: a stem with words that rules look for, a label, a kind and a source.
STEM = "concat(p_name, CASE p_size % 6 WHEN 0 THEN ' acute Timolol dosage' WHEN 1 THEN ' 视盘 staging' WHEN 2 THEN ' cataract surgery' WHEN 3 THEN ' macular EDEMA order' WHEN 4 THEN '' ELSE ' anatomy' END)"
LABEL = "CASE p_size % 4 WHEN 0 THEN 'Normal fundus' WHEN 1 THEN '高度近视' WHEN 2 THEN p_brand ELSE '' END"
SOURCE = "CASE p_partkey % 5 WHEN 0 THEN 'IDRiD' WHEN 1 THEN 'odir' WHEN 2 THEN 'palm' WHEN 3 THEN 'other' END"
KIND = "CASE WHEN p_partkey % 2 = 0 THEN 'image' ELSE 'text' END"
CODES = {"N": 3, "D": 4, "G": 5}


def _words(text: str, words: list[str]) -> str:
    low = f"lower(coalesce({text}, ''))"
    return "(" + " OR ".join(f"contains({low}, '{w}')" for w in dict.fromkeys(w.lower() for w in words)) + ")"


def _node(text: str) -> str:
    return "CASE " + " ".join(f"WHEN {_words(text, words)} THEN '{node}'" for node, words in Q.NODE_RULES) + f" ELSE '{Q.DEFAULT_NODE}' END"


def _of(key: str, values: dict[str, str], default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE '{default}' END"


ROWS = f"WITH r AS (SELECT *, {STEM} AS stem, {LABEL} AS label, {SOURCE} AS source, {KIND} AS kind FROM part)"
HAS_CODE = {k: f"p_partkey % {n} = 0" for k, n in CODES.items()}
CJK = "[\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{F900}-\\x{FAFF}\\x{3000}-\\x{303F}]"


def _lang(text: str) -> str:
    bare = f"regexp_replace({text}, '\\s', '', 'g')"
    return f"CASE WHEN length({bare}) = 0 THEN 'zh' WHEN (length({bare}) - length(regexp_replace({bare}, '{CJK}', '', 'g'))) / length({bare}) >= 0.25 THEN 'zh' ELSE 'en' END"


def _rows(t: Tables) -> DataFrame:
    return t.part.select("*", F.expr(STEM).alias("stem"), F.expr(LABEL).alias("label"), F.expr(SOURCE).alias("source"), F.expr(KIND).alias("kind"))


@query(f"""{ROWS} SELECT p_partkey, {_node('stem')} AS text_node,
CASE WHEN lower(coalesce(source, '')) = 'odir' THEN CASE WHEN {HAS_CODE['D']} THEN '{Q.CODE_NODE['D']}' WHEN {HAS_CODE['G']} THEN '{Q.CODE_NODE['G']}' WHEN {HAS_CODE['N']} THEN '{Q.CODE_NODE['N']}' ELSE '{Q.CODE_NODE['O']}' END
WHEN lower(source) IN ({', '.join(f"'{x}'" for x in Q.IMAGE_SOURCE_NODE)}) THEN {_of('lower(source)', Q.IMAGE_SOURCE_NODE, '')} WHEN {_node('label')} = '{Q.DEFAULT_NODE}' THEN '{Q.MIXED_NODE}' ELSE {_node('label')} END AS image_node FROM r""")
def qst_nodes(t: Tables) -> DataFrame:
    """The curriculum node of a text, and of an image by its source, codes or label."""
    codes = F.create_map(*[c for k, n in CODES.items() for c in (F.lit(k), F.col("p_partkey") % n == 0)])
    return _rows(t).select("p_partkey", Q.text_node(F.col("stem")).alias("text_node"), Q.image_node(F.col("source"), F.col("label"), codes).alias("image_node"))


BOTH = "concat(stem, ' ', label)"
HINT = f"CASE WHEN kind = 'image' THEN CASE WHEN {_words('label', Q.NORMAL_LABELS)} THEN 'mid' ELSE 'high' END WHEN {_words(BOTH, Q.HIGH_WORDS)} THEN 'high' WHEN p_size % 5 > 2 OR {_words(BOTH, Q.MID_WORDS)} THEN 'mid' ELSE 'low' END"


@query(f"""{ROWS}, h AS (SELECT *, {HINT} AS hint FROM r) SELECT p_partkey, hint, CASE WHEN p_size % 7 = 0 THEN 'difficult_diagnostic' ELSE CASE hint WHEN 'low' THEN 'routine_clarification' WHEN 'high' THEN 'difficult_diagnostic' ELSE 'misconception_triggering' END END AS tier,
CASE WHEN p_size % 9 = 0 THEN 'zh' WHEN kind = 'text' THEN {_lang('stem')} WHEN lower(coalesce(source, '')) IN ('idrid', 'odir', 'palm') THEN 'en' ELSE {_lang('label')} END AS lang, p_size % 3 = 1 AS general FROM h""")
def qst_difficulty(t: Tables) -> DataFrame:
    """Hint and tier of difficulty, a row's language, and whether its node is of another field."""
    c = F.col
    hint = Q.difficulty_hint(c("kind"), c("stem"), c("label"), F.greatest(c("p_size") % 5 - 2, F.lit(0)))
    tier = Q.difficulty_tier(hint, F.when(c("p_size") % 7 == 0, " difficult_diagnostic ").otherwise("unheard of"))
    lang = Q.row_lang(c("kind"), c("source"), c("stem"), c("label"), F.when(c("p_size") % 9 == 0, " ZH").otherwise("auto"))
    node = F.when(c("p_size") % 3 == 0, "ophthalmology/retina").when(c("p_size") % 3 == 1, Q.GENERAL_NODE)
    return _rows(t).select("p_partkey", hint.alias("hint"), tier.alias("tier"), lang.alias("lang"), Q.is_general(node).alias("general"))


OPTIONS = {"A": "p_brand", "B": "p_type", "C": "CASE WHEN p_size > 25 THEN p_name ELSE ' ' END"}
BLOCK = "concat('A. ', p_brand, chr(10), 'B. ', p_type, CASE WHEN p_size > 25 THEN concat(chr(10), 'C. ', p_name) ELSE '' END)"
ASKS = f"concat(p_name, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN concat(' which of the following? ', 'A. ', p_brand, ' B) ', p_type, CASE WHEN p_size > 25 THEN concat(' C: ', p_name) ELSE '' END) WHEN 2 THEN concat(chr(10), 'A. ', p_brand) ELSE concat(chr(10), {BLOCK}) END)"


@query(f"""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN concat(p_name, chr(10), {BLOCK}) WHEN 1 THEN concat(p_name, ' which of the following?', chr(10), {BLOCK}) WHEN 2 THEN concat(p_name, chr(10), substr(p_brand, 2), chr(10), {BLOCK}) ELSE concat(p_name, chr(10), {BLOCK}) END AS question,
CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN concat(p_name, ' this concept? A. ', p_brand, ' B) ', p_type, CASE WHEN p_size > 25 THEN concat(' C: ', p_name) ELSE '' END) ELSE p_name END AS bare, p_size % 4 > 0 AS traces FROM part""")
def qst_options(t: Tables) -> DataFrame:
    """A question with its whole block of options, one without any trace of them, and whether there were traces."""
    own = F.create_map(*[c for k, v in OPTIONS.items() for c in (F.lit(k), F.expr(v))])
    ask = F.expr(ASKS)
    return t.part.select("p_partkey", Q.with_options(ask, own).alias("question"), Q.without_options(ask, F.lit("en")).alias("bare"), Q.has_option_traces(ask, F.lit("en")).alias("traces"))


@query(f"""{ROWS} SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN concat(CASE WHEN kind = 'image' THEN '<image>' ELSE '' END, 'Dr., while reviewing my ', CASE WHEN kind = 'image' THEN 'reading of this image' ELSE 'notes' END, ' I got stuck on this: ', stem, '. I keep second-guessing myself when I try to judge it on my own — could you walk me through it step by step?')
ELSE concat(CASE WHEN kind = 'image' THEN '<image>' ELSE '' END, '老师，我在做题时卡住了：', stem, chr(10), 'A. ', p_brand, chr(10), '我按自己的想法排除了一圈还是拿不准，能带我把每个选项的判断思路一步步过一遍吗？') END AS asked,
CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 2 = 0 THEN concat('mistakenly believes the answer is "', p_type, '"', CASE WHEN label <> '' THEN concat(' while overlooking "', label, '"') ELSE '' END) ELSE concat('误以为正确答案是「', p_type, '」', CASE WHEN label <> '' THEN concat('而忽略「', label, '」') ELSE '' END) END AS misconception,
CASE WHEN p_size % 2 = 0 THEN CASE WHEN kind = 'image' THEN concat('Ophthalmology · DR staging (Findings: ', p_brand, ')') ELSE concat('Ophthalmology · DR staging (Key points: ', stem, '; Explanation: ', label, ')') END ELSE CASE WHEN kind = 'image' THEN concat('眼科学·DR staging（检查所见：', p_brand, '）') ELSE concat('眼科学·DR staging（题目要点：', stem, '；解析：', label, '）') END END AS course FROM r""")
def qst_templates(t: Tables) -> DataFrame:
    """A student's question, misconception and course text, from templates of both languages."""
    c = F.col
    lang, image = F.when(c("p_size") % 2 == 0, "en").otherwise("zh"), c("kind") == "image"
    ask = Q.asked(c("stem"), c("label"), F.create_map(F.lit("A"), c("p_brand")), lang, image, c("p_size") % 2 == 1)
    wrong = F.when(c("p_size") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("p_type", "p_name"))
    course = Q.course_text(F.lit("ophthalmology/retina/DR_staging"), lang, image, c("p_brand"), c("stem"), F.lit(None).cast("string"), c("label"))
    return _rows(t).select("p_partkey", ask.alias("asked"), Q.misconception(wrong, c("label"), lang).alias("misconception"), course.alias("course"))


@query("""WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS p FROM documents), f AS (SELECT doc_id, list_filter(list_transform(p, lambda x, i: {'t': trim(x), 'i': i}), lambda r: r.t <> '') AS p FROM d),
j AS (SELECT doc_id, coalesce(array_to_string(list_transform(p, lambda r: CASE WHEN r.i = 1 THEN 'AIM' WHEN r.i = 3 THEN 'RESULT' ELSE 'CONTEXT' END || ': ' || r.t), chr(10) || chr(10)), '') AS t FROM f),
w AS (SELECT doc_id, t, string_split(t, chr(10) || chr(10)) AS p FROM j), k AS (SELECT doc_id, t, list_sum(list_transform(p, lambda x, i: CASE WHEN i = 1 OR list_sum(list_transform(p[:i], lambda y: length(y) + 2)) <= 300 THEN 1 ELSE 0 END)) AS n, p FROM w)
SELECT doc_id, md5(CASE WHEN length(t) <= 300 THEN t ELSE CASE WHEN length(array_to_string(p[:n], chr(10) || chr(10))) > 300 THEN rtrim(array_to_string(p[:n], chr(10) || chr(10))[:300]) ELSE array_to_string(p[:n], chr(10) || chr(10)) END || ' [...]' END) AS context, length(t) AS n_chars FROM k""")
def qst_context(t: Tables) -> DataFrame:
    """Lines of a document as labelled paragraphs, and whole paragraphs to 300 characters."""
    lines = F.split(F.col("text"), "\n")
    labels = F.array(F.lit("AIM"), F.lit(" "), F.lit("RESULT"))
    flat = Q.flat_context(lines, labels)
    return t.documents.select("doc_id", flat.alias("t")).select("doc_id", F.md5(Q.cut_context(F.col("t"), 300)).alias("context"), F.length("t").cast("long").alias("n_chars"))


@query("""SELECT p_partkey, 'Findings (offline template): this image comes from a public fundus dataset' || CASE WHEN p_size % 3 = 0 AND p_size % 2 = 1 THEN ' (no structured annotations from the dataset)' ELSE ' (dataset annotations: ' || concat_ws('; ', CASE WHEN p_size % 3 > 0 THEN 'DR grade code ' || (p_size % 3) END, CASE WHEN p_size % 2 = 0 THEN 'left eye' END) || ')' END
|| '. Student, please first describe what you see in disc -> vessels -> macula order; the teacher then guides qualitative -> localization -> quantification -> staging. The conclusion is reached through the teacher''s step-by-step guidance.' AS finding FROM part""")
def qst_findings(t: Tables) -> DataFrame:
    """What is said of an image in place of its label."""
    n = F.col("p_size")
    return t.part.select("p_partkey", Q.finding_text(F.when(n % 3 > 0, (n % 3).cast("string")), F.lit(" "), F.when(n % 2 == 0, "left"), F.lit("en")).alias("finding"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'B' END AS letter, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_type END AS answer, 'A. ' || p_brand || chr(10) || 'B. ' || p_type AS block FROM part WHERE trim(p_name) <> ''""")
def src_exam(t: Tables) -> DataFrame:
    """Exam rows to the common record: options from lines, the answer from its letters, and the block written again."""
    from ..sources.adapters import exam_records

    n = F.col("p_size")
    rows = t.part.select("p_partkey", F.col("p_name").alias("Question"), F.concat(F.lit("A "), "p_brand", F.lit("\nB、"), "p_type").alias("Options"), F.when(n % 2 == 0, "a").otherwise(" b").alias("Answer"), F.lit("").alias("Explanation"))
    found = exam_records(rows, "exam", {}, keep=["p_partkey"])
    return found.select("p_partkey", F.col("answer_letter").alias("letter"), "answer", T.options_block(F.col("options")).alias("block"))


@query(f"""WITH r AS (SELECT concat('u', p_partkey % 1900) AS uid, {ASKS} AS content, CASE p_size % 5 WHEN 0 THEN 'AB' WHEN 1 THEN 'B' WHEN 2 THEN 'E' ELSE 'A' END AS label, CASE WHEN p_size % 5 = 1 THEN p_type WHEN p_size % 11 = 0 THEN ' ' ELSE p_brand END AS answer FROM part),
l AS (SELECT *, list_distinct(list_transform(regexp_extract_all(content, '(?m)^\\s*([A-Ja-j])\\s*[.、:：)）]\\s*\\S', 1), lambda x: upper(x))) AS letters,
list_transform(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '^\\s*[A-Ja-j]\\s*[.、:：)）]\\s*\\S')), lambda x: upper(substr(trim(x), 1, 1)) || trim(regexp_replace(x, '^\\s*[A-Ja-j]\\s*[.、:：)）]\\s*', ''))) AS lines FROM r)
SELECT 'rows' AS name, CASE WHEN count(*) <> 1900 THEN abs(count(*) - 1900) ELSE 0 END AS failures FROM l UNION ALL SELECT 'repeated', count(*) - count(DISTINCT uid) FROM l UNION ALL SELECT 'label', count(*) FILTER (label = 'AB') FROM l
UNION ALL SELECT 'answer', count(*) FILTER (trim(answer) = '') FROM l UNION ALL SELECT 'explanation', count(*) FROM l UNION ALL SELECT 'letters', count(*) FILTER (len(letters) < 2) FROM l
UNION ALL SELECT 'label_in_letters', count(*) FILTER (len(letters) >= 2 AND NOT list_contains(letters, label[1])) FROM l UNION ALL SELECT 'answer_text', count(*) FILTER (NOT list_contains(lines, label[1] || trim(answer))) FROM l""")
def qst_verified(t: Tables) -> DataFrame:
    """A dataset's checks and how many rows fail each."""
    from ..operators.verification import verified

    n = F.col("p_size")
    rows = t.part.select(F.concat(F.lit("u"), F.col("p_partkey") % 1900).alias("uid"), F.expr(ASKS).alias("content"), F.when(n % 5 == 0, "AB").when(n % 5 == 1, "B").when(n % 5 == 2, "E").otherwise("A").alias("gt_label"), F.when(n % 5 == 1, F.col("p_type")).when(n % 11 == 0, " ").otherwise(F.col("p_brand")).alias("gt_answer"), F.lit(None).cast("string").alias("gt_explanation"))
    return verified(rows, "en", 1900)
