"""Queries of the assistant's front, of lookups with fallbacks, and of imports and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import routing as G
from ..operators import lookups as L
from ..streaming import stateful as S
from .registry import Tables, query


def _words(text: str, words: list[str]) -> str:
    quoted = [w.lower().replace("'", "''") for w in dict.fromkeys(words)]
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in quoted) + ")"


FALLBACK = "CASE " + " ".join(f"WHEN {_words('lower(trim(text))', words)} THEN '{name}'" for name, words in G.INTENT_WORDS) + " ELSE 'chat' END"
NAMED = "CASE n WHEN 'quiz' THEN 'practice' WHEN 'slide_gen' THEN 'slide_gen' WHEN 'history' THEN 'past' WHEN 'forum' THEN 'forum' WHEN 'course' THEN 'course' END"


@query(f"""WITH r AS (SELECT conv_id, turn, text, ['quiz', 'slide_gen', 'history', 'forum', 'nothing', 'course'][1 + (conv_id + turn) % 6] AS n, conv_id % 4 AS role, turn % 3 AS level FROM conversations),
i AS (SELECT *, {NAMED} AS named, coalesce({NAMED}, {FALLBACK}) AS intent FROM r),
b AS (SELECT *, CASE WHEN intent = 'slide_gen' AND role = 3 THEN 'student_role_no_slide_gen' WHEN level = 1 AND intent IN ('case', 'past', 'forum', 'slide_gen') THEN 'level_1_route_restricted' END AS blocked FROM i)
SELECT conv_id, turn, intent, blocked, CASE WHEN blocked IS NULL THEN CASE intent WHEN 'course' THEN '/course' WHEN 'slide_gen' THEN '/slideGen' WHEN 'practice' THEN '/exam' WHEN 'case' THEN '/case' WHEN 'past' THEN '/pastlist' WHEN 'forum' THEN '/forum' END END AS route,
{_words('lower(trim(text))', G.UNDERSTOOD)} AS understood FROM b""")
def str_intents(t: Tables) -> DataFrame:
    """Intents by name or keywords, their routes and what blocks them, and signs of understanding."""
    k, n = F.col("conv_id"), F.col("turn")
    name = F.element_at(F.array(*map(F.lit, ["Quiz ", "slide-gen", "history", "Forum", "nothing", "course"])), (1 + (k + n) % 6).cast("int"))
    intent = F.coalesce(G.intent(name), G.intent_of_text(F.col("text")))
    rows = t.conversations.select("conv_id", "turn", "text", intent.alias("intent"))
    r = G.routed(F.col("intent"), k % 4, n % 3)
    return rows.select("conv_id", "turn", "intent", r["blocked"].alias("blocked"), r["route"].alias("route"), G.understood(F.col("text")).alias("understood"))


REPLY = "concat(p_name, CASE p_size % 5 WHEN 0 THEN ' Business blue' WHEN 1 THEN ' 3 merah' WHEN 2 THEN '' WHEN 3 THEN ' vibrant 2 ungu' ELSE ' 4' END)"


@query(f"""WITH r AS (SELECT p_partkey, p_size, lower({REPLY}) AS s FROM part)
SELECT p_partkey, CASE WHEN {_words('s', G.STYLES['简约'])} THEN '简约' WHEN {_words('s', G.STYLES['商务'])} THEN '商务' WHEN {_words('s', G.STYLES['清新'])} THEN '清新' WHEN {_words('s', G.STYLES['活泼'])} THEN '活泼' WHEN contains(s, '1') THEN '简约' WHEN contains(s, '2') THEN '商务' WHEN contains(s, '3') THEN '清新' WHEN contains(s, '4') THEN '活泼' ELSE '简约' END AS style,
CASE WHEN {_words('s', G.COLOURS['蓝色'])} THEN '蓝色' WHEN {_words('s', G.COLOURS['红色'])} THEN '红色' WHEN {_words('s', G.COLOURS['绿色'])} THEN '绿色' WHEN {_words('s', G.COLOURS['橙色'])} THEN '橙色' WHEN {_words('s', G.COLOURS['紫色'])} THEN '紫色' ELSE '蓝色' END AS colour,
['enus', 'zhcn', 'malay', 'hindi', 'zhcn', 'zhcn'][1 + p_size % 6] AS locale, CASE p_size % 6 WHEN 0 THEN 'Hello ' || p_size WHEN 2 THEN 'bye' ELSE '你好 ' || p_size END AS said FROM r""")
def str_styles(t: Tables) -> DataFrame:
    """Styles and colours of free replies; locales and their messages."""
    style = G.slide_style(F.expr(REPLY))
    n = F.col("p_size")
    code = F.element_at(F.array(*map(F.lit, ["en-US", "zh_Hans", "MS", "hi-IN", "fr", ""])), (1 + n % 6).cast("int"))
    messages = {"zhcn": {"hello": "你好 {n}"}, "enus": {"hello": "Hello {n}"}, "malay": {"hello": "bye"}}
    said = G.message(code, F.lit("hello"), messages, {"n": n})
    return t.part.select("p_partkey", style["style"].alias("style"), style["colour"].alias("colour"), G.locale(code).alias("locale"), said.alias("said"))


@query("""SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN role WHEN 1 THEN role || ' ' WHEN 2 THEN role WHEN 3 THEN 'a ' || role ELSE '' END AS said,
CASE turn % 4 WHEN 0 THEN '' WHEN 1 THEN 'User' WHEN 2 THEN 'Page' ELSE 'Top' END AS name, CASE turn % 4 WHEN 0 THEN '/' WHEN 1 THEN 'user' WHEN 2 THEN 'a/b/8080/x' ELSE '/top' END AS path, CASE turn % 4 WHEN 1 THEN 'ParentView' WHEN 2 THEN 'InnerLink' ELSE 'Layout' END AS component FROM conversations""")
def str_chat(t: Tables) -> DataFrame:
    """What a user wrote beside a quoted block; routes of menus."""
    n, role = F.col("turn"), F.col("role")
    said = F.when(n % 5 == 0, role).when(n % 5 == 1, F.concat(role, F.lit(" <div>q<br></div>r"))).when(n % 5 == 2, F.concat(F.lit(" <div>q</div>"), role)).when(n % 5 == 3, F.concat(F.lit("a <div>q</div>"), role)).otherwise(" <div>q<br></div>r")
    of = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (1 + n % 4).cast("int"))
    menu = G.menu_route(of("", "", "page", "top"), of("x", "user", "http://www.a.b:8080/x", "top"), of(0, 1, 1, 0), of("C", "M", "C", "M"), F.lit(False))
    return t.conversations.select("conv_id", "turn", G.chat_input(said).alias("said"), *[c.alias(k) for k, c in menu.items()])


@query("""WITH s AS (SELECT conv_id AS id, conv_id % 30 AS uid, string_agg(text, '|' ORDER BY turn) AS history, trim(arg_max(text, turn)) AS last FROM conversations GROUP BY conv_id),
q AS (SELECT id AS ask, CASE WHEN id % 7 = 6 THEN -1 ELSE uid END AS uid, CASE id % 3 WHEN 0 THEN last WHEN 1 THEN right(last, 40) ELSE 'x' || last END AS text, history FROM s),
e AS (SELECT ask, max(id) AS a, max(id) FILTER (q.history = s.history) AS h FROM q JOIN s ON s.uid = q.uid AND s.last = trim(q.text) GROUP BY ask),
f AS (SELECT ask, min(id) AS b FROM q JOIN s ON s.uid = q.uid AND length(last) > 0 AND length(trim(text)) > 0 AND (last = trim(text) OR (length(trim(text)) >= 32 AND (ends_with(last, trim(text)) OR ends_with(trim(text), last)))) GROUP BY ask)
SELECT ask, coalesce(h, a, b) AS id FROM q LEFT JOIN e USING (ask) LEFT JOIN f USING (ask)""")
def jn_trajectories(t: Tables) -> DataFrame:
    """Sealed trajectories by key, by full history where several share it, else by a user's texts with a common end."""
    rows = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("r"))
    stored = rows.select(F.col("conv_id").alias("id"), (F.col("conv_id") % 30).alias("uid"), F.transform("r", lambda x: x["text"]).alias("texts"))
    last = F.trim(F.element_at("texts", -1))
    text = F.when(F.col("id") % 3 == 0, last).when(F.col("id") % 3 == 1, F.right(last, F.lit(40))).otherwise(F.concat(F.lit("x"), last))
    asked = stored.select(F.col("id").alias("ask"), F.when(F.col("id") % 7 == 6, F.lit(-1).cast("long")).otherwise(F.col("uid")).alias("uid"), text.alias("text"), "texts")
    return L.trajectories(asked, stored, "ask")


@query("""SELECT c_custkey AS id, trim(c_name) AS name, try_cast(CASE WHEN c_custkey % 9 = 0 THEN 'n/a' ELSE CAST(c_acctbal AS VARCHAR) END AS DOUBLE) AS balance, CASE c_mktsegment WHEN 'BUILDING' THEN 'b' WHEN 'MACHINERY' THEN 'm' END AS segment FROM customer WHERE c_custkey % 10 <> 3""")
def src_import(t: Tables) -> DataFrame:
    """A sheet's rows under their fields: headers bound, types cast, labels to codes, blank rows left out."""
    k = F.col("c_custkey")
    gone = lambda c: F.when(k % 10 != 3, c)
    sheet = t.customer.select(gone(k.cast("string")).alias("Number"), gone(F.concat(F.lit(" "), "c_name")).alias("Full name"), gone(F.when(k % 9 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string"))).alias("Balance"), gone(F.col("c_mktsegment")).alias("Segment"))
    fields = {"id": ("Number", "bigint", None), "name": ("Full name", "string", None), "balance": ("Balance", "double", None), "segment": ("Segment", "string", {"BUILDING": "b", "MACHINERY": "m"})}
    return L.imported(sheet, fields)


@query("""WITH r AS (SELECT s_suppkey, s_acctbal, (row_number() OVER (ORDER BY s_suppkey) - 1) // 30 AS sheet FROM supplier)
SELECT sheet::BIGINT AS sheet, CAST(s_suppkey AS VARCHAR) AS label, s_acctbal AS balance FROM r UNION ALL SELECT max(sheet)::BIGINT, 'total', round(sum(s_acctbal), 2) FROM r""")
def src_export(t: Tables) -> DataFrame:
    """Rows in sheets of thirty, with a row of totals at the end of the last."""
    rows = t.supplier.select(F.col("s_suppkey").cast("string").alias("label"), F.col("s_acctbal").alias("balance"), "s_suppkey")
    return L.exported(rows, "s_suppkey", 30, "label", ["balance"])


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS u, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type IN ('error', 'view')),
w AS (SELECT user_id, event_id, i, CASE WHEN failed THEN 1 ELSE 0 END AS n, u + 864000000000 AS until, false AS locked FROM o WHERE i = 1 UNION ALL
SELECT user_id, event_id, i, CASE WHEN live >= 3 THEN live WHEN failed THEN live + 1 ELSE 0 END, CASE WHEN live >= 3 THEN until WHEN failed THEN u + 864000000000 ELSE until END, live >= 3
FROM (SELECT o.*, w.until, CASE WHEN o.u >= w.until THEN 0 ELSE w.n END AS live FROM w JOIN o ON o.user_id = w.user_id AND o.i = w.i + 1))
SELECT user_id, event_id, locked FROM w""")
def stm_lockout(t: Tables) -> DataFrame:
    """Logins refused: three failures lock for ten days from the last one; a success before that clears them."""
    rows = t.events.where("event_type IN ('error', 'view')").select("user_id", "event_id", "ts", (F.col("event_type") == "error").alias("failed"))
    return S.locked_out(rows, 3, 864_000)
