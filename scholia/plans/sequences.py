"""Queries of dialogues, learner states and stateful behaviour in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import curriculum as C
from ..operators import dialogue as D
from ..operators import rewards as R
from ..operators.relational import numbered
from ..streaming import stateful as S
from .registry import Tables, query

TAG_LIST = ", ".join(f"'{x}'" for x in D.TAGS)


def turn_text(pick: str) -> str:
    """SQL of a teacher's text made from a row of conversations, in ten forms; pick names a tag by its number."""
    a, b = pick.format("1 + (conv_id * 3 + turn * 5) % 8"), pick.format("1 + (conv_id + turn * 3) % 8")
    pair = lambda tag, body, attrs="": f"'<', {tag}, '{attrs}>', {body}, '</', {tag}, '>'"
    forms = [
        f"'<', {a}, ' level=\"', turn % 3, '\"> ', role, '</', {a}, '> ', {pair(b, 'role')}",
        f"{pair(a, 'role')}, '<end/>'",
        f"'<', {a}, '>x <', {b}, '>y</', {b}, '></', {a}, '>'",
        "'no tag <oops> </hint>'",
        "role, ' in plain words'",
        "' '",
        f"'<', {a}, '/> <end></end> <', {b}, '> left open'",
        f"{pair(a, 'role')}, {pair(a, 'role')}, {pair(a, 'role')}",
        f"'<end/>', {pair(b, 'role')}, '<Hint>z</Hint>'",
        f"'<hint level=2>', role, '</hint>', {pair(b, 'role')}, '<correct>', role, '</correct><hint level=1>r</hint>'",
    ]
    return "CASE (conv_id + turn) % 10 " + " ".join(f"WHEN {i} THEN concat({x})" for i, x in enumerate(forms)) + " END"


TURN, DUCK_TURN = turn_text(f"element_at(array({TAG_LIST}), CAST({{}} AS INT))"), turn_text(f"list_extract([{TAG_LIST}], {{}})")
#: The same for DuckDB: one alternative for each tag instead of a back-reference.
DUCK_TAGS = "(?s)" + "|".join(rf"<{x}(?:[^\w<>-][^<>]*?)?(?:/>|>.*?</{x}>)" for x in D.TAGS)
DUCK_ACTIONS = f"""x AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS t, {DUCK_TURN} AS text FROM conversations),
m AS (SELECT conv_id, turn, t, unnest(regexp_extract_all(text, '{DUCK_TAGS}')) AS e, generate_subscripts(regexp_extract_all(text, '{DUCK_TAGS}'), 1) AS i FROM x),
a AS (SELECT conv_id, turn, t, i, e, regexp_extract(e, '^<(\\w+)', 1) AS tag, regexp_extract(e, '^<\\w+([^<>]*?)(/>|>)', 1) AS attrs FROM m),
l AS (SELECT *, coalesce(try_cast(nullif(regexp_extract(attrs, 'level\\s*=\\s*["'']?(\\d+)', 1), '') AS BIGINT), 1) AS level FROM a)""".replace("\\\\", "\\")
DUCK_DEFECTS = f"""k AS (SELECT conv_id, turn, text, regexp_extract_all(text, '</?[A-Za-z_][A-Za-z0-9_-]*[^<>]*>') AS m FROM x),
s AS (SELECT conv_id, turn, 0 AS i, '' AS open, CAST(NULL AS VARCHAR) AS bad, 0 AS n FROM k UNION ALL SELECT conv_id, turn, i + 1,
CASE WHEN NOT known OR tag = 'end' THEN open WHEN closing THEN '' WHEN alone OR open <> '' THEN open ELSE tag END,
CASE WHEN NOT known THEN 'unknown_tag' WHEN tag = 'end' THEN CASE WHEN closing THEN 'paired_end' WHEN NOT alone THEN 'end_not_self_closed' WHEN open <> '' THEN 'end_nested' END
WHEN closing THEN CASE WHEN open = '' THEN 'stray_close' WHEN open <> tag THEN 'mismatch' END WHEN alone THEN 'self_closed_content' WHEN open <> '' THEN 'nested' END,
n + CASE WHEN known AND ((tag = 'end' AND NOT closing AND alone AND open = '') OR (tag <> 'end' AND NOT closing AND NOT alone AND open = '')) THEN 1 ELSE 0 END
FROM (SELECT s.*, e LIKE '</%' AS closing, e LIKE '%/>' AS alone, regexp_extract(e, '^</?([A-Za-z_][A-Za-z0-9_-]*)', 1) AS tag, regexp_extract(e, '^</?([A-Za-z_][A-Za-z0-9_-]*)', 1) IN ({TAG_LIST}) AS known
FROM (SELECT s.*, k.m[s.i + 1] AS e FROM s JOIN k USING (conv_id, turn) WHERE s.i < len(k.m)) s)),
d AS (SELECT conv_id, turn, list(bad ORDER BY i) FILTER (bad IS NOT NULL) AS bad, arg_max(open, i) AS open, max(n) AS n FROM s GROUP BY conv_id, turn),
f AS (SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN ['empty'] WHEN len(m) = 0 THEN ['no_tags'] WHEN n = 0 AND bad IS NULL AND open = '' THEN ['none'] ELSE list_concat(coalesce(bad, []), CASE WHEN open <> '' THEN ['unclosed'] ELSE [] END) END AS bad FROM k JOIN d USING (conv_id, turn))"""
#: Rules across turns by windows: what was before an action, and counts.
DUCK_RULES = """o AS (SELECT *, coalesce(bool_or(tag IN ('recall', 'hint')) OVER b, false) AS scaffold, coalesce(bool_or(tag IN ('check', 'probe')) OVER b, false) AS checked,
lag(tag) OVER (PARTITION BY conv_id, turn ORDER BY i) AS before FROM l WINDOW b AS (PARTITION BY conv_id ORDER BY turn, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT conv_id, t, level, lag(level) OVER (PARTITION BY conv_id ORDER BY turn, i) AS last FROM l WHERE tag = 'hint'),
g AS (SELECT conv_id, 'G2 ' || t || ' no_scaffold' AS d FROM o WHERE tag = 'correct' AND NOT scaffold UNION ALL SELECT conv_id, 'G2 ' || t || ' no_check' FROM o WHERE tag = 'correct' AND NOT checked
UNION ALL SELECT conv_id, 'G3 ' || t || ' level ' || last || ' ' || level FROM h WHERE level < last UNION ALL SELECT conv_id, 'G3 ' || t || ' level 0 ' || level FROM h WHERE last IS NULL AND level < 0
UNION ALL SELECT conv_id, 'G3 ' || t || ' often ' || tag FROM l GROUP BY conv_id, t, tag HAVING count(*) >= 3
UNION ALL SELECT conv_id, 'G4 ' || t || ' after_end ' || tag FROM o WHERE before = 'end'
UNION ALL SELECT conv_id, 'G4 ' || first || ' early_end' FROM (SELECT conv_id, min(t) FILTER (tag = 'end') AS first FROM l GROUP BY conv_id) JOIN (SELECT conv_id, max(t) AS turns FROM x GROUP BY conv_id) USING (conv_id) WHERE first < turns
UNION ALL SELECT conv_id, 'G5 ' || t || ' ' || tag FROM o WHERE tag IN ('explain', 'correct') AND NOT checked AND conv_id % 3 <> 1
UNION ALL SELECT conv_id, t || ' empty' FROM x WHERE trim(text) = '')"""
#: A node and a difficulty for each dialogue: reading comes first but where conv_id % 3 is 1.
NODE = "CASE conv_id % 3 WHEN 0 THEN 'ophthalmology/retina/OCT_reading' WHEN 1 THEN 'ophthalmology/glaucoma/disc_evaluation' END"


def _turn() -> F.Column:
    return F.expr(TURN)


def _dialogues(t: Tables) -> DataFrame:
    """conv_id and its teacher's texts in order."""
    rows = t.conversations.select("conv_id", "turn", "role", _turn().alias("text"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("rows")).select("conv_id", "rows", F.transform("rows", lambda r: r["text"]).alias("texts"))


@query("""SELECT conv_id, count(*) AS n_turns, bool_and(role IN ('user', 'assistant')) AS roles_ok, bool_and(CASE WHEN b IS NULL THEN role = 'user' ELSE role <> b END) AS alternates,
arg_max(role, turn) = 'assistant' AS ends_with_assistant FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) GROUP BY conv_id""")
def seq_alternation(t: Tables) -> DataFrame:
    """Roles of a dialogue: known, alternating from the user, the assistant last."""
    return D.alternation(t.conversations)


@query(f"""WITH {DUCK_ACTIONS} SELECT x.conv_id, x.turn, coalesce(string_agg(tag, ',' ORDER BY i), '') AS tags, count(i) AS n, coalesce(sum(level) FILTER (tag = 'hint'), 0)::BIGINT AS levels FROM x LEFT JOIN l USING (conv_id, turn) GROUP BY ALL""")
def seq_actions(t: Tables) -> DataFrame:
    """Tags of each turn, and the sum of its hints' levels."""
    rows = t.conversations.select("conv_id", "turn", D.actions(_turn()).alias("a"))
    levels = F.aggregate(F.filter("a", lambda x: x["tag"] == "hint"), F.lit(0).cast("bigint"), lambda s, x: s + D.hint_level(x["attrs"]))
    return rows.select("conv_id", "turn", F.array_join(F.transform("a", lambda x: x["tag"]), ",").alias("tags"), F.size("a").cast("long").alias("n"), levels.alias("levels"))


@query(f"WITH RECURSIVE {DUCK_ACTIONS}, {DUCK_DEFECTS} SELECT conv_id, turn, array_to_string(bad, ',') AS defects FROM f")
def seq_defects(t: Tables) -> DataFrame:
    """What is wrong with each turn's tags."""
    return t.conversations.select("conv_id", "turn", F.array_join(D.turn_defects(_turn()), ",").alias("defects"))


@query(f"""WITH {DUCK_ACTIONS}, {DUCK_RULES} SELECT conv_id, string_agg(DISTINCT d, ',' ORDER BY d) AS defects FROM (SELECT conv_id, d FROM g UNION ALL SELECT DISTINCT conv_id, NULL FROM x) GROUP BY conv_id""")
def seq_rules(t: Tables) -> DataFrame:
    """What is wrong across the turns of each dialogue; null if nothing."""
    bad = D.global_defects(F.col("texts"), D.reading_first(F.expr(NODE), F.lit("difficult_diagnostic")))
    joined = F.array_join(F.array_sort(F.array_distinct(bad)), ",")
    return _dialogues(t).select("conv_id", F.when(joined != "", joined).alias("defects"))


@query(f"""WITH {DUCK_ACTIONS} SELECT conv_id, count(DISTINCT turn) AS n_turns, count(*) FILTER (tag = 'hint') AS hints, count(DISTINCT turn) FILTER (tag = 'hint') AS hint_turns, coalesce(max(level) FILTER (tag = 'hint'), 0) AS max_level, coalesce(bool_or(tag = 'end'), false) AS has_end
FROM x LEFT JOIN l USING (conv_id, turn) GROUP BY conv_id""")
def seq_tag_stats(t: Tables) -> DataFrame:
    """Turns, hints, turns with hints, the highest level and whether there is an end, of each dialogue."""
    s = D.action_stats(F.col("texts"))
    return _dialogues(t).select("conv_id", s["n_turns"].cast("long").alias("n_turns"), s["tag_counts"]["hint"].cast("long").alias("hints"), s["tag_turns"]["hint"].cast("long").alias("hint_turns"), s["max_hint_level"].alias("max_level"), s["has_end"].alias("has_end"))


@query(f"""WITH RECURSIVE {DUCK_ACTIONS.replace("FROM conversations)", "FROM conversations WHERE role = 'assistant')")}, {DUCK_DEFECTS}, {DUCK_RULES},
c AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, max(turn) OVER (PARTITION BY conv_id) = turn AS final, {DUCK_TURN} AS text FROM conversations),
r AS (SELECT conv_id, 'turns' AS reason FROM c GROUP BY conv_id HAVING count(*) FILTER (role = 'assistant') NOT BETWEEN 2 AND 5
UNION ALL SELECT conv_id, 'open_end' FROM c GROUP BY conv_id HAVING NOT contains(coalesce(arg_max(text, turn) FILTER (role = 'assistant'), ''), '<end/>')
UNION ALL SELECT conv_id, 'structure' FROM c WHERE role NOT IN ('user', 'assistant') OR role <> CASE WHEN p % 2 = 1 THEN 'user' ELSE 'assistant' END OR (final AND role <> 'assistant')
UNION ALL SELECT conv_id, 'G1' FROM f WHERE len(bad) > 0 UNION ALL SELECT conv_id, CASE WHEN d LIKE 'G%' THEN d[1:2] ELSE 'other' END FROM g)
SELECT conv_id, coalesce(string_agg(DISTINCT reason, ',' ORDER BY reason), '') AS reasons FROM (SELECT * FROM r UNION ALL SELECT DISTINCT conv_id, NULL FROM c) GROUP BY conv_id""")
def seq_gate(t: Tables) -> DataFrame:
    """Why a dialogue is dropped; nothing if it is kept."""
    messages = F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("content")))
    reasons = D.gate(messages, F.lit("en"), F.expr(NODE), F.lit("difficult_diagnostic"), F.lit(True))
    return _dialogues(t).select("conv_id", F.array_join(F.array_sort(reasons), ",").alias("reasons"))


@query(f"""WITH RECURSIVE {DUCK_ACTIONS}, {DUCK_DEFECTS}, {DUCK_RULES},
n AS (SELECT conv_id, coalesce(a, 0) + coalesce(b, 0) AS bad FROM (SELECT DISTINCT conv_id FROM x) LEFT JOIN (SELECT conv_id, sum(len(bad)) AS a FROM f GROUP BY conv_id) USING (conv_id) LEFT JOIN (SELECT conv_id, count(*) AS b FROM g GROUP BY conv_id) USING (conv_id)),
q AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS k FROM l WHERE tag <> 'end'),
w AS (SELECT u.conv_id, count(*) AS pairs FROM q u JOIN q v ON u.conv_id = v.conv_id AND u.k < v.k WHERE (u.tag, v.tag) IN (('recall', 'hint'), ('hint', 'correct'), ('recall', 'correct')) GROUP BY u.conv_id),
y AS (SELECT conv_id, count(*) AS acts, count(*) - count(DISTINCT (tag, trim(attrs), regexp_replace(regexp_replace(e, '^<[^<>]*>', ''), '</[^<>]*>$', ''))) AS loops FROM q GROUP BY conv_id),
z AS (SELECT conv_id, bad + CASE WHEN acts IS NULL THEN 1 ELSE 0 END AS bad, coalesce(pairs, 0) AS pairs, coalesce(loops, 0) AS loops, conv_id % 7 / 10.0 AS dm, conv_id % 5 / 10.0 AS de, conv_id % 11 / 10.0 AS sev FROM n LEFT JOIN w USING (conv_id) LEFT JOIN y USING (conv_id))
SELECT conv_id, pairs::DOUBLE AS pairs, loops::BIGINT AS loops, round((CASE WHEN bad = 0 THEN 1 ELSE 0 END - 0.1 * bad)::DOUBLE, 6) AS format, round((0.2 * (CASE WHEN bad = 0 THEN 1 ELSE 0 END - 0.1 * bad) + 0.3 * (pairs - 0.1 * loops) + 0.4 * (0.6 * dm + 0.2 * de - 0.2 * sev))::DOUBLE, 6) AS total FROM z""")
def seq_rewards(t: Tables) -> DataFrame:
    """A trajectory's reward: format, ordered pairs, loops, and all together with what was learnt."""
    k = F.col("conv_id")
    turns = F.aggregate(F.transform("texts", lambda x: F.size(D.turn_defects(x))), F.lit(0), lambda s, n: s + n)
    bad = turns + F.size(D.global_defects(F.col("texts"), D.reading_first(F.expr(NODE), F.lit("difficult_diagnostic"))))
    r = R.sequence_reward(F.col("texts"), bad, k % 7 / 10, k % 5 / 10, k % 11 / 10, F.lit(True), F.lit(False))
    return _dialogues(t).select("conv_id", r["pairs"].alias("pairs"), r["loops"].cast("long").alias("loops"), F.round(r["format"], 6).alias("format"), F.round(r["total"], 6).alias("total"))


@query(f"""WITH {DUCK_ACTIONS} SELECT conv_id, turn, '["' || CASE WHEN conv_id % 4 = 0 THEN 'na' ELSE 'n' || conv_id % 4 END || '","' || CASE WHEN turn % 10 / 10.0 < 0.34 THEN 'L' WHEN turn % 10 / 10.0 < 0.67 THEN 'M' ELSE 'H' END || '","none","' || CASE WHEN conv_id % 10 / 10.0 < 0.34 THEN 'L' WHEN conv_id % 10 / 10.0 < 0.67 THEN 'M' ELSE 'H' END || '","'
|| coalesce(nullif(regexp_extract(text, '<(recall|probe|hint|check|explain|correct|encourage|summarize)[\\s>]', 1), ''), 'other') || '"]' AS anchor,
round((0.6 * (turn % 3 - 1) / 10.0 + 0.3 * (conv_id % 3 - 1) / 10.0 + CASE WHEN turn % 3 = 2 THEN 0.1 ELSE 0 END - 0.1 * greatest(0, turn % 10 / 10.0 - 0.6) - CASE WHEN len(string_split(text, '<hint')) > 3 THEN 0.05 ELSE 0 END)::DOUBLE, 6) AS reward FROM x""")
def seq_anchors(t: Tables) -> DataFrame:
    """The anchor and the dense reward of each step."""
    k, n = F.col("conv_id"), F.col("turn")
    anchor = R.anchor_key(F.when(k % 4 != 0, F.concat(F.lit("n"), k % 4)), F.lit(None).cast("string"), n % 10 / 10, k % 10 / 10, _turn())
    reward = R.step_reward((n % 3 - 1) / 10, (k % 3 - 1) / 10, n % 10 / 10, _turn())
    return t.conversations.select("conv_id", "turn", anchor.alias("anchor"), F.round(reward, 6).alias("reward"))


@query(f"""WITH {DUCK_ACTIONS}, e AS (SELECT conv_id, coalesce(bool_or(tag = 'end') FILTER (last), false) AS ends, coalesce(bool_or(tag = 'correct'), false) AS corrected
FROM (SELECT *, t = max(t) OVER (PARTITION BY conv_id) AS last FROM (SELECT x.conv_id, x.t, l.tag FROM x LEFT JOIN l ON l.conv_id = x.conv_id AND l.turn = x.turn)) GROUP BY conv_id)
SELECT conv_id, ends AND NOT corrected AND conv_id % 4 <> 0 AND conv_id % 5 < 3 AS violated FROM e""")
def seq_endings(t: Tables) -> DataFrame:
    """Dialogues that end without a correction and without a sign that the misconception is gone."""
    k = F.col("conv_id")
    fell = F.array(F.struct(F.lit(0.8).alias("before"), (0.8 - (k % 5) / 10).alias("after")))
    return _dialogues(t).select("conv_id", R.ending_violated(F.col("texts"), F.array(k % 4 == 0), fell).alias("violated"))


@query("""WITH l AS (SELECT l_orderkey, list(l_discount ORDER BY l_linenumber, l_discount, l_partkey) AS r FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, round(list_sum(list_transform(r, lambda x, i: x * pow(0.9, i - 1))), 9) AS ret FROM l""")
def seq_discounted(t: Tables) -> DataFrame:
    """Discounted returns of episodes."""
    rows = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_discount", "l_partkey"))).alias("s"))
    return rows.select("l_orderkey", F.round(D.discounted(F.transform("s", lambda x: x["l_discount"]), 0.9), 9).alias("ret"))


@query("""WITH RECURSIVE o AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_discount, l_partkey) AS i, l_discount * 6 - 0.2 AS d, l_tax - 0.05 AS e, l_discount AS f, l_returnflag = 'R' AS resolved, l_returnflag = 'A' OR l_linestatus = 'F' AS shown FROM lineitem),
w AS (SELECT l_orderkey, 0::BIGINT AS i, 0.3::DOUBLE AS m, 0.7::DOUBLE AS g, 0.1::DOUBLE AS f, 0.8::DOUBLE AS s FROM o GROUP BY l_orderkey
UNION ALL SELECT o.l_orderkey, o.i, greatest(0.0, least(1.0, w.m + o.d)), greatest(0.0, least(1.0, w.g + o.e)), greatest(0.0, least(1.0, w.f + o.f)), least(1.0, CASE WHEN resolved THEN greatest(0.0, w.s - 0.5) ELSE w.s END + CASE WHEN shown THEN 0.1 ELSE 0 END) FROM w JOIN o ON o.l_orderkey = w.l_orderkey AND o.i = w.i + 1)
SELECT l_orderkey, round(arg_max(m, i), 6) AS mastery, round(arg_max(g, i), 6) AS engagement, round(arg_max(f, i), 6) AS fatigue, round(arg_max(s, i), 6) AS severity FROM w GROUP BY l_orderkey""")
def seq_states(t: Tables) -> DataFrame:
    """A learner's state after all turns, clamped after each."""
    rows = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_discount", "l_partkey", "l_tax", "l_returnflag", "l_linestatus"))).alias("s"))
    deltas = F.transform("s", lambda x: F.struct((x["l_discount"] * 6 - 0.2).alias("mastery"), (x["l_tax"] - 0.05).alias("engagement"), x["l_discount"].alias("fatigue"), (x["l_returnflag"] == "R").alias("resolved"), ((x["l_returnflag"] == "A") | (x["l_linestatus"] == "F")).alias("shown")))
    return rows.select("l_orderkey", D.final_state(deltas).alias("f")).select("l_orderkey", *[F.round(F.col("f")[k], 6).alias(n) for k, n in (("mastery", "mastery"), ("engagement", "engagement"), ("fatigue", "fatigue"), ("misconception_severity", "severity"))])


@query("""SELECT p_partkey, CAST(p_partkey % 3 * 9 + p_size % 3 * 3 + p_partkey % 2 AS BIGINT) AS action, CASE WHEN p_size % 5 >= p_size % 7 AND p_size % 5 >= p_size % 4 THEN 0 WHEN p_size % 7 >= p_size % 4 THEN 1 ELSE 2 END::BIGINT AS best,
CASE WHEN p_size % 11 = 0 THEN 'end_tag' WHEN p_size % 10 >= 5 THEN 'max_turns' WHEN p_retailprice >= 1500 THEN 'length' END AS stop FROM part""")
def seq_codes(t: Tables) -> DataFrame:
    """Action codes, the heuristic's choice and why a dialogue stops."""
    k, n = F.col("p_partkey"), F.col("p_size")
    code = D.action_code(k % 3, n % 3, k % 2).cast("long")
    stop = D.stop_reason(n % 11 == 0, n % 10, 5, F.col("p_retailprice"), 1500)
    return t.part.select("p_partkey", code.alias("action"), D.best_action(F.array(n % 5, n % 7, n % 4)).alias("best"), stop.alias("stop"))


#: A learner's state from an order: mastery and misconception of six courses, and the rest.
STATES = """WITH s AS (SELECT o_orderkey AS k, [least(1.0, (o_custkey * (i + 3) % 101) / 100.0 + CASE WHEN o_orderkey % 4 = 0 THEN 0.6 ELSE 0 END)::DOUBLE FOR i IN range(6)] AS m,
[((o_orderkey * (i + 2) % 97) / CASE WHEN o_orderkey % 3 = 0 THEN 97.0 ELSE 300.0 END)::DOUBLE FOR i IN range(6)] AS c, (o_custkey % 90 / 90.0)::DOUBLE AS e, (o_orderkey % 70 / 75.0)::DOUBLE AS f, (o_orderkey % 6)::INTEGER AS p, (o_custkey % 3)::INTEGER AS r, (o_orderkey % 41)::INTEGER AS st FROM orders),
q AS (SELECT *, [[]::INTEGER[], [0], [1], [1, 2], [2, 3], [4]] AS need, [m[i + 1] >= 0.7::DOUBLE AND c[i + 1] <= 0.35::DOUBLE FOR i IN range(6)] AS ok, least(p + 1, 5) AS nxt FROM s),
w AS (SELECT *, ok[p + 1] AND len(list_filter(need[nxt + 1], lambda x: NOT ok[x + 1])) = 0 AS adv, list_sort(list_transform(list_filter(need[p + 1], lambda x: NOT ok[x + 1]), lambda x: {'m': m[x + 1], 'x': x})) AS weak FROM q),
a AS (SELECT w.*, n.a::INTEGER AS a, (n.a // 9)::INTEGER AS ma, (n.a % 9 // 3)::INTEGER AS di, (n.a % 3)::INTEGER AS sy, CASE n.a // 9 WHEN 0 THEN nxt WHEN 1 THEN coalesce(weak[1].x, p) ELSE p END AS node FROM w, range(27) n(a)),
v AS (SELECT *, st < 40 AND (ma <> 0 OR adv) AND (ma <> 2 OR c[p + 1] >= 0.12::DOUBLE) AND (di <> 2 OR (m[node + 1] >= 0.45::DOUBLE AND f <= 0.65::DOUBLE)) AND (di <> 1 OR f <= 0.85::DOUBLE) AND (sy <> 2 OR (e >= 0.4::DOUBLE AND f <= 0.65::DOUBLE AND r <> 1)) AS valid FROM a)"""


def _states(t: Tables) -> DataFrame:
    k, u = F.col("o_orderkey"), F.col("o_custkey")
    courses = F.sequence(F.lit(0), F.lit(5))
    mastery = F.transform(courses, lambda i: F.least(F.lit(1.0), (u * (i + 3) % 101) / 100 + F.when(k % 4 == 0, 0.6).otherwise(0.0)))
    misconception = F.transform(courses, lambda i: (k * (i + 2) % 97) / F.when(k % 3 == 0, 97.0).otherwise(300.0))
    state = F.struct(mastery.alias("mastery"), misconception.alias("misconception"), (u % 90 / 90).alias("engagement"), (k % 70 / 75).alias("fatigue"), (k % 6).cast("int").alias("position"), (u % 3).cast("int").alias("profile"), (k % 41).cast("int").alias("step"), F.lit(False).alias("completed"))
    return t.orders.select(k.alias("state"), state.alias("s"))


@query(STATES + " SELECT k AS state, count(*) FILTER (valid) AS valid, min(a) FILTER (valid) AS first_valid, max(a) FILTER (valid) AS last_valid FROM v GROUP BY k")
def sim_mask(t: Tables) -> DataFrame:
    """Which of 27 actions a learner's state permits."""
    rows = _states(t).select("state", C.mask(F.col("s")).alias("m"))
    return rows.select("state", F.size("m").cast("long").alias("valid"), F.array_min("m").alias("first_valid"), F.array_max("m").alias("last_valid"))


@query(STATES + """, h AS (SELECT *, CASE WHEN bool_or(valid AND ma = 0) OVER (PARTITION BY k) THEN 0 WHEN c[p + 1] > 0.28::DOUBLE THEN 2 ELSE 1 END AS wm FROM v),
g AS (SELECT *, CASE wm WHEN 0 THEN nxt WHEN 1 THEN coalesce(weak[1].x, p) ELSE p END AS wn FROM h),
j AS (SELECT *, 5 * (ma = wm)::INTEGER + 2 * (di = CASE WHEN m[wn + 1] < 0.35::DOUBLE OR f > 0.45::DOUBLE THEN 0 ELSE 1 END)::INTEGER + (sy = [1, 0, 2][r + 1])::INTEGER AS score FROM g)
SELECT k AS state, arg_max(a, score * 100 - a) FILTER (valid) AS action FROM j GROUP BY k""")
def sim_policy(t: Tables) -> DataFrame:
    """The heuristic's action of each state; null where none is permitted."""
    rows = _states(t).select("state", "s", C.mask(F.col("s")).alias("m"))
    return rows.select("state", C.policy(F.col("s"), F.col("m")).cast("int").alias("action"))


@query()
def sim_rollout(t: Tables) -> DataFrame:
    """The first six steps of the heuristic's episodes without noise."""
    return C.episodes(_states(t), "state", "s", 6)


@query("""SELECT l_partkey AS idx, max(abs(l_discount - l_tax)) + 1e-6 AS priority FROM lineitem GROUP BY l_partkey""")
def sim_priority(t: Tables) -> DataFrame:
    """The largest error of each transition as its priority."""
    return t.lineitem.groupBy(F.col("l_partkey").alias("idx")).agg((F.max(F.abs(F.col("l_discount") - F.col("l_tax"))) + 1e-6).alias("priority"))


@query("""SELECT 'duplicate_id' AS name, count(*) - count(DISTINCT (conv_id, turn)) AS failures FROM conversations UNION ALL SELECT 'empty_text', count(*) FILTER (text = '') FROM conversations
UNION ALL SELECT 'unknown_role', count(*) FILTER (role NOT IN ('user', 'assistant')) FROM conversations""")
def sim_verification(t: Tables) -> DataFrame:
    """A table of checks and their failures, from one pass."""
    one = t.conversations.agg((F.count("*") - F.countDistinct("conv_id", "turn")).alias("duplicate_id"), F.count_if(F.col("text") == "").alias("empty_text"), F.count_if(~F.col("role").isin("user", "assistant")).alias("unknown_role"))
    return one.unpivot([], ["duplicate_id", "empty_text", "unknown_role"], "name", "failures")


@query("""WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 10 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM e)
SELECT user_id, event_type, min(ts) AS opened, max(ts) + INTERVAL 10 MINUTE AS closed, count(*) AS events FROM s GROUP BY user_id, event_type, n""")
def stm_sessions(t: Tables) -> DataFrame:
    """Sessions that ten minutes without an event close."""
    return S.sessions(t.events)


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS clicks FROM events WHERE event_type = 'click' GROUP BY ALL""")
def stm_counters(t: Tables) -> DataFrame:
    """Clicks of each hour."""
    return S.hourly_clicks(t.events)


@query("""WITH o AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
SELECT user_id, event_id, CAST((i - 1) // 400 AS BIGINT) AS file FROM o""")
def stm_history(t: Tables) -> DataFrame:
    """A new history file after every 400 messages."""
    rows = numbered(t.events.select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], "n")
    return rows.select("user_id", "event_id", F.floor((F.col("n") - 1) / 400).alias("file"))


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT user_id, event_id, i, u AS start, 1 AS n FROM o WHERE i = 1 UNION ALL
SELECT o.user_id, o.event_id, o.i, CASE WHEN o.u - w.start >= 86400000000 THEN o.u ELSE w.start END, CASE WHEN o.u - w.start >= 86400000000 THEN 1 ELSE w.n + 1 END FROM w JOIN o ON o.user_id = w.user_id AND o.i = w.i + 1)
SELECT user_id, event_id, n <= 3 AS allowed FROM w""")
def stm_rate_limit(t: Tables) -> DataFrame:
    """At most three events in a day that starts with the first one of a window."""
    return S.rate_limited(t.events, 3, 86_400)


@query("""SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) % 2 = 0 AS liked FROM events GROUP BY ALL""")
def stm_likes(t: Tables) -> DataFrame:
    """Likes as of the last toggle."""
    return t.events.groupBy("user_id", "event_type").agg((F.max_by("event_id", F.struct("ts", "event_id")) % 2 == 0).alias("liked"))


STEP = """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / 51 AS m, l_discount * 5 / 1.03::DOUBLE AS c, (l_suppkey % 10) / 10.3::DOUBLE AS e, l_tax * 8 / 1.07::DOUBLE AS f, l_partkey % 3 AS p, l_suppkey % 3 AS a, l_orderkey % 3 AS d, l_linenumber % 3 AS y FROM lineitem),
t AS (SELECT *, CASE WHEN y = [1, 0, 2][p + 1] THEN 1.0::DOUBLE ELSE 0.82::DOUBLE END AS fits, greatest(0.45::DOUBLE, 1 - 0.25::DOUBLE * abs(d - CASE WHEN m < 0.35 THEN 0 WHEN m < 0.75 THEN 1 ELSE 2 END)) AS apt FROM s),
u AS (SELECT *, greatest(0, least(1, m + [0.27, 0.23, 0.31][p + 1]::DOUBLE * fits * apt * (0.5 + 0.5 * e) * (1 - 0.65 * f) * (1 - 0.35 * c) * (1 - m) * CASE WHEN a = 2 THEN 0.85::DOUBLE ELSE 1 END)) AS m2,
greatest(0, least(1, c - [0.04, 0.05, 0.14][a + 1]::DOUBLE * fits)) AS c2, greatest(0, least(1, f + [-0.04, 0.025, 0.065][d + 1]::DOUBLE + [-0.025, 0, 0.025][y + 1]::DOUBLE)) AS f2 FROM t),
v AS (SELECT *, greatest(0, least(1, e + CASE WHEN fits = 1 THEN 0.025 ELSE -0.025 END::DOUBLE + CASE WHEN apt = 1 THEN 0.01 ELSE -0.015 END::DOUBLE - 0.015 * f2)) AS e2 FROM u)
SELECT l_orderkey, l_linenumber, l_partkey, round(m2, 6) AS mastery, round(c2, 6) AS misconception, round(e2, 6) AS engagement, round(f2, 6) AS fatigue, round(greatest(0, least(1, m2 * (1 - 0.4 * c2))), 6) AS assessment,
round(greatest(-1, least(1, (8 * (m2 - m) + 2 * (c - c2) + 0.5 * (e2 - e) - 0.5 * greatest(0, f2 - f) - 0.08 + CASE WHEN a = 0 THEN 0.8 ELSE 0 END) / 5)), 6) AS reward FROM v"""


@query(STEP)
def sim_step(t: Tables) -> DataFrame:
    """A learner's state and reward after one action, without noise."""
    c = F.col
    after = C.step(c("l_quantity") / 51, c("l_discount") * 5 / 1.03, c("l_suppkey") % 10 / 10.3, c("l_tax") * 8 / 1.07, c("l_partkey") % 3, c("l_suppkey") % 3, c("l_orderkey") % 3, c("l_linenumber") % 3)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(x, 6).alias(name) for name, x in after.items()])
