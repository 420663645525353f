"""Dialogue checks and learner states over turns: the tags of teaching actions, rules within and across turns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The tags of a teacher's actions, the nodes where reading comes first, the difficulty that is free of it.
TAGS = ["recall", "probe", "hint", "check", "explain", "correct", "encourage", "summarize", "end"]
READING_NODES = ["ophthalmology/retina", "ophthalmology/neuro_ophth", "ophthalmology/fundus"]
ROUTINE = "routine_clarification"
# The longest turn by language, and for any other one.
TURN_CHARS = {"zh": 1200, "en": 2400}

MARK = r"(</?[A-Za-z_][A-Za-z0-9_\-]*[^<>]*>)"

def _none() -> Column:
    return F.array().cast("array<string>")


def actions(text: Column) -> Column:
    """Tags in order: array of struct(tag, attrs, body) of paired and self-closing elements; attrs as they are written."""
    pattern = rf"(?s)<({'|'.join(TAGS)})(?![\w-])([^<>]*?)(?:/>|>(.*?)</\1>)"
    found = [F.regexp_extract_all(text, F.lit(pattern), i) for i in (1, 2, 3)]
    body = lambda a: F.regexp_replace(a["body"], r"(?U)^\s+|\s+$", "")
    return F.transform(F.arrays_zip(*[x.alias(n) for x, n in zip(found, ("tag", "attrs", "body"))]), lambda a: F.struct(a["tag"].alias("tag"), a["attrs"].alias("attrs"), body(a).alias("body")))


def hint_level(attrs: Column) -> Column:
    """The number after `level =`, or 1."""
    return F.coalesce(F.regexp_extract(attrs, r"level\s*=\s*[\"']?(\d+)", 1).try_cast("bigint"), F.lit(1).cast("bigint"))


def turn_defects(text: Column) -> Column:
    """What is wrong with one turn's tags, in order and as often as it is: a fold over its marks with the open tag.

    A tag in another one is a defect and doesn't open; a wrong close closes all; `none` stands only alone.
    """
    start = F.struct(F.lit("").alias("open"), _none().alias("bad"), F.lit(0).alias("n"))

    def step(s, m):
        tag = F.regexp_extract(m, r"^</?([A-Za-z_][A-Za-z0-9_\-]*)", 1)
        closing, alone, inside = m.startswith("</"), m.endswith("/>"), s["open"] != ""
        known, end = tag.isin(TAGS), tag == "end"
        bad = (
            F.when(~known, "unknown_tag")
            .when(end, F.when(closing, "paired_end").when(~alone, "end_not_self_closed").when(inside, "end_nested"))
            .when(closing, F.when(~inside, "stray_close").when(s["open"] != tag, "mismatch"))
            .when(alone, "self_closed_content")
            .when(inside, "nested")
        )
        after = F.when(~known | end, s["open"]).when(closing, "").when(alone | inside, s["open"]).otherwise(tag)
        acts = known & bad.isNull() & ~(closing & ~end)
        return F.struct(after.alias("open"), F.when(bad.isNotNull(), F.array_append(s["bad"], bad)).otherwise(s["bad"]).alias("bad"), (s["n"] + acts.cast("int")).alias("n"))

    def finish(s):
        bad = F.when(s["open"] != "", F.array_append(s["bad"], F.lit("unclosed"))).otherwise(s["bad"])
        return F.when((s["n"] == 0) & (F.size(bad) == 0), F.array(F.lit("none"))).otherwise(bad)

    marks = F.regexp_extract_all(text, F.lit(MARK), 1)
    blank = F.regexp_replace(text, r"(?U)\s", "") == ""
    return F.when(text.isNull(), F.array(F.lit("not_text"))).when(blank, F.array(F.lit("empty"))).when(F.size(marks) == 0, F.array(F.lit("no_tags"))).otherwise(F.aggregate(marks, start, step, finish))


def reading_first(node: Column, difficulty: Column) -> Column:
    """Whether a reading has to come before explanations: of reading nodes unless routine, and where there is no node."""
    reads = F.lit(False)
    for name in READING_NODES:
        reads = reads | node.startswith(name)
    return F.when(F.coalesce(F.trim(node), F.lit("")) == "", True).otherwise(reads & (F.coalesce(difficulty, F.lit("")) != ROUTINE))


def global_defects(texts: Column, reading: Column) -> Column:
    """What is wrong across the turns of one dialogue (array of its teacher's texts in order), as `rule turn detail`.

    G2: correct needs a recall or hint and a check or probe before it. G3: no tag thrice in a turn, hint levels don't
    fall. G4: nothing after end, which is in the last turn. G5: explain and correct need a check or probe before them
    where reading comes first. One fold over turns, within it one over the turn's actions.
    """
    text = lambda *parts: F.concat_ws(" ", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    start = F.struct(F.lit(0).alias("t"), F.lit(False).alias("scaffold"), F.lit(False).alias("check"), F.lit(0).cast("bigint").alias("level"), F.lit(0).alias("end"), F.lit(False).alias("ended"), _none().alias("bad"))

    def act(s, a):
        tag, late = a["tag"], a["tag"].isin("explain", "correct")
        level = F.when(tag == "hint", hint_level(a["attrs"])).otherwise(s["level"])
        bad = F.array(
            F.when(s["ended"], text("G4", s["t"], "after_end", tag)),
            F.when((tag == "correct") & ~s["scaffold"], text("G2", s["t"], "no_scaffold")),
            F.when((tag == "correct") & ~s["check"], text("G2", s["t"], "no_check")),
            F.when((tag == "hint") & (level < s["level"]), text("G3", s["t"], "level", s["level"], level)),
            F.when(late & reading & ~s["check"], text("G5", s["t"], tag)),
        )
        ends = tag == "end"
        return F.struct(
            s["t"].alias("t"),
            (s["scaffold"] | tag.isin("recall", "hint")).alias("scaffold"),
            (s["check"] | tag.isin("check", "probe")).alias("check"),
            level.alias("level"),
            F.when(ends & (s["end"] == 0), s["t"]).otherwise(s["end"]).alias("end"),
            ends.alias("ended"),
            F.concat(s["bad"], F.array_compact(bad)).alias("bad"),
        )

    def turn(s, teacher):
        t, acts = s["t"] + 1, actions(F.coalesce(teacher, F.lit("")))
        tags = F.transform(acts, lambda a: a["tag"])
        often = F.filter(F.array_distinct(tags), lambda x: F.size(F.filter(tags, lambda y: y == x)) >= 3)
        bad = F.concat(
            s["bad"],
            F.array_compact(F.array(F.when(teacher.isNull(), text(t, "no_text")).when(F.regexp_replace(teacher, r"(?U)\s", "") == "", text(t, "empty")))),
            F.transform(often, lambda x: text("G3", t, "often", x)),
        )
        begun = F.struct(t.alias("t"), s["scaffold"].alias("scaffold"), s["check"].alias("check"), s["level"].alias("level"), s["end"].alias("end"), F.lit(False).alias("ended"), bad.alias("bad"))
        return F.aggregate(acts, begun, act)

    def finish(s):
        return F.when((s["end"] > 0) & (s["end"] < s["t"]), F.array_append(s["bad"], text("G4", s["end"], "early_end"))).otherwise(s["bad"])

    return F.when(F.size(texts) > 0, F.aggregate(texts, start, turn, finish)).otherwise(F.array(F.lit("empty_trajectory")))


def action_stats(texts: Column) -> dict[str, Column]:
    """n_turns, tag_counts and tag_turns (maps of all tags), hint_levels, max_hint_level and has_end of a dialogue's texts."""
    acts = F.flatten(F.transform(texts, lambda x: F.coalesce(actions(x), F.array().cast("array<struct<tag:string,attrs:string,body:string>>"))))
    tags = F.transform(acts, lambda a: a["tag"])
    own = F.transform(texts, lambda x: F.transform(F.coalesce(actions(x), F.array().cast("array<struct<tag:string,attrs:string,body:string>>")), lambda a: a["tag"]))
    levels = F.transform(F.filter(acts, lambda a: a["tag"] == "hint"), lambda a: hint_level(a["attrs"]))
    count = lambda tag: F.size(F.filter(tags, lambda x: x == tag))
    turns = lambda tag: F.size(F.filter(own, lambda x: F.array_contains(x, tag)))
    return {
        "n_turns": F.size(texts),
        "tag_counts": F.create_map(*[c for tag in TAGS for c in (F.lit(tag), count(tag))]),
        "tag_turns": F.create_map(*[c for tag in TAGS for c in (F.lit(tag), turns(tag))]),
        "hint_levels": levels,
        "max_hint_level": F.coalesce(F.array_max(levels), F.lit(0)).cast("bigint"),
        "has_end": F.array_contains(tags, "end"),
    }


def message_defects(roles: Column) -> Column:
    """What is wrong with the roles of one dialogue's messages in order: other roles, no alternation, the wrong end."""
    pairs = F.transform(roles, lambda r, i: F.array_compact(F.array(
        F.when(~F.coalesce(r.isin("user", "assistant"), F.lit(False)), F.concat_ws(" ", i + 1, F.lit("role"))),
        F.when(~r.eqNullSafe(F.when(i % 2 == 0, "user").otherwise("assistant")), F.concat_ws(" ", i + 1, F.lit("order"))),
    )))
    last = F.when(~F.try_element_at(roles, F.lit(-1)).eqNullSafe(F.lit("assistant")), F.array(F.lit("last"))).otherwise(_none())
    return F.when(F.size(roles) > 0, F.concat(F.flatten(pairs), last)).otherwise(F.array(F.lit("no_messages")))


def medical_point(label: Column, last: Column, keywords: Mapping[str, list[str]]) -> Column:
    """Whether the last teacher's text covers the label: in its correct and explain bodies, else in the whole text.

    Words to look for are the label and those of the longest key of keywords that the label holds. Of a label of more
    than 8 characters, 0.6 of its distinct characters (but white space and punctuation) are enough. Labels that are
    empty or a plain decision are taken as covered.
    """
    name, text = F.trim(F.coalesce(label, F.lit(""))), F.coalesce(last, F.lit(""))
    low = F.lower(name)
    best, words = F.lit(None).cast("string"), F.array(low)
    for key in sorted(keywords, key=len):  # longer keys last, so they win
        best = F.when(low.contains(key), key).otherwise(best)
    extra = F.create_map(*[c for k, v in keywords.items() for c in (F.lit(k), F.array(*[F.lit(x.lower()) for x in v]))])[best]
    words = F.concat(words, F.coalesce(extra, _none()))
    bodies = F.array_join(F.transform(F.filter(actions(text), lambda a: a["tag"].isin("correct", "explain")), lambda a: a["body"]), "\n")
    target = F.when(F.trim(bodies) != "", bodies).otherwise(text)
    chars = F.array_distinct(F.filter(F.split(F.regexp_replace(name, r"(?U)[\s()（）/、,，.。\-—_]", ""), ""), lambda c: c != ""))
    share = F.size(F.filter(chars, lambda c: target.contains(c))) / F.size(chars)
    hit = F.exists(words, lambda w: (w != "") & F.lower(target).contains(w)) | ((F.length(name) > 8) & (F.size(chars) > 0) & (share >= 0.6))
    return F.when((name == "") | low.isin("yes", "no", "maybe"), True).when(F.trim(text) == "", False).otherwise(hit)


def gate(messages: Column, lang: Column, node: Column, difficulty: Column, covered: Column, least: int = 2, most: int = 5) -> Column:
    """Why a dialogue (array of struct(role, content)) is dropped, each reason once, in the order they are met.

    messages, turns, open_end, too_long, then the groups of structure (structure, G1 to G5) and medical_point.
    """
    teacher = F.transform(F.filter(messages, lambda m: m["role"] == "assistant"), lambda m: F.coalesce(m["content"], F.lit("")))
    n, limit = F.size(teacher), F.lit(TURN_CHARS["zh"])
    for code, size in TURN_CHARS.items():
        limit = F.when(lang == code, size).otherwise(limit)
    turns = F.flatten(F.transform(teacher, lambda x: F.transform(turn_defects(x), lambda d: F.lit("G1"))))
    rules = F.transform(global_defects(teacher, reading_first(node, difficulty)), lambda d: F.when(d.rlike("^G[1-5] "), F.substring(d, 1, 2)).when(d == "empty_trajectory", "structure").otherwise("other"))
    structure = F.transform(message_defects(F.transform(messages, lambda m: m["role"])), lambda d: F.lit("structure"))
    reasons = F.concat(
        F.array_compact(F.array(
            F.when((n < least) | (n > most), "turns"),
            F.when(~F.coalesce(F.try_element_at(teacher, F.lit(-1)), F.lit("")).contains("<end/>"), "open_end"),
            F.when(F.exists(teacher, lambda x: F.length(x) > limit), "too_long"),
        )),
        structure, turns, F.when(n > 0, rules).otherwise(_none()),
        F.when(~covered, F.array(F.lit("medical_point"))).otherwise(_none()),
    )
    return F.when(F.coalesce(F.size(messages), F.lit(0)) > 0, F.array_distinct(reasons)).otherwise(F.array(F.lit("messages")))


def alternation(turns: DataFrame, dialogue: str = "conv_id") -> DataFrame:
    """dialogue, n_turns, roles_ok, alternates (user first) and ends_with_assistant."""
    before = F.lag("role").over(Window.partitionBy(dialogue).orderBy("turn"))
    rows = turns.select(dialogue, "turn", "role", before.alias("b"))
    step = F.when(F.col("b").isNull(), F.col("role") == "user").otherwise(F.col("role") != F.col("b"))
    return rows.groupBy(dialogue).agg(
        F.count("*").alias("n_turns"),
        F.bool_and(F.col("role").isin("user", "assistant")).alias("roles_ok"),
        F.bool_and(step).alias("alternates"),
        (F.max_by("role", "turn") == "assistant").alias("ends_with_assistant"),
    )


def clamped_walk(steps: Column, start: float) -> Column:
    """A sum that is clamped to [0, 1] after each step: the running values."""
    zero = F.struct(F.lit(start).alias("x"), F.array().cast("array<double>").alias("all"))

    def step(s, d):
        x = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s["x"] + d)), 9)
        return F.struct(x.alias("x"), F.array_append(s["all"], x).alias("all"))

    return F.aggregate(steps, zero, step)["all"]


#: A learner's state before the first turn.
INITIAL = {"mastery": 0.30, "engagement": 0.70, "fatigue": 0.10, "misconception_severity": 0.80}


def final_state(deltas: Column) -> Column:
    """The learner's state after all turns: struct of INITIAL's names.

    deltas: array of struct(mastery, engagement, fatigue, resolved, shown) in order. Each value is added and clamped to
    [0, 1], null or not finite ones not at all; resolved takes 0.5 off the severity, and shown then adds 0.1.
    """

    def step(s, d):
        moved = []
        for name in ("mastery", "engagement", "fatigue"):
            usable = d[name].isNotNull() & ~F.isnan(d[name]) & (F.abs(d[name]) != float("inf"))
            moved.append(F.when(usable, F.greatest(F.lit(0.0), F.least(F.lit(1.0), s[name] + d[name]))).otherwise(s[name]).alias(name))
        severity = F.when(F.coalesce(d["resolved"], F.lit(False)), F.greatest(F.lit(0.0), s["misconception_severity"] - 0.5)).otherwise(s["misconception_severity"])
        severity = F.when(F.coalesce(d["shown"], F.lit(False)), F.least(F.lit(1.0), severity + 0.1)).otherwise(severity)
        return F.struct(*moved, severity.alias("misconception_severity"))

    return F.aggregate(deltas, F.struct(*[F.lit(v).alias(k) for k, v in INITIAL.items()]), step)


def discounted(rewards: Column, gamma: float) -> Column:
    """The discounted return from the first step on: a fold from the end."""
    return F.aggregate(F.reverse(rewards), F.lit(0.0).cast("double"), lambda a, r: r + gamma * a)


def action_code(macro: Column, difficulty: Column, style: Column) -> Column:
    return macro * 9 + difficulty * 3 + style


def best_action(scores: Column) -> Column:
    """Place of the largest score; of equals the first."""
    return F.array_position(scores, F.array_max(scores)) - 1


def stop_reason(ended: Column, turn: Column, most: int, length: Column, longest: int) -> Column:
    return F.when(ended, "end_tag").when(turn >= most, "max_turns").when(length >= longest, "length")
