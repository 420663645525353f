"""Literal cases of column functions and operators."""

import datetime
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from scholia.functions import numbers as N
from scholia.functions import questions, routing, rowwise
from scholia.functions import text as T
from scholia.operators import activity, curriculum, dialogue, lookups, relational, retrieval, rewards, sections
from scholia.shared import written


def value(spark, column, **given):
    df = spark.createDataFrame([Row(**given)]) if given else spark.range(1)
    return df.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("text", "lang"), [("", "zh"), ("  ", "zh"), ("hello world", "en"), ("眼科学", "zh"), ("abc 眼", "zh"), ("abcdefgh 眼", "en")])
def test_language(spark, text, lang):
    assert value(spark, T.detect_lang(F.lit(text))) == lang


def test_answers(spark):
    assert value(spark, T.answer_letters(F.lit("c, A and a"))) == "ACD"
    assert value(spark, T.answer_numbers(F.lit("ACG"))) == "13"


def test_options(spark):
    parsed = value(spark, T.parsed_options(F.lit("A. one\nB) two\nA: three\nnot one")))
    assert parsed == {"A": "three", "B": "two"}
    assert value(spark, T.options_block(F.map_from_arrays(F.array(F.lit("B"), F.lit("A")), F.array(F.lit(" b "), F.lit("  "))))) == "B. b"


@pytest.mark.parametrize(("kind", "given", "shown"), [("phone", "13812345678", "138****5678"), ("email", "alice@x.org", "a****@x.org"), ("password", "abc", "***"), ("username", "Tom", "T*m"), ("password", " ", ""), ("bank_card", "622202123456789012", "**** **** **** **** 012"), ("bank_card", "12345678901", "12345678901"), ("id_card", "110101199003077777", "1101** **** ****7777"), ("id_card", "11010119900307777X", "11010119900307777X"), ("plate", "京A12345", "京A1***5"), ("plate", "京AD12345", "京AD****5"), ("plate", "京A1234", "京A1234"), ("plate", "", "")])
def test_masks(spark, kind, given, shown):
    assert value(spark, T.masked(F.lit(given), kind)) == shown


def test_names(spark):
    assert value(spark, T.camel_to_snake(F.lit("userName"))) == "user_name"
    assert value(spark, T.snake_to_camel(F.lit("HELLO_WORLD"))) == "helloWorld"
    assert value(spark, T.padded_left(F.lit("12345"), 3, "0")) == "345"
    assert value(spark, T.section_numbers(F.lit("Section 1.2"))) == [1, 2]
    assert value(spark, T.json_object(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert value(spark, T.half_width(T.full_width(F.lit("Ab 1!")))) == "Ab 1!"


@pytest.mark.parametrize(("a", "b", "places", "out"), [(1.0, 3.0, 10, "0.3333333333"), (2.0, 3.0, 2, "0.67"), (-2.0, 3.0, 2, "-0.67"), (0.0, 0.0, 4, "0.0000")])
def test_division(spark, a, b, places, out):
    assert str(value(spark, N.divided(F.lit(a), F.lit(b), places))) == out


def test_division_by_zero(spark):
    with pytest.raises(Exception, match="division by zero"):
        value(spark, N.divided(F.col("a"), F.col("b")), a=1.0, b=0.0)
    with pytest.raises(ValueError):
        N.divided(F.lit(1.0), F.lit(1.0), -1)


def test_exact_sums(spark):
    assert float(value(spark, N.exact(F.lit(0.1)) + N.exact(F.lit(0.2)))) == 0.3
    assert float(value(spark, F.round(N.exact(F.lit(-1.235)), 2))) == -1.24


@pytest.mark.parametrize(("f", "a", "b", "out"), [(N.added, 0.1, 0.2, 0.3), (N.subtracted, 0.3, 0.2, 0.1), (N.multiplied, 0.1, 0.2, 0.02), (N.added, 1 / 3e8, 0.0, 1 / 3e8), (N.multiplied, 1e-12, 2.0, 2e-12), (N.added, 1e25, 1.0, 1e25)])
def test_arithmetic(spark, f, a, b, out):
    assert value(spark, f(F.lit(a), F.lit(b))) == out


@pytest.mark.parametrize(("n", "mb"), [(0, 0.0), (1048576, 1.0), (5243, 0.01), (5242, 0.0), (1572864, 1.5), (10_000_000_000, 9536.74)])
def test_megabytes(spark, n, mb):
    assert value(spark, N.megabytes(F.lit(n))) == mb


def test_long_names(spark):
    name = "_".join(["ab"] * 150)
    assert value(spark, T.snake_to_camel(F.lit(name))) == "ab" + "Ab" * 149
    assert value(spark, T.snake_to_camel(F.lit("a_" + "b" * 3000))) == "aB" + "b" * 2999


def test_lists_and_templates(spark):
    assert value(spark, T.split_list(F.lit(" a, ,b "))) == ["a", "b"] and value(spark, T.split_list(F.lit(None).cast("string"))) == []
    assert value(spark, T.filled("{} is \\\\{} of {}", F.lit("x"), F.lit(2))) == "x is \\2 of {}"
    assert value(spark, T.filled("a \\{} {}", F.lit(1))) == "a {} 1"
    assert value(spark, T.contains_any(F.array(F.lit("A"), F.lit("b")), ["a"], fold=True)) and not value(spark, T.contains_any(F.array(F.lit("A")), ["a"]))
    assert value(spark, T.hidden(F.lit("abcdef"), 2, 4)) == "ab**ef" and value(spark, T.hidden(F.lit("abc"), 2, 9)) == "ab*"
    assert value(spark, T.link_path(F.lit("https://www.a.b:80/c"))) == "a/b/80/c" and value(spark, T.is_http(F.lit("https://x")))
    assert value(spark, T.picture_type(F.unhex(F.lit("89504E470D0A1A0A")))) == "PNG" and value(spark, T.picture_type(F.unhex(F.lit("FFD8FFE000104A464946")))) == "JPG"
    assert T.canonical_digest({"b": 1, "a": [1]}) == T.canonical_digest({"a": [1], "b": 1})


def test_options_of_lists_maps_and_lines(spark):
    assert value(spark, T.listed_options(F.array(F.lit("one"), F.lit("C. two"), F.lit(None).cast("string"), F.lit("xyz"), F.lit("four")))) == {"A": "one", "C": "two", "D": "xyz", "F": "our"}
    assert value(spark, T.named_options(F.create_map(F.lit("a1"), F.lit(" x "), F.lit(""), F.lit("y")))) == {"A": "x", "?": "y"}
    assert value(spark, T.parsed_options(F.lit("1 A. xy 2 B. z"))) == {"A": "xy 2", "B": "z"}
    assert value(spark, T.parsed_options(F.lit("only A. one"))) == {}
    assert value(spark, T.parsed_options(F.lit("a. one\nA: two"))) == {"A": "two"}


def test_addresses(spark):
    assert value(spark, N.ip_allowed(F.lit("10.0.0.7"), ["10.0.0.1-10.0.0.9"])) is True
    assert value(spark, N.ip_allowed(F.lit("10.0.0.77"), ["10.0.0.1-10.0.0.9", "10.1.*.*"])) is False
    assert value(spark, N.ip_number(F.lit("256.1.1.1"))) is None


def test_dates(spark):
    assert value(spark, N.parsed_date(F.lit("2024/03/05 07:08"))) == datetime.datetime(2024, 3, 5, 7, 8)
    assert value(spark, N.parsed_date(F.lit("soon"))) is None


def test_paths():
    import re

    assert re.match(T.ant_pattern("/a/*/c?"), "/a/b/cd") and not re.match(T.ant_pattern("/a/*"), "/a/b/c") and re.match(T.ant_pattern("/a/**"), "/a/b/c")


def test_where_skips_what_is_missing(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    assert relational.Where().eq("v", "").like("v", " ").isin("k", []).between("k", None, None).ne("k", None)(df).count() == 2
    assert [r.k for r in relational.Where().between("k", 2, None)(df).collect()] == [2]


def test_order_guard(spark):
    df = spark.createDataFrame([(1,)], "user_name int")
    assert len(relational.order_columns(df, "userName desc")) == 1
    for bad in ("user_name; drop", "other", "user_name sideways"):
        with pytest.raises(ValueError):
            relational.order_columns(df, bad)


def test_pages(spark):
    df = spark.range(250)
    assert relational.page(df, [F.col("id")], 9, 1000, 250).count() == 50
    assert relational.page(df, [F.col("id")], 0, 0).count() == 1
    assert relational.page(df, [F.col("id")]).count() == 20


def test_scopes(spark):
    df = spark.createDataFrame([(1, 10, "0,1", 5), (2, 11, "0,1,10", 6), (3, 12, "0", 42)], "k int, dept int, ancestors string, owner int")
    seen = lambda roles: {r.k for r in df.where(relational.data_scope(roles, 42, 10, "dept", "ancestors", "owner")).collect()}
    assert seen([]) == set()
    assert seen([{"scope": 1}, {"scope": 5}]) == {1, 2, 3}
    assert seen([{"scope": 4}]) == {1, 2}
    assert seen([{"scope": 2, "depts": [12]}, {"scope": 3}]) == {1, 3}


def test_streaks(spark):
    days = ["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-05"]
    df = spark.createDataFrame([(1, datetime.date.fromisoformat(d)) for d in days], "user_id int, day date")
    assert activity.streaks(df, "2024-01-05").first()[1:] == (4, 3, 1)
    assert activity.streaks(df, "2024-01-06").first()[1:] == (4, 3, 0)
    assert value(spark, activity.clamp_days(F.lit(400))) == 366
    assert value(spark, activity.clamp_days(F.lit(None).cast("int"))) == 1


@pytest.mark.parametrize(("text", "bad"), [("<hint>a</hint>", []), ("plain", ["no_tags"]), (None, ["not_text"]), (" ", ["empty"]), ("<hint>a", ["unclosed"]), ("</hint>", ["stray_close"]), ("<check>x <hint>y</hint></check>", ["nested", "mismatch", "stray_close"]), ("<Hint>a</Hint>", ["unknown_tag", "unknown_tag"]), ("<probe>a</probe><recall>b</recall>", []), ("<hint>a <hint>b</hint>", ["nested"]), ("<oops> <hint>a</hint>", ["unknown_tag"]), ("<hint>a</check>", ["mismatch"]), ("<hint/>", ["self_closed_content"]), ("<end></end>", ["end_not_self_closed", "paired_end"]), ("<hint>a <end/></hint>", ["end_nested"]), ("<foo>x</foo>", ["unknown_tag", "unknown_tag"]), ("<hint>a</hint><end/>", [])])
def test_defects(spark, text, bad):
    assert value(spark, dialogue.turn_defects(F.lit(text).cast("string"))) == bad


def test_walk(spark):
    assert value(spark, dialogue.clamped_walk(F.array(F.lit(0.7), F.lit(-0.2), F.lit(-2.0)), 0.5)) == [1.0, 0.8, 0.0]
    assert value(spark, dialogue.discounted(F.array(F.lit(1.0), F.lit(1.0)), 0.5)) == 1.5


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "q int, d int, rank int")
    b = spark.createDataFrame([(1, 11, 1)], "q int, d int, rank int")
    rows = retrieval.fused([a, b], "q", "d", 5).orderBy("rank").collect()
    assert [r.d for r in rows] == [11, 10] and abs(rows[0].score - (1 / 101 + 1 / 102)) < 1e-9


@pytest.mark.parametrize(("x", "words"), [(0.0, "零元整"), (1.0, "壹元整"), (10.5, "壹拾元伍角"), (1001.03, "壹仟零壹元叁分"), (-120000.0, "负壹拾贰万元整"), (100000001.0, "壹亿零壹元整"), (0.05, "伍分"), (1e12, "壹万亿元整"), (123456789012345.0, "壹佰贰拾叁万肆仟伍佰陆拾柒亿捌仟玖佰零壹万贰仟叁佰肆拾伍元整"), (float("inf"), None), (20_000_010.0, "贰仟万零壹拾元整"), (100_010_000.0, "壹亿零壹万元整")])
def test_amounts(x, words):
    assert rowwise.capital_amount(x) == words


def test_rowwise():
    for text in ("a b", "é中\U0001f600%", ""):
        assert rowwise.unescaped(rowwise.escaped(text)) == text
    assert rowwise.escaped("aZ 中\n") == "%61%5a%20%u4e2d%0a" and rowwise.unescaped("a%20%u4E2Dz") == "a 中z"
    assert rowwise.sanitized('<b>x<script>y</script><a href="javascript:z" target="t">k</b><!-- c -->') == '<b>xy<a href="#z" target="t">k</a></b>'
    assert rowwise.sanitized("<a href=http://x/y target=_b>k</a><i> </i><b><em></em></b><IMG src=q.png onerror=z>") == '<a href="http://x/y" target="_b">k</a><i> </i><img src="q.png" />'
    assert rowwise.decision('```json\n{"approved": true, "reason": ""}\n```') is True
    assert rowwise.decision('{"approved": true, "approved": false, "reason": ""}') is None
    assert rowwise.decision('{"approved": 1, "reason": ""}') is None and rowwise.decision(None) is None


def test_recursive_chunks():
    text = "\n\n".join(" ".join(f"word{i}{j}" for j in range(40)) for i in range(12))
    chunks = rowwise.recursive_chunks(text, 500, 100)
    assert all(0 < len(c) <= 500 for c in chunks) and all(w in " ".join(chunks) for w in text.split())
    assert rowwise.recursive_chunks("", 10, 2) == [] and rowwise.recursive_chunks("x" * 25, 10, 2) == ["x" * 10, "x" * 10, "x" * 9]


def steps(spark, *texts, reading=False):
    return value(spark, dialogue.global_defects(F.array(*[F.lit(t).cast("string") for t in texts]), F.lit(reading)))


def test_rules_across_turns(spark):
    assert steps(spark, "<recall>a</recall><check>b</check>", "<correct>c</correct><end/>") == []
    assert steps(spark, "<correct>c</correct>") == ["G2 1 no_scaffold", "G2 1 no_check"]
    assert steps(spark, "<hint level=2>a</hint>", "<hint>b</hint>") == ["G3 2 level 2 1"]
    assert steps(spark, "<probe>a</probe><probe>b</probe><probe>c</probe>") == ["G3 1 often probe"]
    assert steps(spark, "<end/><check>a</check>") == ["G4 1 after_end check"]
    assert steps(spark, "<check>a</check><end/>", "<check>b</check>") == ["G4 1 early_end"]
    assert steps(spark, "<explain>a</explain>", reading=True) == ["G5 1 explain"] and steps(spark, "<explain>a</explain>") == []
    assert steps(spark, "<probe>a</probe><explain>a</explain>", reading=True) == []
    assert steps(spark, None, " ") == ["1 no_text", "2 empty"]
    assert value(spark, dialogue.global_defects(F.array().cast("array<string>"), F.lit(False))) == ["empty_trajectory"]


@pytest.mark.parametrize(("node", "difficulty", "first"), [(None, None, True), (" ", "x", True), ("ophthalmology/retina/x", "difficult_diagnostic", True), ("ophthalmology/retina/x", "routine_clarification", False), ("ophthalmology/glaucoma/x", None, False), ("ophthalmology/fundus/x", None, True)])
def test_reading_first(spark, node, difficulty, first):
    assert value(spark, dialogue.reading_first(F.lit(node).cast("string"), F.lit(difficulty).cast("string"))) is first


@pytest.mark.parametrize(("label", "text", "hit"), [("", "x", True), ("Yes", "", True), ("glaucoma", "", False), ("Glaucoma stage 2", "x <correct>视杯 large</correct>", True), ("glaucoma", "青光眼 <explain>none</explain>", False), ("glaucoma", "the 青光眼", True), ("abcdefghij", "<explain>abcdef</explain>", True), ("abcdefghij", "<explain>abcde</explain>", False)])
def test_medical_point(spark, label, text, hit):
    words = {"glaucoma": ["青光眼", "视杯"], "dr": ["糖网"]}
    assert value(spark, dialogue.medical_point(F.lit(label), F.lit(text), words)) is hit


def test_states_and_rewards(spark):
    deltas = F.array(F.struct(F.lit(0.9).alias("mastery"), F.lit(None).cast("double").alias("engagement"), F.lit(0.1).alias("fatigue"), F.lit(True).alias("resolved"), F.lit(True).alias("shown")))
    assert {k: round(v, 6) for k, v in value(spark, dialogue.final_state(deltas)).asDict().items()} == {"mastery": 1.0, "engagement": 0.7, "fatigue": 0.2, "misconception_severity": 0.4}
    texts = F.array(F.lit("<recall>a</recall><hint>b</hint>"), F.lit("<correct>c</correct><hint>b</hint><end/>"))
    found = rewards.sequence_reward(texts, F.lit(0), F.lit(0.2), F.lit(0.1), F.lit(0.5), F.lit(True), F.lit(False))
    assert value(spark, found["pairs"]) == 4.0 and value(spark, found["loops"]) == 1
    assert value(spark, found["total"]) == pytest.approx(0.2 * 1 + 0.3 * 3.9 + 0.4 * (0.12 + 0.02 - 0.1))
    nothing = rewards.sequence_reward(F.array(F.lit("<end/>")), F.lit(0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(True), F.lit(False))
    assert value(spark, nothing["format"]) == -0.1
    assert value(spark, rewards.anchor_key(F.lit(""), F.lit(None).cast("string"), F.lit(float("nan")), F.lit(0.9), F.lit("x <hint level=1>"))) == '["na","L","none","H","hint"]'
    assert value(spark, rewards.step_reward(F.lit(0.1), F.lit(0.0), F.lit(0.7), F.lit("<hint><hint><hint>"))) == pytest.approx(0.06 + 0.1 - 0.01 - 0.05)
    last = F.array(F.struct(F.lit(0.5).alias("mastery"), F.lit(None).cast("double").alias("engagement"), F.lit(0.1).alias("misconception_severity")), F.lit(None))
    assert tuple(value(spark, rewards.final_evaluation(last))) == (0.5, 0.7, 0.1)


def learner(**given):
    base = {"mastery": [0.9] * 6, "misconception": [0.1] * 6, "engagement": 0.5, "fatigue": 0.1, "position": 5, "profile": 0, "step": 3, "completed": False} | given
    return F.struct(*[(F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)).alias(k) for k, v in base.items()])


def test_curriculum_ends(spark):
    done = value(spark, curriculum.taken(learner(), F.lit(0)))
    assert done.terminated and not done.truncated and done.reward == 1.0 and done.next.completed and done.next.position == 5
    late = value(spark, curriculum.taken(learner(step=39, position=1, mastery=[0.2] * 6), F.lit(9)))
    assert late.truncated and not late.terminated and late.node == 0 and late.next.step == 40
    assert value(spark, curriculum.mask(learner(step=40))) == [] and value(spark, curriculum.mask(learner(completed=True))) == []
    valid = value(spark, curriculum.mask(learner(fatigue=0.9)))
    assert valid and all(a % 9 // 3 == 0 and a % 3 != 2 for a in valid)
    assert value(spark, curriculum.policy(learner(), curriculum.mask(learner()))) == 4


def test_heuristic(spark):
    """What the heuristic chooses is policy's choice of the mask, and episodes are policy and taken step by step."""
    values = [None, float("nan"), 0.0, 0.1, 0.12, 0.3, 0.34, 0.35, 0.4, 0.45, 0.5, 0.65, 0.7, 0.86, 1.0]
    r = random.Random(3)
    good = lambda: [r.choice([0.7, 0.8, 0.9, *values[:3], *values]) for _ in range(6)]
    low = lambda: [r.choice([0.1, 0.2, 0.3, *values]) for _ in range(6)]
    rows = [(i, (good(), low(), r.choice(values), r.choice(values), r.choice([None, *range(6)]), r.choice([None, 0, 1, 2]), r.choice([None, 0, 30, 38, 39, 40]), r.choice([None, False, False, True]))) for i in range(600)]
    kind = "mastery array<double>, misconception array<double>, engagement double, fatigue double, position int, profile int, step int, completed boolean"
    states = spark.createDataFrame(rows, f"k int, s struct<{kind}>").localCheckpoint()
    done, s = states, F.col("s")
    expected = []
    for n in range(3):
        chosen = done.select("k", "s", curriculum.mask(s).alias("m")).where("size(m) > 0").localCheckpoint()
        chosen = chosen.select("k", "s", curriculum.policy(s, F.col("m")).alias("action")).localCheckpoint()
        chosen = chosen.select("k", "action", curriculum.taken(s, F.col("action")).alias("t")).localCheckpoint()
        expected += chosen.selectExpr("k", f"{n} AS n", "action", "t.node", "t.reward", "t.terminated", "t.truncated", "t.successful").collect()
        done = chosen.where("NOT t.terminated AND NOT t.truncated").selectExpr("k", "t.next AS s")
    found = curriculum.episodes(states, "k", "s", 3)
    assert len(expected) > 600 and sorted(map(repr, found.collect())) == sorted(map(repr, expected))
    assert "transform" not in "".join(map(str, curriculum._layers()))


def test_section_chunks():
    pair = "".join(f"<i>{'y' * 600}</i>" for _ in range(2))
    xml = f"<a><title>T</title><sec><title>S</title><p>{'x' * 300}</p><p>short</p><p><bold>Sub</bold></p><list><i>a</i><i>b <b>c</b> d</i></list><p>after</p><list>{pair}</list><p>end?</p></sec></a>"
    found = sections.chunks("f", xml)
    assert [(i, t, c) for i, t, c, _ in found] == [("f_0", "T -- S", "x" * 300 + " short"), ("f_1", "T -- S -- Sub", "a b c d after"), ("f_2", "T -- S", "y" * 600), ("f_3", "T -- S", "y" * 600), ("f_4", "T -- S", "end?")]
    assert found[1][3] == "T -- S -- Sub. a b c d after" and sections.chunks("f", "not xml") == []


def test_deep_and_rootless_trees(spark):
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 61)], "node long, parent long")
    rows = {r.node: r.depth for r in relational.depths(chain, "node", "parent").collect()}
    assert len(rows) == 60 and rows[60] == 59
    circle = spark.createDataFrame([(1, 2), (2, 1)], "node long, parent long")
    assert sorted(r.node for r in relational.depths(circle, "node", "parent").collect()) == [1, 2]
    path = "1," + ",".join(map(str, range(5000)))
    assert value(spark, relational.reparented(F.lit(path), "1", "7,1")) == "7,1" + path[1:]


def test_not_in(spark):
    keys = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    values = lambda *xs: spark.createDataFrame([(x,) for x in xs], "v int")
    assert [r.k for r in relational.not_in(keys, "k", values(1)).collect()] == [2]
    assert relational.not_in(keys, "k", values(1, None)).count() == 0 and relational.not_in(keys, "k", values()).count() == 3


def test_a_deep_chain_takes_few_rounds(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(relational, "written", lambda df, name: tables.append(name) or written(df, name))
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(5000)] + [(6000, 6001), (6001, 6000), (6002, 6000)], "node int, parent int")
    rows = {r.node: (r.depth, r.n) for r in relational.depths(chain, "node", "parent").select("node", "depth", F.size(F.split("path", ",")).alias("n")).collect()}
    assert rows == {i: (i, i + 1) for i in range(5000)} and len(tables) < 20


def test_names_that_clash(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "a", 6)], "place int, key string, first_place int")
    assert [r.place for r in relational.keep_first(rows, [F.col("key")], [F.col("place")]).collect()] == [1]
    assert relational.last_wins(rows, "key", "place").collect()[0].first_place == 6
    assert sorted(r.n for r in relational.numbered(rows, ["key"], ["place"], "n").collect()) == [1, 2]
    odd = spark.createDataFrame([(1, 2, 2.0), (2, 2, 3.0)], "source int, source_of int, range_part double")
    assert sorted(r.n for r in relational.numbered(odd, ["source"], ["range_part"], "n").collect()) == [1, 1]
    assert [(r.part, r.place) for r in lookups.exported(spark.createDataFrame([(1, "2.0", "x"), (2, "3.0", "y")], "base int, part string, place string"), "base", 1, "place", ["part"]).orderBy("sheet", "part").collect()] == [(2.0, "x"), (3.0, "y"), (5.0, "total")]
    drawn = lambda key: [r[1] for r in relational.replayed(spark.createDataFrame([(i, 1.0, i % 2 == 0) for i in range(40)], f"{key} int, part double, o boolean"), key, "part", "o", 8, 0.4, 0.5, 1).orderBy("place").collect()]
    assert drawn("own") == drawn("x") == drawn("n") and all(0 <= i < 40 for i in drawn("own"))


def test_blank_keys_are_numbered_over_ranges(spark):
    given = [(i, None if i % 3 == 0 else f"k{i % 50}", i) for i in range(600)]
    rows = relational.last_wins_numbered(spark.createDataFrame([(p, k, p, 1) for p, k, _ in given], "pos int, key string, v int, range_of int").repartition(7), "key", "pos")
    plain = {}
    for pos, key, v in given:
        key = key or f"q-{len(plain) + 1:06d}"
        plain[key] = (plain[key][0] if key in plain else pos, v)
    assert {r.key: (r.pos, r.v) for r in rows.collect()} == plain


def test_tiers_profiles_and_labels(spark):
    for hint, tier in {"低": 0, "中": 1, " 高 ": 2, "low": 0, "?": 1, None: 1}.items():
        assert value(spark, questions.difficulty_tier(F.lit(hint).cast("string"), F.lit("other"))) == questions.TIERS[tier]
    assert value(spark, questions.by_profile(F.lit("?"), F.lit("EN "), F.lit(True))).startswith("First-year clinical resident; can recite")
    assert value(spark, questions.by_profile(F.lit("difficult_diagnostic"), F.lit("zh"), F.lit(False))).startswith("眼科规培二年级")
    messages = {"zhcn": {"p": "风格「{style}」、配色「{color}」{n}"}, "enus": {"p": 'style "{style}", color "{color}"{n}'}}
    said = lambda code: value(spark, routing.message(F.lit(code), F.lit("p"), messages, {"style": F.lit("简约"), "color": F.lit("蓝色"), "n": F.lit("红色")}))
    assert said("zhcn") == "风格「简约」、配色「蓝色」红色" and said("en-US") == 'style "Minimal", color "Blue"红色'


def test_texts_with_pattern_marks(spark):
    options = F.create_map(F.lit("A"), F.lit(r"x\Ey\Q("), F.lit("B"), F.lit(r"\E"))
    assert value(spark, questions.with_options(F.lit("Q A. x\\Ey\\Q( B. \\E"), options)) == "Q\nA. x\\Ey\\Q(\nB. \\E"
    assert value(spark, T.split_list(F.lit("a\\Eb"), "\\E")) == ["a", "b"]


def test_questions(spark):
    options = F.create_map(F.lit("A"), F.lit("one (x)"), F.lit("B"), F.lit("two"))
    given = {
        "Which?": "Which?\nA. one (x)\nB. two",
        "Which? A. one (x) B) two": "Which?\nA. one (x)\nB. two",
        "Which?\nA. one (x)\nB: two": "Which?\nA. one (x)\nB: two",
        "Which?\nA. one": "Which?\nne\nA. one (x)\nB. two",
    }
    for question, whole in given.items():
        assert value(spark, questions.with_options(F.lit(question), options)) == whole
    assert value(spark, questions.with_options(F.lit("q"), F.map_from_arrays(F.array(), F.array()).cast("map<string,string>"))) == "q"
    assert value(spark, questions.one_line(F.lit(" a\u2028b\u2029"))) == "a b"
    assert value(spark, questions.flat_context(F.array(F.lit("x"), F.lit(None), F.lit("y")), F.array(F.lit("L"), F.lit(" ")))) == "L: x\n\nCONTEXT: y"
    assert value(spark, questions.cut_context(F.lit("aaaa\n\nbb\n\ncc"), 9)) == "aaaa [...]" and value(spark, questions.cut_context(F.lit("a" * 20), 9)) == "a" * 9 + " [...]"
    assert value(spark, questions.misconception(F.array(F.lit(" ")), F.lit("t"), F.lit("en"))) == ""
