"""The curriculum: which actions a learner's state permits, where they are aimed, what they change, and a policy.

A state is a struct of mastery and misconception (one value a course), engagement, fatigue, position, profile, step and
completed. Actions are numbers from 0 to 26: macro (advance, review, remedy) * 9 + difficulty * 3 + style.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import clamp
from ..shared import written

# By profile, the learning rate and the style that fits; by macro action (advance, review, remedy), the
# correction; by difficulty and by style, what they add to fatigue.
RATES = (0.27, 0.23, 0.31)
FITTING_STYLE = (1, 0, 2)
CORRECTIONS = (0.04, 0.05, 0.14)
TIRING_DIFFICULTY = (-0.04, 0.025, 0.065)
TIRING_STYLE = (-0.025, 0.0, 0.025)
# What each course needs before it, the most steps, when a course is mastered, its share of misconception.
PREREQUISITES = ((), (0,), (1,), (1, 2), (2, 3), (4,))
MAX_STEPS, MASTERED, MISTAKEN = 40, 0.70, 0.35
ACTIONS = 27
#: Bytes of a method that the JVM compiles at most.
HUGE_METHOD = 8000
MISFIT, DIFFICULTY_STEP, DIFFICULTY_FLOOR, REMEDY, REWARD_SCALE = 0.82, 0.25, 0.45, 0.85, 5.0


def _of(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), index.cast("int") + 1)


def step(mastery: Column, misconception: Column, engagement: Column, fatigue: Column, profile: Column, macro: Column, difficulty: Column, style: Column) -> dict[str, Column]:
    """mastery, misconception, engagement, fatigue, assessment after the action, and its reward from -1 to 1."""
    fits = F.when(style == _of(FITTING_STYLE, profile), 1.0).otherwise(MISFIT)
    wanted = F.when(mastery < 0.35, 0).when(mastery < 0.75, 1).otherwise(2)
    apt = F.greatest(F.lit(DIFFICULTY_FLOOR), 1 - DIFFICULTY_STEP * F.abs(difficulty - wanted))
    openness = (0.5 + 0.5 * engagement) * (1 - 0.65 * fatigue) * (1 - 0.35 * misconception)
    gain = _of(RATES, profile) * fits * apt * openness * (1 - mastery) * F.when(macro == 2, REMEDY).otherwise(1.0)
    after = {"mastery": clamp(mastery + gain), "misconception": clamp(misconception - _of(CORRECTIONS, macro) * fits)}
    after["fatigue"] = clamp(fatigue + _of(TIRING_DIFFICULTY, difficulty) + _of(TIRING_STYLE, style))
    mood = F.when(fits == 1.0, 0.025).otherwise(-0.025) + F.when(apt == 1.0, 0.01).otherwise(-0.015)
    after["engagement"] = clamp(engagement + mood - 0.015 * after["fatigue"])
    after["assessment"] = clamp(after["mastery"] * (1 - 0.4 * after["misconception"]))
    return after | {"reward": clamp(_raw(mastery, misconception, engagement, fatigue, macro, after) / REWARD_SCALE, -1.0, 1.0)}


def _raw(mastery: Column, misconception: Column, engagement: Column, fatigue: Column, macro: Column, after: dict[str, Column]) -> Column:
    """The reward before it is scaled."""
    raw = 8 * (after["mastery"] - mastery) + 2 * (misconception - after["misconception"]) + 0.5 * (after["engagement"] - engagement)
    return raw - 0.5 * F.greatest(F.lit(0.0), after["fatigue"] - fatigue) - 0.08 + F.when(macro == 0, 0.8).otherwise(0.0)


def allowed(macro: Column, difficulty: Column, style: Column, mastery: Column, misconception: Column, engagement: Column, fatigue: Column, profile: Column, may_advance: Column) -> Column:
    """Whether a state permits an action at the course that it is aimed at."""
    return (
        ((macro != 0) | may_advance)
        & ((macro != 2) | (misconception >= 0.12))
        & ((difficulty != 2) | ((mastery >= 0.45) & (fatigue <= 0.65)))
        & ((difficulty != 1) | (fatigue <= 0.85))
        & ((style != 2) | ((engagement >= 0.40) & (fatigue <= 0.65) & (profile != 1)))
    )


def ready(state: Column, node: Column) -> Column:
    """Whether a course is mastered, without too much misconception."""
    return (F.get(state["mastery"], node) >= MASTERED) & (F.get(state["misconception"], node) <= MISTAKEN)


def _by_course(node: Column, values: list[Column]) -> Column:
    """The value of a course; null for what is none."""
    out = F.when(node == 0, values[0])
    for i, value in enumerate(values[1:], 1):
        out = out.when(node == i, value)
    return out


def _weakest(state: Column) -> Column:
    """Of the courses that the own one needs and that aren't ready, the weakest (of equals the first); null if there is none."""

    def of(needs: tuple[int, ...]) -> Column:
        weak = [F.when(~ready(state, F.lit(p)), F.struct(F.get(state["mastery"], F.lit(p)).alias("m"), F.lit(i).alias("i"), F.lit(p).alias("p"))) for i, p in enumerate(needs)]
        return (F.least(*weak) if len(weak) > 1 else weak[0])["p"] if weak else F.lit(None).cast("int")

    return _by_course(state["position"], [of(p) for p in PREREQUISITES])


def may_advance(state: Column) -> Column:
    """Whether the own course is ready, and all that the next one needs."""
    after = F.least(state["position"] + 1, F.lit(len(PREREQUISITES) - 1))
    needed = [reduce(and_, [ready(state, F.lit(p)) for p in needs], F.lit(True)) for needs in PREREQUISITES]
    return ready(state, state["position"]) & _by_course(after, needed)


def target_node(state: Column, macro: Column) -> Column:
    """The course an action is aimed at: the next one to advance, of a review the weakest one that the own one needs and
    that isn't ready (of equals the first), else the own one."""
    n, position = len(PREREQUISITES), state["position"]
    return F.when(macro == 0, F.least(position + 1, F.lit(n - 1))).when(macro == 1, F.coalesce(_weakest(state), position)).otherwise(position)


def is_open(state: Column) -> Column:
    """Whether the curriculum is neither completed nor its steps used up."""
    return ~F.coalesce(state["completed"], F.lit(False)) & (state["step"] < MAX_STEPS)


def mask(state: Column) -> Column:
    """The permitted actions, in order; none where the curriculum is completed or the steps are used up."""
    advance = may_advance(state)
    targets = F.array(*[target_node(state, F.lit(m)) for m in range(3)])

    def permitted(a):
        macro, difficulty, style = (F.floor(x).cast("int") for x in (a / 9, a % 9 / 3, a % 3))
        mastery = F.get(state["mastery"], F.get(targets, macro))
        own = F.get(state["misconception"], state["position"])
        return allowed(macro, difficulty, style, mastery, own, state["engagement"], state["fatigue"], state["profile"], advance)

    return F.when(is_open(state), F.filter(F.sequence(F.lit(0), F.lit(ACTIONS - 1)), permitted)).otherwise(F.array().cast("array<int>"))


def policy(state: Column, valid: Column) -> Column:
    """The heuristic's choice among valid actions: the macro, difficulty and style it wants count 5, 2 and 1; of equals
    the first. Null where there is none."""
    own = F.get(state["misconception"], state["position"])
    macro = F.when(F.exists(valid, lambda a: a < 9), 0).when(own > 0.28, 2).otherwise(1)
    mastery = F.get(state["mastery"], target_node(state, macro))
    difficulty = F.when((mastery < 0.35) | (state["fatigue"] > 0.45), 0).otherwise(1)
    style = _of(FITTING_STYLE, state["profile"])

    def score(a):
        return 5 * (F.floor(a / 9) == macro).cast("int") + 2 * (F.floor(a % 9 / 3) == difficulty).cast("int") + (a % 3 == style).cast("int")

    return -F.array_max(F.transform(valid, lambda a: F.struct(score(a).alias("s"), (-a).alias("a"))))["a"]


def heuristic(state: Column, advance: Column, macro: Column, node: Column) -> Column:
    """What policy chooses of the mask of a state that is open: advance is may_advance, macro and node what it wants.

    The mask is a product: macro, difficulty and style each permit their values by themselves, 0 of the last two always,
    and the macro that is wanted too. So each is the wanted value, if permitted, else the first. Without a profile no
    action is preferred, and the first permitted one is chosen.
    """
    fatigue, mastery = state["fatigue"], F.get(state["mastery"], node)
    difficulty = F.when((mastery < 0.35) | (fatigue > 0.45), 0).when(fatigue <= 0.85, 1).otherwise(0)
    fitting = _of(FITTING_STYLE, state["profile"])
    style = F.when(fitting != 2, fitting).when((state["engagement"] >= 0.40) & (fatigue <= 0.65), 2).otherwise(0)
    return F.when(state["profile"].isNull(), F.when(advance, 0).otherwise(9)).otherwise(macro * 9 + difficulty * 3 + style)


def wanted_macro(state: Column, advance: Column) -> Column:
    """The macro action that the heuristic wants: to advance where it may, a remedy of much misconception, else a review."""
    return F.when(advance, 0).when(F.get(state["misconception"], state["position"]) > 0.28, 2).otherwise(1)


def taken(state: Column, action: Column) -> Column:
    """What an action does without noise: next (a state), node, reward, terminated, truncated and successful.

    To advance from the last course completes the curriculum, with the full reward. The last step that doesn't is
    truncated, at a cost. Successful: a positive reward with 0.02 more mastery, 0.03 less misconception, or an advance.
    """
    macro, node = F.floor(action / 9).cast("int"), target_node(state, F.floor(action / 9).cast("int"))
    return outcome(state, macro, node, effect(state, action, node))


def effect(state: Column, action: Column, node: Column) -> dict[str, Column]:
    """What step gives for an action that is aimed at a course."""
    macro, difficulty, style = (F.floor(x).cast("int") for x in (action / 9, action % 9 / 3, action % 3))
    return step(F.get(state["mastery"], node), F.get(state["misconception"], node), state["engagement"], state["fatigue"], state["profile"], macro, difficulty, style)


def outcome(state: Column, macro: Column, node: Column, after: dict[str, Column]) -> Column:
    """As taken, of an action's effect."""
    mastery, misconception = F.get(state["mastery"], node), F.get(state["misconception"], node)
    graduates = (macro == 0) & (state["position"] == len(PREREQUISITES) - 1)
    truncated = ~graduates & (state["step"] + 1 >= MAX_STEPS)
    raw = _raw(mastery, misconception, state["engagement"], state["fatigue"], macro, after) - F.when(truncated, 1.0).otherwise(0.0)
    reward = F.when(graduates, 1.0).otherwise(clamp(raw / REWARD_SCALE, -1.0, 1.0))
    own = [F.when((node == i) & ~graduates, True).otherwise(False) for i in range(len(PREREQUISITES))]
    put = lambda values, new: F.when(values.isNotNull(), F.array(*[F.when(x, new).otherwise(F.get(values, F.lit(i))) for i, x in enumerate(own)]))
    keep = lambda name: F.when(graduates, state[name]).otherwise(after[name])
    following = F.struct(
        put(state["mastery"], after["mastery"]).alias("mastery"),
        put(state["misconception"], after["misconception"]).alias("misconception"),
        keep("engagement").alias("engagement"),
        keep("fatigue").alias("fatigue"),
        F.when((macro == 0) & ~graduates, node).otherwise(state["position"]).alias("position"),
        state["profile"].alias("profile"),
        (state["step"] + 1).alias("step"),
        graduates.alias("completed"),
    )
    gained = (~graduates & ((after["mastery"] - mastery >= 0.02) | (misconception - after["misconception"] >= 0.03))) | (macro == 0)
    return F.struct(following.alias("next"), node.alias("node"), reward.alias("reward"), graduates.alias("terminated"), truncated.alias("truncated"), ((reward > 0) & gained).alias("successful"))


def episodes(states: DataFrame, key: str, state: str, steps: int = MAX_STEPS) -> DataFrame:
    """key, n, action and what taken gives of each step of the heuristic's noise-free episodes, until all have ended.

    Each step is one map over the open episodes, written to the shared folder, so plans don't grow with the steps. What
    later columns use more than once is a column first, and none is a function of lists, so that a step is compiled: in
    as many parts as the JVM needs (it runs methods beyond HUGE_METHOD uncompiled, which is what one for all would be).
    """
    conf, limit = states.sparkSession.conf, "spark.sql.codegen.hugeMethodLimit"
    before = conf.get(limit)
    conf.set(limit, str(HUGE_METHOD))
    try:
        return _episodes(states.select(key, F.col(state).alias("s")), key, steps)
    finally:
        conf.set(limit, before)


def _episodes(open_: DataFrame, key: str, steps: int) -> DataFrame:
    out, layers = None, _layers()
    for n in range(steps):
        rows = open_.where(is_open(F.col("s")))
        for layer in layers:
            rows = rows.withColumns(layer)
        last = n == steps - 1
        rows = written(rows.select(key, F.lit(n).alias("n"), "action", F.col("t").dropFields("next").alias("t") if last else "t"), "episodes")
        step_ = rows.select(key, "n", "action", "t.node", "t.reward", "t.terminated", "t.truncated", "t.successful")
        out = step_ if out is None else out.unionByName(step_)
        if last:
            break
        open_ = rows.where("NOT t.terminated AND NOT t.truncated").select(key, F.col("t.next").alias("s"))
        if open_.isEmpty():
            break
    return out


def _layers() -> list[dict[str, Column]]:
    """The columns of a step from state s to action and t, each layer's from those before it."""
    s, advance, wanted, action, macro, node = map(F.col, ("s", "advance", "wanted", "action", "macro", "node"))
    after = effect(s, action, node)
    return [
        {"advance": may_advance(s)},
        {"wanted": wanted_macro(s, advance)},
        {"aim": target_node(s, wanted)},
        {"action": heuristic(s, advance, wanted, F.col("aim")).cast("int")},
        {"macro": F.floor(action / 9).cast("int")},
        {"node": target_node(s, macro)},
        {f"after_{x}": c for x, c in after.items()},
        {"t": outcome(s, macro, node, {x: F.col(f"after_{x}") for x in after})},
    ]
