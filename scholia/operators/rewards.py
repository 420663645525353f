"""Rewards of dialogues: what a whole trajectory earns, what a step earns, and the anchors that steps are grouped by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dialogue import actions

# The default coefficients, the ordered pairs that earn something, the state where a value is missing.
COEFFICIENTS = {"alpha": 0.2, "beta": 0.3, "gamma": 0.4, "mu1": 0.6, "mu2": 0.2, "mu3": 0.2, "lambda_fmt": 0.1, "lambda_loop": 0.1, "risk_weight": 0.0, "end_penalty": 0.0}
RHO = {("recall", "hint"): 1.0, ("hint", "correct"): 1.0, ("recall", "correct"): 1.0}
MISSING = {"mastery": 0.3, "engagement": 0.7, "misconception_severity": 1.0}
# The tags that name a turn's phase.
PHASES = ["recall", "probe", "hint", "check", "explain", "correct", "encourage", "summarize"]


def _number(value: Column, missing: float) -> Column:
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), F.lit(missing)).otherwise(value)


def phase(text: Column) -> Column:
    """The tag that starts first in the text, or other."""
    first = F.regexp_extract(F.coalesce(text, F.lit("")), rf"<({'|'.join(PHASES)})(?=[\s>])", 1)
    return F.when(first != "", first).otherwise("other")


def bucket(value: Column) -> Column:
    return F.when(value < 0.34, "L").when(value < 0.67, "M").otherwise("H")


def anchor_key(node: Column, misconception: Column, mastery: Column, engagement: Column, text: Column) -> Column:
    """JSON list of node, mastery's bucket, misconception, engagement's bucket and phase, of the state before the action."""
    named = lambda c, other: F.when(F.coalesce(c, F.lit("")) == "", other).otherwise(c)
    return F.to_json(F.array(named(node, "na"), bucket(_number(mastery, MISSING["mastery"])), named(misconception, "none"), bucket(_number(engagement, MISSING["engagement"])), phase(text)))


def step_reward(mastery_gain: Column, engagement_gain: Column, fatigue_after: Column, text: Column) -> Column:
    """0.6 and 0.3 of the gains, 0.1 for any mastery, less a tenth of fatigue beyond 0.6 and 0.05 for more than two hints."""
    dm, de, tired = _number(mastery_gain, 0.0), _number(engagement_gain, 0.0), _number(fatigue_after, 0.0)
    hints = F.regexp_count(F.coalesce(text, F.lit("")), F.lit("<hint"))
    return 0.6 * dm + 0.3 * de + F.when(dm > 0, 0.1).otherwise(0.0) - 0.1 * F.greatest(F.lit(0.0), tired - 0.6) - F.when(hints > 2, 0.05).otherwise(0.0)


def final_evaluation(states: Column) -> Column:
    """mastery, engagement and misconception_severity of the last state that isn't null, with values for what is missing."""
    last = F.try_element_at(F.filter(states, lambda s: s.isNotNull()), F.lit(-1))
    return F.struct(*[_number(last[k], v).alias(k) for k, v in MISSING.items()])


def ending_violated(texts: Column, resolved: Column, severities: Column) -> Column:
    """Whether a dialogue ends without a correct action and without evidence that the misconception is resolved.

    texts in order; resolved: array of flags; severities: array of struct(before, after). A fall by 0.3 is evidence.
    """
    tags = lambda x: F.transform(actions(F.coalesce(x, F.lit(""))), lambda a: a["tag"])
    ends = F.array_contains(tags(F.try_element_at(texts, F.lit(-1))), "end")
    corrected = F.exists(texts, lambda x: F.array_contains(tags(x), "correct"))
    fell = F.exists(severities, lambda s: F.coalesce(s["before"] - F.coalesce(s["after"], F.lit(0.0)) >= 0.3, F.lit(False)))
    return F.when(F.size(texts) > 0, ends & ~corrected & ~F.exists(resolved, lambda r: F.coalesce(r, F.lit(False))) & ~fell).otherwise(False)


def _pairs(tags: Column, first: str, second: str) -> Column:
    """How many places of first and later second there are."""

    def later(i):
        return F.size(F.filter(F.slice(tags, i + 2, F.greatest(F.size(tags), F.lit(1))), lambda y: y == second))

    counts = F.transform(tags, lambda x, i: F.when(x == first, later(i)).otherwise(0))
    return F.aggregate(counts, F.lit(0), lambda s, n: s + n)


def sequence_reward(texts: Column, n_defects: Column, mastery_gain: Column, engagement_gain: Column, severity: Column, ended: Column, risky: Column, c: dict[str, float] = COEFFICIENTS) -> dict[str, Column]:
    """Components of a trajectory's reward and their weighted total.

    texts: the teacher's texts of steps whose actions count, in order; n_defects: all that was found wrong, to which an
    empty list of actions adds one. Pairs count each (earlier, later) couple; a repeated action is a loop.
    """
    acts = F.filter(F.flatten(F.transform(texts, lambda x: actions(F.coalesce(x, F.lit(""))))), lambda a: a["tag"] != "end")
    signed = F.transform(acts, lambda a: F.struct(a["tag"], F.trim(a["attrs"]), a["body"]))
    tags = F.transform(acts, lambda a: a["tag"])
    bad = n_defects + F.when(F.size(acts) == 0, 1).otherwise(0)
    fmt = F.when(bad == 0, 1.0).otherwise(0.0) - c["lambda_fmt"] * bad
    worth = F.lit(0.0)
    for pair, value in RHO.items():
        worth = worth + value * _pairs(tags, *pair)
    loops = F.size(signed) - F.size(F.array_distinct(signed))
    rule = worth - c["lambda_loop"] * loops
    learn = c["mu1"] * mastery_gain + c["mu2"] * engagement_gain - c["mu3"] * severity
    total = c["alpha"] * fmt + c["beta"] * rule + c["gamma"] * learn - c["risk_weight"] * risky.cast("double") - F.when(ended, 0.0).otherwise(c["end_penalty"])
    return {"format": fmt, "rule": rule, "learn": learn, "pairs": worth, "loops": loops, "total": total}


def rollout_groups(rows: DataFrame, group: str, context: list[str], size: int) -> DataFrame:
    """group, rollouts, contexts and complete: whether a group has a whole number of `size` rollouts, all of one prompt.

    A rollout's context is the digest of its columns as JSON, nulls included. A null group is a group; no rows give none.
    """
    digest = F.sha2(F.to_json(F.struct(*context), {"ignoreNullFields": "false"}), 256)
    found = rows.select(group, digest.alias("digest")).groupBy(group).agg(F.count("*").alias("rollouts"), F.count_distinct("digest").alias("contexts"))
    return found.withColumn("complete", (F.col("rollouts") % size == 0) & (F.col("contexts") == 1))
