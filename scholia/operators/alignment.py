"""Tokens and actions: which action owns each labelled token, and the clipped objective over actions."""

from __future__ import annotations

from collections.abc import Collection, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The label of a token that nobody is taught.
UNLABELLED = -100
#: Examples that a task has as Python lists at a time.
PART = 32


def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of PART at most: numbers take many times more room as Python lists than in Arrow."""
    for batch in batches:
        for at in range(0, batch.num_rows, PART):
            yield batch.slice(at, PART)


def action_owners(ids: Sequence[int], labels: Sequence[int], bodies: Sequence[Sequence[int]], credits: Sequence[int | None], harmless: Collection[int]) -> tuple[list[int] | None, str | None]:
    """The action that owns each token (-1: none), or what is wrong.

    Runs of labelled tokens and actions are merged in order. A run has its action's body once, with only harmless tokens
    (special or blank ones) before and after it; its owner is the action's credit where that is given.
    """
    if len(ids) != len(labels):
        return None, "lengths differ"
    runs: list[tuple[int, int]] = []
    for i, (token, label) in enumerate(zip(ids, labels)):
        if label == UNLABELLED:
            continue
        if label != token:
            return None, "a label isn't its token"
        if runs and runs[-1][1] == i:
            runs[-1] = (runs[-1][0], i + 1)
        else:
            runs.append((i, i + 1))
    if len(runs) != len(bodies):
        return None, "runs and actions differ in number"
    owners = [-1] * len(ids)
    for k, ((a, b), body, credit) in enumerate(zip(runs, bodies, credits)):
        run = list(ids[a:b])
        # Only harmless tokens may come before, so the body starts at the first other token, or among the harmless ones before it.
        first = next((i for i, x in enumerate(run) if x not in harmless), len(run))
        last = next((i for i in range(len(run), 0, -1) if run[i - 1] not in harmless), 0)
        starts = [i for i in range(min(first, len(run) - len(body)) + 1) if run[i : i + len(body)] == list(body) and i + len(body) >= last] if body else []
        if not starts:
            return None, f"action {k} isn't in its run alone"
        if len(starts) > 1:
            return None, f"action {k} is in its run more than once"
        owner = k if credit is None else credit
        if not 0 <= owner < len(bodies):
            return None, f"action {k} has no such owner"
        owners[a:b] = [owner] * (b - a)
    return owners, None


def aligned(rows: DataFrame, key: str, harmless: Collection[int]) -> DataFrame:
    """key, owners and problem of rows with key, ids, labels, bodies and credits (lists; null ones are empty).

    One of owners and problem is null, so rows that fail can be put aside. A row is one training example; no exchange.
    """
    kept = frozenset(harmless)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            found = [action_owners(ids or [], labels or [], bodies or [], credits or [None] * len(bodies or []), kept) for ids, labels, bodies, credits in zip(*(batch.column(c).to_pylist() for c in ("ids", "labels", "bodies", "credits")))]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([x for x, _ in found], pa.list_(pa.int32())), pa.array([x for _, x in found], pa.string())], [key, "owners", "problem"])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, "ids", "labels", "bodies", "credits").mapInArrow(run, f"`{key}` {kind}, owners array<int>, problem string")


def action_terms(rows: DataFrame, key: str, low: float, high: float, beta: float) -> DataFrame:
    """key, action, policy and kl of every action of rows with lists logps, old_logps, ref_logps, advantages, actions and mask.

    Tokens that the mask leaves out or that no action owns (below 0) don't count. An action's ratio is exp of its tokens'
    summed log differences, clipped to 1 - low and 1 + high; kl sums exp(d) - d - 1 of ref less new. Lists of other
    lengths, an action with unlike advantages and a result that isn't finite stop the job, as they do in training. Inside the row: no exchange.
    """
    names = ["logps", "old_logps", "ref_logps", "advantages", "actions", "mask"]
    same = F.lit(True)
    for c in names[1:]:
        same = same & (F.size(c) == F.size("logps"))
    kinds = {"actions": "int", "mask": "boolean"}
    cast = rows.select(key, *[F.col(c).cast(f"array<{kinds.get(c, 'double')}>").alias(c) for c in names])
    checked = F.when(same, F.arrays_zip(*names)).otherwise(F.raise_error(F.lit("lists of one row differ in length")))
    active = F.filter(checked, lambda x: x["mask"] & (x["actions"] >= 0))
    plain = cast.select(key, F.transform(active, lambda x: F.struct(x["logps"].alias("new"), x["old_logps"].alias("old"), x["ref_logps"].alias("ref"), x["advantages"].alias("adv"), x["actions"].alias("action"))).alias("tokens"))

    def total(tokens: Column, of) -> Column:
        return F.aggregate(tokens, F.lit(0.0), lambda s, x: s + of(x))

    def term(action: Column) -> Column:
        own = F.filter("tokens", lambda x: x["action"] == action)
        adv = own[0]["adv"]
        unlike = F.exists(own, lambda x: F.abs(x["adv"] - adv) > 1e-8 + 1e-5 * F.abs(adv))
        ratio = F.exp(total(own, lambda x: x["new"] - x["old"]))
        policy = -F.least(ratio * adv, F.greatest(F.lit(1 - low), F.least(F.lit(1 + high), ratio)) * adv)
        kl = total(own, lambda x: F.exp(x["ref"] - x["new"]) - (x["ref"] - x["new"]) - 1) if beta else F.lit(0.0)
        return F.struct(action.alias("action"), F.when(unlike, F.raise_error(F.lit("an action has unlike advantages")).cast("double")).otherwise(policy).alias("policy"), kl.alias("kl"))

    actions = F.transform(F.array_distinct(F.transform("tokens", lambda x: x["action"])), term)
    return plain.select(key, F.explode(actions).alias("t")).select(key, "t.action", "t.policy", "t.kl")


def clipped_objective(rows: DataFrame, key: str, low: float = 0.2, high: float = 0.28, beta: float = 0.04) -> DataFrame:
    """loss, policy, kl (means over all actions) and actions: one row. The divisor is the count of all actions, 1 at least; no rows: zeros."""
    terms = action_terms(rows, key, low, high, beta)
    loss = F.coalesce(F.sum(F.col("policy") + beta * F.col("kl")), F.lit(0.0)) / F.greatest(F.count("*"), F.lit(1))
    found = terms.agg(loss.alias("loss"), F.coalesce(F.avg("policy"), F.lit(0.0)).alias("policy"), F.coalesce(F.avg("kl"), F.lit(0.0)).alias("kl"), F.count("*").alias("actions"))
    bad = F.col("loss").isNull() | F.isnan("loss") | (F.abs("loss") == float("inf"))
    return found.withColumn("loss", F.when(bad, F.raise_error(F.lit("the objective isn't finite")).cast("double")).otherwise(F.col("loss")))
