"""Strict checks of stored trajectories: what each row breaks first, rows put aside, counts against a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# Names of an action's parts and of courses, the most steps, and how many actions there are.
MACROS, DIFFICULTIES, STYLES = ("advance", "review", "remediate"), ("easy", "medium", "hard"), ("gentle", "neutral", "strict")
COURSES = ("foundations", "concepts", "worked_examples", "application", "integration", "capstone")
MAX_STEPS, ACTIONS, PROFILES = 40, 27, 3

STATE = "struct<mastery:array<double>,engagement:double,fatigue:double,misconception:array<double>,position:int,profile:int,assessment:double,step:int,completed:boolean>"
TRANSITION = f"struct<state:{STATE},next_state:{STATE},action:struct<index:int,macro:string,difficulty:string,style:string>,reward:double,terminated:boolean,truncated:boolean,done:boolean,successful:boolean,valid_actions:array<int>,next_valid_actions:array<int>,target_course:string>"
TRAJECTORY = f"trajectory_id string, profile int, transitions array<{TRANSITION}>"


def _sound(s: Column) -> Column:
    """Whether a state has its sizes and ranges."""
    share = lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x <= 1)
    whole = lambda x, n: x.isNotNull() & (x >= 0) & (x < n)
    sizes = (F.size(s["mastery"]) == len(COURSES)) & (F.size(s["misconception"]) == len(COURSES))
    shares = F.forall(s["mastery"], share) & F.forall(s["misconception"], share) & share(s["engagement"]) & share(s["fatigue"]) & share(s["assessment"])
    places = whole(s["position"], len(COURSES)) & whole(s["profile"], PROFILES) & whole(s["step"], MAX_STEPS + 1)
    return sizes & shares & places & s["completed"].isNotNull() & (~s["completed"] | (s["position"] == len(COURSES) - 1))


def _part(names: tuple[str, ...], i: Column) -> Column:
    return F.get(F.array(*map(F.lit, names)), i.cast("int"))


def _ascending(xs: Column) -> Column:
    """Whether a list is a set of actions in order."""
    return xs.isNotNull() & F.forall(xs, lambda x: x.isNotNull() & (x >= 0) & (x < ACTIONS)) & (xs == F.array_sort(F.array_distinct(xs)))


def _broken(t: Column) -> Column:
    """The first rule that a transition breaks, else null; what is null where it has to be known breaks the rule it is asked by."""
    s, n, a = t["state"], t["next_state"], t["action"]
    done = t["terminated"] | t["truncated"]
    advances = a["macro"] == MACROS[0]
    last = len(COURSES) - 1
    # An advance goes one course on; a review is aimed at this course or an earlier one, a remedy at this one.
    place = F.when(advances, F.least(s["position"] + 1, F.lit(last))).otherwise(s["position"])
    target = F.array_position(F.array(*map(F.lit, COURSES)), t["target_course"]) - 1
    aimed = F.when(a["macro"] == MACROS[1], (target >= 0) & (target <= s["position"])).otherwise(target == place)
    graduates = advances & (s["position"] == last)
    rules = {
        "state": _sound(s) & _sound(n),
        "action": (a["index"] >= 0) & (a["index"] < ACTIONS) & (a["macro"] == _part(MACROS, a["index"] / 9)) & (a["difficulty"] == _part(DIFFICULTIES, a["index"] % 9 / 3)) & (a["style"] == _part(STYLES, a["index"] % 3)),
        "flags": t["successful"].isNotNull() & ~(t["terminated"] & t["truncated"]) & (t["done"] == done),
        "step": (n["step"] == s["step"] + 1) & (n["profile"] == s["profile"]),
        "progress": (n["position"] == place) & (t["terminated"] == graduates) & (n["completed"] == t["terminated"]) & (t["truncated"] == ((n["step"] == MAX_STEPS) & ~t["terminated"])),
        "target": aimed,
        "masks": _ascending(t["valid_actions"]) & _ascending(t["next_valid_actions"]) & (~done | (F.size(t["next_valid_actions"]) == 0)),
        "reward": F.array_contains(t["valid_actions"], a["index"]) & ~F.isnan(t["reward"]) & (F.abs(t["reward"]) <= 1),
    }
    found = F.lit(None).cast("string")
    for name, holds in reversed(list(rules.items())):
        found = F.when(~F.coalesce(holds, F.lit(False)), name).otherwise(found)
    return found


def checked(trajectories: DataFrame) -> DataFrame:
    """The rows (TRAJECTORY) with problem: the first rule that each breaks, in the order of its transitions, else null.

    Of the whole: id (missing or given more than once), empty. Of each transition: state, action, flags, step, progress,
    target, masks, reward; then joined (its state isn't the next_state before), start (the first isn't at step 0), end
    (done isn't exactly the last one's). At last profile. Masks are checked as sets that hold the action, not against
    the environment. Only the count of ids is an exchange; the rest is in the row.
    """
    ids = trajectories.groupBy(F.col("trajectory_id").alias("id_")).agg(F.count("*").alias("times_"))
    again = ids.where("times_ > 1 or id_ is null")
    ts, size = F.col("transitions"), F.size("transitions")
    before = F.slice(F.concat(F.array(F.lit(None).cast(TRANSITION)), ts), 1, size)
    place = F.sequence(F.lit(0), size - 1)

    def of(t: Column, more: Column) -> Column:
        i, prior = more["i"], more["prior"]
        joined = (i == 0) | prior["next_state"].eqNullSafe(t["state"])
        ends = t["done"].eqNullSafe(i == size - 1)
        return F.coalesce(_broken(t), F.when(~joined, "joined"), F.when((i == 0) & ~t["state"]["step"].eqNullSafe(F.lit(0)), "start"), F.when(~ends, "end"))

    more = F.transform(F.arrays_zip(place.alias("i"), before.alias("prior")), lambda x: F.struct(x["i"].alias("i"), x["prior"].alias("prior")))
    problems = F.filter(F.zip_with(ts, more, of), lambda x: x.isNotNull())
    profile = ~F.col("profile").eqNullSafe(F.get(ts, F.lit(0))["state"]["profile"])
    rows = trajectories.join(again, F.col("trajectory_id").eqNullSafe(F.col("id_")), "left")
    empty = F.coalesce(size, F.lit(0)) < 1
    inside = F.when(~empty, F.coalesce(F.get(problems, F.lit(0)), F.when(profile, "profile")))
    return rows.withColumn("problem", F.coalesce(F.when(F.col("times_").isNotNull(), "id"), F.when(empty, "empty"), inside)).drop("id_", "times_")


def accepted(trajectories: DataFrame, path: str, manifest: dict[str, int] | None = None) -> DataFrame:
    """The rows without a problem, written below path; the others go to path/refused. One pass counts both.

    manifest (num_trajectories, num_transitions) has to agree with what was accepted, else the call fails and the rows stay
    where they are, to be looked at.
    """
    seen = Observation("trajectories")
    fine = F.col("problem").isNull()
    rows = checked(trajectories).observe(seen, F.count_if(fine).alias("num_trajectories"), F.coalesce(F.sum(F.when(fine, F.size("transitions"))), F.lit(0)).alias("num_transitions"))
    rows.withColumn("kind", F.when(fine, "accepted").otherwise("refused")).write.partitionBy("kind").parquet(path)
    if manifest is not None and {k: seen.get[k] for k in manifest} != manifest:
        raise ValueError(f"the manifest has {manifest}, the rows have {seen.get}")
    return trajectories.sparkSession.read.schema(rows.schema).parquet(f"{path}/kind=accepted").drop("problem")
