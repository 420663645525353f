"""Relational operators: optional predicates, data scopes, trees, paging, merges and deterministic samples."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chance
from ..shared import written


def fresh(df: DataFrame, name: str) -> str:
    """name, with as many underscores after it as make it no column of df."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


class Where:
    """Predicates that hold only where their parameter is there: a null, empty or blank one adds nothing."""

    def __init__(self) -> None:
        self.found: list[Column] = []

    def _add(self, present: bool, make) -> "Where":
        if present:
            self.found.append(make())
        return self

    def eq(self, c: str, x: Any) -> "Where":
        return self._add(x is not None and x != "", lambda: F.col(c) == x)

    def ne(self, c: str, x: Any) -> "Where":
        return self._add(x is not None, lambda: F.col(c) != x)

    def like(self, c: str, x: str | None) -> "Where":
        return self._add(bool(x and x.strip()), lambda: F.lower(F.col(c)).like(f"%{x.lower()}%"))

    def isin(self, c: str, xs: Iterable[Any] | None) -> "Where":
        xs = list(xs or [])
        return self._add(bool(xs), lambda: F.col(c).isin(xs))

    def between(self, c: str, low: Any, high: Any) -> "Where":
        self._add(low is not None, lambda: F.col(c) >= F.lit(low))
        return self._add(high is not None, lambda: F.col(c) <= F.lit(high))

    def days(self, c: str, first: str | None, last: str | None) -> "Where":
        """Whole days, written so that the scan can use it."""
        self._add(bool(first), lambda: F.col(c) >= F.lit(first).cast("timestamp_ntz"))
        return self._add(bool(last), lambda: F.col(c) < F.date_add(F.to_date(F.lit(last)), 1).cast("timestamp_ntz"))

    def __call__(self, df: DataFrame) -> DataFrame:
        for p in self.found:
            df = df.where(p)
        return df


def data_scope(roles: Sequence[dict], user_id: int, dept_id: int, dept: str, ancestors: str, owner: str) -> Column:
    """The OR of the roles' scopes: 1 all, 2 listed departments, 3 own, 4 own and below, 5 own rows; none denies all."""
    if any(r["scope"] == 1 for r in roles):
        return F.lit(True)
    found = F.lit(False)
    for scope in sorted({r["scope"] for r in roles}):
        if scope == 2:
            found = found | F.col(dept).isin([d for r in roles if r["scope"] == 2 for d in r["depts"]])
        elif scope == 3:
            found = found | (F.col(dept) == dept_id)
        elif scope == 4:
            found = found | (F.col(dept) == dept_id) | (F.find_in_set(F.lit(str(dept_id)), F.col(ancestors)) > 0)
        elif scope == 5:
            found = found | (F.col(owner) == user_id)
    return found


def order_columns(df: DataFrame, text: str) -> list[Column]:
    """Columns of an order-by text: names of df, camel case allowed, with asc or desc; anything else is an error."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        m = re.fullmatch(r"(\w+)(?:\s+(asc|desc|ascending|descending))?", part, re.I)
        name = m and re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", m[1]).lower()
        if not m or name not in df.columns:
            raise ValueError(f"not an order: {part}")
        out.append(F.col(name).desc() if (m[2] or "").lower().startswith("desc") else F.col(name).asc())
    return out


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int | None = None, total: int | None = None) -> DataFrame:
    """One page by a total order; size from 1 to 100 (20 if null), number from 1, to the last page if total is given."""
    size = 20 if size is None else max(1, min(100, size))
    number = max(1, number)
    if total is not None:
        number = min(number, max(1, -(-total // size)))
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """df with each row's place in its group, from 1, by a total order; a group may hold any share of the rows.

    Rows are dealt by ranges of group and order, so a large group lies in many tasks; counts of its ranges, one row a
    task and group, give where each starts.
    """
    part, n, base = fresh(df, "range_part"), fresh(df, "range_rows"), fresh(df, "range_base")
    keys = [F.col(c) for c in (*group, *order)]
    ranged = written(df.repartitionByRange(*keys).withColumn(part, F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(*group, part).agg(F.count("*").alias(n))
    before = F.coalesce(F.sum(n).over(Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sides = {c: fresh(ranged, f"range_{i}_of") for i, c in enumerate((*group, part))}
    counts = counts.withColumn(base, before).drop(n).withColumnsRenamed(sides)
    same = F.col(part) == F.col(sides[part])
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(sides[g]))
    at = fresh(ranged, "range_place")
    place = F.row_number().over(Window.partitionBy(*group, part).orderBy(*order))
    return ranged.withColumn(at, place).join(counts, same).select(*df.columns, (F.col(base) + F.col(at)).alias(name))


def keep_first(df: DataFrame, key: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each key: one exchange by the key, no row sent twice."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    own = fresh(df, "place")
    return df.withColumn(own, n).where(F.col(own) == 1).drop(own)


def last_wins(df: DataFrame, key: str, pos: str) -> DataFrame:
    """The last row of each key in the place of its first: aggregates only, so a hot key is merged before the exchange."""
    rest = [c for c in df.columns if c not in (key, pos)]
    packed = F.struct(F.col(pos), *rest)
    first, row = fresh(df, "first_place"), fresh(df, "last_row")
    return df.groupBy(key).agg(F.min(pos).alias(first), F.max_by(packed, F.col(pos)).alias(row)).select(key, F.col(first).alias(pos), *[F.col(row)[c].alias(c) for c in rest])


def last_wins_numbered(df: DataFrame, key: str, pos: str) -> DataFrame:
    """last_wins of rows in order of pos (a number from 0 on without gaps), blank keys first numbered `q-000001`.

    A blank key's number is one more than the keys that are there before it; where that is another row's own key, the
    later one wins. First rows of keys are found by aggregates; numbers are running sums within ranges of pos, after
    the sums of the ranges before, so no task holds more than a range.
    """
    given = F.trim(F.coalesce(F.col(key), F.lit("")))
    own, first, count, part, base, side = (fresh(df, c) for c in ("given_key", "first_of_key", "new_key", "range_part", "range_base", "range_of"))
    rows = df.withColumn(own, F.when(given != "", given))
    firsts = rows.where(F.col(own).isNotNull()).groupBy(F.col(own).alias(side)).agg(F.min(pos).alias(first))
    # A row adds a key if it is blank or the first of its key.
    rows = rows.join(firsts, F.col(own) == F.col(side), "left").withColumn(count, (F.col(own).isNull() | (F.col(pos) == F.col(first))).cast("int")).drop(side, first)
    rows = written(rows.repartitionByRange(pos).withColumn(part, F.spark_partition_id()), "numbered-keys")
    sums = rows.groupBy(part).agg(F.sum(count).alias(base))
    earlier = F.coalesce(F.sum(base).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col(part).alias(side), earlier.alias(base))  # one row a task
    inside = F.coalesce(F.sum(count).over(Window.partitionBy(part).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn(first, inside).join(F.broadcast(sums), F.col(part) == F.col(side))
    number = F.col(base) + F.col(first) + 1
    rows = rows.withColumn(key, F.coalesce(own, F.concat(F.lit("q-"), F.lpad(number.cast("string"), 6, "0")))).select(*df.columns)
    return last_wins(rows, key, pos)


def capped(df: DataFrame, group: Sequence[str], key: str, most: int, seed: int) -> DataFrame:
    """At most so many rows of each group, drawn by the digest of seed and key."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(chance(seed, F.col(key)), key))
    own = fresh(df, "place")
    return df.withColumn(own, n).where(F.col(own) <= most).drop(own)


def priority_sample(df: DataFrame, first: Column, key: str, total: int, seed: int) -> DataFrame:
    """total rows: those where first holds before all others, each drawn by digest; a top-k, not a full sort."""
    return df.orderBy(F.when(first, 0).otherwise(1), chance(seed, F.col(key)), key).limit(total)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new over old by key; a null in new keeps what old has."""
    rest = [c for c in old.columns if c != key]
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    return joined.select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in rest])


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of new's keys replaced by new's rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def depths(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """node, depth and path of a forest of any depth; roots are nodes whose parent isn't a node, all if there is none.

    Each node points at an ancestor, its parent at first, and then at that one's: pointers double, so rounds (a join and
    a table in the shared folder each) grow with the logarithm of the depth. Every round brings some node to its root,
    as long as there is one that has a root; nodes that hang on a circle have none and are left out, unless all do.
    """
    nodes = nodes.select(F.col(node).alias("node"), F.col(parent).alias("parent"))
    known = nodes.select(F.col("node").alias("p")).distinct()
    root = F.col("node").cast("string").alias("path")
    closed = written(nodes.join(known, F.col("parent") == F.col("p"), "left_anti").select("node", F.lit(0).alias("depth"), root), "tree")
    if closed.isEmpty():
        return nodes.select("node", F.lit(0).alias("depth"), root)
    open_ = written(nodes.join(known, F.col("parent") == F.col("p"), "left_semi").select("node", F.col("parent").alias("up"), F.lit(1).alias("depth"), root), "tree")
    while not open_.isEmpty():
        ahead = open_.unionByName(closed, allowMissingColumns=True).select(F.col("node").alias("at"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("path").alias("head"))
        moved = open_.join(ahead, F.col("up") == F.col("at")).select("node", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.concat_ws(",", "head", "path").alias("path"))
        moved = written(moved, "tree")
        done = moved.where("up is null").drop("up")
        if done.isEmpty():
            break
        closed, open_ = closed.unionByName(done), moved.where("up is not null")
    return closed


def not_in(df: DataFrame, key: str, values: DataFrame) -> DataFrame:
    """Rows whose key is not among values (one column), as NOT IN has it: a null among values keeps no row, a null key
    stays only where there are no values at all. An anti join by key, after two looks at values."""
    name = values.columns[0]
    if values.isEmpty():
        return df
    if not values.where(F.col(name).isNull()).isEmpty():
        return df.limit(0)
    return df.where(F.col(key).isNotNull()).join(values, F.col(key) == values[name], "left_anti")


def reparented(path: Column, old: str, new: str) -> Column:
    """path with its leading old replaced by new."""
    return F.when((path == old) | path.startswith(old + ","), F.concat(F.lit(new), F.right(path, F.length(path) - len(old)))).otherwise(path)


def inserted(old: DataFrame, new: Sequence[DataFrame]) -> DataFrame:
    """old with the rows of new after it, by column name; columns that new lacks are null, others are an error."""
    for rows in new:
        extra = set(rows.columns) - set(old.columns)
        if extra:
            raise ValueError(f"no such columns: {sorted(extra)}")
        old = old.unionByName(rows, allowMissingColumns=True)
    return old


def replayed(rows: DataFrame, key: str, weight: str, offline: str, batch: int, beta: float, share: float, seed: int) -> DataFrame:
    """place, key and importance weight of a batch drawn with replacement by weight.

    Where both kinds (offline or not) are there, share of the batch is offline, at least one of each. A place's draw is
    the row whose stretch of its kind's running sum holds the digest's unit. Sums run over blocks of rows first, so no
    task holds a kind. weights are (N * p) ** -beta over their largest.
    """
    kinds = {r[0]: (r[1], r[2]) for r in rows.groupBy(offline).agg(F.sum(weight), F.count("*")).collect()}
    old = batch if set(kinds) == {True} else 0 if set(kinds) == {False} else min(batch - 1, max(1, round(batch * share)))
    units = [(i, i < old, (int(hashlib.md5(f"{seed}-{i}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32) for i in range(batch)]
    draws = rows.sparkSession.createDataFrame([(i, o, u * kinds[o][0]) for i, o, u in units if o in kinds], "place int, o boolean, x double")
    rows = rows.select(F.col(key).alias("own_key"), F.col(weight).alias("own_weight"), F.col(offline).alias("own_kind"))  # no column's name matters from here on
    name, key, weight, offline = key, "own_key", "own_weight", "own_kind"
    # The running sum in order of key: within key ranges, after the sums of the ranges before.
    ranged = written(rows.select(key, weight, offline).repartitionByRange(key).withColumn("part", F.spark_partition_id()), "replay-rows")
    own = F.sum(weight).over(Window.partitionBy("part", offline).orderBy(key))
    sums = ranged.groupBy("part", offline).agg(F.sum(weight).alias("s"))
    base = F.coalesce(F.sum("s").over(Window.partitionBy(offline).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sums = sums.select(F.col("part"), F.col(offline).alias("o"), base.alias("base"))  # one row a task and kind
    upto = ranged.withColumn("own", own).join(F.broadcast(sums), (ranged["part"] == sums["part"]) & (ranged[offline] == sums["o"])).select(key, weight, offline, (F.col("base") + F.col("own")).alias("upto"))
    hits = upto.join(F.broadcast(draws), (F.col(offline) == F.col("o")) & (F.col("x") <= F.col("upto")) & (F.col("x") > F.col("upto") - F.col(weight)))
    n = sum(c for _, c in kinds.values())
    total = F.lit(None).cast("double")
    for kind, (s, _) in kinds.items():
        part = (old if kind else batch - old) / batch
        total = F.when(F.col(offline) == kind, F.lit(part) * F.col(weight) / s).otherwise(total)
    raw = hits.select("place", F.col(key).alias(name), F.pow(n * total, F.lit(-beta)).alias("raw"))
    return raw.select("place", name, F.round(F.col("raw") / F.max("raw").over(Window.partitionBy()), 6).alias("weight"))  # batch rows


def advantages(steps: DataFrame, totals: DataFrame, group: str, record: str, place: str, credit: str, anchor: str, suffix: str, total: str, mix: float, eps: float = 1e-6) -> DataFrame:
    """group, record, place and mixed: mix of the record's standard score in its group, the rest of the step's.

    A step's own score is that of its suffix return among the group's steps of its anchor that own their credit; another
    step has the score of the place that its credit names (0 where that owns none). Means and deviations are aggregates,
    merged before their exchange.
    """
    score = lambda x, m, s: (F.col(x) - F.col(m)) / (F.col(s) + eps)
    spread = totals.groupBy(group).agg(F.avg(total).alias("m"), F.stddev_pop(total).alias("s"))
    seq = totals.join(spread, group).select(group, record, score(total, "m", "s").alias("seq"))
    owners = steps.where(F.col(credit) == F.col(place)).select(group, record, F.col(place).alias(credit), anchor, suffix)
    spread = owners.groupBy(group, anchor).agg(F.avg(suffix).alias("m"), F.stddev_pop(suffix).alias("s"))
    act = owners.join(spread, [group, anchor]).select(group, record, credit, score(suffix, "m", "s").alias("act"))
    rows = steps.select(group, record, place, credit).join(seq, [group, record]).join(act, [group, record, credit], "left")
    return rows.select(group, record, place, (mix * F.col("seq") + (1 - mix) * F.coalesce("act", F.lit(0.0))).alias("mixed"))
