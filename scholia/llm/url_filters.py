"""URL filters: stated rules, and for the rest a tree of path templates of each host.

A host's tree has the segments of its paths, DEPTH levels deep; what lies below is one last wildcard. At each node the
segments are generalised into a wildcard, but for those that are few (FANOUT) or hold at least a FANOUTth of the node's
pages, so a node has at most FANOUT + 1 children and a host a bounded tree. Siblings whose shares (of pages that end
there, of allowed and blocked ones, of each child) differ by less than Hoeffding's bound, all the way down, become one branch, where the
bound says anything at all. A template is rejected if the smoothed share of blocked pages among its labelled ones is high enough.

Levels are counted by map-side aggregation over all pages, so a hot host is many small sums; the literal segments of a
level are looked up by a broadcast of counted size, or a join beyond it. Only templates, never pages, meet by host.
"""

from __future__ import annotations

import math
import string
from collections.abc import Sequence
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table, written

#: Levels of a tree, and how many children of a node are no wildcard's.
DEPTH, FANOUT = 4, 8
#: Error of Hoeffding's bound; the smoothed share of blocked pages that rejects a template.
ALPHA, REJECT = 0.05, 0.9
#: Rows of a level's literal segments, or of all templates, that are broadcast at most.
BROADCAST_NODES = 100_000
#: Stated rules at most: they become one column.
MOST_RULES = 500
WILD, REST = "*", "**"

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
_AFTER = r"(?s)\A.*?://"


def host_of(url: Column) -> Column:
    """What follows the first :// up to a slash, question mark or number sign, with A to Z made small; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, _AFTER + r"([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark or number sign; else empty."""
    return F.coalesce(F.regexp_extract(url, _AFTER + r"[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest of the rules (verdict, host, path) that fits, as a struct of rule and verdict; else null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    found = F.lit(None).cast("struct<rule string, verdict string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def templates(urls: DataFrame, host: str, path: str, name: str) -> DataFrame:
    """urls with each row's template: /, a literal segment or a wildcard, level by level."""
    at, segs, seg, n, fan, total = fresh(urls, "template_", "segments_", "segment_", "n_", "fan_", "total_")
    rows = written(urls.withColumn(segs, F.slice(F.split(path, "/"), 2, 2**31 - 1)), "url-segments")
    rows = rows.withColumn(at, F.lit(""))
    deepest = rows.agg(F.max(F.size(segs))).head()[0] or 0
    for level in range(min(DEPTH, deepest)):
        own = F.get(segs, F.lit(level))
        inside = F.size(segs) > level
        # Tables of their own, so that a node with very many children is split between tasks in the join.
        kids = written(rows.where(inside).groupBy(host, at, own.alias(seg)).agg(F.count("*").alias(n)), "url-children")
        nodes = written(kids.groupBy(host, at).agg(F.count("*").alias(fan), F.sum(n).alias(total)), "url-nodes")
        literal = kids.join(F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes, [host, at]).where((F.col(seg) != WILD) & ((F.col(fan) <= FANOUT) | (F.col(n) * FANOUT >= F.col(total))))
        literal = written(literal.select(F.col(host).alias(host + "_of"), F.col(at).alias(at + "_of"), seg), "url-literals")
        few = literal.count() <= BROADCAST_NODES
        same = inside & (F.col(host) == F.col(host + "_of")) & (F.col(at) == F.col(at + "_of")) & (own == F.col(seg))
        rows = rows.join(F.broadcast(literal) if few else literal, same, "left")
        rows = rows.withColumn(at, F.when(inside, F.concat(at, F.lit("/"), F.coalesce(seg, F.lit(WILD)))).otherwise(F.col(at))).select(*urls.columns, segs, at)
    below = F.when(F.size(segs) > DEPTH, F.concat(at, F.lit("/" + REST))).otherwise(F.col(at))
    return rows.select(*urls.columns, below.alias(name))


class Branch:
    """A node of a host's tree: pages below it (all, allowed, blocked), those that end here, and its children."""

    def __init__(self) -> None:
        self.counts, self.ended = [0, 0, 0], [0, 0, 0]
        self.kids: dict[str, Branch] = {}
        self.leaves: list[str] = []

    def put(self, template: str, counts: Sequence[int]) -> None:
        node = self
        node.counts = [a + b for a, b in zip(node.counts, counts)]
        for seg in template.split("/")[1:]:
            node = node.kids.setdefault(seg, Branch())
            node.counts = [a + b for a, b in zip(node.counts, counts)]
        node.ended = [a + b for a, b in zip(node.ended, counts)]
        node.leaves.append(template)

    def like(self, other: "Branch") -> bool:
        """Whether no share here differs from the other's by Hoeffding's bound, nor below."""
        n, m = self.counts[0], other.counts[0]
        bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (n**-0.5 + m**-0.5)
        if bound >= 1:
            return False
        names = self.kids.keys() | other.kids.keys()
        held = lambda b: [b.ended[0], *b.counts[1:], *(b.kids[k].counts[0] if k in b.kids else 0 for k in sorted(names))]
        if any(abs(x / n - y / m) >= bound for x, y in zip(held(self), held(other))):
            return False
        return all(_near(self.kids[k], other.kids[k]) for k in self.kids.keys() & other.kids.keys())

    def fold(self, other: "Branch") -> None:
        self.counts = [a + b for a, b in zip(self.counts, other.counts)]
        self.ended = [a + b for a, b in zip(self.ended, other.ended)]
        self.leaves += other.leaves
        for name, kid in other.kids.items():
            if name in self.kids:
                self.kids[name].fold(kid)
            else:
                self.kids[name] = kid

    def merged(self) -> None:
        """Join similar children, the largest first, then theirs."""
        kinds: list[tuple[list[str], Branch]] = []
        for name, kid in sorted(self.kids.items(), key=lambda x: (-x[1].counts[0], x[0])):
            home = next((k for k in kinds if k[1].like(kid)), None)
            if home:
                home[0].append(name)
                home[1].fold(kid)
            else:
                kinds.append(([name], kid))
        self.kids = {(names[0] if len(names) == 1 else "{" + ",".join(sorted(names)) + "}"): kid for names, kid in kinds}
        for kid in self.kids.values():
            kid.merged()

    def listed(self, name: str = "") -> list[tuple]:
        own = [(leaf, name, *self.ended) for leaf in self.leaves]
        return own + list(chain.from_iterable(kid.listed(f"{name}/{seg}") for seg, kid in self.kids.items()))


def _near(a: Branch, b: Branch) -> bool:
    """like, where a small branch below a similar parent says nothing against it."""
    return math.sqrt(0.5 * math.log(2 / ALPHA)) * (a.counts[0] ** -0.5 + b.counts[0] ** -0.5) >= 1 or a.like(b)


def judged(urls: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """urls (with a column url) with host, path, rule, verdict, template and purity; their names get underscores where they clash.

    Labels are the pages that rules judge. The smoothed purity of a template is (blocked + 1) / (labelled + 2), so one
    without labels has 0.5 and is allowed. A null url, and one without ://, has an empty host and path and is of the
    template of those. No rows give no rows; repeated rows count each.
    """
    host, path, rule, verdict, template, purity, found = fresh(urls, "host", "path", "rule", "verdict", "template", "purity", "found_")
    rows = urls.withColumn(host, host_of(F.col("url"))).withColumn(path, path_of(F.col("url"))).withColumn(found, ruled(F.col(host), F.col(path), rules))
    rows = templates(rows, host, path, template)
    is_ = lambda v: F.count_if(F.col(found)["verdict"] == v)
    counts = rows.groupBy(F.col(host).alias("host"), F.col(template).alias("template")).agg(F.count("*").alias("n"), is_("allow").alias("allowed"), is_("block").alias("blocked"))

    def merge(own: pd.DataFrame) -> pd.DataFrame:
        root = Branch()
        for t, *counts in own.sort_values("template")[["template", "n", "allowed", "blocked"]].itertuples(index=False, name=None):
            root.put(t, counts)
        root.merged()
        out = pd.DataFrame(root.listed(), columns=["template_of", "branch", "n", "allowed", "blocked"])
        out.insert(0, "host_of", own["host"].iloc[0])
        return out

    branches = counts.groupBy("host").applyInPandas(merge, "host_of string, template_of string, branch string, n long, allowed long, blocked long")
    branches = written(branches.select("host_of", "template_of", "branch", ((F.col("blocked") + 1) / (F.col("allowed") + F.col("blocked") + 2)).alias("share")), "url-branches")
    few = branches.count() <= BROADCAST_NODES
    joined = rows.join(F.broadcast(branches) if few else branches, (F.col(host) == F.col("host_of")) & (F.col(template) == F.col("template_of")), "left")
    learnt = F.when(F.col("share") >= REJECT, "block").otherwise("allow")
    return joined.select(*urls.columns, host, path, F.col(found)["rule"].alias(rule), F.coalesce(F.col(found)["verdict"], learnt).alias(verdict), F.col("branch").alias(template), F.col("share").alias(purity))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return judged(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).drop("url")
