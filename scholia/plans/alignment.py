"""Queries of tokens and actions."""

from __future__ import annotations

import functools
import os
from collections.abc import Iterable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import alignment as A
from .registry import Tables, query

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@functools.cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def examples(turns: DataFrame, path: str, end: int) -> DataFrame:
    """conv_id, ids, labels, bodies and credits of conversations (conv_id, turn, role, text): each turn's ids, then end;
    those of the assistant are labelled. A conversation is one training example, and so one row."""
    own = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in A.parts(batches):
            out = []
            for conv, turns in zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist()):
                ids, labels, bodies = [], [], []
                for turn in turns:
                    body = tokenizer.encode(turn["text"], add_special_tokens=False).ids
                    ids += [*body, end, end]
                    taught = turn["role"] == "assistant"
                    labels += [*(body + [end] if taught else [A.UNLABELLED] * (len(body) + 1)), A.UNLABELLED]
                    bodies += [body] if taught else []
                out.append((conv, ids, labels, bodies, [None] * len(bodies)))
            kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32())), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)], ["conv_id", "ids", "labels", "bodies", "credits"])

    return own.mapInArrow(run, "conv_id long, ids array<int>, labels array<int>, bodies array<array<int>>, credits array<int>")


@query()
def seq_owners(t: Tables) -> DataFrame:
    """Tokens of each conversation that each of the assistant's turns owns (-1: none), or what is wrong with the conversation."""
    rows = examples(t.conversations, public_tokenizers.path("byte_bpe_50k.json"), 0)
    found = A.aligned(rows, "conv_id", {0})
    owned = found.select("conv_id", "problem", F.explode_outer("owners").alias("owner"))
    return owned.groupBy("conv_id", "problem", "owner").agg(F.count("*").alias("tokens"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber % 3 - 1 AS a, -CAST(l_discount AS DOUBLE) AS new, -CAST(l_tax AS DOUBLE) AS old, -(CAST(l_discount AS DOUBLE) + CAST(l_tax AS DOUBLE)) / 2 AS ref, (l_orderkey % 5 - 2 + l_linenumber % 3 - 1) / 2.0::DOUBLE AS adv FROM lineitem WHERE l_returnflag <> 'R' AND l_linenumber % 3 >= 1),
g AS (SELECT exp(sum(new - old)) AS r, any_value(adv) AS adv, sum(exp(ref - new) - (ref - new) - 1) AS kl FROM t GROUP BY l_orderkey, a), p AS (SELECT -least(r * adv, greatest(0.8::DOUBLE, least(1.28::DOUBLE, r)) * adv) AS policy, kl FROM g)
SELECT round(sum(policy + 0.04::DOUBLE * kl) / greatest(count(*), 1), 6) AS loss, round(avg(policy), 6) AS policy, round(avg(kl), 6) AS kl, count(*) AS actions FROM p""")
def seq_objective(t: Tables) -> DataFrame:
    """The clipped objective over all orders, as if each were a dialogue whose lines are tokens of two actions."""
    c, d = F.col, lambda name: F.col(name).cast("double")
    token = F.struct("l_linenumber", (-d("l_discount")).alias("logps"), (-d("l_tax")).alias("old_logps"), (-(d("l_discount") + d("l_tax")) / 2).alias("ref_logps"), ((c("l_orderkey") % 5 - 2 + c("l_linenumber") % 3 - 1) / 2).alias("advantages"), (c("l_linenumber") % 3 - 1).alias("actions"), (c("l_returnflag") != "R").alias("mask"))
    rows = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(token)).alias("x"))  # an order has a handful of lines
    rows = rows.select("l_orderkey", *[F.col(f"x.{name}").alias(name) for name in ("logps", "old_logps", "ref_logps", "advantages", "actions", "mask")])
    found = A.clipped_objective(rows, "l_orderkey")
    return found.select(*[F.round(name, 6).alias(name) for name in ("loss", "policy", "kl")], "actions")
