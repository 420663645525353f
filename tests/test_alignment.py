"""Owners of tokens against a search by brute force, and the objective's errors."""

import math
import random

import pandas as pd
import public_tokenizers
import pytest

from scholia.operators import alignment as A
from scholia.plans import registry

SF = "/root/testdata/sf0.001"


def plain_owners(ids, labels, bodies, harmless):
    runs, now = [], []
    for i, x in enumerate([*labels, A.UNLABELLED]):
        if x != A.UNLABELLED:
            now.append(i)
        elif now:
            runs.append(now)
            now = []
    if len(runs) != len(bodies):
        return None
    out = [-1] * len(ids)
    for k, (run, body) in enumerate(zip(runs, bodies)):
        own = [ids[i] for i in run]
        fits = [i for i in range(len(own) - len(body) + 1) if own[i : i + len(body)] == body and set(own[:i] + own[i + len(body) :]) <= harmless]
        if not body or len(fits) != 1:
            return None
        for i in run:
            out[i] = k
    return out


def test_owners_against_brute_force():
    rng = random.Random(1)
    some = 0
    for _ in range(16_000):
        ids = [rng.choice([0, 1, 2, 3]) for _ in range(rng.randint(0, 8))]
        labels = [x if rng.random() < 0.7 else A.UNLABELLED for x in ids]
        bodies = [[rng.choice([0, 1, 2, 3]) for _ in range(rng.randint(0, 3))] for _ in range(rng.randint(0, 2))]
        found, problem = A.action_owners(ids, labels, bodies, [None] * len(bodies), {0, 3})
        assert found == plain_owners(ids, labels, bodies, {0, 3}) and (found is None) == (problem is not None)
        some += found is not None and len(bodies) > 0
    assert some > 50


def test_what_is_wrong(spark):
    rows = [(1, [5, 0], [5, 0], [[5]], [None]), (2, [5], [5, 0], [[5]], [None]), (3, [5], [6], [[5]], [None]), (4, [5], [5], [], []), (5, [5, 5], [5, 5], [[5]], [None]), (6, [0, 0], [0, 0], [[0]], [None]), (7, [5], [5], [[5]], [3]), (8, [5, 9, 6], [5, -100, 6], [[5], [6]], [1, 1]), (9, None, None, None, None)]
    df = spark.createDataFrame(rows, "conv long, ids array<int>, labels array<int>, bodies array<array<int>>, credits array<int>")
    found = {r.conv: r.owners or r.problem for r in A.aligned(df, "conv", {0}).collect()}
    assert found == {1: [0, 0], 2: "lengths differ", 3: "a label isn't its token", 4: "runs and actions differ in number", 5: "action 0 isn't in its run alone", 6: "action 0 is in its run more than once", 7: "action 0 has no such owner", 8: [1, -1, 1], 9: None}


def test_owners_of_conversations(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    turns = pd.read_parquet(f"{SF}/conversations.parquet").sort_values(["conv_id", "turn"])
    wanted = {}
    for conv, own in turns.groupby("conv_id"):
        k = 0
        for role, text in zip(own["role"], own["text"]):
            n = len(tokenizer.encode(text, add_special_tokens=False).ids)
            taught = role == "assistant"
            wanted[conv, -1] = wanted.get((conv, -1), 0) + (1 if taught else n + 2)
            if taught:
                wanted[conv, k] = n + 1
                k += 1
    rows = registry.QUERIES["seq_owners"](spark, SF).collect()
    assert {r.problem for r in rows} == {None} and {(r.conv_id, r.owner): r.tokens for r in rows} == wanted


def test_objective(spark):
    schema = "k int, logps array<double>, old_logps array<double>, ref_logps array<double>, advantages array<double>, actions array<int>, mask array<boolean>"
    rows = [(1, [-1.0, -2.0, -3.0, -9.0], [-1.5, -2.0, -2.0, 0.0], [-1.0, -1.0, -3.0, 0.0], [2.0, 2.0, -1.0, 7.0], [0, 0, 1, 1], [True, True, True, False]), (2, [-1.0], [0.0], [0.0], [3.0], [-1], [True]), (3, [], [], [], [], [], [])]
    got = A.clipped_objective(spark.createDataFrame(rows, schema), "k", 0.2, 0.28, 0.1).first()
    policy = [-min(math.exp(0.5) * 2, 1.28 * 2), -min(-math.exp(-1), -0.8)]
    kl = [math.exp(1) - 2, 0.0]
    assert got.actions == 2 and got.policy == pytest.approx(sum(policy) / 2) and got.kl == pytest.approx(sum(kl) / 2) and got.loss == pytest.approx((sum(policy) + 0.1 * sum(kl)) / 2)
    assert tuple(A.clipped_objective(spark.createDataFrame([], schema), "k").first()) == (0.0, 0.0, 0.0, 0)
    for bad in ((1, [0.0, 0.0], [0.0, 0.0], [0.0, 0.0], [1.0, 2.0], [0, 0], [True, True]), (1, [0.0], [], [], [], [], []), (1, [1000.0], [0.0], [0.0], [-1.0], [0], [True])):
        with pytest.raises(Exception):
            A.clipped_objective(spark.createDataFrame([bad], schema), "k").collect()
