"""The classifier, neighbours, mixing, sharding and the pipeline."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scholia.llm import mixing, neighbours, quality, sharding
from scholia.llm.registry import QUERIES

from .conftest import SCHEMA, SF, texts_of

LABELS = "doc_id long, quality int, toxic int, text string"


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text))


def test_quality_on_held_out_rows(spark):
    rows = QUERIES["op2_quality"](spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet").set_index("doc_id")["quality"]
    assert rows["score"].between(0, 1).all() and len(rows) == 1000
    assert (rows["predicted"] == (rows["score"] >= 0.3)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in rows["held_out"].items())
    held = rows[rows["held_out"]].join(labels, how="inner")
    assert (held["predicted"] == held["quality"]).mean() > 0.97


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0, None), (3, 0, 0, None), (4, 0, 0, None), (4, 1, 0, None), (7, 1, None, None), (None, 1, 0, None), (6, None, 0, None), (99, 1, 0, None), (10, 0, 0, None)], LABELS)
    none = spark.createDataFrame([], LABELS)
    for known in (labels, none, labels.where("quality = 1")):
        rows = quality.quality_scores(odd_docs, known).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
        assert quality.quality_scores(no_docs, known).count() == 0
    assert {r.score for r in quality.quality_scores(odd_docs, none).collect()} == {0.5}
    kept = quality.accepted(odd_docs, none)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert quality.accepted(no_docs, labels).count() == 0


def test_isotonic():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 40, 400):
        for _ in range(20):
            x = rng.normal(size=n).round(2)
            y = (x + rng.normal(size=n) > 0).astype(float)
            knots, values = quality.pool_adjacent(x, y)
            assert (np.diff(knots) >= 0).all() and (np.diff(values) >= 0).all() and 0 <= values.min() <= values.max() <= 1
            assert (np.diff(np.interp(np.linspace(-4, 4, 99), knots, values)) >= 0).all()


def test_normal_equations_of_partitions_are_those_of_all_rows(spark):
    """Weights from partition sums against a solution over all learnt rows at once."""
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    stats = quality.statistics_table(docs)
    model = quality.fit(stats, quality._labels(labels))
    known = labels.toPandas().set_index("doc_id")["quality"]
    held = {r.doc_id for r in labels.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(quality.SEED + 1)), F.lit(5)).alias("k")).collect() if r.k == 0}
    learnt = [(r.stats, known[r.doc_id]) for r in stats.collect() if r.doc_id in known.index and zlib.crc32(str(r.doc_id).encode()) % 5]
    fitted = [(r.stats, known[r.doc_id]) for r in stats.collect() if r.doc_id in known.index and zlib.crc32(str(r.doc_id).encode()) % 5 and r.doc_id not in held]
    z, y = model.features(np.array([x for x, _ in fitted])), np.array([y for _, y in fitted], float)
    want = np.linalg.solve(z.T @ z + quality.RIDGE * len(learnt) / z.shape[1] * np.eye(z.shape[1]), z.T @ y)
    assert np.allclose(model.weights, want, atol=1e-6)


def brute_nearest(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = {}
    for q, x in good:
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((y - x) ** 2).sum())), i) for i, y in good if i != q)
            out[q] = near[:k]
    return out


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (100, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (200, [0.0, 0.0]), (8, [-3.0, 4.0])]
    df = spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")
    want = brute_nearest(rows, 10)
    found = collections.defaultdict(list)
    for r in neighbours.nearest(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.score, r.vec_id))
    assert {q: [i for _, i in x] for q, x in found.items()} == {q: [i for _, i in x] for q, x in want.items()}
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_neighbours_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    want = brute_nearest(rows, 10)
    found = QUERIES["op4_neighbours"](spark, "/root/testdata/sf0.1").toPandas()
    assert (found.groupby("query_id").size() == 10).all() and set(found["query_id"]) == set(want)
    hits = sum(len(set(found[found["query_id"] == q]["vec_id"]) & {i for _, i in x}) for q, x in want.items())
    assert hits / (10 * len(want)) >= 0.9


def test_exact_search(spark, monkeypatch):
    """Without probes every vector is compared: blocks of queries, batches of vectors."""
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    vectors = spark.createDataFrame([(np.array(v, "<f8").tobytes(), [i], [0] * 12) for i, v in rows], "vector binary, ids array<long>, codes array<long>")
    queries = vectors.select(F.col("ids")[0].alias("q"), F.col("ids")[0].alias("query_id"), "vector").where("query_id % 100 = 0")
    for block, batch in ((1024, 2048), (2, 7)):
        monkeypatch.setattr(neighbours, "BLOCK", block)
        monkeypatch.setattr(neighbours, "BATCH", batch)
        found = neighbours.in_blocks(queries, vectors, 10).toPandas()
        for q, near in brute_nearest(rows, 10).items():
            own = found[found["query_id"] == q].sort_values("rank")
            assert own["vec_id"].tolist() == [i for _, i in near] and own["score"].tolist() == pytest.approx([d for d, _ in near], abs=1e-12)


@pytest.mark.parametrize(("sizes", "weights", "out"), [([10, 10], [1, 1], [10, 10]), ([10, 90], [1, 1], [30, 70]), ([1, 1, 98], [1, 1, 1], [3, 3, 94]), ([0, 10], [1, 1], [0, 10]), ([], [], [])])
def test_targets(sizes, weights, out):
    assert mixing.targets_of(sizes, weights, 3) == pytest.approx(out)


def test_duels_keep_words_and_chances():
    rng = random.Random(1)
    words = [rng.randrange(1, 400) for _ in range(60)]
    counts = np.zeros(60)
    for seed in range(1500):
        found = mixing.duels(list(range(60)), words, [0.3] * 60, seed)
        assert sum(map(mixing.open_, found)) <= 1
        assert sum(f * w for f, w in zip(found, words)) == pytest.approx(0.3 * sum(words))
        counts += found
    assert abs(counts / 1500 - 0.3).max() < 0.06
    mixed = [rng.random() for _ in range(60)]
    found = mixing.duels(list(range(60)), words, mixed, 3)
    assert sum(map(mixing.open_, found)) <= 1 and sum(f * w for f, w in zip(found, words)) == pytest.approx(sum(f * w for f, w in zip(mixed, words)))


def test_mix_of_twins(spark, monkeypatch):
    """One row a thousand times over: its copies are dealt to many nodes, and the sums still meet the targets."""
    monkeypatch.setattr(mixing, "BLOCK", 16)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    rows = [(7, "a b c d", None, "s1", 1, *[None] * 9)] * 1000 + [(100 + i, "w " * (i % 9), None, f"s{i % 3}", 1, *[None] * 9) for i in range(500)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    first = mixing.mixed(docs).toPandas()
    assert len(first) == 1500
    sums = first.assign(taken=first["copies"] * first["size"]).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), largest=("size", "max"))
    assert (abs(sums["taken"] - sums["target"]) <= sums["largest"]).all()
    want, got = collections.Counter(), collections.Counter(r.doc_id for r in mixing.mix_documents(docs).collect())
    for r in first.itertuples():
        want[r.doc_id] += r.copies
    assert got == +want


def test_mix_against_plain_rounding(spark):
    """One block a source: the tables' outcome is that of a plain loop over all documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.source, size_of(r.text or ""), k.key) for r, k in zip(docs.collect(), docs.select(F.xxhash64("doc_id", "source", "text").alias("key")).collect())]
    names = sorted({r[1] for r in rows}, key=lambda x: (x is None, x or ""))
    sums = [sum(r[2] for r in rows if r[1] == x) for x in names]
    left, shares, open_ = sum(sums), {}, set(range(len(names)))
    while open_:
        per = left / sum(i % 3 + 1 for i in open_)
        full = [i for i in open_ if per * (i % 3 + 1) > 3 * sums[i]]
        shares |= {i: 3 * sums[i] if full else per * (i % 3 + 1) for i in full or open_}
        left -= sum(shares[i] for i in full)
        open_ -= set(full or open_)
    found = {r.doc_id: r for r in QUERIES["op5_mixing"](spark, SF).collect()}
    for i, name in enumerate(names):
        own = [r for r in rows if r[1] == name]
        rate = shares[i] / sums[i]
        taken = sum(found[r[0]].taken for r in own)
        assert all(found[r[0]].target == pytest.approx(shares[i]) and found[r[0]].source_size == sums[i] for r in own)
        assert all(found[r[0]].taken in (int(rate) * r[2], (int(rate) + 1) * r[2]) for r in own)
        assert abs(taken - shares[i]) <= max(r[2] for r in own)


def test_mix(spark, odd_docs, no_docs, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for block in (4096, 16):
        monkeypatch.setattr(mixing, "BLOCK", block)
        monkeypatch.setattr(mixing, "FAN_IN", 4)
        first = mixing.mixed(docs).toPandas()
        again = mixing.mixed(docs.repartition(5)).toPandas()
        order = lambda x: x.sort_values("doc_id").reset_index(drop=True)
        pd.testing.assert_frame_equal(order(first), order(again))
        assert first["copies"].between(0, 3).all()
        sums = first.assign(taken=first["copies"] * first["size"]).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), largest=("size", "max"))
        assert (abs(sums["taken"] - sums["target"]) <= sums["largest"]).all()
    assert mixing.mixed(no_docs).count() == 0 and mixing.mix_documents(no_docs).count() == 0
    rows = mixing.mixed(odd_docs).toPandas()
    assert len(rows) == odd_docs.count() and rows["copies"].between(0, 3).all()
    taken = mixing.mix_documents(odd_docs)
    assert taken.columns == odd_docs.columns and taken.count() == rows["copies"].sum()


def test_mix_meets_targets_and_keeps_means():
    """Over seeds: each source's words come within 3 % of its target in the mean (12 % at worst: a document's chance stays its
    rate, so one larger than all that its source takes besides can't be made good), and mean copies are the rate."""
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    docs["size"] = [size_of(x) for x in docs["text"]]
    sources = sorted(docs["source"].unique())
    shares = mixing.targets_of([int(docs.loc[docs["source"] == x, "size"].sum()) for x in sources], [i % 3 + 1 for i in range(len(sources))], 3)
    for source, share in zip(sources, shares):
        words = docs.loc[docs["source"] == source, "size"].tolist()
        rate = share / sum(words)
        f, sums, misses = rate - int(rate), np.zeros(len(words)), []
        for seed in range(200):
            found = mixing.duels(range(len(words)), words, [f] * len(words), seed)
            ends = [i for i, x in enumerate(found) if mixing.open_(x)]
            assert len(ends) <= 1 and abs(sum(x * w for x, w in zip(found, words)) - f * sum(words)) < 1e-6
            if seed < 20:
                taken = sum((int(rate) + round(0 if i in ends else x)) * w for i, (x, w) in enumerate(zip(found, words)))
                misses.append(abs(taken - share) / share)
            sums += np.array(found)
        assert np.mean(misses) <= 0.03 and max(misses) <= 0.12, (source, misses)
        held = np.array(words) > 0
        assert (abs(sums[held] / 200 - f) <= 5 * math.sqrt(f * (1 - f) / 200)).all()  # each is a coin of chance f, 200 times


def plain_duels(keys, words, fractions, seed):
    """The same rounding with plain loops over a list, one large document after another."""
    f = [x if w else 0.0 for x, w in zip(fractions, words)]
    order = sorted((i for i in range(len(f)) if 1e-12 < f[i] < 1 - 1e-12), key=lambda i: (-words[i], keys[i]))
    for at, i in enumerate(order[:-1]):
        if not 1e-12 < f[i] < 1 - 1e-12:
            continue
        stakes = {j: min(f[j] * words[j] / (1 - f[i]), (1 - f[j]) * words[j] / f[i]) for j in order[at + 1 :] if 1e-12 < f[j] < 1 - 1e-12}
        if sum(stakes.values()) < words[i]:
            continue
        up = mixing._chance(seed, keys[i], -1) < f[i]
        for j, stake in stakes.items():
            share = stake * words[i] / sum(stakes.values())
            f[j] += (-(1 - f[i]) if up else f[i]) * share / words[j]
            f[j] = 0.0 if f[j] < 1e-12 else 1.0 if f[j] > 1 - 1e-12 else f[j]
        f[i] = float(up)
    return f


def test_duels_against_plain_loops():
    rng = random.Random(8)
    for seed in range(60):
        n = rng.randint(1, 30)
        words, f = [rng.choice([0, 1, 2, 5, 40]) for _ in range(n)], [rng.random() for _ in range(n)]
        found, plain = mixing.duels(range(n), words, f, seed), plain_duels(range(n), words, f, seed)
        assert all(x == pytest.approx(y) for x, y in zip(found, plain) if not mixing.open_(y))
        assert sum(map(mixing.open_, found)) <= 1 and sum(x * w for x, w in zip(found, words)) == pytest.approx(sum(x * w for x, w in zip(f, words)))


def test_mix_query(spark):
    rows = QUERIES["op5_mixing"](spark, SF).collect()
    texts = dict(texts_of(spark.read.parquet(f"{SF}/documents.parquet")))
    assert all(r["size"] == size_of(texts[r.doc_id]) and r.taken <= 3 * r["size"] and r.taken % max(1, r["size"]) == 0 for r in rows) and len(rows) == len(texts)


def check_shards(docs, shards):
    rows = sharding.sharded(docs, shards).toPandas()
    assert len(rows) == docs.count()
    assert rows["shard"].between(0, shards - 1).all()
    for _, own in rows.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    want = sorted((len(t.encode()) + 16, zlib.crc32(t.encode())) for _, t in texts_of(docs))
    assert sorted(zip(rows["size"], rows["text_crc32"])) == want
    return rows


def test_shards(spark, odd_docs, no_docs, monkeypatch):
    check_shards(odd_docs, 4)
    check_shards(no_docs, 4)
    monkeypatch.setattr(sharding, "NUMBERED", 7)
    rows = check_shards(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 40)
    sums = rows.groupby("shard")["size"].sum().reindex(range(40), fill_value=0)
    assert (sums.max() - sums.min()) / sums.mean() < 0.1


def test_shard_query(spark):
    """The registered query: every row once, the law's promise, and equal texts together."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pd.DataFrame([r.asDict() for r in QUERIES["op7_sharding"](spark, "/root/testdata/sf0.01").collect()]).set_index("doc_id")
    texts = dict(texts_of(docs))
    assert set(rows.index) == set(texts) and (rows["law"] == "bytes").all() and rows["grown_shard"].isna().all()
    assert all(r.size == len(texts[i].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[i].encode()) for i, r in zip(rows.index, rows.itertuples()))
    for _, own in rows.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    share = rows["size"].sum() / 40
    together = pd.DataFrame({"text": texts, "shard": rows["shard"], "size": rows["size"]}).groupby("text").agg(n=("shard", "nunique"), size=("size", "sum"), rows=("size", "count"))
    assert (together["n"][(together["size"] <= share) & (together["rows"] <= len(rows) / 40)] == 1).all()


@pytest.mark.parametrize("part", [20_000, 50])
def test_small_groups_in_parts(spark, monkeypatch, part):
    monkeypatch.setattr(sharding, "PART", part)
    rows = check_shards(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 10)
    sums = rows.groupby("shard")["size"].sum()
    assert (sums.max() - sums.min()) / sums.mean() < 0.1


def test_shards_of_a_hot_group(spark):
    """Copies that make up a third of all rows are cut into slices; shards stay even."""
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, "same text " * 20 if i % 3 == 0 else "".join(rng.choices("abc d", k=rng.randrange(50, 350))), *[None] * 12) for i in range(3000)], SCHEMA)
    rows = check_shards(docs, 10)
    sums, counts = rows.groupby("shard")["size"].sum(), rows.groupby("shard").size()
    assert (sums.max() - sums.min()) / sums.mean() < 0.05 and (counts.max() - counts.min()) / counts.mean() < 0.1


def test_equal_texts_share_a_shard(spark):
    """Groups of up to nearly a shard's share of rows, or of bytes, aren't cut."""
    rng = random.Random(9)
    texts = ["copied text " * 20] * 250 + ["another one " * 15] * 60 + ["long words " * 800] * 2
    texts += ["".join(rng.choices("abc d", k=rng.randrange(50, 350))) for _ in range(2_700)]
    docs = spark.createDataFrame([(i, t, *[None] * 12) for i, t in enumerate(texts)], SCHEMA)
    rows = check_shards(docs, 10)
    assert rows.groupby(["size", "text_crc32"])["shard"].nunique().max() == 1
    sums = rows.groupby("shard")["size"].sum()
    assert (sums.max() - sums.min()) / sums.mean() < 0.1


def test_pipeline(spark, tmp_path):
    """Each stage against what it must do to its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(n)))
        after = spark.read.parquet(str(tmp_path / str(n)))
        seen.append((docs, after))
        assert n == 4 or after.columns == docs.columns
        docs = after
    scores = {r.doc_id: r.predicted for r in QUERIES["op2_quality"](spark, SF).collect()}
    assert {r.doc_id for r in seen[0][1].collect()} == {i for i, p in scores.items() if p}
    from .test_dedup import groups, removed

    before, after = (dict(texts_of(x)) for x in seen[1])
    assert set(after) == set(groups(list(before.items())).values())
    before, after = (dict(texts_of(x)) for x in seen[2])
    sizes = {i: n - gone for i, n, gone, _, _ in removed(list(before.items()))}
    assert all(sizes[i] - 6 <= len(t.encode()) <= sizes[i] for i, t in after.items()) and set(after) == set(before)
    counts = collections.Counter(r.doc_id for r in seen[3][1].collect())
    assert counts == {r.doc_id: r.copies for r in mixing.mixed(seen[3][0]).collect() if r.copies}
    assert seen[4][1].count() == seen[4][0].count()
    again = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, again.collect())) == sorted(map(str, seen[4][1].collect()))


def test_pipeline_of_nothing_and_of_odd_rows(spark, odd_docs, no_docs, tmp_path):
    for k, docs in enumerate((no_docs, odd_docs)):
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, SF).write.parquet(str(tmp_path / f"{k}-{n}"))
            docs = spark.read.parquet(str(tmp_path / f"{k}-{n}"))
        assert k or docs.count() == 0
