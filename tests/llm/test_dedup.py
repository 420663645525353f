"""Near-duplicates, repeated strings and fingerprints against brute force."""

import collections
import hashlib
import random
import re
import unicodedata

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scholia.llm import fingerprints, graph, near_dedup, suffix_dedup
from scholia.llm.registry import QUERIES

from .conftest import SCHEMA, SF, texts_of


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 1, *[None] * 9) for i, t in texts], SCHEMA)


def word_sets(texts):
    sets = collections.defaultdict(list)
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i].append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return sets


def groups(texts):
    sets = word_sets([x for x in texts if x[0] is not None])
    name = {i: i for i in sets}
    flat = [(i, s) for i, own in sets.items() for s in own if s]
    for n, (i, a) in enumerate(flat):
        for j, b in flat[:n]:
            common = len(a & b)
            if 100 * common >= 75 * (len(a) + len(b) - common) and name[i] != name[j]:
                low, high = sorted((name[i], name[j]))
                name = {k: low if v == high else v for k, v in name.items()}
    return name


def check_groups(spark, docs):
    name = groups(texts_of(docs))
    rows = near_dedup.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.component_id == (None if r.doc_id is None else name[r.doc_id])
        assert r.kept == (r.doc_id is None or name[r.doc_id] == r.doc_id)


def test_near_duplicates(spark, odd_docs, no_docs):
    check_groups(spark, odd_docs)
    check_groups(spark, no_docs)


def near_copies(n, seed=1, edits=3, size=60):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    out = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
        out.append((i, " ".join(words)))
    return out


def test_near_copies(spark, monkeypatch):
    """A large group whose members differ in pairs by more than its middle does; regions are split by depth."""
    docs = near_copies(60, edits=3) + [(100 + i, t) for i, t in near_copies(40, seed=2, edits=2)]
    check_groups(spark, frame(spark, docs))
    monkeypatch.setattr(near_dedup, "MOST", 12)
    check_groups(spark, frame(spark, docs))


def test_dense_regions_compare_all(spark, monkeypatch):
    """One region of all classes, far over its bound: what further values part is compared all the same."""
    docs = near_copies(40, seed=7, edits=4) + [(100 + i, t) for i, t in near_copies(30, seed=8, edits=3)]
    for name, value in (("ROUNDS", (1,)), ("DEPTH", 0), ("MOST", 12)):
        monkeypatch.setattr(near_dedup, name, value)
    check_groups(spark, frame(spark, docs))


def region_of(sets, tree=0):
    return pd.DataFrame({"tree": tree, "rep": range(1, len(sets) + 1), "component": range(1, len(sets) + 1), "sig": [near_dedup.signature(s).tobytes() for s in sets], "set": [s.tobytes() for s in sets]})


def components_of(n, links):
    name = list(range(n + 1))
    for a, b in links:
        name = [name[a] if v == name[b] else v for v in name]
    return [name.index(v) for v in name[1:]]


def test_links_with_unlikely_signatures():
    """A link at 0.75 whose signatures agree in 0.54 of their values, in a region of three."""
    x = np.unique(np.random.default_rng(4759).integers(0, 1 << 63, 64, np.uint64))
    assert near_dedup.linked(region_of([x[:28], np.concatenate([x[:24], x[28:32]]), x[40:]])) in ([(1, 2)], [(2, 1)])


def test_regions_are_compared_whole():
    """Random sets around the line, in one region whatever their signatures: components are those of all pairs."""
    rng = np.random.default_rng(3)
    for n in (2, 3, 9, 40):
        for _ in range(25):
            pool = np.unique(rng.integers(0, 1 << 63, 60, np.uint64))
            sets = [np.sort(rng.choice(pool, rng.integers(1, 59), False)) for _ in range(n // 2)]
            sets += [np.sort(np.unique(np.concatenate([s[: max(1, len(s) * 9 // 10)], rng.integers(0, 1 << 63, 2, np.uint64)]))) for s in sets] + [pool[:1 + n % 2]]
            links = [(a + 1, b + 1) for b in range(len(sets)) for a in range(b) if near_dedup.similar(sets[a], sets[b])]
            assert components_of(len(sets), near_dedup.linked(region_of(sets))) == components_of(len(sets), links)


def test_many_pairs_at_the_line_in_one_region(spark, monkeypatch):
    """Pairs just over 0.75 that share a long part with all others: every pair is its own component, however dense."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**9)}"
    shared, docs = [word() for _ in range(60)], []
    for k in range(40):
        own = [word() for _ in range(60)]
        for side in range(2):
            docs.append((2 * k + side, " ".join(shared + own[: 60 - 12 * side] + [word() for _ in range(12 * side)])))
    check_groups(spark, frame(spark, docs))
    for most in (20, 6):
        monkeypatch.setattr(near_dedup, "MOST", most)
        check_groups(spark, frame(spark, docs))


def test_one_of_each(spark, odd_docs, no_docs):
    assert near_dedup.one_of_each(no_docs).count() == 0
    rows = near_dedup.one_of_each(odd_docs)
    name = groups(texts_of(odd_docs))
    assert rows.columns == odd_docs.columns
    assert sorted(r.doc_id for r in rows.collect() if r.doc_id is not None) == sorted(set(name.values()))
    assert rows.where("doc_id is null").count() == 2


def test_near_query(spark):
    name = groups(texts_of(spark.read.parquet(f"{SF}/documents.parquet")))
    assert {r.doc_id: r.component_id for r in QUERIES["op9_near_dedup"](spark, SF).collect()} == name


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1040)]
    name = {i: i for link in links for i in link}
    for a, b in links:
        low, high = sorted((name[a], name[b]))
        name = {k: low if v == high else v for k, v in name.items()}
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: c for i, c in name.items() if any(i in x and x[0] != x[1] for x in links)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def removed(texts):
    data = [t.encode() for _, t in texts]
    seen = collections.Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for (doc_id, _), d in zip(texts, data):
        gone = np.zeros(len(d) + 1, int)
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                gone[i] += 1
                gone[i + 200] -= 1
        gone = np.cumsum(gone)[: len(d)] > 0
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        out.append((doc_id, len(d), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check_removed(docs):
    assert sorted(map(tuple, suffix_dedup.removal_report(docs).collect()), key=str) == removed(texts_of(docs))


def test_repeats(spark, odd_docs, no_docs):
    check_removed(odd_docs)
    check_removed(no_docs)


def test_repeats_in_periodic_and_shared_texts(spark, monkeypatch):
    rng = random.Random(5)
    passage = "".join(rng.choices("abcdefgh é", k=260))
    docs = [(i, "".join(rng.choices("abcdefgh ", k=rng.randrange(400))) + (passage if i % 2 else "") + "".join(rng.choices("ijk", k=50))) for i in range(40)]
    docs += [(50, "ab" * 400), (51, "abc" * 70), (52, passage[:200]), (53, passage[:199]), (54, passage[10:]), (55, passage + passage)]
    check_removed(frame(spark, docs))
    for size in (20_000, 500):
        monkeypatch.setattr(suffix_dedup, "BUCKET", size)
        check_removed(frame(spark, docs))


def test_hot_anchor_is_cut_in_halves(spark, monkeypatch):
    """One line in many surroundings: its anchor's blocks outgrow a bucket, down to single windows."""
    rng = random.Random(8)
    line = "".join(rng.choices("mnopqrst", k=150))
    word = lambda k: "".join(rng.choices("ab", k=k))
    docs = [(i, word(60) + line + word(60)) for i in range(60)]
    docs += [(100 + i, docs[i % 7][1][10:] + word(30)) for i in range(30)] + [(200 + i, "c" * i + docs[3][1]) for i in range(20)]
    monkeypatch.setattr(suffix_dedup, "BROADCAST_IDS", 0)
    for size in (4000, 300):
        monkeypatch.setattr(suffix_dedup, "BUCKET", size)
        check_removed(frame(spark, docs))


def test_windows_are_sorted():
    """Suffixes in the order of their first LENGTH bytes, by residue from the anchor."""
    rng = random.Random(9)
    blocks = ["".join(rng.choices("ab", k=rng.randrange(200, 420))).encode() for _ in range(12)]
    places = [rng.randrange(150) for _ in blocks]
    order, same = suffix_dedup.sorted_windows(blocks + blocks[:3], places + places[:3])
    flat = [((i - p) % 7, b[i : i + 200]) for b, p in zip(blocks + blocks[:3], places + places[:3]) for i in range(len(b) - 199)]
    own = [flat[i] for i in order]
    assert own == sorted(own) and same.tolist() == [False, *(a == b for a, b in zip(own, own[1:]))]


def test_pieces_hold_each_window_once(monkeypatch):
    """Texts longer than a piece: every window once, with an anchor inside it, equal windows with equal places."""
    rng = random.Random(6)
    data = [(n, "".join(rng.choices("abc", k=size)).encode()) for n, size in enumerate((0, 199, 200, 450, 1300, 5000))]
    data += [(9, data[4][1][100:900])]
    for piece in (1 << 20, 300):
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        seen, places = collections.Counter(), collections.defaultdict(set)
        for pieces in suffix_dedup._pieces(data):
            for doc, a, b, p, h in zip(*suffix_dedup.runs(pieces)):
                for w in range(a, b + 1):
                    seen[doc, w] += 1
                    assert w <= p <= w + suffix_dedup.SPAN - 1
                    places[dict(data)[doc][w : w + 200]].add((p - w, h))
        assert seen == {(doc, w): 1 for doc, d in data for w in range(len(d) - 199)}
        assert all(len(x) == 1 for x in places.values())


def test_cut_texts(spark, odd_docs, no_docs):
    assert suffix_dedup.deduplicated(no_docs).count() == 0
    rows = suffix_dedup.deduplicated(odd_docs)
    assert rows.columns == odd_docs.columns and rows.count() == odd_docs.count()
    texts = {r.doc_id: r.text for r in rows.collect()}
    assert texts[1] == "" and texts[3] is None and texts[6] == "word" and texts[7].endswith("follow here")


def test_repeats_query(spark):
    rows = QUERIES["op6_suffix_dedup"](spark, SF).collect()
    assert sorted(map(tuple, rows), key=str) == removed(texts_of(spark.read.parquet(f"{SF}/documents.parquet")))


@pytest.mark.parametrize(("a", "b", "same"), [("Ａ b", "a  B\n", True), ("straße", "STRASSE", True), ("é", "é", True), ("a", "b", False), ("", " ", True)])
def test_canonical(a, b, same):
    assert (fingerprints.canonical(a) == fingerprints.canonical(b)) is same
    assert fingerprints.likeness(fingerprints.canonical(a), fingerprints.canonical(b)) == float(same)


def plain_form(text):
    """The canonical form, step by step on characters."""
    folded = unicodedata.normalize("NFKC", "".join(c.casefold() for c in unicodedata.normalize("NFKC", text)))
    return re.sub(r"\s+", " ", folded.replace("\x1c", " ").replace("\x1d", " ").replace("\x1e", " ").replace("\x1f", " ")).strip()


def check_fingerprints(spark, docs):
    """Against plain Python: edited texts by their SHA-256, fingerprints by which texts they tell apart."""
    hashed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).collect()
    texts = sorted(hashed, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h, r.text))
    rows = collections.defaultdict(list)
    for r in fingerprints.compared_with_next(docs).collect():
        rows[r.doc_id, r.n_chars, r.edited_sha256].append(r)
    form = {}
    for n, r in enumerate(texts):
        after = texts[(n + 1) % len(texts)].text
        half = len(r.text) // 2
        edited = r.text[: len(r.text) - half] + after[:half]
        own = rows[r.doc_id, len(r.text), hashlib.sha256(edited.encode()).hexdigest()].pop()
        assert form.setdefault(own.fingerprint, plain_form(r.text)) == plain_form(r.text)
        assert form.setdefault(own.edited_fingerprint, plain_form(edited)) == plain_form(edited)
        assert (own.near_edited, own.near_next) == (plain_form(r.text) == plain_form(edited), plain_form(r.text) == plain_form(after))
    assert len(set(form.values())) == len(form) and not any(rows.values())


def test_fingerprints(spark, odd_docs, no_docs):
    check_fingerprints(spark, odd_docs)
    check_fingerprints(spark, no_docs)
    check_fingerprints(spark, spark.read.parquet(f"{SF}/documents.parquet"))
    check_fingerprints(spark, frame(spark, [(1, "only one")]))


def test_fingerprint_query(spark):
    """Equal canonical texts share the registered query's fingerprint and group; others don't."""
    texts = dict(texts_of(spark.read.parquet(f"{SF}/documents.parquet")))
    first = {}
    for i in sorted(texts):
        first.setdefault(plain_form(texts[i]), i)
    rows = QUERIES["op10_fingerprints"](spark, SF).collect()
    assert {r.doc_id: r.group_id for r in rows} == {i: first[plain_form(t)] for i, t in texts.items()}
    assert {r.doc_id: r.n_chars for r in rows} == {i: len(t) for i, t in texts.items()}
    assert len({r.fingerprint for r in rows}) == len(first)


def test_groups_of_equal_texts(spark, odd_docs, no_docs):
    assert fingerprints.equal_groups(no_docs).count() == 0
    for docs in (odd_docs, spark.read.parquet(f"{SF}/documents.parquet")):
        first = {}
        for i, t in texts_of(docs):
            if i is not None:
                k = fingerprints.canonical(t)
                first[k] = min(first.get(k, i), i)
        canon = collections.defaultdict(set)
        for i, t in texts_of(docs):
            canon[i].add(first.get(fingerprints.canonical(t)))
        rows = fingerprints.equal_groups(docs).collect()
        assert len(rows) == docs.count()
        assert all(r.group_id in canon[r.doc_id] if r.doc_id is not None else r.group_id is None for r in rows)


def test_several_texts_under_one_id(spark):
    """All sets of an id count as one document's: what is near to any of them is in its component."""
    rng = random.Random(6)
    words = lambda: [f"w{rng.randint(0, 10**6)}" for _ in range(80)]
    near = lambda own: [*own[:-2], "x", "y"]
    a, b, c, d = words(), words(), words(), words()
    rows = [(5, a), (5, b), (7, near(a)), (8, near(b)), (9, c), (9, d), (3, near(d)), (11, words()), (-4, near(c)), (None, near(a)), (12, []), (12, words())]
    docs = spark.createDataFrame([(i, " ".join(t), 1, 2) for i, t in rows], "doc_id long, text string, rep long, low long").repartition(3)
    found = {(r.doc_id, r.n_shingles): r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert {i: {c for (j, _), c in found.items() if j == i} for i in (5, 7, 8, 9, 3, -4, 11, 12, None)} == {5: {5}, 7: {5}, 8: {5}, 9: {-4}, 3: {-4}, -4: {-4}, 11: {11}, 12: {12}, None: {None}}
    kept = near_dedup.one_of_each(docs).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(["5", "-4", "11", "12", "None"])
