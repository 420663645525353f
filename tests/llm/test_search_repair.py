"""Lexical search, url filters and conversation repair against plain Python."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import pandas as pd
import pyarrow.parquet as pq
import pytest

from scholia.llm import conversation_repair, lexical_search, url_filters
from scholia.llm.registry import ORACLES, QUERIES

from .conftest import SF

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, k):
    own = [(i, collections.Counter(terms_of(t))) for i, t in docs]
    own = [(i, c, c.total()) for i, c in own if c]
    n_all, l_all = len(own), sum(n for *_, n in own)
    df = collections.Counter(t for _, c, _ in own for t in c)
    wanted = collections.defaultdict(collections.Counter)
    for i, t in items:
        wanted[i].update(terms_of(t))
    rows = []
    for item, q in wanted.items():
        scores = []
        for i, c, n in own:
            m = 25 + 75 * n * n_all // l_all
            scores.append((-sum(r * math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, r in q.items() if t in c), i is None, i))
        rows += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted((s for s in scores if s[0] < 0), key=lambda s: (s[0], s[1], s[2] or 0))[:k], 1)]
    return sorted(rows, key=str)


def found_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_search_equals_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    assert found_rows(QUERIES["op11_lexical_search"](spark, SF)) == sorted(con.execute(ORACLES["op11_lexical_search"]).fetchall(), key=str)


@pytest.mark.parametrize("postings, block", [(lexical_search.SEGMENT_POSTINGS, lexical_search.BLOCK_TERMS), (40, 3)])
def test_search_of_odd_rows(spark, odd_docs, no_docs, monkeypatch, postings, block):
    monkeypatch.setattr(lexical_search, "SEGMENT_POSTINGS", postings)
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", block)
    items = [(1, "The quick BROWN fox fox"), (2, "a b word x1 日本語"), (2, "é lazy"), (3, None), (4, " .,-"), (None, "no id here"), (5, "nowhere"), (6, "a b " * 500), (7, "\u0130 x" + "x" * 4999)]
    asked = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, rank int, term int")
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for k in (1, 3, 100):
        assert found_rows(lexical_search.search(lexical_search.build_index(odd_docs), asked, k)) == ranked(docs, items, k)
    assert not found_rows(lexical_search.search(lexical_search.build_index(no_docs), asked, 3))
    assert not found_rows(lexical_search.search(lexical_search.build_index(odd_docs), asked.limit(0), 3))


def test_search_among_many_ties(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(400)] + [(1000 + i, "w1 w2 w3 w4") for i in range(600)]
    items = [(i, " ".join(rng.choices(words, k=6))) for i in range(20)] + [(99, "w1 w2")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert found_rows(lexical_search.search(lexical_search.build_index(df), spark.createDataFrame(items, "item_id long, text string"), 10)) == ranked(docs, items, 10)


def plain_address(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def plain_rule(host, path):
    fits = [(h + p, v) for v, h, p in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


def plain_templates(paths):
    """Template of each path of one host, top down over groups of rows."""
    segs = [p.split("/")[1:] for p in paths]
    out = [""] * len(paths)

    def split(rows, level):
        rows = [i for i in rows if len(segs[i]) > level]
        if level == url_filters.DEPTH:
            for i in rows:
                out[i] += "/**"
            return
        n = collections.Counter(segs[i][level] for i in rows)
        literal = {s for s in n if s != "*" and (len(n) <= url_filters.FANOUT or n[s] * url_filters.FANOUT >= len(rows))}
        groups = collections.defaultdict(list)
        for i in rows:
            groups[segs[i][level] if segs[i][level] in literal else "*"].append(i)
        for name, own in groups.items():
            for i in own:
                out[i] += "/" + name
            split(own, level + 1)

    split(range(len(paths)), 0)
    return out


def plain_verdicts(urls):
    """(host, path, rule, verdict) of each, the trees as nested lists of pages; an independent statement of the method."""
    at = [plain_address(u) for u in urls]
    rules = [plain_rule(*x) for x in at]
    out = [None] * len(urls)
    by_host = collections.defaultdict(list)
    for i, (h, _) in enumerate(at):
        by_host[h].append(i)
    far = math.sqrt(0.5 * math.log(2 / url_filters.ALPHA))

    def bound(a, b):
        return far * (len(a) ** -0.5 + len(b) ** -0.5)

    def shares(pages, names, level):
        heads = collections.Counter(p[1][level] if len(p[1]) > level else None for p in pages)
        verdicts = collections.Counter(rules[p[0]][1] for p in pages)
        return [x / len(pages) for x in (heads[None], verdicts["allow"], verdicts["block"], *(heads[n] for n in names))]

    def kids(pages, level):
        found = collections.defaultdict(list)
        for p in pages:
            if len(p[1]) > level:
                found[p[1][level]].append(p)
        return found

    def alike(a, b, level, strict=True):
        if bound(a, b) >= 1:
            return not strict
        ka, kb = kids(a, level), kids(b, level)
        names = sorted(ka.keys() | kb.keys())
        near = all(abs(x - y) < bound(a, b) for x, y in zip(shares(a, names, level), shares(b, names, level)))
        return near and all(alike(ka[k], kb[k], level + 1, False) for k in ka.keys() & kb.keys())

    def judge(pages, level):
        here = [p for p in pages if len(p[1]) == level]
        seen = collections.Counter(rules[p[0]][1] for p in here)
        for i, _ in here:
            out[i] = rules[i][1] or ("block" if (seen["block"] + 1) / (seen["block"] + seen["allow"] + 2) >= url_filters.REJECT else "allow")
        kinds = []
        for _, own in sorted(kids(pages, level).items(), key=lambda x: (-len(x[1]), x[0])):
            home = next((k for k in kinds if alike(k, own, level + 1)), None)
            if home is None:
                kinds.append(own)
            else:
                home += own
        for own in kinds:
            judge(own, level + 1)

    for own in by_host.values():
        judge([(i, t.split("/")[1:]) for i, t in zip(own, plain_templates([at[i][1] for i in own]))], 0)
    return [(*at[i], rules[i][0], out[i]) for i in range(len(urls))]


def test_pages_are_judged_as_by_plain_trees(spark):
    rows = QUERIES["op12_url_filters"](spark, "/root/testdata/sf0.1").toPandas().sort_values("page_id")
    pages = pd.read_parquet("/root/testdata/sf0.1/pages.parquet").sort_values("page_id")
    assert [tuple(x) for x in rows[["host", "path", "rule", "verdict"]].astype(object).where(rows.notna(), None).itertuples(index=False)] == plain_verdicts(pages["url"].tolist())


def test_learnt_verdicts(spark):
    rng = random.Random(5)
    langs = ["es"] * 40 + ["fr"] * 30 + ["en", "de", "it", "pt", "nl", "sv", "da", "fi", "no"]
    urls = [f"http://Mixed.net/{rng.choice(['es', 'fr'])}/{i}" for i in range(120)] + [f"http://mixed.net/{x}{i % 3}/{i}" for i, x in enumerate(langs)]
    urls += [f"https://odd.net/es/{i}/a/b/c/d/{i}" for i in range(30)] + [f"https://odd.net/{i}" for i in range(30)] + [f"ftp://com/{i % 2}/x?y#z" for i in range(25)]
    urls += [f"http://shop.org/{kind}/{i}" for kind in ("a", "b", "*") for i in range(60)] + ["http://x.com", "http://x.com?/a", "http://com/", "://net/es/", "x", "", None, "http://net/es", "http://notnet/es/1", "http://a.net/fr/#/q", "a://b://c/d"] * 2
    df = spark.createDataFrame([(i, u, None, 1) for i, u in enumerate(urls)], "page_id long, url string, host string, template int").repartition(4)
    rows = url_filters.judged(df, url_filters.RULES).orderBy("page_id").collect()
    assert [(r.host_, r.path, r.rule, r.verdict) for r in rows] == plain_verdicts(urls)
    assert rows[0].host is None and {r.template for r in rows} == {1}
    assert any("{a,b" in r.template_ or "{*,a" in r.template_ for r in rows if r.host_ == "shop.org")
    assert url_filters.judged(df.limit(0), url_filters.RULES).count() == 0
    with pytest.raises(ValueError):
        url_filters.judged(df, url_filters.RULES * 200)


def test_a_mixed_template_is_rejected(spark):
    """Rare first segments are one wildcard; where nearly all its labelled pages are blocked, the others go too."""
    rules = [("block", "site.org", f"/bad{i}/") for i in range(40)] + [("allow", "fine.org", f"/ok{i}/") for i in range(40)]
    urls = [f"http://{h}.org/{s}{i}/x" for h, s in (("site", "bad"), ("fine", "ok")) for i in range(40)] + ["http://site.org/other/x", "http://fine.org/other/x", "http://site.org/else"]
    got = {r.url: (r.verdict, r.template) for r in url_filters.judged(spark.createDataFrame([(u,) for u in urls], "url string"), rules).collect()}
    assert got["http://site.org/other/x"] == ("block", "/*/x") and got["http://fine.org/other/x"][0] == "allow" and got["http://site.org/else"] == ("allow", "/*")


LEGAL = re.compile(r"(s?(ua)+)?")


START_OF_LEGAL = re.compile(r"s?(ua)*u?")


def plain_repair(rows):
    """The least (cost, edits) by trying every string of edits within a cost, with what it gives."""
    found = []

    def go(i, left, edits, out):
        initials = "".join(r[:1] for r, _ in out)
        if left < 0 or not START_OF_LEGAL.fullmatch(initials) or any(not r for r, _ in out):
            return
        if i == len(rows) and LEGAL.fullmatch(initials):
            found.append((edits, out))
        for role in ("user", "assistant"):
            go(i, left - 2, edits + "I", [*out, (role, "")])
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, left - 3, edits + "D", out)
            if fault not in (1, 2):
                go(i + 1, left - (fault == 3), edits + "K", [*out, (role, text)])
                for other in ("user", "assistant"):
                    go(i + 1, left - 2 - (fault == 3), edits + "R", [*out, (other, text)])

    for cost in itertools.count():
        go(0, cost, "", [])
        if found:
            return cost, *min(found)


def plain_audit(rows):
    """Of one conversation's rows (turn, role, text) after damage."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faulty = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faulty.append((role, text, 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0))
        seen.add((role, text))
    turns = {t for t, *_ in rows if t is not None}
    n = collections.Counter(f for *_, f in faulty)
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, *_), (b, *_) in itertools.pairwise(faulty))
    cost, edits, out = plain_repair(faulty)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, n[1], n[2], n[3], illegal, cost, edits, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


AUDIT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def audits(df):
    return {r.conv_id: tuple(r[c] for c in AUDIT) for r in df.collect()}


def plain_damage(rows):
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        out[conv] += [(turn, "user" if harm == 4 else role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    return {k: plain_audit(v) for k, v in out.items()}


def test_repair_of_given_conversations(spark):
    rows = pd.read_parquet(f"{SF}/conversations.parquet")[["conv_id", "turn", "role", "text"]].itertuples(index=False, name=None)
    assert audits(QUERIES["op13_conversation_repair"](spark, SF)) == plain_damage(rows)


@pytest.mark.parametrize("block", [2, conversation_repair.BLOCK])
def test_repair_of_random_conversations(spark, monkeypatch, block):
    monkeypatch.setattr(conversation_repair, "BLOCK", block)
    rng = random.Random(block)
    rows = []
    for conv in [None, *range(150)]:
        for _ in range(rng.randint(1, 6)):
            rows.append((conv, rng.choice([None, 1, 2, 3, 4, 9]), rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None]), rng.choice(["a.", "b!", "c", " ", "", None, "d?\n", "e. f"])))
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, fault int").repartition(3)
    by = collections.defaultdict(list)
    for conv, *own in rows:
        by[conv].append(tuple(own))
    assert audits(conversation_repair.audited(df)) == {k: plain_audit(v) for k, v in by.items()}
    texts = collections.defaultdict(list)
    for r in sorted(conversation_repair.repaired_rows(df).collect(), key=lambda r: r.place):
        texts[r.conv_id].append(f"{r.role}:{r.text}")
    assert {k: hashlib.sha256("\n".join(texts[k]).encode()).hexdigest() for k in by} == {k: plain_audit(v)[-1] for k, v in by.items()}
    assert not audits(conversation_repair.audited(df.limit(0)))


def test_a_conversation_in_many_pieces(spark):
    rng = random.Random(1)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), f"t{rng.randint(0, 900)}" + rng.choice([".", ""])) for t in range(3000)]
    found = audits(conversation_repair.audited(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)))[7]
    assert found[0] == 0 and len([e for e in found[6] if e != "I"]) == 3000
    ordered, seen, faulty = sorted(rows, key=lambda r: r[1]), set(), []
    for _, _, role, text in ordered:
        faulty.append((role[0], conversation_repair.DUPLICATE if (role, text) in seen else 0 if text[-1] == "." else conversation_repair.CUT))
        seen.add((role, text))
    assert found[6] == conversation_repair.walk(faulty, 0, conversation_repair.AT_END, True)[0]


def test_row_groups_of_the_index_are_bounded(spark, monkeypatch):
    """A task that writes many segments closes a row group by bytes after any segment, not after a hundred."""
    monkeypatch.setitem(lexical_search.GROUPS, "parquet.block.size", "4096")
    index = lexical_search.build_index(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").coalesce(1))
    files = [pq.ParquetFile(f.removeprefix("file:")) for f in index.segments.inputFiles()]
    sizes = [f.metadata.row_group(i).num_rows for f in files for i in range(f.num_row_groups)]
    assert sum(sizes) > 4 and max(sizes) <= 2
