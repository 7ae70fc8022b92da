"""Queries over whole tables that have no SQL, against brute force on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgeo.operators import ngrams
from kgeo.plans.queries import QUERIES

ORDERS = {r: [(r * k + j * 5) % 9 + 100 * (j % 2) + 200 for j in range(3)] for k, r in enumerate(range(1, 13), 2)}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    lines = [(r, p, j, 1, 20.0, 1.0) for r, ps in ORDERS.items() for j, p in enumerate(ps)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_suppkey long, l_quantity double, l_extendedprice double").write.parquet(str(at / "lineitem.parquet"))
    spark.createDataFrame([(r, 300000.0 + 20000 * (r % 5)) for r in ORDERS], "o_orderkey long, o_totalprice double").write.parquet(str(at / "orders.parquet"))
    parts = sorted({p for ps in ORDERS.values() for p in ps})
    spark.createDataFrame([(p, f"w{p} w{p + 1}") for p in parts], "p_partkey long, p_name string").write.parquet(str(at / "part.parquet"))
    spark.createDataFrame([(1, "abcdefghij abcdefghij é"), (2, "aaaa"), (3, ""), (4, None)], "doc_id long, text string").write.parquet(str(at / "documents.parquet"))
    return str(at)


def rating(r):
    return 800 + (1200 * min(1.0, (300000.0 + 20000 * (r % 5)) / 500000) // 1)


def test_trees_of_all_relations(spark, tables):
    child = {r: {c for c, q in ORDERS.items() if q[0] in ps[1:]} for r, ps in ORDERS.items()}
    want = [(r, r, 0) for r in ORDERS] + [(r, a, 1) for r in ORDERS for a in child[r] - {r}] + [(r, b, 2) for r in ORDERS for a in child[r] - {r} for b in child[a] - {r, a}]
    assert sorted(map(tuple, QUERIES["v6_relation_tree_all"](spark, tables).select("root", "relation_id", "depth").collect())) == sorted(want)
    assert {r for r, _, _ in want} - {1, 2, 3, 4, 5}


def test_contradictions_of_all_sources(spark, tables):
    elo = {}
    for r, ps in ORDERS.items():
        for a in ps:
            for b in ps:
                if a != b:
                    elo[a, b] = max(elo.get((a, b), 0), rating(r))
    want = {(s, a, b) for s, a in elo for t, b in elo if s == t and a < b and a % 2 == b % 2 and abs(elo[s, a] - elo[s, b]) < 100}
    got = [(r.src, r.a, r.b) for r in QUERIES["d10_contradictions_all"](spark, tables).collect()]
    assert len(got) == len({*got}) and {*got} == want and any(s > 200 for s, _, _ in want)


def test_words_of_all_compositions(spark, tables):
    got = QUERIES["l1_solvable_all"](spark, tables).collect()
    strong = {p for r, ps in ORDERS.items() if rating(r) > 1500 for p in ps}
    known = {w for p in strong for w in (f"w{p}", f"w{p + 1}")}
    assert {(r.id, r.keywords, r.known) for r in got} == {(p, 2, len({f"w{p}", f"w{p + 1}"} & known)) for p in {p for ps in ORDERS.values() for p in ps}}
    assert any(r.known for r in got if r.id % 7)


def test_repeats_of_up_to_eight_characters(spark, tables):
    texts = {1: "abcdefghij abcdefghij é", 2: "aaaa"}
    want = {}
    for d, t in texts.items():
        for n in range(1, 9):
            for i in range(len(t) - n + 1):
                want.setdefault((d, t[i : i + n]), []).append(i)
    want = {(d, g, len(at), at[0]) for (d, g), at in want.items() if len(at) > 1}
    got = QUERIES["i4_character_ngrams_documents"](spark, tables).collect()
    assert {(r.doc_id, r.ngram, r.freq, r["first"]) for r in got} == want and max(len(g) for _, g, _, _ in want) == 8
    rebuilt = {r.doc_id: r.text for r in QUERIES["i7_tiling_documents"](spark, tables).collect()}
    assert {d: rebuilt[d] for d in texts} == texts


def test_repeats_take_one_exchange(spark, tables):
    for name in ("i4_character_ngrams_documents", "i7_tiling_documents", "i3_relations"):
        plan = QUERIES[name](spark, tables)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1, plan


def test_repeats_of_long_short_and_shared_keys(spark, monkeypatch):
    rng = np.random.default_rng(7)
    made = lambda letters, n: "".join(rng.choice([*letters], n))
    rows = [(1, made("ab", 90)), (1, made("ab", 40)), (None, "xyxy"), (2, made("aé\U0001f600日\0", 80)), (3, made([chr(c) for c in range(200, 900)], 300)), (4, made("abc", 700)), (5, ""), (6, None), (7, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {}
    for d, x in rows:
        for n in range(1, 6):
            for i in range(len(x or "") - n + 1):
                want.setdefault((d, x[i : i + n]), []).append(i)
    want = {(d, g, len(at), min(at), len(g) > 1 and len({*g}) == 1) for (d, g), at in want.items() if len(at) > 2}
    pieces = {}
    known = {(d, g) for d, g, *_ in want}
    for d, x in rows:
        at, cut = 0, []
        while at < len(x or ""):
            n = next((n for n in range(min(5, len(x) - at), 1, -1) if (d, x[at : at + n]) in known), 1)
            cut.append(x[at : at + n])
            at += n
        if cut:
            pieces.setdefault(d, []).append(cut)
    for most in (2_000_000, 500):
        monkeypatch.setattr(ngrams, "MOST", most)
        got = ngrams.ngrams(docs, 5, 3).collect()
        assert {(r.doc_id, r.ngram, r.freq, r["first"], r.is_rle) for r in got} == want and len(got) == len(want)
        found = {}
        for r in ngrams.tile_repeats(docs, 5, 3).collect():
            found.setdefault(r.doc_id, []).append(r.pieces)
        assert {d: sorted(x) for d, x in found.items()} == {d: sorted(x) for d, x in pieces.items()}


def test_relations_are_those_that_ingest_mentions(spark):
    from kgeo.functions.text import tokens
    from kgeo.operators import ingest

    texts = ["b a b a c", "a b", "é a é 日本 a", "x x x", "", None, "a", "one", "日a 日\U0001f600"]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    words = docs.selectExpr("doc_id", "text").select("doc_id", F.posexplode(tokens(F.col("text"))).alias("pos", "token"))
    made = ingest.compositions(words, ingest.atoms(words))
    names = {r.id: r.token for r in made.collect()}
    want = {}
    for r in ingest.relations(words, made).collect():
        pair = tuple(sorted((names[r.a_id], names[r.b_id]), key=str.encode))
        want[pair] = want.get(pair, 0) + 1
    got = ngrams.mentioned_pairs(docs).collect()
    assert {(r.a, r.b): r.n for r in got} == want and len(got) == len(want)


def test_association_in_blocks_equals_counting(spark, monkeypatch):
    """three windows over all words and five aggregates of their rows went through the exchange row by row."""
    from collections import Counter
    from math import log2

    rng = np.random.default_rng(12)
    texts = [None, "", "one", "a b", "a a a a", "a b", *(" ".join(rng.choice(["a", "b", "c", "dé", "e!"], int(rng.integers(1, 30)))) for _ in range(40))]
    docs = spark.createDataFrame([(x,) for x in texts], "text string")
    freq, left, right = Counter(), {}, {}
    for x in texts:
        t = ngrams._TOKEN.findall(x or "")
        for i, pair in enumerate(zip(t, t[1:], strict=False)):
            freq[pair] += 1
            for side, at in ((left, i - 1), (right, i + 2)):
                if 0 <= at < len(t):
                    side.setdefault(pair, Counter())[t[at]] += 1
    total, na, nb = sum(freq.values()), Counter(), Counter()
    for (a, b), n in freq.items():
        na[a] += n
        nb[b] += n
    entropy = lambda c: -sum(n / c.total() * log2(n / c.total()) for n in c.values()) if c else 0.0
    want = {(a, b): (n, log2((n / total) / (na[a] / total * (nb[b] / total))) / -log2(n / total), entropy(left.get((a, b))), entropy(right.get((a, b)))) for (a, b), n in freq.items() if n >= 2}
    measured = ngrams.association(docs)
    assert "Window" not in measured._jdf.queryExecution().toString()
    got = {(r.a, r.b): (r.freq, r.npmi, r.left_entropy, r.right_entropy) for r in measured.collect()}
    assert got.keys() == want.keys() and len(want) > 15
    for pair, x in want.items():
        assert got[pair] == pytest.approx(x, abs=1e-9), pair
    assert ngrams.association(docs.limit(3)).count() == 0
