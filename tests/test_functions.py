"""Golden values of the column functions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgeo import ids
from kgeo.functions import curves, phonetic, scoring, text
from kgeo.functions import geometry as g


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def lit(*v):
    return [F.lit(float(x)) for x in v]


def test_distances(spark):
    a, b = lit(1, 0, 0, 0), lit(0, 1, 0, 0)
    r = one(spark, g.geodesic(a, b), g.geodesic(a, a), g.geodesic(a, lit(-1, 0, 0, 0)), g.geodesic_fast(a, b), g.euclidean(lit(1, 1, 1, 1), lit(2, 2, 2, 2)), g.geodesic(lit(1.0000001, 0, 0, 0), a))
    assert np.allclose(list(r), [math.pi / 2, 0, math.pi, math.pi / 2, 2, 0], atol=1e-12)


def test_box_and_zero_vectors(spark):
    low, high = lit(-1, -1, -1, -1), lit(1, 1, 1, 1)
    assert one(spark, g.box_distance(lit(0, 0, 0, 0), low, high)).c0 == 0
    assert one(spark, g.box_distance(lit(2, 0, 0, 0), low, high)).c0 == 1
    assert list(one(spark, *g.normalize(lit(0, 0, 0, 0)))) == [0, 0, 0, 0]
    assert list(one(spark, *g.normalize(lit(0, 0, 0, 0), (1, 0, 0, 0)))) == [1, 0, 0, 0]


def test_hopf_round_trip(spark):
    assert list(one(spark, *g.hopf(lit(1, 0, 0, 0)))) == [1, 0, 0]
    rows = spark.range(200).select(*[e.alias(c) for e, c in zip(g.spiral(F.col("id"), 200), "xyzw")])
    back = rows.select(*"xyzw", *[e.alias(f"s{i}") for i, e in enumerate(g.hopf(g.hopf_inverse(g.hopf(g.point()), F.lit(0.3))))], *[e.alias(f"t{i}") for i, e in enumerate(g.hopf(g.point()))]).collect()
    m = np.array([list(r) for r in back])
    assert np.allclose((m[:, :4] ** 2).sum(1), 1, atol=1e-12) and np.allclose(m[:, 4:7], m[:, 7:], atol=1e-9)
    assert math.isclose(g.PSI**3, g.PSI + 1)


def test_interpolation_and_paths(spark):
    r = one(spark, *g.interpolate(lit(1, 0, 0, 0), lit(0, 1, 0, 0), 0.5))
    assert np.allclose(list(r), [math.sqrt(0.5)] * 2 + [0, 0])
    p = lambda *v: F.struct(*[F.lit(float(x)).alias(c) for x, c in zip(v, "xyzw")])
    a, b = F.array(p(1, 0, 0, 0), p(0, 1, 0, 0)), F.array(p(1, 0, 0, 0), p(0, 0, 1, 0))
    r = one(spark, g.frechet(a, b), g.frechet(a, a), g.hausdorff(a, b), g.path_tortuosity(F.array(p(1, 0, 0, 0))))
    assert np.allclose(list(r), [math.pi / 2, 0, math.sqrt(2), 1])


def test_hilbert_curve(spark):
    grid = np.array([[a, b, c, d] for a in range(4) for b in range(4) for c in range(4) for d in range(4)])
    words = curves.hilbert_words(grid, 2)
    index = [int("".join(f"{(w >> bit) & 1}" for bit in (1, 0) for w in map(int, row)), 2) for row in words]
    order = np.argsort(index)
    assert sorted(index) == [*range(256)] and (np.abs(np.diff(grid[order], axis=0)).sum(1) == 1).all()
    corners = curves.hilbert_keys(np.array([[i >> k & 1 for k in range(4)] for i in range(16)], float))
    assert len(set(corners)) == 16 and all(len(k) == 16 for k in corners)
    assert curves.hilbert_keys(np.array([[0.3] * 4]), curves.ATOM)[0][-1] & 3 == curves.ATOM
    near, far = (int.from_bytes(curves.hilbert_keys(np.array([[v] * 4]))[0], "big") for v in (0.1000001, 0.9))
    here = int.from_bytes(curves.hilbert_keys(np.array([[0.1] * 4]))[0], "big")
    assert abs(near - here) < abs(far - here)
    df = spark.createDataFrame([(0.1, 0.2, 0.3, 0.4), (None, 0.0, 0.0, 0.0)], "x double, y double, z double, w double")
    keys = [r.k for r in df.select(curves.hilbert()(*"xyzw").alias("k")).collect()]
    assert bytes(keys[0]) == curves.hilbert_keys(np.array([[0.1, 0.2, 0.3, 0.4]]))[0] and keys[1] is None


def test_blake3_vectors():
    assert ids.blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    data = bytes(i % 251 for i in range(3072))
    assert len({ids.blake3(data[:n]) for n in (0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 2049, 3072)}) == 11
    assert ids.blake3(data[:1]).hex().startswith("2d3adedff11b61f1") and ids.blake3(data[:1025]).hex().startswith("d00278ae47eb27b3")


def test_ids_are_symmetric(spark):
    a, b = F.lit("0" * 32), F.lit("f" * 32)
    for backend in ("md5", "blake3"):
        r = one(spark, ids.relation_id(a, b, backend), ids.relation_id(b, a, backend), ids.relation_id(a, a, backend))
        assert r.c0 == r.c1 != r.c2 and len(r.c0) == 32
    r = one(spark, ids.clean_hex(ids.with_hyphens(a)), ids.clean_hex(F.lit("abc")), F.hex(ids.u32(F.lit(0x01020304))))
    assert (r.c0, r.c1, r.c2) == ("0" * 32, None, "04030201")


@pytest.mark.parametrize(("word", "want"), [("ssi", "XXY"), ("abba", "XYYX"), ("abab", "XYXY"), ("a", ""), ("", ""), ("abcd", "XYZa")])
def test_patterns(spark, word, want):
    assert one(spark, text.pattern(F.lit(word))).c0 == want


def test_text_functions(spark):
    r = one(spark, text.tokens(F.lit("Hi, 日本 x\n")), text.keywords(F.lit("What is the Whale's name?")), text.char(F.lit(960)), text.runs(F.lit("aab")), text.unrun(text.runs(F.lit("aabπ"))), text.sentence(F.array(*map(F.lit, ["the", "the", "cat", ",", "sat"]))), text.clean_markup(F.lit("'''a''' [[b|c]] {{x}} &lt;")))
    assert r.c0 == ["Hi,", "日", "本", "x"] and r.c1 == ["whales", "name"] and r.c2 == "π"
    assert [tuple(x) for x in r.c3] == [(0, "a", 2), (2, "b", 1)] and r.c4 == "aabπ" and r.c5 == "The cat, sat." and r.c6 == "a c  <"
    r = one(spark, text.similarity(F.lit("word"), F.lit("words")), text.is_run(F.lit("aa")), text.is_run(F.lit("a")), text.is_artifact(F.lit("##x")), text.is_function_word(F.lit("The")), text.is_question(F.lit("Is it")), text.is_creative(F.lit("Please write a poem")))
    assert math.isclose(r.c0, 4 / 7) and [r.c1, r.c2, r.c3, r.c4, r.c5, r.c6] == [True, False, True, True, True, True]


def test_scores(spark):
    r = one(spark, scoring.vote_rating(F.lit(0.75)), scoring.folded_vote(F.lit(1500), F.lit(1), F.lit(1601)), scoring.feedback_delta(F.lit(-0.5), F.lit(50)), scoring.edge_cost(F.lit(2000.0), F.lit(999)))
    assert list(r) == [1750, 1550, -8, 1.0]


def test_metaphone():
    assert [phonetic.metaphone_of(w) for w in ("Thompson", "knight", "phone", "", None)] == ["0MPS", "NT", "FN", "", None]
