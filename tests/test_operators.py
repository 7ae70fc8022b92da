"""Graph search, n-grams, sources, sinks and streams on small fixtures."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgeo.operators import evidence, graph, ingest, lookups, maintenance, ml, ngrams, reasoning, search, voronoi
from kgeo.sources import linguistic, tensors, unicode
from kgeo.streaming import feedback


def ngram_counts(spark, text, low=2, n=8):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return {r.ngram: r for r in ngrams.ngrams(df, n, low).collect()}


@pytest.mark.parametrize(("text", "want"), [("aaaa", {"a": 4, "aa": 3, "aaa": 2}), ("abcabc", {"abc": 2, "ab": 2}), ("mississippi", {"i": 4, "s": 4, "ss": 2, "issi": 2}), ("日本日本", {"日本": 2}), ("🎉x🎉x", {"🎉x": 2})])
def test_ngrams(spark, text, want):
    got = ngram_counts(spark, text)
    assert {k: got[k].freq for k in want} == want
    assert all(r.is_rle == (len(set(k)) == 1 and len(k) > 1) for k, r in got.items())


def test_long_repeat(spark):
    got = ngram_counts(spark, "telephony___telephony", n=9)
    assert got["telephony"].freq == 2 and got["telephony"].n == 9


def edges(spark):
    rows = [(1, 2, 1900.0, 900), (2, 3, 1900.0, 900), (1, 3, 1000.0, 2), (3, 4, 1700.0, 50), (4, 5, 900.0, 1)]
    both = rows + [(b, a, e, o) for a, b, e, o in rows]
    return spark.createDataFrame([(*r, 1) for r in both], "src long, dst long, elo double, obs long, n long")


def test_a_star_is_dijkstra_without_a_heuristic(spark):
    e = edges(spark)
    found = graph.a_star(graph.Adjacency(e), 1, {4})
    assert found["path"] == [1, 2, 3, 4]
    assert graph.a_star(graph.Adjacency(e), 1, {4}, heuristic=lambda n: 0.5, weight=0)["cost"] == found["cost"]
    assert graph.a_star(graph.Adjacency(e, min_elo=1950), 1, {4}) is None
    paths = graph.multi_hop(e, spark.createDataFrame([(1,)], "src long"), 3, limit=None).collect()
    assert all(len(set(r.path)) == len(r.path) for r in paths)


def test_walks_keep_their_state(spark):
    names = spark.createDataFrame([(i, w) for i, w in enumerate(["", "whale", "ship", "the", "sea", "[PAD]"])], "id long, text string")
    steps = graph.walk(graph.candidates(edges(spark), names), 1, 6, seed=1)
    assert steps == graph.walk(graph.candidates(edges(spark), names), 1, 6, seed=1)
    energies = [s["energy"] for s in steps]
    assert energies == sorted(energies, reverse=True) and all(0 <= s["probability"] <= 1 for s in steps if s["text"])
    assert 5 not in {s["node"] for s in steps}


def test_reasoning(spark):
    best = reasoning.reason(graph.Adjacency(edges(spark)), 1, [3, 4])
    assert best["resolved"] == 1 and best["path"][0] == 1
    links = edges(spark).withColumn("rating", F.col("elo"))
    got = {r.node: r.depth for r in reasoning.decompose(links, spark.createDataFrame([(5,)], "id long")).collect()}
    assert got[5] == 0 and got[4] == 1 and got[3] == 2
    votes = spark.createDataFrame([(1, 2, "k", 1.0, "a", 1), (1, 2, "k", 0.0, "b", 2)], "src long, dst long, kind string, weight double, model string, seq long")
    r = reasoning.fold_votes(votes).first()
    assert (r.elo, r.n, json.loads(r.provenance)) == (1500, 2, ["a", "b"])
    assert [*reasoning.stream_tokens("a b")] == ["a", "b"]


def test_evidence_thresholds(spark):
    rows = [(r, i, True, 0.5, f"2024-01-01 0{i % 10}:00:00") for r, n in ((1, 5), (2, 6)) for i in range(n)] + [(2, 99, True, 1.0, "2024-01-01 23:30:00")]
    e = spark.createDataFrame(rows, "relation_id long, content_id long, is_valid boolean, signal double, validated_at string").withColumn("validated_at", F.col("validated_at").cast("timestamp"))
    got = reasoning.orient(e, F.lit("2024-01-01 23:00:00").cast("timestamp")).collect()
    assert [(r.relation_id, r.n, r.mean_signal) for r in got] == [(2, 6, 0.5)]
    kept, rated, gone = evidence.forget(e.withColumn("source", F.lit("s")), F.col("relation_id") == 1)
    assert kept.count() == 7 and rated.count() == 0 and [r.relation_id for r in gone.collect()] == [1]


def test_radius_join_is_all_pairs(spark):
    m = np.random.default_rng(1).uniform(-1, 1, (120, 4))
    p = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(m)], "key long, x double, y double, z double, w double")
    for r in (0.2, 0.7):
        got = {(x.a_key, x.b_key) for x in search.radius_join(p, p, r).collect()}
        d = np.linalg.norm(m[:, None] - m[None], axis=2)
        assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(d <= r))}


def test_knn_join_in_blocks(spark):
    m = np.random.default_rng(2).standard_normal((90, 6))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)] + [(500, [0.0] * 6), (501, None)], "id long, v array<double>")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(90) for j in np.argsort(-s[i])[:3] if s[i, j] >= 0.2}
    for block in (17, 1000):
        assert {(r.src, r.dst) for r in search.knn_join(v, v, 3, 0.2, block).collect()} == want


def test_models(spark):
    v = spark.createDataFrame([(i, np.random.default_rng(i % 3).standard_normal(8).tolist()) for i in range(30)], "id long, v array<double>")
    placed = ml.eigenmap(ml.embedding_edges(v, 8, 0.0)).toPandas()
    assert np.allclose((placed[[*"xyzw"]] ** 2).sum(axis=1), 1)
    with pytest.raises(ValueError):
        ml.eigenmap(ml.embedding_edges(v, 8, 0.0), limit=3)
    gated = ml.project(v, np.eye(8)[:, :2], gate=True).first()
    x = np.array(v.first().v[:2])
    assert np.allclose(gated.v, x / (1 + np.exp(-x)))
    rec = ml.recurrent_relations(v.filter("id < 4"), np.eye(8)).collect()
    assert len(rec) == 3 and all(0 <= r.w <= 1 for r in rec)
    same = ml.similar_layers(v.select((F.col("id") % 2).alias("layer"), F.lit(0).alias("row"), F.first("v").over(__import__("pyspark").sql.Window.partitionBy(F.lit(1)).orderBy("id")).alias("v")).dropDuplicates(["layer"])).first()
    assert same.skip


def test_cells(spark):
    pts = np.random.default_rng(3).standard_normal((40, 4))
    pts /= np.linalg.norm(pts, axis=1, keepdims=True)
    places = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "id long, x double, y double, z double, w double")
    got = voronoi.analyze_cells(places, 100).collect()
    assert len(got) == 40 and all(0 <= r.volume <= 1 and 0 <= r.eccentricity <= 1 for r in got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, voronoi.analyze_cells(places, 100).collect()))


def test_runs_give_back_the_text(spark):
    words = spark.createDataFrame([(1, 0, "aabbb"), (1, 1, "日日x"), (1, 2, "aabbb")], "doc_id long, pos int, token string")
    got = {r.token: r.text for r in ingest.text_of(ingest.composition_sequence(words)).collect()}
    assert got == {"aabbb": "aabbb", "日日x": "日日x"}
    rel = ingest.relations(words, ingest.compositions(words, ingest.atoms(words)))
    rating, ev = ingest.merge(rel)
    assert rating.first().observations == 2 and ev.count() == 1


def test_conllu(spark, tmp_path):
    (tmp_path / "a.conllu").write_text("# sent\n1\tDogs\tdog\tN\t_\t_\t2\n1-2\tx\tx\n2\tbark\tbark\tV\t_\t_\t0\n2.1\te\te\n\n1\tHi\thi\tX\t_\t_\t0")
    rows = linguistic.conllu(spark, str(tmp_path))
    assert sorted((r.sent, r.id, r.lemma, r.head) for r in rows.collect()) == [(0, 1, "dog", 2), (0, 2, "bark", 0), (1, 1, "hi", 0)]
    assert sorted(map(tuple, linguistic.dependencies(rows).collect())) == [("dog", "bark", 1500), ("dog", "bark", 1800)]


def test_tatoeba(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("1\teng\tThe cat sat down now\n2\tdeu\tDie Katze saß\n3\tjpn\t猫\n")
    (tmp_path / "l.tsv").write_text("1\t2\n1\t99\n")
    got = linguistic.translations(linguistic.tatoeba_sentences(spark, str(tmp_path / "s.tsv")), linguistic.tatoeba_links(spark, str(tmp_path / "l.tsv"))).collect()
    assert sorted(map(tuple, got)) == [("The", "Die", 1400), ("cat", "Katze", 1300), ("sat", "saß", 1300)]


def test_wordnet_and_omw(spark, tmp_path):
    (tmp_path / "data.adj").write_text("  1 licence\n00001740 00 s 02 able 0 capable 0 001 ! 00002098 a 0101 | having skill  \n00002098 00 a 01 unable 0 000 | without\n")
    rows = linguistic.wordnet(spark, str(tmp_path / "data.adj"))
    got = {r.offset: r for r in rows.collect()}
    assert got["00001740"].lemmas == ["able", "capable"] and got["00001740"].pos == "a" and got["00001740"].gloss == "having skill" and got["00002098"].pointers == []
    assert sorted(map(tuple, linguistic.wordnet_relations(rows).collect())) == [("able", "capable", "synonym", 1900), ("able", "unable", "!", 1700)]
    (tmp_path / "x.tab").write_text("# c\n1-n\tlemma\tcat \n1-n\tlemma\tcat\n2-n\tlemma\tdog\n")
    assert sorted(map(tuple, linguistic.omw(spark, str(tmp_path / "x.tab")).collect())) == [("1-n", "cat"), ("2-n", "dog")]


def test_wiktionary(spark, tmp_path):
    (tmp_path / "w.xml").write_text("<m><page><title>cat</title><ns>0</ns><revision><text>==English==\n# a [[pet]]\n{{syn|en|feline|kitty}}\n[[Category:Cats]]\n==French==\n{{syn|en|no}}</text></revision></page><page><title>T</title><ns>10</ns><revision><text>x</text></revision></page></m>")
    pages = linguistic.wiktionary(spark, str(tmp_path / "w.xml"))
    assert [r.title for r in pages.collect()] == ["cat"]
    got = {(r.b, r.kind, r.elo) for r in linguistic.wiktionary_relations(pages).collect()}
    assert got == {("feline", "syn", 1950), ("kitty", "syn", 1950), ("Cats", "category", 1200), ("a pet", "definition", 1900)}


def test_unicode_files(spark, tmp_path):
    (tmp_path / "ucd.xml").write_text('<ucd><char cp="0041" na="A" gc="Lu" sc="Latn" blk="ASCII" suc="#" slc="0061" dm="#"/><char cp="00C5" gc="Lu" sc="Latn" dm="0041 030A"/></ucd>')
    pts = unicode.ucd_xml(spark, str(tmp_path / "ucd.xml"))
    assert {(r.codepoint, r.lower) for r in pts.collect()} == {(0x41, 0x61), (0xC5, None)}
    assert {tuple(r) for r in unicode.case_edges(pts).collect()} == {(0x41, 0x61, "lower"), (0xC5, 0x41, "decomposition"), (0xC5, 0x30A, "decomposition")}
    (tmp_path / "keys.txt").write_text("@version 1\n0041  ; [.1C47.0020.0008] # A\n0041 0042 ; [.1.2.3]\n")
    assert [tuple(r) for r in unicode.collation(spark, str(tmp_path / "keys.txt")).collect()] == [(0x41, 0x1C47, 0x20, 8)]
    (tmp_path / "conf.txt").write_text("# c\n0430 ;\t0061 ;\tMA\n0430 0431 ;\t0061 ;\tMA\n")
    assert [tuple(r) for r in unicode.confusables(spark, str(tmp_path / "conf.txt")).collect()] == [(0x430, 0x61)]
    (tmp_path / "rs.txt").write_text("U+4E00\tkRSUnicode\t1.0\nU+4E01\tkOther\tx\n")
    assert [tuple(r) for r in unicode.radicals(spark, str(tmp_path / "rs.txt")).collect()] == [(0x4E00, 1, 0)]


def test_safetensors(spark, tmp_path):
    parts, head, at = [], {"__metadata__": {"a": "b"}}, 0
    for name, kind, shape, data in (("a", "F32", [2, 2], np.array([1, 2, 3, 4], "<f4").tobytes()), ("h", "F16", [2], np.array([1, 2], "<f2").tobytes()), ("b", "BF16", [1], struct.pack("<H", 0x3F80)), ("u", "U8", [3], b"\1\2\3")):
        head[name] = {"dtype": kind, "shape": shape, "data_offsets": [at, at + len(data)]}
        parts.append(data)
        at += len(data)
    h = json.dumps(head).encode()
    (tmp_path / "m.safetensors").write_bytes(struct.pack("<Q", len(h)) + h + b"".join(parts))
    got = {(r.name, r.row): list(r.v) for r in tensors.safetensors(spark, str(tmp_path)).collect()}
    assert got == {("a", 0): [1, 2], ("a", 1): [3, 4], ("h", 0): [1, 2], ("b", 0): [1], ("u", 0): [0, 0, 0]}
    (tmp_path / "i.json").write_text(json.dumps({"weight_map": {"x": "1.safetensors"}}))
    assert [tuple(r) for r in tensors.shards(spark, str(tmp_path / "i.json")).collect()] == [("x", "1.safetensors")]
    names = spark.createDataFrame([("model.layers.3.self_attn.q_proj.weight",), ("wte.weight",), ("h.2.mlp.fc1",), ("x",)], "name string")
    assert {(r.layer, r.role) for r in tensors.layer_roles(names).collect()} == {(3, "q"), (2, "gate")}
    assert tensors.embedding_name(names).first().name == "wte.weight"
    (tmp_path / "vocab.txt").write_text("a\nb\n")
    assert [tuple(r) for r in tensors.vocabulary(spark, str(tmp_path / "vocab.txt")).collect()] == [("a", 0), ("b", 1)]


def test_sinks_are_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, t string")
    path = str(tmp_path / "t")
    assert [maintenance.write_table(df, path, ["id"]) for _ in range(2)] == [2, 2]
    old = spark.createDataFrame([(1, 1000.0, 1)], "relation_id long, rating double, observations long")
    new = spark.createDataFrame([(1, 2000.0, 3, 2), (1, 1200.0, 1, 1)], "relation_id long, rating double, observations long, seq long")
    assert tuple(maintenance.fold_ratings(old, new, "last").first()) == (1, 2000.0, 5)
    assert tuple(maintenance.fold_ratings(old, new).first()) == (1, 1640.0, 5)


def test_stream_is_the_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = feedback.evidence_stream(spark, str(tmp_path / "events"), src.schema)
    seen, now = {}, F.lit("2024-02-01").cast("timestamp")
    base = src.select(F.col("user_id").alias("relation_id")).distinct().withColumns({"rating": F.lit(1500.0), "observations": F.lit(1).cast("long")})
    q = feedback.feedback_loop(stream, lambda: base, lambda df, n: seen.setdefault(n, sorted(map(tuple, df.collect()))), str(tmp_path / "c"), now)
    q.awaitTermination(120)
    batch = src.select(F.col("user_id").alias("relation_id"), (F.col("event_type") != "error").alias("is_valid"), F.least(F.lit(1.0), F.col("value") / 500).alias("signal"), F.col("ts").cast("timestamp").alias("validated_at"))
    assert seen[0] == sorted(map(tuple, reasoning.act(base, reasoning.orient(batch, now)).collect()))


def test_exact_limits_start_at_first_use(spark, tmp_path):
    rows = [(1, 1, "2024-01-01 00:50:00"), (1, 2, "2024-01-01 01:10:00"), (1, 3, "2024-01-01 01:51:00"), (2, 4, "2024-01-01 00:00:00")]
    spark.createDataFrame(rows, "user_id long, event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("user_id long, event_id long, ts timestamp").parquet(str(tmp_path / "e"))
    q = feedback.exact_limits(stream, 1, 10).writeStream.format("memory").queryName("limits").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.event_id, r.allowed) for r in spark.sql("SELECT * FROM limits").collect()} == {(1, True), (2, False), (3, True), (4, True)}


def test_lookups_refuse_and_fall_back(spark):
    import pytest

    from kgeo.functions import geometry as g
    from kgeo.operators import lookups

    names = spark.createDataFrame([(1, "whale"), (2, "Ahab"), (3, "sea")], "id long, text string")
    with pytest.raises(ValueError, match="not found: ship"):
        lookups.touch(names, spark.createDataFrame([("ship",), ("sea",)], "text string"), "now")
    sequence = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (2, 1, 0), (2, 3, 1)], "relation_id long, composition_id long, ordinal int")
    rating = spark.createDataFrame([(1, 1500.0, 3), (2, 1700.0, 5)], "relation_id long, rating double, observations long")
    assert [tuple(r) for r in lookups.walk_seeds(sequence, rating, names, "the Whale, Sea?").collect()] == [(1, 1), (3, 1)]
    assert [tuple(r) for r in lookups.walk_seeds(sequence, rating, names, "of no use").collect()] == [(1, 0)]
    assert [tuple(r) for r in lookups.name_answers(sequence, names, "WHALE").collect()] == [("Ahab", 2), ("sea", 1)]
    assert lookups.first_cell(names.filter("id > 5")) is None
    numbers = spark.createDataFrame([([],), ([0.0, 2.0, 0.0, 0.0],)], "a array<double>")
    assert [r[0] and tuple(r[0]) for r in numbers.select(g.centroid_of_numbers(F.col("a"))).collect()] == [None, (0.0, 1.0, 0.0, 0.0)]
    with pytest.raises(Exception, match="multiple of 4"):
        spark.createDataFrame([([1.0],)], "a array<double>").select(g.centroid_of_numbers(F.col("a"))).collect()


def test_exploded_runs_are_not_broadcast(spark):
    """the driver would hold a row for every character of every composition."""
    names = spark.range(100).select("id", F.col("id").cast("string").alias("text"))
    atoms_of = names.select("id", F.posexplode(F.split(F.repeat("text", 50), "")).alias("ordinal", "ch")).select("id", "ordinal", F.ascii("ch").alias("codepoint"), F.lit(1).alias("occurrences"))
    places = spark.range(200).select("id", *[F.rand(k).alias(c) for k, c in enumerate("xyzw")])
    atom = atoms_of.select("codepoint").distinct().select("codepoint", *[F.lit(0.5).alias(c) for c in "xyzw"])
    out = lookups.composition_details(atoms_of, places, atom)
    assert "SortMergeJoin [id#" in out._jdf.queryExecution().sparkPlan().toString()
    assert out.count() == atoms_of.count()


def test_nearest_within_finds_all_through_leaves(spark, monkeypatch):
    """F8: a cell's neighbours are sought in leaves; a row per pair within the radius filled the disk."""
    monkeypatch.setattr(voronoi, "LEAF", 40)
    rng = np.random.default_rng(8)
    p = rng.standard_normal((400, 4))
    p[100:200] = p[100]  # copies
    p[300:340, 0] += 9  # a dense spot
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    places = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double, z double, w double")
    for k, radius in ((5, 0.9), (32, 0.5)):
        got = {r.id: r for r in voronoi.nearest_within(places, k, radius).collect()}
        assert sorted(got) == [*range(400)]
        for i, r in got.items():
            near = [j for j in range(400) if j != i and np.sqrt(np.square(p[j] - p[i]).sum()) <= radius]
            want = sorted(near, key=lambda j: (round(-float(p[j] @ p[i]), 12), j))[:k]
            assert {*want} <= {*r.others} and len(r.points) == 4 * len(r.others) and len({*r.others}) == len(r.others)
            assert len(r.others) <= 12 * (k + 2)


def test_boundary_concepts_count_the_edges_once(spark, tmp_path):
    """the edges were made anew for each use of the places, and copies of places were broadcast."""
    folder = str(tmp_path)

    def seen(batches):
        import tempfile

        tempfile.mkstemp(dir=folder)
        yield from batches

    rng = np.random.default_rng(6)
    p = rng.standard_normal((60, 4))
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    places = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double, z double, w double")
    edges = spark.createDataFrame([(i, j) for i in range(70) for j in range(i % 12)], "src long, dst long").coalesce(1).mapInPandas(seen, "src long, dst long")
    got = voronoi.boundary_concepts(places, edges, degree=8, volume=1.0).collect()
    assert sorted(r.id for r in got) == [i for i in range(60) if i % 12 >= 8]
    assert len([*tmp_path.iterdir()]) == 1
