"""Language ID, nearest neighbours, URL filter and the pipeline."""

import numpy as np
import pytest

from kgeo.llm import ann, language, url_filter

SF = "/root/testdata/sf0.001"


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs.filter(~language.held_out()).select("text", "lang"))
    got = language.identify(docs.filter(language.held_out()), model)
    right, n = got.selectExpr("sum(int(lang = lang_pred))", "count(*)").first()
    assert model.languages == ["de", "en", "es", "fr"] and right / n > 0.97
    assert got.filter("score < 0 OR score > 1").count() == 0


def test_language_edge_cases(spark):
    rows = [(1, "the cat and the dog are here", "en"), (2, "der Hund und die Katze sind da", "de")] * 20
    model = language.fit(spark.createDataFrame([r[1:] for r in rows] + [(None, "en"), ("123", "xx"), ("mot", None)], "text string, lang string"))
    assert model.languages == ["de", "en"]
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "12 !?", "c"), (4, "the dog", "d"), (5, "Ω≈ç√ жук жаба", "e"), (None, "die Katze " * 5000, "f"), (4, "the dog", "d")], "doc_id long, text string, score string")
    got = language.identify(odd, model).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "lang_pred", "score", "rejected"} and len(got) == 7
    by = {r.doc_id: r for r in got}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 and by[k].rejected for k in (1, 2, 3))
    assert by[4].lang_pred == "en" and not by[4].rejected and by[5].rejected and by[None].lang_pred == "de"
    none = language.fit(spark.createDataFrame([], "text string, lang string"))
    assert {r.lang_pred for r in language.identify(odd, none).collect()} == {"und"}
    assert language.identify(odd.limit(0), model).count() == 0


def test_centroid_search_is_brute_force(spark):
    texts = ["the cat and the dog", "der Hund und die Katze", "el gato y el perro"]
    idf = np.ones(language.DIM, np.float32)
    c = language.vectors(texts, idf)
    model = language.LanguageModel(["de", "en", "es"], c, np.array([1, 0, 2]), np.zeros(3), idf)
    best, near = model.predict([*texts, "cat cat"])
    assert best[:3].tolist() == [1, 0, 2] and np.allclose(near[:3], 1)
    v = language.vectors(["cat cat"], idf)[0]
    assert np.isclose(near[3], max(float(v @ x) for x in c))


def test_neighbours_reach_the_recall(spark):
    rng = np.random.default_rng(2)
    m = rng.standard_normal((6000, 16)).astype(np.float32)
    m[1000:1040] = m[20]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "vec_id long, embedding array<float>").selectExpr("*", "'p' AS part", "0.5 AS score")
    got = ann.search(df, df.filter("vec_id % 20 = 0"), block=700).collect()
    x = m.astype(float)
    hits = total = 0
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert len(by) == 300
    for q, rows in by.items():
        rows.sort(key=lambda r: r.rank)
        assert [r.rank for r in rows] == [*range(1, 21)] and q not in {r.vec_id for r in rows}
        s = x @ x[q]
        assert all(abs(r.score - s[r.vec_id]) < 1e-9 for r in rows)
        assert all((-a.score, a.vec_id) < (-b.score, b.vec_id) or abs(a.score - b.score) < 1e-12 for a, b in zip(rows, rows[1:]))
        s[q] = -np.inf
        hits += len({r.vec_id for r in rows} & {*np.lexsort((np.arange(6000), -s))[:20].tolist()})
        total += 20
    assert hits / total >= 0.9


def test_neighbour_edge_cases(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(12)] + [(20, None), (40, [0.0, 0.0]), (60, [float("inf"), 1.0]), (80, [1.0, None]), (100, [1.0]), (None, [1.0, 1.0]), (0, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, df.filter("vec_id % 20 = 0")).collect()
    assert {r.query_id for r in got} == {0}
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank)] == [*range(1, 12)]
    assert ann.search(df.limit(0), df).count() == 0 and ann.search(df, df.limit(0)).count() == 0


def test_parts_are_balanced():
    m = np.random.default_rng(4).standard_normal((900, 8))
    part = ann.balanced_parts(ann.neighbours(m, 8), 3, 1)
    n = np.bincount(part)
    assert len(n) == 8 and n.max() - n.min() <= 3


def parse(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    k = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[k:]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:k]), tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]


URLS = [None, "", "no scheme", "http://", "http://A.COM", "http://a.com/", "https://x.Example.com/en/1?a=b&c", "https://www.example.com/en/1", "http://notexample.com/en/", "http://b.net/es/z#f", "http://b.net?x=/es/", "http://b.net/fr/", "http://org.example.org/a/b/c?d=1", "ftp://é.net/es/", "x://y://z/p", "http://example.com/EN/", "HTTP://WWW.EXAMPLE.COM/en/#?", "http://a.com\nb/c", "http://n.net/" + "p" * 40_000]


def test_url_rules_and_parts(spark):
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(None, URLS[6], None), (6, URLS[6], "h")], "page_id long, url string, host string")
    got = url_filter.filter_urls(df, url_filter.RULES, trees=2).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        host, path = parse(r.url)
        assert (r.host, r.path) == (host, path), r.url
        fits = [x for x in url_filter.RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.name), default=None)
        assert r.rule == (best and best.name) and (best is None or r.verdict == best.verdict)
        assert r.verdict == (best.verdict if best else "block" if r.margin > 0 else "allow")
    empty = url_filter.filter_urls(df.limit(0), url_filter.RULES)
    assert empty.count() == 0
    none = url_filter.filter_urls(df.filter("page_id < 3"), url_filter.RULES).collect()
    assert {r.verdict for r in none} == {"allow"}


def test_trees_learn_what_is_there(spark):
    df = spark.range(4000).selectExpr("id AS page_id", "concat('http://', IF(id % 3 = 0, 'bad', 'good'), id % 40, '.example.', IF(id % 2 = 0, 'com', 'net'), '/', repeat(IF(id % 3 = 0, '9', 'a'), 12)) AS url")
    rules = [url_filter.Rule("block", f"bad{i}.example.com", "/") for i in range(40)] + [url_filter.Rule("allow", f"good{i}.example.com", "/") for i in range(40)]
    got = url_filter.filter_urls(df, rules).filter("rule IS NULL").selectExpr("(verdict = 'block') = (page_id % 3 = 0) AS ok")
    assert got.filter("ok").count() / got.count() > 0.95


def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from kgeo.llm.storage import materialize

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialize(stage(spark, before, SF), name)
        assert after.columns == docs.columns
        assert after.join(before, "doc_id", "left_anti").count() == 0 and 0 < after.count() <= before.count()
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert packed.select("doc_id").distinct().count() == before.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "minhash_near_dedup", "packing"]


def test_a_stage_takes_odd_rows(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    odd = spark.createDataFrame([(1, None, "en", "s", None), (2, "", None, None, 0), (None, "the cat and the dog", "en", "s", 19), (3, "the cat and the dog", "en", "s", 19), (3, "the cat and the dog", "en", "s", 19), (5, "a b", "en", "t", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, "").count() > 0
        assert stage(spark, odd.limit(0), "").count() == 0
