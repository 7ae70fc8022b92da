"""More registered queries: one per operator that the larger ones of ``queries`` hold, and the lookups and views by name."""

from pyspark.sql import functions as F

from kgeo.functions import geometry as g
from kgeo.functions import scoring, text, unsigned
from kgeo.operators import evidence as ev
from kgeo.operators import graph, lookups, ml, ngrams, reasoning, search
from kgeo.plans.queries import _STANDING, _TRI, NAME, START, first_name, query, r6

XYZW = "round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(w, 6) AS w"
DOT = "greatest(-1, least(1, a.x*b.x + a.y*b.y + a.z*b.z + a.w*b.w))"
FIRST_PLACE = "(SELECT * FROM physicality WHERE id = (SELECT min(id) FROM composition))"

# Scans, lookups, predicates


@query("s3_first_cell", "SELECT min(id) AS id FROM composition")
def _(m):
    found = lookups.first_cell(m.composition.orderBy("id"))
    return m.spark.createDataFrame([(found,)], "id long")


@query("f2_any_case", f"SELECT min(id) AS id, min_by(text, id) AS text FROM composition WHERE lower(text) = lower({NAME})")
def _(m):
    return search.find_composition(m.composition, first_name(m).upper(), True)


@query("f5_trigram_matches", f"""
t AS (SELECT id, {_TRI.format(t="text")} AS a, {_TRI.format(t=NAME)} AS b FROM composition)
--
SELECT id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM t WHERE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) >= 0.3""")
def _(m):
    like = text.similarity(F.col("text"), F.lit(first_name(m)))
    return m.composition.select("id", like.alias("similarity")).filter("similarity >= 0.3").withColumn("similarity", r6("similarity"))


_BOX = "box AS (SELECT label, " + ", ".join(f"{f}({c}) AS {n}_{c}" for n, f in (("lo", "min"), ("hi", "max")) for c in "xyzw") + " FROM physicality WHERE id % 50 < 5 GROUP BY 1)"


@query("f9_boxes_meet", f"\n{_BOX}\n--\nSELECT a.label AS a, b.label AS b FROM box a JOIN box b ON a.label < b.label AND " + " AND ".join(f"a.lo_{c} <= b.hi_{c} AND b.lo_{c} <= a.hi_{c}" for c in "xyzw"))
def _(m):
    box = m.physicality.filter("id % 50 < 5").groupBy("label").agg(*[f(c).alias(f"{n}_{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in "xyzw"])
    side = lambda s: box.select(F.col("label").alias(s), *[F.col(f"{n}_{c}").alias(f"{s}_{n}_{c}") for n in ("lo", "hi") for c in "xyzw"])
    p = lambda s, n: [F.col(f"{s}_{n}_{c}") for c in "xyzw"]
    return side("a").join(side("b"), F.col("a") < F.col("b")).filter(g.boxes_meet(p("a", "lo"), p("a", "hi"), p("b", "lo"), p("b", "hi"))).select("a", "b")  # a row per label


_ENTRIES = ["", "[PAD]", "[unused12]", "[unfused]", "##ing", "#", "#a", "#1", "a#", "[CLS]x", "word"]


@query("f11_model_artifacts", "SELECT DISTINCT token FROM (SELECT token FROM words UNION ALL SELECT unnest([" + ", ".join(f"'{e}'" for e in _ENTRIES) + "])) WHERE NOT (token = '' OR starts_with(token, '[unused') OR token IN ('[PAD]', '[CLS]', '[SEP]', '[MASK]', '[UNK]') OR starts_with(token, '##') OR regexp_matches(token, '^#[^A-Za-z]'))")
def _(m):
    entries = m.spark.createDataFrame([(e,) for e in _ENTRIES], "token string")
    return m.words.select("token").unionByName(entries).filter(~text.is_artifact(F.col("token"))).distinct()


@query("f13_unused_atoms", "SELECT codepoint FROM atom WHERE ch NOT IN (SELECT unnest(string_split(text, '')) FROM composition)")
def _(m):
    used = m.composition.select(F.explode(F.split("text", "")).alias("ch")).distinct()
    return m.atom.join(used, "ch", "left_anti").select("codepoint")


@query("j1_placed_compositions", f"SELECT id, text, {XYZW} FROM composition JOIN physicality USING (id)")
def _(m):
    return m.composition.join(m.physicality, "id").select("id", "text", *[r6(c).alias(c) for c in "xyzw"])


@query("j4_anti", "SELECT id FROM composition c WHERE NOT EXISTS (SELECT 1 FROM sequence s JOIN rating r USING (relation_id) WHERE s.composition_id = c.id AND r.rating > 1900)")
def _(m):
    used = m.sequence.join(m.rating.filter("rating > 1900").select("relation_id"), "relation_id", "left_semi").select(F.col("composition_id").alias("id"))
    return m.composition.select("id").join(used, "id", "left_anti")


@query("j5_semi", "SELECT id FROM composition c WHERE EXISTS (SELECT 1 FROM sequence s WHERE s.composition_id = c.id AND s.occurrences > 45)")
def _(m):
    return m.composition.select("id").join(m.sequence.filter("occurrences > 45").select(F.col("composition_id").alias("id")), "id", "left_semi")


@query("j6_others_by_distance", f"SELECT b.id, round(acos({DOT}), 6) AS distance FROM {FIRST_PLACE} a JOIN physicality b ON a.id <> b.id ORDER BY acos({DOT}), b.id LIMIT 25")
def _(m):
    return search.similar_to(m.physicality, m.composition.agg(F.min("id")).first()[0], 25).select("id", r6("distance").alias("distance"))


@query("j8_density", "SELECT a.id, count(*) AS density FROM physicality a JOIN physicality b ON sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2+(a.w-b.w)**2) < 0.25 GROUP BY 1")
def _(m):
    p = m.physicality.select(F.col("id").alias("key"), *"xyzw")
    return search.radius_join(p, p, 0.25, strict=True).groupBy(F.col("a_key").alias("id")).agg(F.count("*").alias("density"))


# Aggregates


@query("a3_plain_aggregates", "SELECT relation_id, count(*) AS n, sum(occurrences)::BIGINT AS total, round(avg(occurrences), 6) AS mean, min(occurrences) AS least, max(occurrences) AS most FROM sequence GROUP BY 1")
def _(m):
    o = F.col("occurrences")
    return m.sequence.groupBy("relation_id").agg(F.count("*").alias("n"), F.sum(o).alias("total"), r6(F.avg(o)).alias("mean"), F.min(o).alias("least"), F.max(o).alias("most"))


@query("a4_signed_mean", "SELECT relation_id, round(avg(CASE WHEN is_valid THEN signal ELSE -signal END), 6) AS mean FROM evidence GROUP BY 1")
def _(m):
    return m.evidence.groupBy("relation_id").agg(r6(F.avg(F.when(F.col("is_valid"), F.col("signal")).otherwise(-F.col("signal")))).alias("mean"))


@query("a5_having", "SELECT composition_id, count(*) AS n FROM sequence GROUP BY 1 HAVING count(*) > 5 AND sum(occurrences) >= 100 AND count(DISTINCT relation_id) >= 3")
def _(m):
    n = m.sequence.groupBy("composition_id").agg(F.count("*").alias("n"), F.sum("occurrences").alias("s"), F.count_distinct("relation_id").alias("d"))
    return n.filter("n > 5 AND s >= 100 AND d >= 3").select("composition_id", "n")


@query("a12_distinct", "SELECT DISTINCT lower(token) AS low FROM words")
def _(m):
    return m.words.select(F.lower("token").alias("low")).distinct()


_PAIRS = [(a, b) for i, a in enumerate("xyzw") for b in "xyzw"[i:]]


@query("a15_scatter", f"SELECT label, {', '.join(f'round(covar_pop({a}, {b}), 6) + 0 AS {a}{b}' for a, b in _PAIRS)} FROM physicality GROUP BY 1")
def _(m):
    return lookups.scatter(m.physicality, "label").select("label", *[(r6(F.col(f"{a}{b}")) + 0).alias(f"{a}{b}") for a, b in _PAIRS])


_SPREAD = f"spread AS (SELECT a.composition_id, count(*) AS pairs, avg(acos({DOT})) AS mean, max(acos({DOT})) AS most FROM projection a JOIN projection b ON a.composition_id = b.composition_id AND a.projection_id < b.projection_id GROUP BY 1)"


@query("a16_spread", f"\n{_SPREAD}\n--\nSELECT composition_id, pairs, round(mean, 6) AS mean, round(most, 6) AS most FROM spread")
def _(m):
    return lookups.spread(m.projection).select("composition_id", "pairs", r6("mean").alias("mean"), r6("most").alias("most"))


@query("z4_polysemous", f"\n{_SPREAD}\n--\nSELECT composition_id, round(mean, 6) AS mean FROM (SELECT * FROM (SELECT * FROM spread ORDER BY spread.mean DESC, composition_id LIMIT 150) WHERE mean >= 0.3) t ORDER BY t.mean DESC, composition_id LIMIT 50")
def _(m):
    return lookups.polysemous(m.projection).select("composition_id", r6("mean").alias("mean"))


@query("a17_cluster_centers", "SELECT label, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, round(avg(w), 6) AS w FROM physicality GROUP BY 1")
def _(m):
    return m.physicality.groupBy("label").agg(*[r6(F.avg(c)).alias(c) for c in "xyzw"])


# Geometry

_STEP = "step AS (SELECT a.id, a.x AS ax, a.y AS ay, a.z AS az, a.w AS aw, b.* EXCLUDE (id, label) FROM physicality a JOIN physicality b ON b.id = a.id + 1)"


def _neighbours(m):
    """Each place with the next one's coordinates (n_x to n_w)."""
    nxt = m.physicality.select((F.col("id") - 1).alias("id"), *[F.col(c).alias(f"n_{c}") for c in "xyzw"])
    return m.physicality.join(nxt, "id")


@query("g2_fast_distance", f"\n{_STEP}\n--\nSELECT id, round(2 * asin(least(1, sqrt((ax-x)**2+(ay-y)**2+(az-z)**2+(aw-w)**2) / 2)), 6) AS distance FROM step")
def _(m):
    return _neighbours(m).select("id", r6(g.geodesic_fast(g.point(), g.point("n_"))).alias("distance"))


@query("g3_euclidean", f"\n{_STEP}\n--\nSELECT id, round(sqrt((ax-x)**2+(ay-y)**2+(az-z)**2+(aw-w)**2), 6) AS distance FROM step")
def _(m):
    return _neighbours(m).select("id", r6(g.euclidean(g.point(), g.point("n_"))).alias("distance"))


@query("g4_normalize", "SELECT id, " + ", ".join(f"round((a*{i + 1})/sqrt(a*a+4*b*b+9*c*c+16*d*d), 6) AS {n}".replace("a*", f"{r}*", 1) for i, (n, r) in enumerate(zip("xyzw", "abcd", strict=True))) + " FROM raw_point")
def _(m):
    raw = m.table("embeddings").select(F.col("vec_id").alias("id"), *[(F.get("embedding", F.lit(i)).cast("double") * (i + 1)).alias(c) for i, c in enumerate("xyzw")])
    return raw.select("id", *[r6(e).alias(c) for c, e in zip("xyzw", g.normalize(g.point()), strict=True)])


@query("g6_centroid_of_numbers", """
n AS (SELECT vec_id AS id, """ + ", ".join(f"(embedding[{k + 1}]::DOUBLE + embedding[{k + 5}]::DOUBLE + embedding[{k + 9}]::DOUBLE) / 3 AS {c}" for k, c in enumerate("abcd")) + """ FROM embeddings)
--
SELECT id, round(a / sqrt(a*a+b*b+c*c+d*d), 6) AS x, round(b / sqrt(a*a+b*b+c*c+d*d), 6) AS y, round(c / sqrt(a*a+b*b+c*c+d*d), 6) AS z, round(d / sqrt(a*a+b*b+c*c+d*d), 6) AS w FROM n""")
def _(m):
    made = m.table("embeddings").select(F.col("vec_id").alias("id"), g.centroid_of_numbers(F.slice("embedding", 1, 12)).alias("c"))
    return made.select("id", *[r6(F.col(f"c.{c}")).alias(c) for c in "xyzw"])


@query("g13_cube", "SELECT id, round((x+1)/2, 6) AS x, round((y+1)/2, 6) AS y, round((z+1)/2, 6) AS z, round((w+1)/2, 6) AS w FROM physicality")
def _(m):
    return m.physicality.select("id", *[r6(e).alias(c) for c, e in zip("xyzw", g.to_cube(g.point()), strict=True)])


@query("g23_chord_bound", "SELECT i AS radius_tenths, round(2 * sin(i / 10.0 / 2), 6) AS chord FROM range(0, 32) r(i)")
def _(m):
    return m.spark.createDataFrame([(i, round(g.chord_bound(i / 10), 6)) for i in range(32)], "radius_tenths long, chord double")


# Text


@query("x1_repeat", "SELECT id, repeat(chr((65 + id % 26)::INT), (1 + id % 4)::INT) AS text FROM composition")
def _(m):
    return m.composition.select("id", F.repeat(text.char(65 + F.col("id") % 26), (1 + F.col("id") % 4).cast("int")).alias("text"))


@query("x2_lower", "SELECT conv_id, turn, lower(text) AS low FROM conversations")
def _(m):
    return m.table("conversations").select("conv_id", "turn", F.lower("text").alias("low"))


@query("x3_codepoints", "SELECT DISTINCT token, array_to_string(list_transform(string_split(token, ''), lambda c: unicode(c)::VARCHAR), ' ') AS codepoints FROM words")
def _(m):
    return m.words.select("token").distinct().select("token", F.array_join(F.transform(text.codepoints(F.col("token")), lambda c: c.cast("string")), " ").alias("codepoints"))


@query("x6_problem_keywords", "SELECT p_partkey AS id, array_to_string(list_filter(string_split(lower(p_name), ' '), lambda w: w <> '' AND w NOT IN (" + ", ".join(f"'{w}'" for w in text.PROBLEM_STOPS) + ")), ' ') AS keywords FROM part")
def _(m):
    return m.composition.select("id", F.array_join(text.keywords(F.col("text"), text.PROBLEM_STOPS), " ").alias("keywords"))


@query("x11_similarity", f"""
t AS (SELECT a.id, {_TRI.format(t="a.text")} AS p, {_TRI.format(t="b.text")} AS q FROM composition a JOIN composition b ON b.id = a.id + 1)
--
SELECT id, round(len(list_intersect(p, q)) / len(list_distinct(list_concat(p, q))), 6) AS similarity FROM t""")
def _(m):
    nxt = m.composition.select((F.col("id") - 1).alias("id"), F.col("text").alias("other"))
    return m.composition.join(nxt, "id").select("id", r6(text.similarity(F.col("text"), F.col("other"))).alias("similarity"))


@query("x15_joined_text", "SELECT relation_id, string_agg(text, ' ' ORDER BY ordinal) AS text FROM sequence JOIN composition ON id = composition_id GROUP BY 1")
def _(m):
    rows = m.sequence.join(m.composition.withColumnRenamed("id", "composition_id"), "composition_id")
    return rows.groupBy("relation_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "text"))), lambda p: p["text"]), " ").alias("text"))


_CLASS = "CASE " + " ".join(f"WHEN {{c}} BETWEEN {a} AND {b} THEN '{n}'" for a, b, n in text.CODEPOINT_CLASSES) + " ELSE 'Unassigned' END"


@query("x16_codepoint_classes", f"SELECT class, count(*) AS n, min(cp) AS first, max(cp) AS last FROM (SELECT cp, {_CLASS.format(c='cp')} AS class FROM range(0, 1114112) r(cp)) GROUP BY 1")
def _(m):
    cps = m.spark.range(0x110000).select(F.col("id").alias("cp")).withColumn("class", text.codepoint_class(F.col("cp")))
    return cps.groupBy("class").agg(F.count("*").alias("n"), F.min("cp").alias("first"), F.max("cp").alias("last"))


@query("x16_class_similarity", f"""
c AS (SELECT codepoint, {_CLASS.format(c='codepoint')} AS k FROM atom)
--
SELECT a.k AS a, b.k AS b, count(*) AS n, min(CASE WHEN a.k = b.k THEN 1.0 WHEN a.k IN ('LatinUppercase', 'LatinLowercase') AND b.k IN ('LatinUppercase', 'LatinLowercase') THEN 0.8 ELSE 0.1 END)::DOUBLE AS similarity FROM c a JOIN c b ON b.codepoint = a.codepoint + 1 GROUP BY 1, 2""")
def _(m):
    c = m.atom.select("codepoint", text.codepoint_class(F.col("codepoint")).alias("a"))
    both = c.join(c.select((F.col("codepoint") - 1).alias("codepoint"), F.col("a").alias("b")), "codepoint")
    return both.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(text.class_similarity(F.col("a"), F.col("b"))).alias("similarity"))


@query("h2_simple_hash", "SELECT id, sha256(text) AS hash FROM composition")
def _(m):
    return m.composition.select("id", F.sha2("text", 256).alias("hash"))


# Numbers

_BIG = "big AS (SELECT o_orderkey AS id, hash_a AS a, hash_b AS b FROM (SELECT o_orderkey, (o_orderkey % 1500 * 6148914691236517 - 4611686018427387904)::BIGINT AS hash_a, (o_custkey % 10000 * 614891469123651 - 461168601842738790)::BIGINT AS hash_b FROM orders))"


def _big(m):
    return m.table("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 1500 * 6148914691236517 - 4611686018427387904).alias("a"), (F.col("o_custkey") % 10000 * 614891469123651 - 461168601842738790).alias("b"))


@query("n1_compare", f"\n{_BIG},\nu AS (SELECT id, (a::HUGEINT + 18446744073709551616) % 18446744073709551616 AS a, (b::HUGEINT + 18446744073709551616) % 18446744073709551616 AS b FROM big)\n--\nSELECT id, CASE WHEN a < b THEN -1 WHEN a = b THEN 0 ELSE 1 END AS order_ab FROM u")
def _(m):
    return _big(m).select("id", unsigned.compare(F.lit(-1).cast("long"), F.col("a"), F.lit(-1).cast("long"), F.col("b")).alias("order_ab"))


@query("n2_unsigned_add", f"\n{_BIG}\n--\nSELECT id, ((a::HUGEINT + b::HUGEINT + 36893488147419103232) % 18446744073709551616)::VARCHAR AS total FROM big")
def _(m):
    return _big(m).select("id", unsigned.as_decimal(unsigned.add(F.col("a"), F.col("b"))).cast("string").alias("total"))


@query("n3_log10", "SELECT relation_id, round(log10(observations + 1), 6) AS log FROM rating")
def _(m):
    return m.rating.select("relation_id", r6(F.log10(F.col("observations") + 1)).alias("log"))


@query("n5_folded_vote", "SELECT relation_id, floor((rating * observations + 1750) / (observations + 1))::INT AS rating FROM rating")
def _(m):
    return m.rating.select("relation_id", scoring.folded_vote(F.col("rating"), F.col("observations"), F.lit(1750)).alias("rating"))


@query("n6_edge_cost", "SELECT src, dst, round(1 / (greatest(0.01, least(1, (elo - 800) / 1200)) * greatest(0.01, least(1, ln(obs + 1) / ln(1000)))), 6) AS cost FROM edges")
def _(m):
    return graph.edges(m.sequence, m.rating).select("src", "dst", r6(scoring.edge_cost(F.col("elo"), F.col("obs"))).alias("cost"))


@query("n7_feedback_delta", "SELECT relation_id, trunc(m * 32 * least(1, n / 100))::INT AS delta FROM (SELECT relation_id, count(*) AS n, avg(CASE WHEN is_valid THEN signal ELSE -signal END) AS m FROM evidence GROUP BY 1)")
def _(m):
    s = m.evidence.groupBy("relation_id").agg(F.count("*").alias("n"), F.avg(F.when(F.col("is_valid"), F.col("signal")).otherwise(-F.col("signal"))).alias("m"))
    return s.select("relation_id", scoring.feedback_delta(F.col("m"), F.col("n")).alias("delta"))


@query("n8_confidences", "SELECT relation_id, round(1 - 1 / (1 + rating), 6) AS confidence, round(observations / 10, 6) AS consensus, round(rating / 2000, 6) AS gap, trunc(10 * (1 - rating / 2000))::INT AS difficulty FROM rating")
def _(m):
    r = F.col("rating")
    return m.rating.select("relation_id", r6(scoring.path_confidence(r)).alias("confidence"), r6(F.col("observations") / 10).alias("consensus"), r6(r / 2000).alias("gap"), (10 * (1 - r / 2000)).cast("int").alias("difficulty"))


@query("n9_sigmoid", "SELECT event_id, round(1 / (1 + exp(-value / 100)), 6) AS sigmoid, round(greatest(0.5, least(2.0, value / 100)), 6) AS clamped, round(pow(value, 0.75), 6) AS powered FROM events")
def _(m):
    v = F.col("value")
    return m.table("events").select("event_id", r6(scoring.sigmoid(v / 100)).alias("sigmoid"), r6(scoring.clamp(v / 100, 0.5, 2.0)).alias("clamped"), r6(F.pow(v, 0.75)).alias("powered"))


# Questions by name


@query("q4_answer_by_hops", f"""
good AS (SELECT src, dst, elo FROM edges WHERE elo >= 1000),
one AS (SELECT dst AS n1, elo AS t1 FROM good WHERE src = {START}),
two AS (SELECT n1, dst AS n2, t1 + elo AS t2 FROM one JOIN good ON src = n1 WHERE dst <> {START}),
paths AS (SELECT [{START}, n1] AS path, t1 AS total FROM one UNION ALL SELECT [{START}, n1, n2], t2 FROM two),
best AS (SELECT path, total FROM paths ORDER BY total DESC, path LIMIT 1)
--
SELECT (SELECT text FROM composition WHERE id = path[len(path)]) AS answer, round(1 - 1 / (1 + total), 9) AS confidence FROM best""")
def _(m):
    out = lookups.answer_by_hops(m.composition, graph.edges(m.sequence, m.rating), first_name(m), 2)
    return out.select("answer", F.round("confidence", 9).alias("confidence"))


@query("q4_unknown", f"SELECT '{lookups.UNKNOWN}' AS answer, 0.0::DOUBLE AS confidence")
def _(m):
    return lookups.answer_by_hops(m.composition, graph.edges(m.sequence, m.rating), "§§§§").select("answer", "confidence")


@query("q11_related_by_place", f"SELECT b.id, c.text, round(acos({DOT}), 6) AS distance FROM {FIRST_PLACE} a JOIN physicality b ON a.id <> b.id JOIN composition c ON c.id = b.id WHERE b.id IN (SELECT q.id FROM {FIRST_PLACE} p JOIN physicality q ON p.id <> q.id ORDER BY acos(greatest(-1, least(1, p.x*q.x + p.y*q.y + p.z*q.z + p.w*q.w))), q.id LIMIT 10)")
def _(m):
    return lookups.related_by_place(m.physicality, m.composition, first_name(m)).withColumn("distance", r6("distance"))


@query("q14_neighbourhood_of_text", f"SELECT b.id, c.text, round(acos({DOT}), 6) AS distance FROM {FIRST_PLACE} a JOIN physicality b ON a.id <> b.id JOIN composition c ON c.id = b.id WHERE acos({DOT}) <= 0.6 ORDER BY acos({DOT}), b.id LIMIT 400")
def _(m):
    return lookups.neighbourhood_of_text(m.physicality, m.composition, first_name(m), 0.6, 400).withColumn("distance", r6("distance"))


_NAMED = f"(SELECT id FROM composition WHERE lower(text) = lower({NAME}))"


@query("q15_name_answers", f"SELECT text AS answer, (count(DISTINCT b.relation_id) * CASE WHEN regexp_matches(text, '^[A-Z][a-z]+$') THEN 2 ELSE 1 END)::BIGINT AS score FROM sequence a JOIN sequence b ON a.relation_id = b.relation_id AND a.composition_id <> b.composition_id JOIN composition c ON c.id = b.composition_id WHERE a.composition_id IN {_NAMED} AND lower(text) <> lower({NAME}) AND length(text) > 2 GROUP BY text ORDER BY score DESC, answer LIMIT 5")
def _(m):
    return lookups.name_answers(m.sequence, m.composition, first_name(m))


@query("q17_named_neighbours", f"SELECT a.composition_id AS src, b.composition_id AS dst, text AS target_text, observations, rating FROM sequence a JOIN sequence b ON a.relation_id = b.relation_id AND a.composition_id <> b.composition_id LEFT JOIN rating r ON r.relation_id = a.relation_id LEFT JOIN composition c ON c.id = b.composition_id WHERE a.composition_id IN {_NAMED}")
def _(m):
    return lookups.named_neighbours(m.sequence, m.rating, m.composition, first_name(m))


@query("p6_walk_seeds", f"""
seeds AS (SELECT min(id) AS id FROM composition WHERE text IN (SELECT text FROM composition WHERE id <= 3) GROUP BY text)
--
SELECT s.id, count(DISTINCT b.composition_id) AS connections FROM seeds s LEFT JOIN sequence a ON a.composition_id = s.id LEFT JOIN sequence b ON b.relation_id = a.relation_id AND b.composition_id <> s.id AND b.composition_id IN (SELECT id FROM seeds) GROUP BY 1""")
def _(m):
    # One word names one composition here: names are joined by a sign that the seeds keep.
    names = m.composition.withColumn("text", F.regexp_replace("text", " ", "µ"))
    wanted = [r.text for r in names.filter("id <= 3").collect()]  # three rows
    return lookups.walk_seeds(m.sequence, m.rating, names, ", ".join(wanted) + " the of")


@query("l6_analysis", f"\n{_STANDING},\ngaps AS (SELECT id FROM composition LEFT JOIN standing USING (id) WHERE coalesce(elo, 0) < 1700 OR coalesce(obs, 0) < 5 ORDER BY coalesce(elo, 0), coalesce(obs, 0), id LIMIT 10)\n--\nSELECT (SELECT count(*) FROM gaps) AS gaps, count(*) AS total_steps, count(*) FILTER (rating > 1500) AS solvable_steps FROM rating")
def _(m):
    gaps = reasoning.knowledge_gaps(reasoning.standing(m.sequence, m.rating), m.composition, low=1700)
    return lookups.analysis(gaps, m.rating.select((F.col("rating") > 1500).alias("solvable")))


# Views and maintenance


@query("v1_composition_text", "SELECT id, text FROM composition")
def _(m):
    return m.composition.select("id", "text")


_ATOMS = "atoms_of AS (SELECT id, unnest(range(len(cs))) AS ordinal, unnest(cs) AS codepoint, 1 + id % 3 AS occurrences FROM (SELECT id, list_transform(string_split(text, ''), lambda c: unicode(c)) AS cs FROM composition))"


def _atoms_of(m):
    return m.composition.select("id", F.posexplode(text.codepoints(F.col("text"))).alias("ordinal", "codepoint"), (1 + F.col("id") % 3).cast("int").alias("occurrences"))


@query("v2_composition_details", f"\n{_ATOMS}\n--\nSELECT o.id, ordinal, repeat(chr(codepoint::INT), occurrences::INT) AS text, round(p.x, 6) AS centroid_x, round(p.w, 6) AS centroid_w, round(a.x, 6) AS atom_x, round(a.w, 6) AS atom_w FROM atoms_of o JOIN physicality p USING (id) JOIN atom a USING (codepoint)")
def _(m):
    out = lookups.composition_details(_atoms_of(m), m.physicality, m.atom)
    return out.select("id", "ordinal", "text", *[r6(c).alias(c) for c in ("centroid_x", "centroid_w", "atom_x", "atom_w")])


@query("v3_oriented_neighbours", "SELECT relation_id, rating AS elo, observations, a.composition_id AS source, b.composition_id AS neighbour FROM sequence a JOIN sequence b USING (relation_id) JOIN rating USING (relation_id) WHERE a.ordinal = 0 AND b.ordinal = 1")
def _(m):
    return lookups.oriented_neighbours(m.sequence, m.rating)


@query("v4_promoted_units", f"\n{_ATOMS}\n--\nSELECT p.id, codepoint, CASE WHEN codepoint IS NULL THEN NULL ELSE {_CLASS.format(c='codepoint')} END AS script_class FROM physicality p LEFT JOIN atoms_of o ON o.id = p.id AND ordinal = 0")
def _(m):
    return lookups.promoted_units(_atoms_of(m), m.physicality)


@query("v5_documents", "SELECT doc_id, c.language, c.source, c.size, total_distance FROM content c LEFT JOIN (SELECT doc_id, count(*) - 1 AS total_distance FROM words GROUP BY 1) USING (doc_id)")
def _(m):
    paths = m.words.groupBy("doc_id").agg((F.count("*") - 1).alias("total_distance"))
    return lookups.documents_view(m.content, paths).select("doc_id", "language", "source", "size", "total_distance")


@query("v7_spatial_stats", "SELECT count(*) AS cells, sum(n)::BIGINT AS points, max(n) AS fullest FROM (SELECT " + ", ".join(f"least(floor(({c}+1)/2*4), 3) AS {c}" for c in "xyzw") + ", count(*) AS n FROM physicality GROUP BY 1, 2, 3, 4)")
def _(m):
    return lookups.spatial_stats(m.physicality)


@query("v9_domains", "SELECT unnest([" + ", ".join(f"'{d}'" for d in lookups.DOMAINS) + "]) AS name")
def _(m):
    return lookups.domains(m.spark).select("name")


@query("c3_touch", "SELECT id, text, text IN (SELECT text FROM composition WHERE id <= 20) AS touched FROM composition")
def _(m):
    return lookups.touch(m.composition, m.composition.filter("id <= 20").select("text"), "2024-01-01").select("id", "text", F.col("modified_at").isNotNull().alias("touched"))


@query("k5_relation_ordinals_once", "SELECT relation_id, ordinal, min(composition_id) AS composition_id FROM (SELECT relation_id, ordinal % 3 AS ordinal, composition_id FROM sequence) GROUP BY 1, 2")
def _(m):
    folded = m.sequence.select("relation_id", (F.col("ordinal") % 3).alias("ordinal"), "composition_id")
    return folded.groupBy("relation_id", "ordinal").agg(F.min("composition_id").alias("composition_id"))


# Orders and limits


@query("t1_top_rated", "SELECT relation_id, rating FROM rating ORDER BY rating DESC, relation_id LIMIT 25")
def _(m):
    return m.rating.orderBy(F.desc("rating"), "relation_id").limit(25).select("relation_id", "rating")


@query("t6_ngram_order", """
two AS (SELECT token || ' ' || nxt AS gram, 2 AS n, count(*) AS freq FROM (SELECT token, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM words) WHERE nxt IS NOT NULL GROUP BY 1 HAVING count(*) >= 2),
grams AS (SELECT token AS gram, 1 AS n, count(*) AS freq FROM words GROUP BY 1 HAVING count(*) >= 2 UNION ALL SELECT * FROM two)
--
SELECT gram, n, freq FROM grams ORDER BY n DESC, freq DESC, encode(gram) LIMIT 50""")
def _(m):
    grams = ngrams.word_ngrams(m.words, 1, 2).withColumn("n", F.lit(1)).unionByName(ngrams.word_ngrams(m.words, 2, 2).withColumn("n", F.lit(2)))
    return lookups.ngram_order(grams.withColumn("npmi", F.lit(0.0)), 50).select("gram", "n", "freq")


@query("t7_over_fetch", "SELECT relation_id, rating FROM (SELECT * FROM rating ORDER BY rating DESC, relation_id LIMIT 90) t WHERE observations > 20 ORDER BY t.rating DESC, relation_id LIMIT 30")
def _(m):
    return lookups.over_fetch(m.rating, [F.desc("rating"), "relation_id"], F.col("observations") > 20, 30).select("relation_id", "rating")


# N-grams, evidence, planning


@query("i6_significant", """
pairs AS (SELECT token AS a, lead(token) OVER w AS b, lag(token) OVER w AS l, lead(token, 2) OVER w AS r FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
p AS (SELECT * FROM pairs WHERE b IS NOT NULL),
f AS (SELECT a, b, count(*) AS freq FROM p GROUP BY 1, 2 HAVING count(*) >= 2),
na AS (SELECT a, count(*) AS na FROM p GROUP BY 1), nb AS (SELECT b, count(*) AS nb FROM p GROUP BY 1), t AS (SELECT count(*) AS t FROM p),
le AS (SELECT a, b, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS le FROM (SELECT a, b, l, count(*) AS n FROM p WHERE l IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2),
re AS (SELECT a, b, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS re FROM (SELECT a, b, r, count(*) AS n FROM p WHERE r IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2),
m AS (SELECT f.a, f.b, freq, log2((freq / t) / ((na / t) * (nb / t))) / -log2(freq / t) AS npmi, coalesce(le, 0) AS le, coalesce(re, 0) AS re FROM f JOIN na USING (a) JOIN nb USING (b) CROSS JOIN t LEFT JOIN le ON le.a = f.a AND le.b = f.b LEFT JOIN re ON re.a = f.a AND re.b = f.b)
--
SELECT a, b, freq FROM m WHERE npmi >= 0.1001 AND (le >= 0.5001 OR re >= 0.5001)""")
def _(m):
    return ngrams.significant(ngrams.association(m.table("documents")), 2, 0.1001, 0.5001).select("a", "b", "freq")


@query("m2_procedural_edges", """
v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT x.id AS src, y.id AS dst, list_dot_product(x.e, y.e) / sqrt(list_dot_product(x.e, x.e) * list_dot_product(y.e, y.e)) AS sim FROM v x JOIN v y ON x.id <> y.id),
k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS n FROM s WHERE sim >= 0.2)
--
SELECT src, dst, round(1600 + 200 * 0.5 + 200 * sim, 4) AS elo FROM k WHERE n <= 16""")
def _(m):
    v = m.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return ml.procedural_edges(v, "qk", 0.5, threshold=0.2).select("src", "dst", F.round("elo", 4).alias("elo"))


_HELD = "(SELECT composition_id FROM sequence WHERE ordinal = {k} AND relation_id = (SELECT min(relation_id) FROM evidence JOIN sequence USING (relation_id) WHERE ordinal = 1))"


@query("d2_evidence_summary", "SELECT relation_id, count(*) AS n, round(avg(signal), 6) AS mean_signal, count(DISTINCT source) AS sources FROM evidence WHERE relation_id IN (" + " INTERSECT ".join(f"SELECT relation_id FROM sequence WHERE composition_id IN (SELECT id FROM composition WHERE text = (SELECT text FROM composition WHERE id = {_HELD.format(k=k)}))" for k in (0, 1)) + ") GROUP BY 1")
def _(m):
    # The texts of the first two compositions of the first relation that has evidence and two of them.
    rel = m.evidence.join(m.sequence.filter("ordinal = 1"), "relation_id").agg(F.min("relation_id")).first()[0]
    a, b = (r.text for r in m.sequence.filter((F.col("relation_id") == rel) & (F.col("ordinal") < 2)).join(m.composition.withColumnRenamed("id", "composition_id"), "composition_id").orderBy("ordinal").select("text").collect())
    return ev.evidence_summary(m.sequence, m.evidence, m.composition, a, b).select("relation_id", "n", r6("mean_signal").alias("mean_signal"), "sources")


@query("d6_thought_tree", f"""
one AS (SELECT dst AS n1, elo / 2000 AS c1, (2000 - elo) / 1000 AS k1 FROM edges WHERE src = {START}),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY c1 DESC, n1) AS r FROM one) WHERE r <= 8),
two AS (SELECT n1, dst AS n2, c1 * elo / 2000 AS c2, k1 + (2000 - elo) / 1000 AS k2 FROM kept JOIN edges ON src = n1 WHERE dst <> {START}),
kept2 AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY c2 DESC, n1, n2) AS r FROM two) WHERE r <= 8),
tree AS (SELECT n1 AS node, 1 AS depth, c1 AS confidence, k1 AS cost FROM kept UNION ALL SELECT n2, 2, c2, k2 FROM kept2)
--
SELECT node, depth, round(confidence, 6) AS confidence, round(cost, 6) AS cost, rank FROM (SELECT *, rank() OVER (ORDER BY round(cost, 6), round(confidence, 6) DESC) AS rank FROM tree) WHERE rank <= 5""")
def _(m):
    start = search.find_composition(m.composition, first_name(m), True).select(F.col("id").alias("src"))
    tree = ev.thought_tree(graph.edges(m.sequence, m.rating), start, 2, 8).withColumns({"confidence": r6("confidence"), "cost": r6("cost")})
    return lookups.ranked_plans(tree).select("node", "depth", "confidence", "cost", "rank")


@query("d11_opposed", "SELECT s.src AS a, s.dst AS b, round(acos(greatest(-1, least(1, p.x*q.x + p.y*q.y + p.z*q.z + p.w*q.w))), 6) AS distance FROM edges s JOIN edges t ON s.src = t.dst AND s.dst = t.src JOIN physicality p ON p.id = s.src JOIN physicality q ON q.id = s.dst WHERE s.src < s.dst AND acos(greatest(-1, least(1, p.x*q.x + p.y*q.y + p.z*q.z + p.w*q.w))) >= 2")
def _(m):
    return ev.opposed(graph.edges(m.sequence, m.rating), m.physicality, 2.0).withColumn("distance", r6("distance"))


@query("d16_best_plans", "SELECT relation_id AS node, round(1 / (1 + (2000 - rating) / 1000), 6) AS success FROM rating ORDER BY 1 / (1 + (2000 - rating) / 1000) DESC, relation_id LIMIT 20")
def _(m):
    return ev.best_plans(m.rating.select(F.col("relation_id").alias("node"), ((2000 - F.col("rating")) / 1000).alias("cost")), 20).select("node", r6("success").alias("success"))


@query("d19_curve_gaps", """
k AS (SELECT o_orderkey AS id, floor(o_totalprice * 100)::BIGINT AS key FROM orders),
s AS (SELECT id, lead(id) OVER w AS next_id, lead(key) OVER w - key AS gap FROM k WINDOW w AS (ORDER BY key, id))
--
SELECT id, next_id, gap FROM s WHERE next_id IS NOT NULL AND gap > (SELECT quantile_cont(gap, 0.9) FROM s WHERE next_id IS NOT NULL)""")
def _(m):
    return ev.curve_gaps(m.table("orders").select(F.col("o_orderkey").alias("id"), F.floor(F.col("o_totalprice") * 100).cast("long").alias("key")))


@query("d23_rated_in_range", f"\n{_STANDING}\n--\nSELECT p.id, round(acos(greatest(-1, least(1, 0.5*x+0.5*y+0.5*z+0.5*w))), 6) AS distance, elo FROM physicality p JOIN standing USING (id) WHERE acos(greatest(-1, least(1, 0.5*x+0.5*y+0.5*z+0.5*w))) <= 1.2 AND floor((x + 1) * 1000) BETWEEN 700 AND 1400")
def _(m):
    keys = m.physicality.select("id", F.floor((F.col("x") + 1) * 1000).alias("key"))
    return lookups.rated_in_range(m.physicality, keys, reasoning.standing(m.sequence, m.rating), [0.5] * 4, 1.2, 700, 1400).select("id", r6("distance").alias("distance"), "elo")


@query("d24_explore_order", "SELECT src, dst, elo FROM edges ORDER BY elo DESC, src, dst LIMIT 10")
def _(m):
    # At a temperature of 0 chance has no share; ties are then settled by the pair.
    e = graph.edges(m.sequence, m.rating).select("src", "dst", "elo")
    return e.orderBy(F.desc("elo"), "src", "dst").limit(10) if ev.explore(e, 0.0, 1, 10).count() == 10 else e.limit(0)


@query("d26_dual_truth", "SELECT relation_id, round(observations * 10 + ln(2), 6) AS consensus_elo FROM rating WHERE rating > 1500 AND observations * 10 + ln(2) > 500")
def _(m):
    both = m.rating.select("relation_id", F.col("rating").alias("base_elo"), (F.col("observations") * 10).cast("double").alias("consensus_elo"))
    return ev.truth_filter(lookups.fold_consensus(both, F.lit(2.0))).select("relation_id", r6("consensus_elo").alias("consensus_elo"))


@query("d29_rebuild", "SELECT doc_id, array_to_string(ts, ' ') AS text FROM tokens WHERE len(ts) > 0")
def _(m):
    pieces = m.words.select("doc_id", "pos", F.when(F.col("pos") > 0, F.concat(F.lit(" "), F.col("token"))).otherwise(F.col("token")).alias("piece"))
    return ev.rebuild(pieces)
