"""Operators over evidence and rated edges that combine counting, ranking and pruning.

``evidence``: relation_id, content_id, is_valid, signal, validated_at, source. ``edges``: src, dst, elo, obs."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgeo.functions import geometry as g
from kgeo.functions import scoring


def elo_from_evidence(evidence: DataFrame) -> DataFrame:
    """1500 + least(1000, 0.1 n) + 500 mean signal + least(200, 20 sources) per relation."""
    s = evidence.groupBy("relation_id").agg(F.count("*").alias("n"), F.avg("signal").alias("mean_signal"), F.count_distinct("source").alias("sources"))
    return s.withColumn("elo", scoring.evidence_rating(F.col("n"), F.col("mean_signal"), F.col("sources")))


def evidence_summary(sequence: DataFrame, evidence: DataFrame, names: DataFrame, a: str, b: str) -> DataFrame:
    """Evidence of the relations that hold both compositions: relation_id, n, mean_signal, sources, elo."""
    ids = {k: names.filter(F.col("text") == v).select("id") for k, v in (("a", a), ("b", b))}
    rel = None
    for k in "ab":
        one = sequence.join(ids[k].withColumnRenamed("id", "composition_id"), "composition_id", "left_semi").select("relation_id").distinct()
        rel = one if rel is None else rel.join(one, "relation_id", "left_semi")
    return elo_from_evidence(evidence.join(rel, "relation_id", "left_semi"))


def provenance(evidence: DataFrame, relations: DataFrame) -> DataFrame:
    return evidence.join(relations.select("relation_id").distinct(), "relation_id", "left_semi").orderBy("validated_at", "content_id")


def forget(evidence: DataFrame, drop: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Evidence without the rows that ``drop`` names; ratings anew of the relations that lost some; relations left with none."""
    kept = evidence.filter(~F.coalesce(drop, F.lit(False)))
    touched = evidence.filter(drop).select("relation_id").distinct()
    left = touched.join(kept.select("relation_id").distinct(), "relation_id", "left_semi")
    return kept, elo_from_evidence(kept.join(left, "relation_id", "left_semi")), touched.join(left, "relation_id", "left_anti")


def beam(paths: DataFrame, width: int) -> DataFrame:
    """The ``width`` heaviest paths of each depth (ties all stay)."""
    return paths.withColumn("rank", F.rank().over(Window.partitionBy("depth").orderBy(F.desc("weight")))).filter(F.col("rank") <= width)


def thought_tree(edges: DataFrame, start: DataFrame, depth: int = 3, width: int = 32) -> DataFrame:
    """Paths with confidence = product of elo / 2000 and cost = sum of (2000 - elo) / 1000, a beam kept per depth: start, node,
    depth, path, confidence, cost."""
    step = edges.select("src", "dst", "elo")
    now = start.select(F.col("src").alias("start"), F.col("src").alias("node"), F.array("src").alias("path"), F.lit(1.0).alias("confidence"), F.lit(0.0).alias("cost"))
    out = None
    for d in range(1, depth + 1):
        grown = now.join(step, F.col("node") == F.col("src")).filter(~F.array_contains("path", F.col("dst")))
        grown = grown.select("start", F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"), (F.col("confidence") * F.col("elo") / 2000).alias("confidence"), (F.col("cost") + (2000 - F.col("elo")) / 1000).alias("cost"))
        now = grown.withColumn("_r", F.row_number().over(Window.partitionBy("start").orderBy(F.desc("confidence"), "path"))).filter(F.col("_r") <= width).drop("_r")
        level = now.withColumn("depth", F.lit(d))
        out = level if out is None else out.unionByName(level)
    return out


def prune_by_percentile(paths: DataFrame, share: float = 0.8) -> DataFrame:
    """Paths at or above the percentile of confidence of their depth."""
    cut = paths.groupBy("depth").agg(F.percentile("confidence", share).alias("cut"))
    return paths.join(cut, "depth").filter(F.col("confidence") >= F.col("cut")).drop("cut")


def sparse_regions(degrees: DataFrame, share: float = 0.5) -> DataFrame:
    """``degrees``: id, region, n. Those with under ``share`` of their region's mean: id, region, n, score."""
    mean = F.avg("n").over(Window.partitionBy("region"))
    return degrees.withColumn("mean", mean).filter(F.col("n") < share * F.col("mean")).select("id", "region", "n", (F.col("mean") - F.col("n")).alias("score"))


def unknown_concepts(mentions: DataFrame, names: DataFrame) -> DataFrame:
    """``mentions``: token. Tokens that no composition has, with how often they are mentioned: token, importance."""
    known = names.select(F.lower("text").alias("low")).distinct()
    return mentions.withColumn("low", F.lower("token")).join(known, "low", "left_anti").groupBy("token").agg(F.count("*").alias("importance"))


def contradictions(edges: DataFrame, within: float = 100) -> DataFrame:
    """Pairs of targets of a source, of one kind, with ratings closer than ``within``: src, kind, a, b, priority."""
    a, b = (edges.select("src", "kind", F.col("dst").alias(n), F.col("elo").alias(f"{n}_elo")) for n in "ab")
    near = a.join(b, ["src", "kind"]).filter((F.col("a") < F.col("b")) & (F.abs(F.col("a_elo") - F.col("b_elo")) < within))
    return near.select("src", "kind", "a", "b", (F.greatest("a_elo", "b_elo") / 2000).alias("priority"))


def opposed(edges: DataFrame, places: DataFrame, distance: float) -> DataFrame:
    """Edges that run both ways between compositions at least ``distance`` apart: a, b, distance."""
    back = edges.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    both = edges.select("src", "dst").join(back, ["src", "dst"], "left_semi").filter("src < dst").distinct()
    p = lambda n, k: places.select(F.col("id").alias(k), *[F.col(c).alias(f"{n}_{c}") for c in "xyzw"])
    return both.join(p("a", "src"), "src").join(p("b", "dst"), "dst").withColumn("distance", g.geodesic(g.point("a_"), g.point("b_"))).filter(F.col("distance") >= distance).select(F.col("src").alias("a"), F.col("dst").alias("b"), "distance")


def consistency_vote(answers: list[DataFrame]) -> DataFrame:
    """``answers``: answer, confidence, from different lines of thought. Votes and mean confidence per answer."""
    all_ = answers[0]
    for a in answers[1:]:
        all_ = all_.unionByName(a)
    return all_.groupBy("answer").agg(F.count("*").alias("votes"), F.avg("confidence").alias("confidence"))


def feedback_update(feedback: DataFrame) -> DataFrame:
    """``feedback``: relation_id, score 1 to 5. Change of +50 at a mean of 4, -50 at 2; to be looked at under 3 or over 100 rows."""
    s = feedback.groupBy("relation_id").agg(F.count("*").alias("n"), F.avg("score").alias("mean"))
    return s.select("relation_id", "n", "mean", F.when(F.col("mean") >= 4, 50).when(F.col("mean") <= 2, -50).otherwise(0).alias("delta"), ((F.col("mean") < 3) | (F.col("n") > 100)).alias("candidate"))


def reflexion(rating: DataFrame, traces: DataFrame) -> DataFrame:
    """``traces``: edges (JSON array of relation ids), success. Each edge gains 10 per success and loses 20 per failure."""
    each = traces.select(F.explode(F.from_json("edges", "array<bigint>")).alias("relation_id"), F.when(F.col("success"), 10).otherwise(-20).alias("change"))
    return rating.join(each.groupBy("relation_id").agg(F.sum("change").alias("change")), "relation_id", "left").select("relation_id", (F.col("rating") + F.coalesce("change", F.lit(0))).alias("rating"), "observations")


def typed_chain(edges: DataFrame, start: DataFrame, kinds: list[str], min_elo: float = 1800) -> DataFrame:
    """From each start, hop by hop along edges of the next kind over ``min_elo``, the best one each time: start, path, avg_elo."""
    best = edges.filter(F.col("elo") > min_elo).groupBy("src", "kind").agg(F.max(F.struct("elo", (-F.col("dst")).alias("order"))).alias("b")).select("src", "kind", (-F.col("b.order")).alias("dst"), "b.elo")
    now = start.select(F.col("src").alias("start"), F.col("src").alias("node"), F.array("src").alias("path"), F.lit(0.0).alias("sum"))
    for kind in kinds:
        now = now.join(best.filter(F.col("kind") == kind), F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"), (F.col("sum") + F.col("elo")).alias("sum"))
    return now.select("start", "path", (F.col("sum") / len(kinds)).alias("avg_elo"))


def best_plans(costs: DataFrame, limit: int = 5) -> DataFrame:
    """``costs``: node, cost. By success = 1 / (1 + cost)."""
    return costs.withColumn("success", 1 / (1 + F.col("cost"))).orderBy(F.desc("success"), "node").limit(limit)


def self_description(edges: DataFrame, names: DataFrame) -> DataFrame:
    e = edges.agg(F.count_distinct("src").alias("known"), F.count_distinct(F.when(F.col("elo") > 1500, F.col("src"))).alias("well_known"), F.avg("elo").alias("mean_elo"))
    n = names.agg(F.count("*").alias("compositions"))
    out = e.crossJoin(n)  # one row each
    return out.withColumn("sentence", F.concat(F.lit("I know "), F.col("known").cast("string"), F.lit(" of "), F.col("compositions").cast("string"), F.lit(" compositions, "), F.col("well_known").cast("string"), F.lit(" of them well.")))


def isolated(names: DataFrame, edges: DataFrame) -> DataFrame:
    """Compositions in no edge, on either end."""
    used = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return names.join(used, "id", "left_anti")


def weak_edges(edges: DataFrame, min_elo: float = 1400, min_sources: int = 2) -> DataFrame:
    return edges.filter((F.col("elo") < min_elo) | (F.col("n") < min_sources))


def curve_gaps(keys: DataFrame, share: float = 0.9) -> DataFrame:
    """``keys``: id, key (ordered). The widest steps to the next key: id, next_id, gap; ``share`` of all steps are smaller."""
    w = Window.orderBy("key", "id")  # an order of the whole curve
    steps = keys.select("id", F.lead("id").over(w).alias("next_id"), (F.lead("key").over(w) - F.col("key")).alias("gap")).filter("next_id IS NOT NULL")
    cut = steps.agg(F.percentile("gap", share).alias("cut"))
    return steps.crossJoin(cut).filter(F.col("gap") > F.col("cut")).drop("cut")  # one row


def neighbourhood(places: DataFrame, edges: DataFrame, id_: int, radius: float) -> DataFrame:
    """Places within ``radius`` of one, with the number of relations shared with it: id, distance, shared."""
    from kgeo.operators.search import nearest

    near = nearest(places, places.filter(F.col("id") == id_), 1 << 30, F.col("id") == id_).filter(F.col("distance") <= radius)
    mine = edges.filter(F.col("src") == id_).select(F.col("dst").alias("id"), "n")
    return near.join(mine, "id", "left").select("id", "distance", F.coalesce("n", F.lit(0)).alias("shared"))


def model_votes(rows: DataFrame) -> DataFrame:
    """``rows``: src, dst, votes (JSON object of model to elo). Consensus per pair: n, consensus."""
    each = rows.select("src", "dst", F.explode(F.from_json("votes", "map<string,double>")).alias("model", "elo"))
    return each.groupBy("src", "dst").agg(F.count("*").alias("n"), F.avg("elo").alias("consensus"))


def next_best(edges: DataFrame) -> DataFrame:
    """Of every source the target with the best rating: src, dst, elo."""
    return edges.groupBy("src").agg(F.max(F.struct("elo", (-F.col("dst")).alias("o"))).alias("b")).select("src", (-F.col("b.o")).alias("dst"), "b.elo")


def explore(edges: DataFrame, temperature: float, seed: int, limit: int = 10) -> DataFrame:
    """By elo plus a random share of the temperature."""
    return edges.withColumn("_o", F.col("elo") + F.rand(seed) * temperature).orderBy(F.desc("_o")).drop("_o").limit(limit)


def strategies(rows: DataFrame) -> DataFrame:
    """``rows``: strategy, ok, latency. By success, then by latency."""
    return rows.groupBy("strategy").agg(F.avg(F.col("ok").cast("int")).alias("success"), F.avg("latency").alias("latency"), F.count("*").alias("n"))


def truth_filter(rating: DataFrame, base: float = 1500, consensus: float = 500) -> DataFrame:
    """``rating``: base_elo, consensus_elo and more."""
    return rating.filter((F.col("base_elo") > base) & (F.col("consensus_elo") > consensus))


def provable(problems: DataFrame, available: DataFrame) -> DataFrame:
    """``problems``: id, required (array). What is missing of what is available (column item), and whether nothing is."""
    need = problems.select("id", F.explode_outer("required").alias("item"))
    missing = need.join(available.select("item").distinct(), "item", "left_anti").filter("item IS NOT NULL").groupBy("id").agg(F.sort_array(F.collect_list("item")).alias("missing"))
    return problems.select("id").join(missing, "id", "left").select("id", F.coalesce("missing", F.array().cast(missing.schema["missing"].dataType)).alias("missing"), F.col("missing").isNull().alias("provable"))


def rebuild(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """Texts from their stored tiling (key, pos, piece)."""
    return pieces.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "piece"))), lambda p: p["piece"]), "").alias("text"))
