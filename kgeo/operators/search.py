"""Lookups and ranking: by text, by co-occurrence, by mass, by place on the sphere."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgeo.functions import geometry as g
from kgeo.functions import scoring, text
from kgeo.operators.graph import neighbours


def find_composition(names: DataFrame, wanted: str, any_case: bool = False) -> DataFrame:
    """The composition of that text; of several, the smallest id."""
    test = F.lower("text") == wanted.lower() if any_case else F.col("text") == wanted
    return names.filter(test).orderBy("id").limit(1)


def find_related(sequence: DataFrame, names: DataFrame, wanted: str, limit: int = 10) -> DataFrame:
    """Compositions that share most relations with the one named: id, text, n."""
    start = find_composition(names, wanted, True).select(F.col("id").alias("src"))
    top = neighbours(sequence, start).groupBy("dst").agg(F.count_distinct("relation_id").alias("n")).orderBy(F.desc("n"), "dst").limit(limit)
    return top.join(names.withColumnRenamed("id", "dst"), "dst").select(F.col("dst").alias("id"), "text", "n")


def relations_of(sequence: DataFrame, names: DataFrame, wanted: str) -> DataFrame:
    return sequence.join(find_composition(names, wanted, True).select(F.col("id").alias("composition_id")), "composition_id").select("relation_id").distinct()


def gravitational_truth(sequence: DataFrame, rating: DataFrame, places: DataFrame, names: DataFrame, wanted: str, min_elo: float = 1500, radius: float = 0.05, limit: int = 10, planar: bool = False) -> DataFrame:
    """Candidates linked to the named composition, by mass = elo * log10(obs + 1) * density; density counts the candidates
    (itself too) closer than ``radius``. ``places``: id and x, y, z, w. ``planar`` leaves w out."""
    start = find_composition(names, wanted, True).select(F.col("id").alias("src"))
    near = neighbours(sequence, start).join(rating, "relation_id").filter(F.col("rating") >= min_elo).join(places.withColumnRenamed("id", "dst"), "dst").select("relation_id", F.col("dst").alias("id"), "rating", "observations", *"xyzw")
    axes = "xyz" if planar else "xyzw"
    pairs = radius_join(near.select(F.struct("relation_id", "id").alias("key"), *"xyzw"), near.select(F.struct("relation_id", "id").alias("key"), *"xyzw"), radius, axes, strict=True)
    density = pairs.groupBy("a_key").agg(F.count("*").alias("density"))
    out = near.join(density, F.struct("relation_id", "id") == F.col("a_key"))
    return out.select("relation_id", "id", (scoring.mass(F.col("rating"), F.col("observations")) * F.col("density")).alias("mass"), "density").orderBy(F.desc("mass"), "relation_id", "id").limit(limit).withColumn("confidence", F.col("mass") / 10000)


def radius_join(a: DataFrame, b: DataFrame, radius: float, axes: str = "xyzw", strict: bool = False) -> DataFrame:
    """Pairs (a_key, b_key) of points closer than ``radius``, or at it. Points fall into cells as wide as the radius; ``b`` is
    copied to the neighbouring cells and joined on the cell, so only neighbours meet."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    left = a.select(F.col("key").alias("a_key"), *[F.col(c).alias(f"a_{c}") for c in axes], F.xxhash64(*[cell(c) for c in axes]).alias("cell"))
    moves = F.explode(F.array(*[F.array(*[F.lit(v) for v in move]) for move in _moves(len(axes))]))
    right = b.select(F.col("key").alias("b_key"), *[F.col(c).alias(f"b_{c}") for c in axes], moves.alias("move")).withColumn("cell", F.xxhash64(*[(F.floor(F.col(f"b_{c}") / radius) + F.get("move", F.lit(i))).cast("long") for i, c in enumerate(axes)])).drop("move")
    far = F.sqrt(sum((F.pow(F.col(f"a_{c}") - F.col(f"b_{c}"), 2) for c in axes[1:]), F.pow(F.col(f"a_{axes[0]}") - F.col(f"b_{axes[0]}"), 2)))
    # a cell's number is a hash of it: two of the cells around a point may share one, so pairs are made distinct
    return left.join(right, "cell").filter(far < radius if strict else far <= radius).select("a_key", "b_key").distinct()


def _moves(n: int) -> list[tuple]:
    return [()] if n == 0 else [(v, *rest) for v in (-1, 0, 1) for rest in _moves(n - 1)]


def gravitational_centers(sequence: DataFrame, rating: DataFrame, places: DataFrame, min_mass: float = 1000, radius: float = 0.05) -> DataFrame:
    """Per composition with a place: its mass (summed over relations) times the number of neighbours within ``radius``, their
    number, and the neighbours' mean place. ``min_mass`` is asked of the product."""
    own = sequence.join(rating, "relation_id").groupBy(F.col("composition_id").alias("id")).agg(F.sum(scoring.mass(F.col("rating"), F.col("observations"))).alias("mass")).join(places, "id")
    near = radius_join(own.select(F.col("id").alias("key"), *"xyzw"), own.select(F.col("id").alias("key"), *"xyzw"), radius)
    pulled = near.join(own.select(F.col("id").alias("b_key"), *"xyzw"), "b_key").groupBy(F.col("a_key").alias("id")).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"center_{c}") for c in "xyzw"])
    return own.select("id", "mass").join(pulled, "id").withColumn("total_mass", F.col("mass") * F.col("n")).filter(F.col("total_mass") >= min_mass).select("id", "n", "total_mass", *[f"center_{c}" for c in "xyzw"])


def answer(sequence: DataFrame, names: DataFrame, questions: DataFrame, per_keyword: int = 20) -> DataFrame:
    """Per question (id, text): the text that most of its keywords' relations lead to, proper nouns counted twice: id, answer, score."""
    asked = questions.select("id", F.explode(text.keywords(F.col("text"))).alias("keyword"))
    named = names.withColumn("low", F.lower("text")).groupBy("low").agg(F.min("id").alias("src"))
    start = asked.join(named, asked["keyword"] == named["low"]).groupBy("id", "src").agg(F.count("*").alias("times"))
    near = neighbours(sequence, start.select("src").distinct()).groupBy("src", "dst").agg(F.count_distinct("relation_id").alias("n"))
    top = near.withColumn("_r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), "dst"))).filter(F.col("_r") <= per_keyword)
    scored = start.join(top, "src").join(names.select(F.col("id").alias("dst"), F.col("text").alias("answer")), "dst").groupBy("id", "answer").agg(F.sum(F.col("n") * F.col("times") * F.when(text.is_proper(F.col("answer")), 2).otherwise(1)).alias("score"))
    return scored.groupBy("id").agg(F.max(F.struct("score", "answer")).alias("best")).select("id", "best.answer", "best.score")


def fuzzy_search(names: DataFrame, query: str, limit: int = 10, threshold: float = 0.3) -> DataFrame:
    """By shared trigrams: id, text, similarity."""
    scored = names.withColumn("similarity", text.similarity(F.col("text"), F.lit(query)))
    return scored.filter(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), "id").limit(limit)


def phonetic_search(names: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """By sound (soundex of the text, or its metaphone of up to four signs), ranked by trigrams."""
    from kgeo.functions.phonetic import metaphone, metaphone_of

    same = (F.soundex("text") == F.soundex(F.lit(query))) | (metaphone(F.col("text")) == metaphone_of(query))
    return names.filter(same).withColumn("similarity", text.similarity(F.col("text"), F.lit(query))).orderBy(F.desc("similarity"), "id").limit(limit)


def nearest(places: DataFrame, target: list[float] | DataFrame, limit: int = 10, exclude: Column | None = None) -> DataFrame:
    """The places closest to a point, by geodesic distance (ties by id): a top-k per partition, then of those."""
    rows = places if exclude is None else places.filter(~exclude)
    if isinstance(target, DataFrame):
        rows = rows.crossJoin(F.broadcast(target.limit(1).select(*[F.col(c).alias(f"t_{c}") for c in "xyzw"])))  # one row
        point = g.point("t_")
    else:
        point = [F.lit(float(v)) for v in target]
    return rows.withColumn("distance", g.geodesic(g.point(), point)).select("id", "distance").orderBy("distance", "id").limit(limit)


def similar_to(places: DataFrame, id_: int, limit: int = 10) -> DataFrame:
    return nearest(places, places.filter(F.col("id") == id_), limit, F.col("id") == id_)


def within_radius(places: DataFrame, target: list[float], radius: float) -> DataFrame:
    """Places within a geodesic ``radius``: first by each axis (which Parquet statistics prune), then exactly."""
    bound = g.chord_bound(min(radius, math.pi))
    rows = places
    for c, v in zip("xyzw", target, strict=True):
        rows = rows.filter(F.col(c).between(v - bound - 1e-12, v + bound + 1e-12))
    return rows.withColumn("distance", g.geodesic(g.point(), [F.lit(float(v)) for v in target])).filter(F.col("distance") <= radius).select("id", "distance")


def similar_trajectories(paths: DataFrame, target: Column, limit: int = 10, measure: str = "hausdorff") -> DataFrame:
    """``paths``: id, path (array of points). By 1 / (1 + Hausdorff distance), or by Fréchet distance."""
    if measure == "hausdorff":
        return paths.select("id", (1 / (1 + g.hausdorff(F.col("path"), target))).alias("score")).orderBy(F.desc("score"), "id").limit(limit)
    return paths.select("id", g.frechet(F.col("path"), target).alias("score")).orderBy("score", "id").limit(limit)


def knn_join(a: DataFrame, b: DataFrame, k: int, threshold: float, block: int = 2048) -> DataFrame:
    """For each vector of ``a`` (id, v) its ``k`` nearest of ``b`` by cosine of at least ``threshold``, itself left out: src,
    dst, sim. Blocks of both sides meet in tasks of their own; each keeps a top-k, and these are merged."""
    from kgeo.operators.blocks import cosine_blocks

    found = cosine_blocks(a, b, k, threshold, block)
    return found.withColumn("_r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("sim"), "dst"))).filter(F.col("_r") <= k).drop("_r")
