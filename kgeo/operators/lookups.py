"""Questions put by name, views over the stored tables, and the checked update of a composition."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgeo.functions import geometry as g
from kgeo.functions import scoring, text
from kgeo.operators.graph import multi_hop, neighbours
from kgeo.operators.search import find_composition, fuzzy_search, nearest

#: The domains an explorer starts from.
DOMAINS = ["Science", "Mathematics", "Philosophy", "Art", "Technology", "History", "Literature", "Nature", "Space", "Cognition"]
UNKNOWN = "I do not understand the concepts in this question."


def first_cell(rows: DataFrame):
    """The first column of the first row, or None: for queries of one value."""
    row = rows.select(rows.columns[0]).first()
    return None if row is None else row[0]


def related_by_place(places: DataFrame, names: DataFrame, wanted: str, limit: int = 10) -> DataFrame:
    """The compositions nearest to the one named, with their text: id, text, distance. An unknown name gives no rows."""
    start = find_composition(names, wanted).select("id")
    near = nearest(places.join(start, "id", "left_anti"), places.join(start, "id", "left_semi"), limit)
    return near.join(names, "id").select("id", "text", "distance")


def neighbourhood_of_text(places: DataFrame, names: DataFrame, wanted: str, radius: float = 0.1, limit: int = 10) -> DataFrame:
    """As related_by_place, none further than ``radius``."""
    return related_by_place(places, names, wanted, limit).filter(F.col("distance") <= radius)


def name_answers(sequence: DataFrame, names: DataFrame, wanted: str, limit: int = 5) -> DataFrame:
    """Texts of over two characters that share relations with the one named; those that look like a name count twice: answer, score."""
    start = names.filter(F.lower("text") == wanted.lower()).select(F.col("id").alias("src"))
    others = names.filter((F.lower("text") != wanted.lower()) & (F.length("text") > 2)).withColumnRenamed("id", "dst")
    counted = neighbours(sequence, start).join(others, "dst").groupBy(F.col("text").alias("answer")).agg(F.count_distinct("relation_id").alias("n"))
    return counted.select("answer", (F.col("n") * F.when(F.col("answer").rlike("^[A-Z][a-z]+$"), 2).otherwise(1)).alias("score")).orderBy(F.desc("score"), "answer").limit(limit)


def named_neighbours(sequence: DataFrame, rating: DataFrame, names: DataFrame, wanted: str) -> DataFrame:
    """Every link of the compositions of that text in any case, with the other's text and the relation's rating, if any."""
    start = names.filter(F.lower("text") == wanted.lower()).select(F.col("id").alias("src"))
    return neighbours(sequence, start).join(rating, "relation_id", "left").join(names.select(F.col("id").alias("dst"), F.col("text").alias("target_text")), "dst", "left").select("src", "dst", "target_text", "observations", "rating")


def answer_by_hops(names: DataFrame, edges: DataFrame, question: str, max_hops: int = 3) -> DataFrame:
    """The text at the end of the path of the highest total rating from the composition most like the question: answer,
    confidence, reasoning_path (texts). A question like no composition gets one row that says so."""
    spark = names.sparkSession
    start = fuzzy_search(names, question, 1).select(F.col("id").alias("src"))
    if start.isEmpty():
        return spark.createDataFrame([(UNKNOWN, 0.0, [])], "answer string, confidence double, reasoning_path array<string>")
    best = multi_hop(edges, start, max_hops, limit=None).orderBy(F.desc("total_elo"), "path").limit(1)
    steps = best.select("node", "total_elo", F.posexplode("path").alias("pos", "id")).join(names, "id")
    path = steps.groupBy("node", "total_elo").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]).alias("reasoning_path"))  # max_hops + 1 at most
    return path.select(F.element_at("reasoning_path", -1).alias("answer"), scoring.path_confidence(F.col("total_elo")).alias("confidence"), "reasoning_path")


def walk_seeds(sequence: DataFrame, rating: DataFrame, names: DataFrame, prompt: str) -> DataFrame:
    """Content words of the prompt that are compositions, by exact text, else in lower case, with how many other seeds share a
    relation with each: id, connections, best first (ties by place in the prompt). With none, the best rated composition."""
    spark = names.sparkSession
    words = spark.createDataFrame([(prompt,)], "prompt string").select(F.posexplode(F.split("prompt", r"\s+")).alias("pos", "raw")).select("pos", F.regexp_replace("raw", text.PUNCTUATION, "").alias("word")).filter(~text.is_function_word(F.col("word")))
    one = names.groupBy("text").agg(F.min("id").alias("id"))
    exact, low = (words.join(one.withColumnRenamed("id", n), key == one["text"], "left").select("pos", n) for n, key in (("exact", words["word"]), ("low", F.lower(words["word"]))))
    seeds = exact.join(low, "pos").select(F.coalesce("exact", "low").alias("id"), "pos").filter("id IS NOT NULL").groupBy("id").agg(F.min("pos").alias("pos"))
    met = neighbours(sequence, seeds.select(F.col("id").alias("src"))).join(seeds.select(F.col("id").alias("dst")), "dst").groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("connections"))
    found = seeds.join(met, "id", "left").select("id", F.coalesce("connections", F.lit(0)).alias("connections"), "pos")
    if found.isEmpty():
        return sequence.join(rating, "relation_id").orderBy(F.desc("rating"), "composition_id").limit(1).select(F.col("composition_id").alias("id"), F.lit(0).cast("long").alias("connections"))
    return found.orderBy(F.desc("connections"), "pos").select("id", "connections")


def analysis(gaps: DataFrame, parts: DataFrame) -> DataFrame:
    """A problem's plan in numbers, one row: gaps, total_steps, solvable_steps. ``parts``: solvable (boolean)."""
    return gaps.agg(F.count("*").alias("gaps")).crossJoin(parts.agg(F.count("*").alias("total_steps"), F.count(F.when(F.col("solvable"), 1)).alias("solvable_steps")))  # one row each


def touch(names: DataFrame, wanted: DataFrame, at) -> DataFrame:
    """``names`` with modified_at set to ``at`` for the texts in ``wanted`` (column text). A text that no composition has
    raises: compositions are made by ingestion alone."""
    missing = first_cell(wanted.select("text").distinct().join(names, "text", "left_anti").orderBy("text"))
    if missing is not None:
        raise ValueError(f"composition not found: {missing}")
    own = wanted.select("text", F.lit(True).alias("touched")).distinct()
    return names.join(own, "text", "left").select("id", "text", F.when(F.col("touched"), F.lit(at)).alias("modified_at"))


# Views


def composition_details(atoms_of: DataFrame, places: DataFrame, atom: DataFrame) -> DataFrame:
    """A row per run of a composition: its text, where the composition and the atom lie. ``atoms_of``: id, ordinal, codepoint, occurrences.

    The places are sorted and merged: Catalyst takes exploded runs for as small as the texts, and would broadcast them."""
    own = places.select("id", *[F.col(c).alias(f"centroid_{c}") for c in "xyzw"]).hint("merge")
    return atoms_of.join(own, "id").join(atom.select("codepoint", *[F.col(c).alias(f"atom_{c}") for c in "xyzw"]), "codepoint").withColumn("text", F.repeat(text.char(F.col("codepoint")), F.col("occurrences")))


def oriented_neighbours(sequence: DataFrame, rating: DataFrame) -> DataFrame:
    """From the first to the second composition of each rated relation: relation_id, elo, observations, source, neighbour."""
    side = lambda k, n: sequence.filter(F.col("ordinal") == k).select("relation_id", F.col("composition_id").alias(n))
    return side(0, "source").join(side(1, "neighbour"), "relation_id").join(rating, "relation_id").select("relation_id", F.col("rating").alias("elo"), "observations", "source", "neighbour")


def promoted_units(atoms_of: DataFrame, places: DataFrame) -> DataFrame:
    """Placed compositions with the class of their first atom: id, codepoint, script_class (null without one)."""
    first = atoms_of.filter("ordinal = 0").select("id", "codepoint")
    return places.select("id").join(first, "id", "left").withColumn("script_class", F.when(F.col("codepoint").isNotNull(), text.codepoint_class(F.col("codepoint"))))


def documents_view(content: DataFrame, paths: DataFrame) -> DataFrame:
    """Contents with the length of their trajectory, where they have one. ``paths``: doc_id, total_distance."""
    return content.join(paths, "doc_id", "left")


def spatial_stats(places: DataFrame, cells: int = 4) -> DataFrame:
    """How full a grid of ``cells`` per axis over the cube is: cells in use, points, most in a cell. One row."""
    cube = [F.least(F.floor(c * cells), F.lit(cells - 1)).cast("int") for c in g.to_cube(g.point())]
    full = places.groupBy(*[c.alias(f"cell_{n}") for c, n in zip(cube, "xyzw", strict=True)]).agg(F.count("*").alias("n"))
    return full.agg(F.count("*").alias("cells"), F.sum("n").alias("points"), F.max("n").alias("fullest"))


def domains(spark) -> DataFrame:
    return spark.createDataFrame([(d, d, "Domain") for d in DOMAINS], "name string, id string, type string")


# Orders and limits


def ngram_order(measured: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` first by length, frequency and npmi (all descending; ties by the gram). ``measured``: gram, n, freq, npmi."""
    return measured.orderBy(F.desc("n"), F.desc("freq"), F.desc("npmi"), "gram").limit(limit)


def over_fetch(rows: DataFrame, order: list, keep, limit: int, times: int = 3) -> DataFrame:
    """``limit`` of the rows that ``keep`` allows among the first ``times`` * ``limit`` in ``order``."""
    return rows.orderBy(*order).limit(times * limit).filter(keep).orderBy(*order).limit(limit)


def rated_in_range(places: DataFrame, keys: DataFrame, rated: DataFrame, target: list[float], radius: float, low: int, high: int) -> DataFrame:
    """Places within ``radius`` whose curve key (``keys``: id, key) lies in a range, best rated first: id, distance, elo."""
    from kgeo.operators.search import within_radius

    near = within_radius(places, target, radius).join(keys.filter(F.col("key").between(low, high)).select("id"), "id", "left_semi")
    return near.join(rated, "id").select("id", "distance", "elo").orderBy(F.desc("elo"), "id")


def spread(projections: DataFrame) -> DataFrame:
    """Per composition with two projections or more, mean and largest distance between any two: composition_id, n, mean, most.
    ``projections``: composition_id, projection_id, x, y, z, w."""
    side = lambda n: projections.select("composition_id", F.col("projection_id").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in "xyzw"])
    far = side("a").join(side("b"), "composition_id").filter("a < b").withColumn("d", g.geodesic(g.point("a_"), g.point("b_")))
    return far.groupBy("composition_id").agg(F.count("*").alias("pairs"), F.avg("d").alias("mean"), F.max("d").alias("most"))


def polysemous(projections: DataFrame, least: float = 0.3, limit: int = 50) -> DataFrame:
    """Compositions whose projections lie at least ``least`` apart on average, widest first."""
    return over_fetch(spread(projections), [F.desc("mean"), "composition_id"], F.col("mean") >= least, limit)


def scatter(rows: DataFrame, key: str) -> DataFrame:
    """The ten covariances of the coordinates of each group."""
    pairs = [(a, b) for i, a in enumerate("xyzw") for b in "xyzw"[i:]]
    return rows.groupBy(key).agg(*[F.covar_pop(a, b).alias(f"{a}{b}") for a, b in pairs])


def fold_consensus(rating: DataFrame, weight) -> DataFrame:
    """``consensus_elo`` raised by the logarithm of a source's weight."""
    return rating.withColumn("consensus_elo", F.col("consensus_elo") + F.log(weight))


def ranked_plans(tree: DataFrame, limit: int = 5) -> DataFrame:
    """Of ``thought_tree``: rank by cost, then confidence (ties share it), ranks up to ``limit``."""
    return tree.withColumn("rank", F.rank().over(Window.partitionBy("start").orderBy("cost", F.desc("confidence")))).filter(F.col("rank") <= limit)
