"""Texts to compositions and relations: atoms, runs, centroids, ids, evidence."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgeo import ids
from kgeo.functions import geometry as g
from kgeo.functions import text as t
from kgeo.functions.curves import COMPOSITION, hilbert


def atoms(words: DataFrame) -> DataFrame:
    """Atoms of all characters of ``words`` (token): codepoint, id, x, y, z, w."""
    cps = words.select("token").distinct().select(F.explode(t.codepoints(F.col("token"))).alias("codepoint")).distinct()
    return cps.select("codepoint", ids.atom_id(F.col("codepoint")).alias("id"), *[e.alias(c) for e, c in zip(g.codepoint_point(F.col("codepoint")), "xyzw", strict=True)])


def compositions(words: DataFrame, atoms_: DataFrame) -> DataFrame:
    """Per distinct token: id (of the tag and its atoms' ids in order), length, centroid. Characters without an atom are left out."""
    each = words.select("token").distinct().select("token", F.posexplode(t.codepoints(F.col("token"))).alias("pos", "codepoint")).join(atoms_, "codepoint")
    made = each.groupBy("token").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda p: p["id"]), "").alias("ids"), F.count("*").alias("length"), *[e.alias(c) for e, c in zip(g.centroid(), "xyzw", strict=True)])
    return made.select("token", ids.content_id(F.concat(F.lit(bytearray(ids.COMPOSITION)), F.unhex("ids"))).alias("id"), "length", *"xyzw")


def with_hilbert(points: DataFrame, kind: int = COMPOSITION) -> DataFrame:
    return points.withColumn("hilbert", hilbert(kind)(*g.to_cube(g.point())))


def composition_sequence(words: DataFrame) -> DataFrame:
    """Per distinct token its runs: token, ordinal, codepoint, occurrences."""
    return words.select("token").distinct().select("token", F.explode(t.runs(F.col("token"))).alias("r")).select("token", "r.ordinal", F.ascii("r.ch").alias("codepoint"), "r.occurrences")


def text_of(sequence: DataFrame) -> DataFrame:
    """Texts from runs (token key, ordinal, codepoint, occurrences)."""
    run = F.struct("ordinal", F.repeat(t.char(F.col("codepoint")), F.col("occurrences")).alias("s"))
    return sequence.groupBy("token").agg(F.array_join(F.transform(F.sort_array(F.collect_list(run)), lambda r: r["s"]), "").alias("text"))


def relations(words: DataFrame, compositions_: DataFrame, base: float = 1500, k: float = 32) -> DataFrame:
    """Neighbouring different tokens of each document as undirected relations: doc_id, relation_id, a_id, b_id, rating, k_factor,
    signal, and the middle of their centroids. A pair once per document and direction of reading."""
    nxt = words.select("doc_id", "token", F.lead("token").over(Window.partitionBy("doc_id").orderBy("pos")).alias("next")).filter("next IS NOT NULL AND token <> next").distinct()
    side = lambda c, n: compositions_.select(F.col("token").alias(c), F.col("id").alias(f"{n}_id"), *[F.col(x).alias(f"{n}_{x}") for x in "xyzw"])
    both = nxt.join(side("token", "a"), "token").join(side("next", "b"), "next")
    middle = g.normalize([(a + b) / 2 for a, b in zip(g.point("a_"), g.point("b_"), strict=True)], (1, 0, 0, 0))
    return both.select("doc_id", ids.relation_id(F.col("a_id"), F.col("b_id")).alias("relation_id"), "a_id", "b_id", F.lit(float(base)).alias("rating"), F.lit(float(k)).alias("k_factor"), F.lit(1.0).alias("signal"), *[e.alias(c) for e, c in zip(middle, "xyzw", strict=True)])


def merge(relations_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rating (every mention observed) and evidence (once per content and relation) of relation mentions."""
    rating = relations_.groupBy("relation_id").agg(F.count("*").alias("observations"), F.avg("rating").alias("rating"))
    return rating, relations_.select(F.col("doc_id").alias("content_id"), "relation_id", "rating", "signal").dropDuplicates(["content_id", "relation_id"])


def new_contents(docs: DataFrame, stored: DataFrame) -> DataFrame:
    """Documents whose text is not stored yet (``stored``: content_hash), each text once."""
    hashed = docs.withColumn("content_hash", F.md5("text"))
    return hashed.dropDuplicates(["content_hash"]).join(stored.select("content_hash"), "content_hash", "left_anti")
