"""The graph's tables over the test tables, as DataFrames and, for the oracle, as SQL with the same names and columns."""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgeo.functions import geometry as g
from kgeo.functions.text import tokens


class Model:
    """Each property is a lazy table. ``sequence``: which composition stands where in which relation."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def composition(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))

    @cached_property
    def sequence(self) -> DataFrame:
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
        return self.table("lineitem").select(F.col("l_orderkey").alias("relation_id"), F.col("l_partkey").alias("composition_id"), (F.row_number().over(order) - 1).alias("ordinal"), F.col("l_quantity").cast("int").alias("occurrences"))

    @cached_property
    def rating(self) -> DataFrame:
        seen = self.table("lineitem").groupBy(F.col("l_orderkey").alias("relation_id")).agg(F.sum(F.col("l_quantity").cast("int")).alias("observations"))
        rated = self.table("orders").select(F.col("o_orderkey").alias("relation_id"), (800 + F.floor(1200 * F.least(F.lit(1.0), F.col("o_totalprice") / 500000))).cast("double").alias("rating"))
        return rated.join(seen, "relation_id").select("relation_id", "rating", "observations")

    @cached_property
    def evidence(self) -> DataFrame:
        return self.table("events").select(F.col("user_id").alias("relation_id"), F.col("event_id").alias("content_id"), (F.col("event_type") != "error").alias("is_valid"), F.least(F.lit(1.0), F.col("value") / 500).alias("signal"), F.col("ts").cast("timestamp_ntz").alias("validated_at"), F.col("event_type").alias("source"))

    @cached_property
    def content(self) -> DataFrame:
        return self.table("documents").select("doc_id", F.md5("text").alias("id"), F.col("lang").alias("language"), "source", F.col("n_chars").alias("size"))

    @cached_property
    def physicality(self) -> DataFrame:
        raw = self.table("embeddings").select(F.col("vec_id").alias("id"), F.col("label"), *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyzw")])
        return raw.select("id", "label", *[e.alias(c) for e, c in zip(g.normalize(g.point()), "xyzw", strict=True)])

    @cached_property
    def projection(self) -> DataFrame:
        return self.physicality.select((F.col("id") % 50).alias("composition_id"), F.col("label").alias("content_id"), *"xyzw", F.col("id").alias("projection_id"))

    @cached_property
    def words(self) -> DataFrame:
        """(doc_id, pos, token) of whole documents."""
        return self.table("documents").select("doc_id", F.posexplode(tokens(F.col("text"))).alias("pos", "token"))

    @cached_property
    def atom(self) -> DataFrame:
        cps = self.words.select("token").distinct().select(F.explode(F.filter(F.split("token", ""), lambda c: c != "")).alias("ch")).distinct().select(F.ascii("ch").alias("codepoint"), "ch")
        return cps.select("codepoint", "ch", *[e.alias(c) for e, c in zip(g.codepoint_point(F.col("codepoint")), "xyzw", strict=True)])


#: The same tables in DuckDB's SQL, to be put before a query.
SQL = r"""
composition AS (SELECT p_partkey AS id, p_name AS text FROM part),
sequence AS (SELECT l_orderkey AS relation_id, l_partkey AS composition_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS ordinal, l_quantity::INT AS occurrences FROM lineitem),
rating AS (SELECT o_orderkey AS relation_id, (800 + floor(1200 * least(1.0, o_totalprice / 500000)))::DOUBLE AS rating, observations
  FROM orders JOIN (SELECT l_orderkey, sum(l_quantity::INT)::BIGINT AS observations FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
evidence AS (SELECT user_id AS relation_id, event_id AS content_id, event_type <> 'error' AS is_valid, least(1.0, value / 500) AS signal, ts AS validated_at, event_type AS source FROM events),
content AS (SELECT doc_id, md5(text) AS id, lang AS language, source, n_chars AS size FROM documents),
raw_point AS (SELECT vec_id AS id, label, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS d FROM embeddings),
physicality AS (SELECT id, label, a / sqrt(a*a+b*b+c*c+d*d) AS x, b / sqrt(a*a+b*b+c*c+d*d) AS y, c / sqrt(a*a+b*b+c*c+d*d) AS z, d / sqrt(a*a+b*b+c*c+d*d) AS w FROM raw_point),
projection AS (SELECT id % 50 AS composition_id, label AS content_id, x, y, z, w, id AS projection_id FROM physicality),
tokens AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r]+') AS ts FROM documents),
words AS (SELECT doc_id, unnest(range(len(ts))) AS pos, unnest(ts) AS token FROM tokens),
characters AS (SELECT DISTINCT unnest(string_split(token, '')) AS ch FROM (SELECT DISTINCT token FROM words)),
atom_angle AS (SELECT unicode(ch) AS codepoint, ch, pi() * unicode(ch) / 1114111 AS t, 2 * pi() * (unicode(ch) % 360) / 360 AS p, pi() * (unicode(ch) % 180) / 180 AS q FROM characters),
atom AS (SELECT codepoint, ch, cos(t/2)*cos((p+q)/2) AS x, cos(t/2)*sin((p+q)/2) AS y, sin(t/2)*cos((p-q)/2) AS z, sin(t/2)*sin((p-q)/2) AS w FROM atom_angle),
links AS (SELECT a.composition_id AS src, b.composition_id AS dst, a.relation_id, r.rating, r.observations FROM sequence a JOIN sequence b ON a.relation_id = b.relation_id AND a.composition_id <> b.composition_id JOIN rating r ON r.relation_id = a.relation_id),
edges AS (SELECT src, dst, max(rating) AS elo, sum(observations)::BIGINT AS obs, count(*) AS n FROM links GROUP BY 1, 2)
"""
