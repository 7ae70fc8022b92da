"""Unicode character data: flat XML, collation weights, confusables, radicals, and the seeded table of all codepoints."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgeo.functions import geometry as g


def _hex(c):
    return F.conv(c, 16, 10).cast("int")


def ucd_xml(spark: SparkSession, path: str) -> DataFrame:
    """codepoint, general_category, script, block, upper, lower of <char> elements (ranges are left out)."""
    raw = spark.read.format("xml").option("rowTag", "char").option("attributePrefix", "").schema("cp string, na string, gc string, sc string, blk string, age string, suc string, slc string, dm string").load(path)
    case = lambda c: F.when(F.col(c).rlike("^[0-9A-F]+$"), _hex(F.col(c)))
    return raw.filter("cp IS NOT NULL").select(_hex(F.col("cp")).alias("codepoint"), F.col("na").alias("name"), F.col("gc").alias("general_category"), F.col("sc").alias("script"), F.col("blk").alias("block"), "age", case("suc").alias("upper"), case("slc").alias("lower"), F.when(F.col("dm") != "#", F.col("dm")).alias("decomposition"))


def collation(spark: SparkSession, path: str) -> DataFrame:
    """codepoint, w1, w2, w3 of allkeys.txt; lines of several codepoints are left out."""
    lines = spark.read.text(path).filter(F.col("value").rlike(r"^[0-9A-F]+\s*;"))
    w = lambda k: _hex(F.regexp_extract("value", r"\[[.*]([0-9A-F]+)\.([0-9A-F]+)\.([0-9A-F]+)", k))
    return lines.select(_hex(F.regexp_extract("value", r"^([0-9A-F]+)", 1)).alias("codepoint"), w(1).alias("w1"), w(2).alias("w2"), w(3).alias("w3"))


def confusables(spark: SparkSession, path: str) -> DataFrame:
    """a, b of single codepoints that look alike."""
    c = F.split("value", r"\s*;\s*")
    lines = spark.read.text(path).filter(~F.startswith("value", F.lit("#"))).select(F.get(c, F.lit(0)).alias("a"), F.get(c, F.lit(1)).alias("b"))
    return lines.filter(F.col("a").rlike("^[0-9A-F]+$") & F.col("b").rlike("^[0-9A-F]+$")).select(_hex(F.col("a")).alias("a"), _hex(F.col("b")).alias("b"))


def radicals(spark: SparkSession, path: str) -> DataFrame:
    """codepoint, radical, strokes of kRSUnicode lines."""
    p = r"^U\+([0-9A-F]+)\tkRSUnicode\t([0-9]+)'*\.(-?[0-9]+)"
    lines = spark.read.text(path).filter(F.col("value").rlike(p))
    return lines.select(_hex(F.regexp_extract("value", p, 1)).alias("codepoint"), F.regexp_extract("value", p, 2).cast("int").alias("radical"), F.regexp_extract("value", p, 3).cast("int").alias("strokes"))


def all_codepoints(spark: SparkSession, assigned: DataFrame | None = None) -> DataFrame:
    """The whole codespace, or what of it is not assigned."""
    every = spark.range(0x110000).select(F.col("id").cast("int").alias("codepoint"))
    return every if assigned is None else every.join(assigned, "codepoint", "left_anti")


def primary_group(general_category):
    """L 1, N 2, P 3, S 4, M 5, Z 6, others 7."""
    first = F.substring(general_category, 1, 1)
    out = F.lit(7)
    for k, letter in reversed([*enumerate("LNPSMZ", 1)]):
        out = F.when(first == letter, k).otherwise(out)
    return out


def sequence(points: DataFrame) -> DataFrame:
    """``points`` (codepoint, general_category, script, w1, w2, radical, strokes, base) in semantic order, with each one's
    number and place on the spiral: codepoint, number, x, y, z, w. One order over at most 0x110000 rows."""
    order = [primary_group(F.col("general_category")), "script", "w1", "w2", "radical", "strokes", "base", "codepoint"]
    numbered = points.withColumn("number", F.row_number().over(Window.orderBy(*order)) - 1)
    return numbered.select("codepoint", "number", *[e.alias(c) for e, c in zip(g.spiral(F.col("number"), points.count()), "xyzw", strict=True)])


def case_edges(points: DataFrame) -> DataFrame:
    """a, b, kind: upper and lower forms, and one-to-one decompositions."""
    out = None
    for c in ("upper", "lower"):
        one = points.filter(F.col(c).isNotNull() & (F.col(c) != F.col("codepoint"))).select(F.col("codepoint").alias("a"), F.col(c).alias("b"), F.lit(c).alias("kind"))
        out = one if out is None else out.unionByName(one)
    dec = points.filter(F.col("decomposition").isNotNull()).select(F.col("codepoint").alias("a"), F.explode(F.split("decomposition", " ")).alias("h")).select("a", _hex(F.col("h")).alias("b"), F.lit("decomposition").alias("kind"))
    return out.unionByName(dec)


def block_coverage(points: DataFrame, ranges: dict[str, tuple[int, int]]) -> DataFrame:
    """How many codepoints of each named range are there: name, n."""
    return points.select(F.explode(F.array(*[F.when(F.col("codepoint").between(a, b), F.lit(n)) for n, (a, b) in ranges.items()])).alias("name")).filter("name IS NOT NULL").groupBy("name").agg(F.count("*").alias("n"))
