"""Sinks, integrity, limits, moderation, security views, statistics."""

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def insert_absent(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not there yet, one per key."""
    return new.dropDuplicates(key).join(existing.select(*key), key, "left_anti")


def fold_ratings(existing: DataFrame, new: DataFrame, mode: str = "weighted") -> DataFrame:
    """relation_id, rating, observations (and seq in ``new``). Observations add up; ``last``: the rating of the largest seq
    wins; ``weighted``: mean by observations."""
    both = existing.withColumn("seq", F.lit(-1).cast("long")).unionByName(new.select("relation_id", "rating", "observations", F.col("seq").cast("long").alias("seq")))
    value = F.max_by("rating", "seq") if mode == "last" else F.sum(F.col("rating") * F.col("observations")) / F.sum("observations")
    return both.groupBy("relation_id").agg(value.alias("rating"), F.sum("observations").alias("observations"))


def write_table(df: DataFrame, path: str, key: list[str], partition_by: list[str] | None = None) -> int:
    """Append the rows whose key is new to the Parquet table at ``path``; the number of rows in the table. Safe to repeat."""
    spark = df.sparkSession
    try:
        existing = spark.read.schema(df.schema).parquet(path)
        df = insert_absent(existing, df, key)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        df = df.dropDuplicates(key)
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.parquet(path).count()


def replace_table(df: DataFrame, path: str) -> str:
    """Write a new version beside the old one and return its path; readers switch when the writer has committed."""
    version = f"{path}/v-{uuid.uuid4().hex}"
    df.write.parquet(version)
    return version


def repair_counts(compositions: DataFrame, sequence: DataFrame, rating: DataFrame, evidence: DataFrame) -> DataFrame:
    """How many rows point to nothing: kind, n."""
    rel = sequence.select("relation_id").distinct()
    parts = (
        ("sequence without composition", sequence.join(compositions.select(F.col("id").alias("composition_id")), "composition_id", "left_anti")),
        ("rating without relation", rating.join(rel, "relation_id", "left_anti")),
        ("relation without rating", rel.join(rating, "relation_id", "left_anti")),
        ("evidence without relation", evidence.join(rel, "relation_id", "left_anti")),
    )
    out = None
    for kind, rows in parts:
        one = rows.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def table_stats(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def rate_limits(events: DataFrame, per_hour: int = 1000, per_day: int = 10000, user: str = "user_id", action: str = "event_type", ts: str = "ts") -> DataFrame:
    """Per event whether it is within its user's limits: how many of the user's actions of that kind came in its hour and day."""
    row = lambda unit: F.row_number().over(Window.partitionBy(user, action, F.date_trunc(unit, ts)).orderBy(ts, "event_id"))
    return events.select("event_id", user, action, row("hour").alias("in_hour"), row("day").alias("in_day")).withColumn("allowed", (F.col("in_hour") <= per_hour) & (F.col("in_day") <= per_day))


def flag_content(flags: DataFrame, reject_at: int = 3) -> DataFrame:
    """``flags``: content_id, user_id. Users who flagged and the status."""
    return flags.groupBy("content_id").agg(F.count_distinct("user_id").alias("n"), F.sort_array(F.collect_set("user_id")).alias("users")).withColumn("status", F.when(F.col("n") >= reject_at, "rejected").otherwise("flagged"))


def secured(content: DataFrame, tenant: str | None, admin: bool = False) -> DataFrame:
    """What a tenant may see: its own rows and public ones (tenant_id null); an admin sees all."""
    return content if admin else content.filter(F.col("tenant_id").isNull() | (F.col("tenant_id") == F.lit(tenant)))


def may_write(rows: DataFrame, tenant: str, user: str, admin: bool = False) -> DataFrame:
    """Rows to be inserted or changed, with whether the policy lets this user do so."""
    return rows.withColumn("allowed", F.lit(admin) | ((F.col("tenant_id") == tenant) & (F.col("user_id") == user)))


def compact(spark: SparkSession, path: str, target_files: int) -> str:
    return replace_table(spark.read.parquet(path).repartition(target_files), path)


VERSION = "0.1.0"
#: Versions of the tables, with what each added.
SCHEMA_VERSIONS = [(1, "tables"), (2, "ratings with observations")]


def version(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(VERSION, max(SCHEMA_VERSIONS)[0])], "version string, schema_version int")
