"""Connected components and pair blocks: what the near-duplicate operators share."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgeo.llm.storage import discard, lean, materialize, width


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges`` (a, b: long) to (node, component): the smallest node reachable. Nodes without an edge are absent.

    Alternates two steps until nothing changes: every node links its larger neighbours to its smallest one, then its
    smaller neighbours too. Rounds grow with the logarithm of the longest path. A step is one aggregation (with partial
    sums) and one join on the node (``splittable_join``, so a node with very many neighbours can be dealt out); each round is
    written."""
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = splittable_join(both.filter("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = splittable_join(large, least, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        e, done = materialize(small, "edges"), e
        discard(done)
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)), F.count_distinct("u")).first()
        if now == before and now[0] == now[2]:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def splittable_join(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``other``, which has a key once. Both sides are shuffled for this join, by the key and its hash,
    even if ``other`` lies by the key already: only then may adaptive execution split a key with very many ``rows``."""
    twice = lambda df: df.withColumn("_key_hash", F.xxhash64(key))
    return twice(rows).join(twice(other), [key, "_key_hash"]).drop("_key_hash")


def pair_blocks(rows: DataFrame, key: str, item: str, weight: str | None = None, size: int = 1024) -> DataFrame:
    """Rows of keys with two items or more, dealt so that any two items of a key meet: adds block_a, block_b and own.

    A key's items are split at random into blocks of about ``size`` (in rows, or in units of ``weight``), and each row goes
    to every pair (block_a <= block_b) with its own block in it. A key of up to ``size`` makes one block; a hot key is spread
    over many tasks, none larger than two blocks."""
    total = F.sum(weight) if weight else F.count("*")
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n"), total.alias("_w")).filter("_n > 1").select(key, F.greatest(F.lit(1), F.least(F.col("_n"), F.ceil(F.col("_w") / size))).cast("int").alias("_blocks"))
    dealt = rows.join(sizes, key).withColumn("own", F.pmod(F.xxhash64(F.col(item), F.lit(11)), F.col("_blocks")).cast("int"))
    return dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).withColumns({"block_a": F.least("own", "_other"), "block_b": F.greatest("own", "_other")}).drop("_other", "_blocks")


def by_group(blocks: DataFrame, key: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``run`` gets the rows of ``pair_blocks`` group by group (key, block_a, block_b), the columns in order, streaming."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch.column(batch.schema.names.index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in (key, "block_a", "block_b")])
            cuts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                now = tuple(ids[:, lo])
                if held and now != last:
                    yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held = []
                held.append(batch.slice(lo, hi - lo))
                last = now
        if held:
            yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    at = [key, "block_a", "block_b"]
    return blocks.repartition(width(blocks.sparkSession), *at).sortWithinPartitions(*at).mapInArrow(lean(lambda batches: run(groups(batches))), schema)


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """A star of edges for each connected component of a symmetric boolean matrix."""
    left, out = linked.sum(1) > linked.diagonal(), []
    for seed in np.flatnonzero(left).tolist():
        if not left[seed]:
            continue
        left[seed] = False
        front = np.array([seed])
        while len(front):
            reached = linked[front].any(0) & left
            front = np.flatnonzero(reached)
            left[front] = False
            out += [(seed, int(x)) for x in front]
    return out
