"""Approximate nearest neighbours by learned partitions.

On a bounded sample, the neighbour graph is cut into parts of equal size that few edges cross, and a small network learns
each vector's part. Every vector is indexed under its most probable part; a query goes to its several most probable parts,
whose vectors are ranked exactly. How many parts that are is measured on the sample."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgeo.llm.storage import materialize, width
from kgeo.llm.vectors import distinct_vectors, fixed, numbers


def neighbours(m: np.ndarray, k: int, rows: np.ndarray | None = None) -> np.ndarray:
    """Row numbers of the ``k`` largest inner products of each row (or of those in ``rows``), itself left out."""
    out, rows = [], np.arange(len(m)) if rows is None else rows
    for lo in range(0, len(rows), 128):
        at = rows[lo : lo + 128]
        s = m[at] @ m.T
        s[np.arange(len(s)), at] = -np.inf
        out.append(np.argpartition(-s, min(k, len(m) - 1) - 1, axis=1)[:, :k])
    return np.concatenate(out)


def halves(graph: list[np.ndarray], nodes: np.ndarray, rng: np.random.Generator, rounds: int = 80) -> np.ndarray:
    """Which half each of ``nodes`` goes to: the second eigenvector of the graph's random walk, cut at its median, then swaps
    of the pairs that lessen the crossing edges most."""
    a, b = graph
    place = np.full(max(a.max(), b.max()) + 1 if len(a) else 0, -1)
    place[nodes[nodes < len(place)]] = np.flatnonzero(nodes < len(place))
    inside = (place[a] >= 0) & (place[b] >= 0)
    u, v, n = place[a[inside]], place[b[inside]], len(nodes)
    degree = np.bincount(u, minlength=n) + np.bincount(v, minlength=n)
    total = lambda x: np.bincount(u, x[v], n) + np.bincount(v, x[u], n)
    x = rng.standard_normal(n)
    for _ in range(rounds):
        x = (x + total(x) / np.maximum(degree, 1)) / 2
        x -= (x * (degree + 1e-9)).sum() / (degree + 1e-9).sum()
        x /= max(np.linalg.norm(x), 1e-300)
    side = np.zeros(n, bool)
    side[np.argsort(x, kind="stable")[n // 2 :]] = True
    for _ in range(20):
        sign = np.where(side, 1.0, -1.0)
        gain = -sign * total(sign)  # over 0: more neighbours on the other side
        one, two = np.flatnonzero(side), np.flatnonzero(~side)
        one, two = one[np.argsort(-gain[one], kind="stable")], two[np.argsort(-gain[two], kind="stable")]
        size = min(len(one), len(two), max(1, n // 50))
        swap = np.flatnonzero(gain[one[:size]] + gain[two[:size]] > 4)
        if not len(swap):
            break
        side[one[swap]], side[two[swap]] = False, True
    return side


def balanced_parts(near: np.ndarray, levels: int, seed: int) -> np.ndarray:
    """Part of each node of the neighbour lists: ``levels`` times halved, so that parts differ by one node at most per level."""
    rng, n = np.random.default_rng(seed), len(near)
    graph = [np.repeat(np.arange(n), near.shape[1]), near.ravel()]
    part = np.zeros(n, int)
    for _ in range(levels):
        new = part * 2
        for p in np.unique(part):
            nodes = np.flatnonzero(part == p)
            new[nodes] += halves(graph, nodes, rng)
        part = new
    return part


class Router:
    """A network with one hidden layer that gives each part's probability."""

    def __init__(self, dim: int, parts: int, hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        self.w = [rng.standard_normal((dim, hidden)) * np.sqrt(2 / dim), np.zeros(hidden), rng.standard_normal((hidden, parts)) / np.sqrt(hidden), np.zeros(parts)]

    def scores(self, x: np.ndarray) -> np.ndarray:
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) * np.sqrt(x.shape[1])
        return np.maximum(x @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]

    def fit(self, x: np.ndarray, part: np.ndarray, epochs: int = 40, batch: int = 256, step: float = 2e-3, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) * np.sqrt(x.shape[1])
        mean, square, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), batch):
                at = order[lo : lo + batch]
                h = np.maximum(x[at] @ self.w[0] + self.w[1], 0)
                p = h @ self.w[2] + self.w[3]
                p = np.exp(p - p.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(at)), part[at]] -= 1
                p /= len(at)
                back = (p @ self.w[2].T) * (h > 0)
                t += 1
                for k, g in enumerate((x[at].T @ back, back.sum(0), h.T @ p, p.sum(0))):
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.999 * square[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - step * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.999**t)) + 1e-8)


@dataclass
class PartitionIndex:
    """``router`` is None if there is one part."""

    router: Router | None
    parts: int
    probes: int

    def ranked(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` most probable parts of each row, best first."""
        if self.router is None:
            return np.zeros((len(x), 1), int)
        return np.argsort(-self.router.scores(x), axis=1, kind="stable")[:, :n]


def fit_index(sample: np.ndarray, part_rows: int = 256, max_parts: int = 32, graph_k: int = 10, hidden: int = 128, recall: float = 0.95, k: int = 20, seed: int = 9) -> PartitionIndex:
    """Learn the parts of ``sample``. Probes: the fewest with which sampled rows, asked for their ``k`` nearest in the sample,
    find ``recall`` of them."""
    levels = max(0, int(np.log2(max(1, min(max_parts, len(sample) // part_rows)))))
    if not levels:
        return PartitionIndex(None, 1, 1)
    part = balanced_parts(neighbours(sample, graph_k), levels, seed)
    index = PartitionIndex(Router(sample.shape[1], 1 << levels, hidden, seed), 1 << levels, 1 << levels)
    index.router.fit(sample, part)
    asked = np.random.default_rng(seed).permutation(len(sample))[:512]
    own, routes = index.ranked(sample, 1)[:, 0], index.ranked(sample[asked], 1 << levels)
    true = neighbours(sample, k, asked)
    place = np.argsort(routes, axis=1)  # when a query comes to each part
    when = np.take_along_axis(place, own[true], axis=1)
    index.probes = next(t for t in range(1, (1 << levels) + 1) if (when < t).mean() >= recall)
    return index


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, sample_rows: int = 4096, block: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 9, **settings) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` found for each row of ``queries``: query_id, rank, vec_id, score.

    Nearness is the inner product in double precision; ties go to the smaller vec_id; a query's own vec_id is no candidate.
    The index is fitted on a random sample of at most about ``sample_rows`` distinct vectors and holds all of them. Exact
    copies are searched once and each listed. Vectors that are null, zero or hold null or non-finite components, and null
    ids, take no part; vectors of other lengths than the query's are no candidates, and the length of the most rows of the
    sample is indexed by parts, others in one. A query that finds fewer than ``k`` where there are more asks all parts.
    Rows that repeat a vec_id count once as a query and each as a candidate. Empty tables give no rows."""
    spark = vectors.sparkSession
    rows = materialize(numbers(vectors, id_col, vector_col), "vectors")
    few = rows.filter("digest IS NOT NULL AND vec_id IS NOT NULL").withColumn("_r", F.row_number().over(Window.partitionBy("digest").orderBy("vec_id"))).filter(F.col("_r") <= k + 1).groupBy("digest").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    reps = materialize(distinct_vectors(rows).join(few, "digest"), "distinct-vectors")
    asked = materialize(numbers(queries, id_col, vector_col).filter("digest IS NOT NULL AND vec_id IS NOT NULL"), "queries")
    questions = materialize(distinct_vectors(asked), "distinct-queries")
    n = reps.count()
    drawn = F.pmod(F.xxhash64("rep", F.lit(seed)), F.lit(max(n, 1))) < sample_rows
    sample = reps.filter(drawn).orderBy(F.xxhash64("rep", F.lit(seed + 1))).limit(2 * sample_rows).select("v", "dim").toArrow()
    dim = int(np.bincount(sample["dim"].to_numpy()).argmax()) if len(sample) else 0
    index = fit_index(np.stack([np.frombuffer(x.as_buffer(), "<f8") for x, d in zip(sample["v"], sample["dim"].to_pylist(), strict=True) if d == dim]), k=k, seed=seed, **settings) if len(sample) else PartitionIndex(None, 1, 1)

    def route(df: DataFrame, probes: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = batch.column(batch.schema.names.index("dim")).to_numpy()
                for d in np.unique(dims):
                    part = batch.take(pa.array(np.flatnonzero(dims == d)))
                    at = index.ranked(fixed(part.column(1), "<f8"), probes) if d == dim else np.zeros((part.num_rows, 1), int)
                    whole = part.take(pa.array(np.repeat(np.arange(part.num_rows), at.shape[1])))
                    yield pa.RecordBatch.from_arrays([*whole.columns, pa.array(at.ravel() + int(d) * 65536)], names=[*batch.schema.names, "part"])

        return df.select("rep", "v", "dim").mapInArrow(run, "rep long, v binary, dim int, part long")

    def rank(_: tuple, q: pa.Table, c: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if len(q) and len(c):
            mq, mc = (fixed(x["v"].combine_chunks(), "<f8") for x in (q, c))
            ids, cands = q["rep"].to_numpy(), c["rep"].to_numpy()
            for lo in range(0, len(mq), 256):
                s = mq[lo : lo + 256] @ mc.T
                top = np.argpartition(-s, k, axis=1)[:, : k + 1] if s.shape[1] > k + 1 else np.broadcast_to(np.arange(s.shape[1]), s.shape)
                least = np.take_along_axis(s, top, axis=1).min(1)
                r, x = np.nonzero(s >= least[:, None])  # ties of the last one too
                out[0].append(ids[lo + r])
                out[1].append(cands[x])
                out[2].append(s[r, x])
        cols = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return pa.table({"q": pa.array(cols[0].astype(np.int64)), "rep": pa.array(cols[1].astype(np.int64)), "score": pa.array(cols[2].astype(float))})

    def ranked(found: DataFrame, keys: list[str], order: str) -> DataFrame:
        return found.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), order))).filter(F.col("_r") <= k + 1).drop("_r")

    stored = materialize(route(reps, 1), "index")
    sizes = stored.groupBy("part").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))

    def ask(who: DataFrame, probes: int) -> DataFrame:
        """Each block of a part's vectors meets each block of the queries that come to it."""
        routed = materialize(route(who, probes), "routed")
        ways = routed.groupBy("part").agg(F.ceil(F.count("*") / 1024).cast("int").alias("q_blocks"))
        plan = sizes.join(ways, "part")  # a row per part
        spread = lambda df, own, other: df.join(plan, "part").withColumns({own: F.pmod(F.xxhash64("rep"), F.col({"b": "blocks", "qb": "q_blocks"}[own])).cast("int"), other: F.explode(F.sequence(F.lit(0), F.col({"b": "blocks", "qb": "q_blocks"}[other]) - 1))}).select("part", "b", "qb", "rep", "v").repartition(width(spark), "part", "b", "qb")
        found = spread(routed, "qb", "b").groupBy("part", "b", "qb").cogroup(spread(stored, "b", "qb").groupBy("part", "b", "qb")).applyInArrow(rank, "q long, rep long, score double")
        return materialize(ranked(found, ["q"], "rep"), "found")

    found = ask(questions, index.probes)
    if index.probes < index.parts:
        short = questions.join(found.groupBy(F.col("q").alias("rep")).agg(F.count("*").alias("_n")), "rep", "left").filter(F.coalesce("_n", F.lit(0)) < min(k + 1, n)).drop("_n")
        if not short.isEmpty():
            again = ask(short, index.parts)
            found = found.join(again.select("q").distinct(), "q", "left_anti").unionByName(again)
    each = asked.select("digest", F.col("vec_id").alias("query_id")).distinct().join(questions.select("digest", F.col("rep").alias("q")), "digest").join(found, "q").join(reps.select("rep", "ids"), "rep")
    each = each.select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: rows of embeddings whose vec_id is divisible by 20; candidates: all rows."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.filter("vec_id % 20 = 0"))
