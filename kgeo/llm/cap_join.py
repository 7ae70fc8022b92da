"""Embedding near-dedup by spherical-cap filters.

A filter is a direction; a vector belongs to the filters whose direction it is near to. Directions come from a structured
random product code: the (rotated) space is cut into two halves with a random codebook each, and every pair of codewords,
one from each half, is a direction. A vector's filters are list-decoded from the two short lists of inner products without
looking at all pairs. A few such codes, each with a rotation of its own, make up for vectors that one code serves badly. Vectors that meet in a filter and are near by half-precision values form groups, and within each
group all pairs are compared in double precision."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgeo.llm.graph import by_group, connected_components, forest, pair_blocks
from kgeo.llm.storage import materialize
from kgeo.llm.vectors import distinct_vectors, fixed, numbers

#: Vectors of fewer dimensions get fewer codewords and a nearer reach.
LOW = 64


class ProductCode:
    """``codewords`` ** 2 directions for vectors of ``dim``; a unit vector belongs to those whose inner product with it is at
    or over ``reach`` standard deviations of a random direction's."""

    def __init__(self, dim: int, codewords: int, reach: float, seed: int):
        rng = np.random.default_rng([seed, dim])
        self.n, self.reach = min(codewords, 1 << (dim // 2 + 2)), reach
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.cuts = [c for c in np.array_split(np.arange(dim), 2) if len(c)]
        self.books = [b / np.linalg.norm(b, axis=0) * np.sqrt(dim / len(self.cuts)) for b in (rng.standard_normal((len(c), self.n)) for c in self.cuts)]
        if dim < LOW:  # no inner product is over the square root of the dimension: ask what all of some random vectors reach
            x = rng.standard_normal((256, dim))
            near = [(x / np.linalg.norm(x, axis=1, keepdims=True))[:, c] @ b for c, b in zip(self.cuts, self.books, strict=True)]
            every = (near[0][:64, :, None] + near[1][:64, None, :]).ravel() if len(near) > 1 else near[0].ravel()
            self.reach = min(reach, max(0.85 * float(sum(n.max(1) for n in near).min()), float(np.quantile(every, max(0.0, 1 - 40 / self.n**2)))))

    def filters(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and filter numbers, of all filters of all rows of unit vectors. A single dimension has its codewords as filters."""
        turned = units @ self.turn
        near = [turned[:, c] @ b for c, b in zip(self.cuts, self.books, strict=True)]
        if len(near) == 1:
            return np.nonzero(near[0] > 0)
        row, a = np.nonzero(near[0] >= self.reach - near[1].max(1, keepdims=True))
        rows, keys = [np.zeros(0, int)], [np.zeros(0, int)]
        for lo in range(0, len(row), 4096):
            r, x = row[lo : lo + 4096], a[lo : lo + 4096]
            k, b = np.nonzero(near[1][r] >= self.reach - near[0][r, x][:, None])
            rows.append(r[k])
            keys.append(x[k] * self.n + b)
        return np.concatenate(rows), np.concatenate(keys)


def near_pairs(vectors: DataFrame, threshold: float = 0.9, codewords: int = 256, reach: float = 3.28, codes: int = 3, seed: int = 17, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row of ``vectors``: vec_id, n_links, component_id, kept, by cosine of at least ``threshold`` in double precision.

    Exact copies are one vector with a count. Vectors of other lengths never meet. A vector that takes no part (null, zero,
    a null or non-finite component) has no links and is its own component; so is a row with a null id, with a null
    component, kept. Rows that repeat a vec_id are vectors of their own with the same id. Labels and other columns are
    ignored. The filters find pairs with high probability (README); no pair below the threshold is linked."""
    rows = materialize(numbers(vectors, id_col, vector_col), "vectors")
    reps = materialize(distinct_vectors(rows), "distinct-vectors")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[tuple[int, int], ProductCode] = {}
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for c in range(codes):
                    if (c, int(dim)) not in made:
                        made[c, int(dim)] = ProductCode(int(dim), codewords, reach, seed + c)
                for lo in range(0, len(at), 512):
                    part = batch.take(pa.array(at[lo : lo + 512]))
                    units = fixed(part.column(1), "<f8").copy()
                    units /= np.linalg.norm(units, axis=1, keepdims=True)
                    ids = part.column(0).to_numpy()
                    for c in range(codes):
                        row, key = made[c, int(dim)].filters(units)
                        yield pa.RecordBatch.from_arrays([pa.array((key * codes + c) * 65536 + int(dim) % 65536), pa.array(ids[row])], names=["key", "rep"])

    keys = materialize(reps.select("rep", "v", "dim").mapInArrow(decode, "key long, rep long"), "filters")

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1):
                v = np.frombuffer(x.as_buffer(), "<f8")
                out.append((v / np.linalg.norm(v)).astype("<f2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["rep", "half"])

    def meet(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: list[tuple[int, int]] = []
        for g in groups:
            half = fixed(g["half"], "<f2")
            if half is None:
                continue  # vectors of other lengths that share a number
            m, ids = half.astype(np.float32), g["rep"].to_numpy()
            edges += [(int(ids[a]), int(ids[b])) for a, b in forest(m @ m.T >= threshold - 0.004)]
            if len(edges) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges, strict=True)], names=["a", "b"])
                edges = []
        if edges:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges, strict=True)], names=["a", "b"])

    met = pair_blocks(keys, "key", "rep").join(reps.select("rep", "v").mapInArrow(halve, "rep long, half binary"), "rep")
    groups = connected_components(by_group(met.select("key", "block_a", "block_b", "rep", "half"), "key", meet, "a long, b long"))

    def verify(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in tables:
            own, same = g["own"].to_numpy(), g["block_a"][0].as_py() == g["block_b"][0].as_py()
            ids, copies, m = g["rep"].to_numpy(), g["copies"].to_numpy(), fixed(g["v"], "<f8").copy()
            m /= np.linalg.norm(m, axis=1, keepdims=True)
            linked = m @ m.T >= threshold
            np.fill_diagonal(linked, False)
            if not same:
                linked &= own[:, None] != own[None, :]
            links = linked @ copies
            edges = forest(linked)
            a = np.concatenate([ids, np.array([ids[x] for x, _ in edges], np.int64)])
            b = np.concatenate([np.full(len(ids), -1), np.array([ids[y] for _, y in edges], np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.concatenate([links, np.zeros(len(edges), np.int64)])), pa.array(np.arange(len(a)) >= len(ids))], names=["a", "b", "links", "edge"])

    members = groups.withColumnRenamed("node", "rep").join(reps.select("rep", "v", "copies"), "rep")
    checked = materialize(by_group(pair_blocks(members, "component", "rep").select("component", "block_a", "block_b", "own", "rep", "copies", "v"), "component", verify, "a long, b long, links long, edge boolean"), "links")
    links = checked.filter("NOT edge").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    classes = connected_components(checked.filter("edge").select("a", "b")).withColumnRenamed("node", "rep")
    by_rep = reps.select("digest", "rep", "copies").join(links, "rep", "left").join(classes, "rep", "left").select("digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("digest")).alias("digest")).join(by_rep, "digest", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op9_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of the embeddings table."""
    return near_pairs(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
