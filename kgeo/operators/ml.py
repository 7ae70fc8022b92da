"""Model weights and embeddings as relations: nearest-neighbour edges, extractors, a spectral projection to the sphere."""

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgeo.functions import geometry as g
from kgeo.operators.search import knn_join


def embedding_edges(vectors: DataFrame, k: int = 64, threshold: float = 0.40) -> DataFrame:
    """``vectors``: id, v. The ``k`` nearest of each by cosine, elo = 1000 + 500 * sim: src, dst, sim, elo."""
    return knn_join(vectors, vectors, k, threshold).withColumn("elo", 1000 + 500 * F.col("sim"))


#: The base rating of an edge by the kind of weights it comes from.
WEIGHT_ELO = {"qk": 1600, "v": 1650, "o": 1550, "gate": 1800, "up": 1750, "down": 1700}


def procedural_edges(vectors: DataFrame, kind: str, depth: float = 0.0, k: int = 16, threshold: float = 0.5) -> DataFrame:
    """Edges of projected vectors: elo = base of the kind + 200 * depth + 200 * sim; ``depth`` is the layer's place in [0, 1]."""
    return knn_join(vectors, vectors, k, threshold).withColumn("elo", WEIGHT_ELO[kind] + 200.0 * depth + 200 * F.col("sim"))


def project(vectors: DataFrame, weights: np.ndarray, gate: bool = False) -> DataFrame:
    """``vectors`` times a weight matrix (dim x out), batch by batch; ``gate`` applies x * sigmoid(x)."""

    def run(batches):
        for b in batches:
            if len(b):
                y = np.stack(b["v"].to_numpy()) @ weights
                y = y / (1 + np.exp(-y)) if gate else y
                yield pd.DataFrame({"id": b["id"], "v": [*y]})

    return vectors.select("id", F.col("v").cast("array<double>").alias("v")).mapInPandas(run, "id long, v array<double>")


def sparse(vectors: DataFrame, least: float = 0.01) -> DataFrame:
    """Components under ``least`` to zero."""
    return vectors.withColumn("v", F.transform("v", lambda x: F.when(F.abs(x) < least, F.lit(0).cast("double")).otherwise(x.cast("double"))))


def attention_relations(weights: DataFrame, least: float = 0.01, heads: int = 8) -> DataFrame:
    """``weights``: idx, i, row (array). Layer and head from idx; (layer, head, i, j, w) of weights of at least ``least``."""
    return weights.select(F.floor(F.col("idx") / heads).cast("int").alias("layer"), F.pmod("idx", F.lit(heads)).cast("int").alias("head"), "i", F.posexplode("row").alias("j", "w")).filter(F.col("w") >= least)


def convolution_relations(weights: DataFrame, least: float = 0.1) -> DataFrame:
    """``weights``: i, row. (i, j, w) with w = tanh |weight| where |weight| is at least ``least``."""
    return weights.select("i", F.posexplode("row").alias("j", "raw")).filter(F.abs("raw") >= least).select("i", "j", F.tanh(F.abs("raw")).alias("w"))


def recurrent_relations(states: DataFrame, matrix: np.ndarray) -> DataFrame:
    """``states``: id (time), v. From each state to the next: (1 + cosine of matrix * state and the next) / 2."""
    from pyspark.sql import Window

    moved = project(states, np.asarray(matrix).T).withColumnRenamed("v", "m")
    both = moved.join(states.select("id", F.lead("v").over(Window.orderBy("id")).alias("nxt")), "id").filter("nxt IS NOT NULL")  # one sequence
    d = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return both.select("id", ((1 + d("m", "nxt") / F.sqrt(d("m", "m") * d("nxt", "nxt"))) / 2).alias("w"))


def similar_layers(rows: DataFrame, threshold: float = 0.98) -> DataFrame:
    """``rows``: layer, row, v (sampled). Layers whose rows have a mean cosine over ``threshold`` with the layer before: layer, mean, skip."""
    nxt = rows.select((F.col("layer") - 1).alias("layer"), "row", F.col("v").alias("u"))
    d = lambda a, b: F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda s, x: s + x)
    cos = d("v", "u") / F.sqrt(d("v", "v") * d("u", "u"))
    return rows.join(nxt, ["layer", "row"]).groupBy((F.col("layer") + 1).alias("layer")).agg(F.avg(cos).alias("mean")).withColumn("skip", F.col("mean") > threshold)


def eigenmap(edges: DataFrame, limit: int = 5000) -> DataFrame:
    """Nodes of a neighbour graph (src, dst, sim) on the 3-sphere: the four eigenvectors of the normalised Laplacian after the
    trivial one, made orthonormal, rows to length one: id, x, y, z, w.

    The dense solver takes graphs of up to ``limit`` nodes, which are checked; larger graphs are refused: ``eigenmap_sparse`` takes them."""
    nodes = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    if (n := nodes.count()) > limit:
        raise ValueError(f"{n} nodes are more than the {limit} the dense solver takes")
    ids = [r.id for r in nodes.orderBy("id").collect()]
    at, m = {x: i for i, x in enumerate(ids)}, np.zeros((n, n))
    for r in edges.select("src", "dst", "sim").collect():
        m[at[r.src], at[r.dst]] = m[at[r.dst], at[r.src]] = np.exp(-(1 - r.sim) ** 2)
    d = 1 / np.sqrt(np.maximum(m.sum(1), 1e-12))
    _, vectors = np.linalg.eigh(np.eye(n) - d[:, None] * m * d[None, :])
    q = np.linalg.qr(vectors[:, 1:5])[0] if n > 4 else np.pad(vectors[:, 1:], ((0, 0), (0, max(0, 5 - n))))[:, :4]
    size = np.linalg.norm(q, axis=1, keepdims=True)
    q = np.where(size > 1e-12, q / np.maximum(size, 1e-12), [[1.0, 0, 0, 0]])
    return edges.sparkSession.createDataFrame([(x, *map(float, r)) for x, r in zip(ids, q, strict=True)], "id long, x double, y double, z double, w double")


def _checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder. Only a local master gets a folder of its own where none is set."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = context.getConf().get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="kgeo-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` without its lineage, in the checkpoint folder."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written to the checkpoint folder, read again, and its place; the shuffle files of the write are removed."""
    spark, cleanup = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path = f"{_checkpoint_dir(spark)}/kgeo-{uuid.uuid4().hex}"
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    return spark.read.schema(df.schema).parquet(path), path


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def _matrix(column: pa.ListArray) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), len(values) // len(column))


def _lists(matrix: np.ndarray) -> pa.ListArray:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(matrix.ravel()))


def _sum(rows: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over the batches of basis and new of the matrices that ``of`` makes; one a task comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(of(_matrix(b.column(0)), _matrix(b.column(1))) for b in batches if b.num_rows)
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([len(total)], pa.int32()), _lists(total.reshape(1, -1))], names=["n", "m"])

    parts = rows.select("basis", "new").mapInArrow(run, "n int, m array<double>").collect()
    return sum(np.array(r.m).reshape(r.n, -1) for r in parts)


def eigenmap_sparse(edges: DataFrame, block: int = 8, steps: int = 12, tolerance: float = 1e-5, most: int = 5000) -> DataFrame:
    """As ``eigenmap``, for graphs of any size: block Lanczos on the edge table, all vectors kept orthogonal.

    A step is two sums of small matrices and one written table, a join of the edges with the last ``block`` vectors. A basis of
    ``steps`` blocks is cut to the third of it that leads and grows again (a thick restart), so a row holds and the driver's matrix
    is as wide as block * steps columns, however many steps it takes. It ends when the five leading eigenvectors are left with
    residuals of up to ``tolerance``; ``most`` steps, far more than such graphs take, are an error."""
    spark, held = edges.sparkSession, max(3 * 8, block * steps)
    pair = edges.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.exp(-F.pow(1 - F.max("sim"), 2)).alias("w"))
    raw, raw_path = _written(pair.unionByName(pair.filter("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"), "w")))
    degree = raw.groupBy("u").agg(F.sqrt(F.sum("w")).alias("d"))
    both, both_path = _written(raw.join(degree, "u").join(degree.select(F.col("u").alias("v"), F.col("d").alias("e")), "v").select("u", "v", (F.col("w") / F.col("d") / F.col("e")).alias("w")))
    start = [F.xxhash64("u", F.lit(k)) / 2.0**63 for k in range(block)]
    rows, path = _written(degree.select(F.col("u").alias("id"), F.expr("CAST(array() AS array<double>)").alias("basis"), F.array(*start).alias("new")))
    _remove(spark, raw_path)
    if rows.isEmpty():
        raise ValueError("a graph without edges has no places")
    kind = rows.schema["id"].dataType.simpleString()

    def each(rows: DataFrame, schema: str, of: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, ...]]) -> DataFrame:
        """id and the matrices that ``of`` makes of basis and new."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    made = [b.column(0), *map(_lists, of(_matrix(b.column(1)), _matrix(b.column(2))))]
                    yield pa.RecordBatch.from_arrays(made, names=["id", "basis", "last"][: len(made)])

        return rows.select("id", "basis", "new").mapInArrow(run, f"id {kind}, {schema}")

    t, width = np.zeros((0, 0)), 0
    for _ in range(most):
        h = _sum(rows, lambda b, x: b.T @ x) if width else np.zeros((0, block))

        def again(b: np.ndarray, x: np.ndarray, h: np.ndarray = h) -> np.ndarray:
            x = x - b @ h
            return np.concatenate([b, x], axis=1).T @ x

        # once more, so that rounding leaves nothing of the basis
        more = _sum(rows, again)
        h, left = h + more[: len(t)], more[len(t) :] - more[: len(t)].T @ more[: len(t)]
        size, turn = np.linalg.eigh(left)
        good = size > 1e-18 if width else size > 1e-9 * size.max()
        root, keep = turn[:, good] * np.sqrt(size[good]), None
        if width:
            t[:, -width:], t[-width:, :] = h, h.T
            values, s = np.linalg.eigh(t)
            leading = s[:, ::-1][:, :5]
            if not good.any() or (len(t) >= 5 and (np.linalg.norm(root.T @ leading[-width:], axis=0) <= tolerance).all()):
                break
            if len(t) + block > held:
                keep = s[:, ::-1][:, : held // 3]
                t = np.diag(values[::-1][: held // 3])
        width, onto = int(good.sum()), turn[:, good] / np.sqrt(size[good])
        t = np.pad(t, (0, width))

        def grown(b: np.ndarray, x: np.ndarray, h: np.ndarray = h, onto: np.ndarray = onto, keep: np.ndarray | None = keep) -> tuple[np.ndarray, np.ndarray]:
            last = (x - b @ h) @ onto
            return np.concatenate([b if keep is None else b @ keep, last], axis=1), last

        made = each(rows, "basis array<double>, last array<double>", grown)
        image = both.join(made.select(F.col("id").alias("v"), "last"), "v").groupBy("u").agg(F.array(*[F.sum(F.col("w") * F.col("last")[k]) for k in range(width)]).alias("new"))
        (rows, path), done = _written(made.select("id", "basis").join(image, F.col("id") == F.col("u")).select("id", "basis", "new")), path
        _remove(spark, done)
    else:
        raise RuntimeError(f"eigenvectors did not settle in {most} steps")
    _remove(spark, both_path)
    onto = np.pad(leading[:, 1:], ((0, 0), (0, max(0, 5 - leading.shape[1]))))

    def place(b: np.ndarray, _) -> tuple[np.ndarray]:
        q = b @ onto
        size = np.linalg.norm(q, axis=1, keepdims=True)
        return (np.where(size > 1e-12, q / np.maximum(size, 1e-12), [[1.0, 0, 0, 0]]),)

    return each(rows, "basis array<double>", place).select("id", *[F.col("basis")[k].alias(c) for k, c in enumerate("xyzw")])


def model_overlap(projections: DataFrame, radius: float | None = None) -> DataFrame:
    """``projections``: composition_id, content_id, x..w. Per composition in two contents or more: n, mean and largest geodesic
    distance of the contents' centroids; with ``radius`` only those spread that far."""
    center = projections.groupBy("composition_id", "content_id").agg(*[e.alias(c) for e, c in zip(g.centroid(), "xyzw", strict=True)])
    a, b = (center.select("composition_id", *[F.col(c).alias(f"{s}_{c}") for c in ("content_id", *"xyzw")]) for s in "ab")
    pairs = a.join(b, "composition_id").filter("a_content_id < b_content_id").withColumn("d", g.geodesic(g.point("a_"), g.point("b_")))
    n = center.groupBy("composition_id").agg(F.count("*").alias("n")).filter("n > 1")
    out = pairs.groupBy("composition_id").agg(F.avg("d").alias("spread"), F.max("d").alias("max_distance")).join(n, "composition_id").select("composition_id", "n", "spread", "max_distance")
    return out if radius is None else out.filter(F.col("spread") >= radius)
