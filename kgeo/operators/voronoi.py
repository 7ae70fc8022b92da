"""Cells around points of the sphere, by sampling with a fixed seed."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgeo.operators.ml import cut_lineage

CELL = "id long, volume double, boundary double, eccentricity double, neighbours int"


def samples(center: np.ndarray, n: int, radius: float, rng: np.random.Generator) -> np.ndarray:
    """Points cos(a) * center + sin(a) * t, for random tangents t of length one and a uniform up to ``radius``."""
    t = rng.standard_normal((n, 4))
    t -= (t @ center)[:, None] * center
    t /= np.maximum(np.linalg.norm(t, axis=1, keepdims=True), 1e-12)
    a = rng.uniform(0, radius, (n, 1))
    return np.cos(a) * center + np.sin(a) * t


#: Points to a leaf, levels of leaves at most, points sampled to place the cuts. No result depends on them.
LEAF, DEPTH, SAMPLE = 2048, 12, 1 << 15


class Leaves:
    """A tree of cuts at medians of ``points``: a leaf for each place, and the leaves within reach of one."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth, n = depth, (1 << depth) - 1
        self.axis, self.cut = np.zeros(n, int), np.zeros(n)
        low, high = np.full((2 * n + 1, 4), -np.inf), np.full((2 * n + 1, 4), np.inf)
        parts = {0: points}
        for i in range(n):
            p = parts.pop(i)
            if len(p):
                self.axis[i] = np.ptp(p, axis=0).argmax()
                self.cut[i] = np.median(p[:, self.axis[i]])
            left = p[:, self.axis[i]] < self.cut[i]
            for child, own in ((2 * i + 1, left), (2 * i + 2, ~left)):
                parts[child], low[child], high[child] = p[own], low[i], high[i]
            high[2 * i + 1, self.axis[i]] = low[2 * i + 2, self.axis[i]] = self.cut[i]
        self.low, self.high = low[n:], high[n:]

    def of(self, points: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(points), int), np.arange(len(points))
        for _ in range(self.depth):
            at = 2 * at + 1 + (points[rows, self.axis[at]] >= self.cut[at])
        return at - len(self.axis)

    def within(self, points: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Matrix of whether a leaf may hold a place that near."""
        away = sum(np.square(np.maximum(0, np.maximum(self.low[:, c] - points[:, c, None], points[:, c, None] - self.high[:, c]))) for c in range(4))
        return away <= np.square(reach)[:, None]


def nearest_within(places: DataFrame, k: int, radius: float) -> DataFrame:
    """Per place (id, x..w): at least the ``k`` nearest others, if so many lie within ``radius``: others (ids) and points (flat).

    A place looks through its own leaf, then through the leaves nearer than the ``k``-th found there; of equal points only
    k + 1 are candidates, so no leaf is compared with all copies of one point."""
    rows = places.select("id", *"xyzw").filter("id IS NOT NULL AND " + " AND ".join(f"abs({c}) < 1e300" for c in "xyzw"))
    n = rows.count()
    drawn = rows.filter(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) <= int((1 << 30) * min(1, SAMPLE / max(n, 1)))).select(*"xyzw").toPandas().to_numpy()  # about SAMPLE rows
    leaves = Leaves(drawn.reshape(-1, 4), min(DEPTH, max(0, int(np.ceil(np.log2(max(n, 1) / LEAF))))))

    def route(batches):
        for p in batches:
            yield p.assign(leaf=leaves.of(p[[*"xyzw"]].to_numpy()).astype(np.int32))

    kind = rows.schema["id"].dataType.simpleString()
    placed = rows.mapInPandas(route, f"id {kind}, x double, y double, z double, w double, leaf int")
    one = placed.groupBy("id").agg(F.min(F.struct("leaf", *"xyzw")).alias("at")).select("id", "at.*")
    copies = Window.partitionBy("leaf", *"xyzw").orderBy("id")
    found = placed.withColumn("_r", F.row_number().over(copies)).filter(F.col("_r") <= k + 1).drop("_r")

    def look(asked: pd.DataFrame, held: pd.DataFrame, step: int = 512):
        """Per chunk of ``asked``: it, which of ``held`` to keep, and the k-th nearness (-inf, if there is none)."""
        c, ids = held[[*"xyzw"]].to_numpy(), held["id"].to_numpy()
        for lo in range(0, len(asked), step):
            part = asked.iloc[lo : lo + step]
            q = part[[*"xyzw"]].to_numpy()
            s = q @ c.T
            away = sum(np.square(q[:, None, i] - c[None, :, i]) for i in range(4))
            s[(part["id"].to_numpy()[:, None] == ids) | (np.sqrt(away) > radius)] = -np.inf
            kth = np.partition(s, -k, axis=1)[:, -k] if len(c) > k else np.full(len(q), -np.inf)
            keep = (s >= kth[:, None] - 1e-12) & (s > -np.inf)
            yield part, [ids[x] for x in keep], [c[x].ravel() for x in keep], kth

    def inside(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part, others, points, kth in look(asked, held):
            reach = np.minimum(radius, np.sqrt(np.maximum(0, 2 - 2 * np.maximum(kth, -1)))) + 1e-6
            more = leaves.within(part[[*"xyzw"]].to_numpy(), reach)
            more[np.arange(len(part)), part["leaf"].to_numpy()] = False
            out.append(part.drop(columns="leaf").assign(others=others, points=points, reach=reach, more=[np.flatnonzero(x).astype(np.int32) for x in more]))
        return pd.concat(out) if out else pd.DataFrame(columns=["id", *"xyzw", "others", "points", "reach", "more"])

    def beyond(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = [part.drop(columns=["leaf", "reach"]).assign(others=others, points=points) for part, others, points, _ in look(asked, held)]
        return pd.concat(out) if out else pd.DataFrame(columns=["id", *"xyzw", "others", "points"])

    made = f"id {kind}, x double, y double, z double, w double, others array<{kind}>, points array<double>"
    own = cut_lineage(one.groupBy("leaf").cogroup(found.groupBy("leaf")).applyInPandas(inside, f"{made}, reach double, more array<int>"))
    asked = own.select("id", *"xyzw", "reach", F.explode("more").alias("leaf"))
    further = asked.groupBy("leaf").cogroup(found.groupBy("leaf")).applyInPandas(beyond, made)
    both = own.drop("reach", "more").unionByName(further.filter(F.size("others") > 0))
    return both.groupBy("id").agg(*[F.first(c).alias(c) for c in "xyzw"], F.flatten(F.collect_list("others")).alias("others"), F.flatten(F.collect_list("points")).alias("points"))


def analyze_cells(places: DataFrame, n: int = 1000, radius: float = 0.5, most_neighbours: int = 32) -> DataFrame:
    """``places``: id, x..w. Per place with others within twice the radius: the share of samples nearer to it than to any other
    (volume), their mean distance to the nearest other, the scatter's eccentricity, and how many others own a sample (CELL).

    The others are the ``most_neighbours`` nearest, of equally near ones those of smaller id; samples depend on the id alone."""
    near = nearest_within(places, most_neighbours, 2 * np.sin(min(np.pi / 2, radius)))

    def cell(id_: int, own: np.ndarray, others: np.ndarray, points: np.ndarray) -> tuple:
        order = np.lexsort((others, -(points @ own)))[:most_neighbours]
        m = points[order]
        s = samples(own, n, radius, np.random.default_rng([abs(int(id_)), 77]))
        if not len(m):
            return (id_, 1.0, None, 0.0, 0)
        mine, theirs = s @ own, s @ m.T
        inside = mine >= theirs.max(1)
        scatter = np.linalg.eigvalsh(np.cov(s[inside].T)) if inside.sum() > 4 else np.zeros(4)
        ecc = float(np.sqrt(max(0.0, 1 - scatter[1] / scatter[-1]))) if scatter[-1] > 0 else 0.0
        away = float(np.arccos(np.clip(theirs[inside].max(1), -1, 1)).mean()) if inside.any() else 0.0
        return (id_, float(inside.mean()), away, ecc, len(np.unique(theirs[~inside].argmax(1))))

    def run(batches):
        for p in batches:
            rows = [cell(i, np.array(at), np.asarray(others, np.int64), np.asarray(points, float).reshape(-1, 4)) for i, *at, others, points in p[["id", *"xyzw", "others", "points"]].itertuples(index=False)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CELL.split(", ")])

    return near.mapInPandas(run, CELL)


def analyze_neighbourhood(places: DataFrame, edges: DataFrame, id_: int, n: int = 200, top: int = 8) -> DataFrame:
    """Cells of a composition and of its ``top`` best rated neighbours."""
    near = edges.filter(F.col("src") == id_).orderBy(F.desc("elo"), "dst").limit(top).select(F.col("dst").alias("id"))
    wanted = near.unionByName(edges.sparkSession.createDataFrame([(id_,)], "id long")).distinct()
    return analyze_cells(places.join(wanted, "id", "left_semi"), n)


def boundary_concepts(places: DataFrame, edges: DataFrame, degree: int = 8, volume: float = 0.3, limit: int = 50, n: int = 200) -> DataFrame:
    """Compositions with at least ``degree`` neighbours whose cell holds at most ``volume`` of its samples."""
    placed = edges.join(places.select(F.col("id").alias("src")), "src", "left_semi")
    high = placed.groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("degree")).filter(F.col("degree") >= degree)
    chosen = cut_lineage(places.join(high, "id"))  # as many rows as places have
    return analyze_cells(chosen.select("id", *"xyzw"), n).filter(F.col("volume") <= volume).join(chosen.select("id", "degree"), "id").orderBy("volume", "id").limit(limit)
