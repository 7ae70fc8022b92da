"""Block-wise comparison of two sets of vectors, for exact nearest neighbours without a pair per row."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cosine_blocks(a: DataFrame, b: DataFrame, k: int, threshold: float, block: int) -> DataFrame:
    """src, dst, sim: per block of ``b`` the best ``k`` (and ties) of each vector of ``a``. Zero vectors have no neighbours."""
    na, nb = (max(1, -(-df.count() // block)) for df in (a, b))
    side = lambda df, own, other, n, m: df.select("id", F.col("v").cast("array<double>").alias("v"), F.pmod(F.xxhash64("id"), F.lit(n)).alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other)).withColumns({own: F.col(own).cast("int"), other: F.col(other).cast("int")})

    def meet(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        p, q = (x[[isinstance(v, np.ndarray) and bool(np.any(v)) for v in x["v"]]] for x in (p, q))
        if p.empty or q.empty:
            return pd.DataFrame({"src": pd.Series(dtype="int64"), "dst": pd.Series(dtype="int64"), "sim": pd.Series(dtype="float64")})
        x, y = (np.stack(t["v"].to_numpy()) for t in (p, q))
        s = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
        s[p["id"].to_numpy()[:, None] == q["id"].to_numpy()[None, :]] = -np.inf
        least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
        i, j = np.nonzero((s >= least[:, None]) & (s >= threshold))
        return pd.DataFrame({"src": p["id"].to_numpy()[i], "dst": q["id"].to_numpy()[j], "sim": s[i, j]})

    return side(a, "ab", "bb", na, nb).groupBy("ab", "bb").cogroup(side(b, "bb", "ab", nb, na).groupBy("ab", "bb")).applyInPandas(meet, "src long, dst long, sim double")
