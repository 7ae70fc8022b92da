"""The eigenmap over whole tables, and its sparse solver against the dense one."""

import numpy as np

from kgeo.operators import ml
from kgeo.plans.queries import QUERIES


def test_sparse_solver_equals_the_dense_one(spark):
    rng = np.random.default_rng(3)
    v = spark.createDataFrame([(i, rng.standard_normal(5).tolist()) for i in range(150)], "id long, v array<double>")
    edges = ml.embedding_edges(v, 8, 0.0).localCheckpoint()
    want, got = (f(edges).toPandas().sort_values("id")[[*"xyzw"]].to_numpy() for f in (ml.eigenmap, ml.eigenmap_sparse))
    assert np.allclose(np.abs(want), np.abs(got), atol=1e-3)


def test_every_embedding_has_a_place(spark, tmp_path):
    rng = np.random.default_rng(4)
    spark.createDataFrame([(i, rng.standard_normal(6).tolist()) for i in range(560)], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert sorted(r.id for r in QUERIES["m6_eigenmap"](spark, str(tmp_path)).collect()) == [*range(560)]


def test_a_graph_that_takes_more_steps_than_the_basis_holds(spark):
    """The basis is cut and grown again; that it does not settle in its first ``steps`` blocks is no error."""
    rng = np.random.default_rng(3)
    v = spark.createDataFrame([(i, rng.standard_normal(5).tolist()) for i in range(150)], "id long, v array<double>")
    edges = ml.embedding_edges(v, 8, 0.0).localCheckpoint()
    want = ml.eigenmap(edges).toPandas().sort_values("id")[[*"xyzw"]].to_numpy()
    got = ml.eigenmap_sparse(edges, steps=4).toPandas().sort_values("id")[[*"xyzw"]].to_numpy()
    assert np.allclose(np.abs(want), np.abs(got), atol=1e-3)
