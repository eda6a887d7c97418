"""Density groups at size: cells in place of pairs for few columns, blocks of bounded size for wide vectors."""

import random

import numpy as np
import pytest

from tabulon.operators import density, groups


def brute(x, eps, least):
    """Cluster by smallest core index, noise -1."""
    near = sum((x[:, None, i] - x[None, :, i]) ** 2 for i in range(x.shape[1])) <= eps * eps
    core = near.sum(axis=1) >= least
    label = np.where(core, np.arange(len(x)), len(x))
    while True:
        new = np.where(core, np.minimum(label, np.where(near & core[None, :], label[None, :], len(x)).min(axis=1)), len(x))
        if (new == label).all():
            break
        label = new
    out = np.where(near & core[None, :], label[None, :], len(x)).min(axis=1)
    return np.where(out == len(x), -1, out).tolist()


def frame(spark, x):
    return spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, " + ", ".join(f"c{i} double" for i in range(x.shape[1])))


@pytest.mark.parametrize("dims, eps, levels", [(1, 0.02, 12), (2, 0.15, 12), (2, 0.15, 1), (3, 0.45, 12)])
def test_grid_is_exact(spark, dims, eps, levels):
    rng = np.random.default_rng(dims)
    x = np.r_[rng.normal(size=(250, dims)), np.round(rng.normal(size=(100, dims)), 1), rng.normal(size=(60, dims)) * 0.05 + 3, np.full((9, dims), -7.0)]
    got = {r["id"]: r["cluster"] for r in density.grid_groups(frame(spark, x), "id", [f"c{i}" for i in range(dims)], eps, 4, levels=levels).collect()}
    assert got == dict(enumerate(brute(x, eps, 4))) and len(set(got.values())) > 3


def test_cells_that_touch_at_exactly_eps(spark):
    """Two crowds a distance of eps or a little more apart, which only their nearest points decide."""
    for apart in (0.5, 0.5 + 1e-9):
        x = np.array([[-k / 97 / 8, 0.0] for k in range(20)] + [[apart + k / 97 / 8, 0.0] for k in range(20)])
        got = [r["cluster"] for r in density.grid_groups(frame(spark, x), "id", ["c0", "c1"], 0.5, 4).orderBy("id").collect()]
        assert got == brute(x, 0.5, 4) and len(set(got)) == (1 if apart == 0.5 else 2)


def test_a_crowd_makes_no_pairs(spark):
    """6,000 points within eps would be 36 million pairs."""
    rnd = random.Random(3)
    x = np.array([[rnd.random() * 0.1, rnd.random() * 0.1] for _ in range(6000)] + [[50.0, 50.0], [float("inf"), 1.0]])
    got = {r["id"]: r["cluster"] for r in groups.density_groups(frame(spark, x), "id", ["c0", "c1"], 0.5, 4).collect()}
    assert set(got.values()) == {0, -1} and got[6000] == got[6001] == -1 and len(got) == 6002


@pytest.mark.parametrize("crowd, block", [(1500, None), (30, 90), (25, 10_000)])
def test_vectors_that_buckets_do_not_part_meet_once_and_exactly(spark, crowd, block):
    """Unit vectors with a wide eps: nearly all share their bucket in all tables."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(5, 8))
    x = np.r_[centres[rng.integers(0, 5, 300)] + rng.normal(size=(300, 8)) * 0.3, rng.normal(size=(60, 8))]
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {r["id"]: r["cluster"] for r in density.density_groups(rows, "id", ["v"], 0.45, 4, crowd=crowd, block=block).collect()}
    assert got == dict(enumerate(brute(x, 0.45, 4))) and len(set(got.values())) > 3
