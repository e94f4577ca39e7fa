"""Verdicts of the quality rules against a plain minimum covariance determinant, with a cluster of far rows."""

import math

import numpy as np
import pytest

from recordqc.llm import quality

P, G, D = quality.P, quality.GRID, quality.DGRID
FLOOR2 = np.diag(np.array(quality.FLOOR) ** 2)


def table(seed, far):
    """Rows of two groups, correlated; ``far`` of every 100 in a cluster of their own."""
    rng = np.random.default_rng(seed)
    mix = np.eye(P) + 0.6 * rng.normal(size=(P, P))
    out = []
    for g, n in (("a", 300), ("b", 120)):
        x = rng.normal(size=(n, P)) @ mix + 3
        x[: n * far // 100] = rng.normal(size=(n * far // 100, P)) * 0.2 + np.array([9, -7, 8, 9, -9])
        out += [(g, *map(int, row)) for row in np.rint(x * G)]
    return out


def scatter(x, factor):
    mean = x.mean(axis=0)
    return mean, factor * ((x.T @ x) / len(x) - np.outer(mean, mean)) + FLOOR2


def distances(x, mean, cov):
    return (np.linalg.solve(np.linalg.cholesky(cov), (x - mean).T) ** 2).sum(axis=0)


def plain(x, core=0.75):
    """The start that is least after two steps, and its estimate in the end."""
    q = np.percentile(x, [25, 50, 75], axis=0)
    d = np.sqrt(((q[2] - q[0]) / 1.349) ** 2 + np.diag(FLOOR2))
    z = (x - q[1]) / d
    bent = [np.tanh(z), z / np.linalg.norm(z, axis=1, keepdims=True)]
    corrs = [np.eye(P)] + [0.99 * np.corrcoef(np.rint(b * G).T) + 0.01 * np.eye(P) for b in bent]
    def steps(mean, cov, n):
        for _ in range(n):
            dist = np.floor(np.log1p(distances(x, mean, cov)) * D)
            mean, cov = scatter(x[dist <= np.percentile(dist, core * 100)], quality._consistency(core))
        return np.linalg.slogdet(cov)[1], mean, cov
    found = [steps(q[1], c * np.outer(d, d), 2) for c in corrs]
    best = min(range(3), key=lambda i: found[i][0])
    return best, steps(*found[best][1:], 28)


@pytest.mark.parametrize("seed,far", [(1, 0), (3, 20)])
def test_least_determinant_of_three_starts(spark, tmp_path, seed, far):
    rows = table(seed, far)
    spark.createDataFrame(rows, "g string, " + ", ".join(f"x{i} long" for i in range(P))).repartition(5).write.parquet(f"{tmp_path}/r")
    got = {r["g"]: r for r in quality.estimate(spark.read.parquet(f"{tmp_path}/r"), steps=30).collect()}
    for g in "ab":
        x = np.array([r[1:] for r in rows if r[0] == g]) / G
        best, (det, mean, cov) = plain(x)
        assert math.isclose(got[g]["logdet"], det, abs_tol=1e-6)
        assert got[g]["start"] == best
        chol = np.linalg.cholesky(cov)
        assert np.allclose([got[g][f"m{i}"] for i in range(P)], mean, atol=1e-6)
        assert np.allclose([got[g][f"l{i}{j}"] for i in range(P) for j in range(i + 1)], [chol[i, j] for i in range(P) for j in range(i + 1)], atol=1e-6)
        dist = distances(x, mean, cov)
        n_far = len(x) * far // 100
        assert (dist[:n_far] > quality.chi2_quantile(1 - 1e-5, P)).all()
        assert (dist[n_far:] < quality.chi2_quantile(1 - 1e-5, P)).mean() > 0.99
