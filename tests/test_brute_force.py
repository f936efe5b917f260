"""Distributed methods against plain computations on small random data."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from asclera.operators import neighbors
from asclera.plans import cells, models, search, survival


@pytest.fixture(scope="module")
def patients_data():
    rng = random.Random(3)
    return [(rng.randint(1, 25), int(rng.random() < 0.6), round(rng.gauss(0, 1), 2), rng.randint(0, 1), "abc"[rng.randint(0, 2)]) for _ in range(160)]


@pytest.fixture(scope="module")
def patients_df(spark, patients_data):
    return spark.createDataFrame(patients_data, "time int, event int, x double, z int, g string")


def efron(data, steps=30):
    """Newton steps of the Efron partial likelihood."""
    t, e = np.array([r[0] for r in data]), np.array([r[1] for r in data])
    x = np.array([[r[2], r[3]] for r in data], float)
    beta = np.zeros(2)
    for _ in range(steps):
        g, h = np.zeros(2), np.zeros((2, 2))
        for time in sorted(set(t[e == 1])):
            risk, tied = t >= time, (t == time) & (e == 1)
            d = tied.sum()
            w, wt = np.exp(x[risk] @ beta), np.exp(x[tied] @ beta)
            g += x[tied].sum(axis=0)
            for k in range(d):
                f = k / d
                s0 = w.sum() - f * wt.sum()
                s1 = w @ x[risk] - f * (wt @ x[tied])
                s2 = (x[risk] * w[:, None]).T @ x[risk] - f * (x[tied] * wt[:, None]).T @ x[tied]
                g -= s1 / s0
                h += s2 / s0 - np.outer(s1, s1) / s0**2
        beta = beta + np.linalg.solve(h, g)
    return beta, np.linalg.inv(h)


def test_cox_matches_newton_on_one_machine(patients_df, patients_data):
    fit = survival.cox(patients_df, "time", "event", ["x", "z"])
    beta, cov = efron(patients_data)
    assert np.allclose(fit["beta"], beta, atol=1e-6)
    assert np.allclose(fit["covariance"], cov, atol=1e-6)
    table = {r["covariate"]: r for r in survival.cox_summary(patients_df, fit).collect()}
    assert table["x"]["hazard_ratio"] == pytest.approx(math.exp(beta[0]), abs=1e-6)


def test_concordance_counts_every_pair(patients_df, patients_data):
    good = bad = tied = 0
    for a in patients_data:
        for b in patients_data:
            if a[1] and (b[0] > a[0] or (b[0] == a[0] and not b[1])):
                good += a[2] > b[2]
                bad += a[2] < b[2]
                tied += a[2] == b[2]
    got = survival.concordance(patients_df, "x", "time", "event").first()
    assert (got["concordant"], got["discordant"], got["tied"]) == (good, bad, tied)
    assert got["c_index"] == pytest.approx((good + tied / 2) / (good + bad + tied))


def test_log_rank_matches_plain_sums(patients_df, patients_data):
    groups = "abc"
    o, e, v = np.zeros(3), np.zeros(3), np.zeros((3, 3))
    for time in sorted({r[0] for r in patients_data if r[1]}):
        n = np.array([sum(1 for r in patients_data if r[0] >= time and r[4] == g) for g in groups], float)
        d = np.array([sum(1 for r in patients_data if r[0] == time and r[1] and r[4] == g) for g in groups], float)
        total, deaths = n.sum(), d.sum()
        o, e = o + d, e + deaths * n / total
        if total > 1:
            v += deaths * (total - deaths) / (total**2 * (total - 1)) * (np.diag(n) * total - np.outer(n, n))
    stat = (o - e)[:2] @ np.linalg.solve(v[:2, :2], (o - e)[:2])
    got = survival.log_rank(patients_df, "g").first()
    assert got["statistic"] == pytest.approx(stat)
    assert got["p_value"] == pytest.approx(math.exp(-stat / 2))


def test_chi_square_tail():
    assert survival.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert survival.chi2_tail(5.991464547107979, 2) == pytest.approx(0.05)
    assert survival.chi2_tail(7.814727903251179, 3) == pytest.approx(0.05)
    assert survival.chi2_tail(9.487729036781154, 4) == pytest.approx(0.05)


def test_residuals_sum_to_zero_correlation_is_finite(patients_df):
    fit = survival.cox(patients_df, "time", "event", ["x", "z"])
    got = survival.schoenfeld(patients_df, fit, "time", "event").collect()
    assert {r["covariate"] for r in got} == {"x", "z"} and all(abs(r["time_correlation"]) <= 1 for r in got)


@pytest.mark.parametrize("pivots,block", [(4, 16), (40, 7), (1, 1000)])
def test_neighbours_are_exact_in_small_blocks(spark, pivots, block):
    rng = np.random.default_rng(1)
    base = np.round(rng.normal(size=(90, 5)), 1)
    # a third of the points are copies of one point
    points = np.vstack([base, np.repeat(base[:1], 45, axis=0)]).astype("float32")
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(points)], "id bigint, v array<float>")
    got = neighbors.nearest(df, df, "id", "v", 6, include_self=False, pivots=pivots, block=block)
    found = {}
    for r in got.orderBy("id", "rank").collect():
        found.setdefault(r["id"], []).append((r["neighbor"], round(r["distance"], 6)))
    x = points.astype("float64")
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((np.arange(len(x)), d)) if j != i][:6]
        assert found[i] == [(j, round(float(d[j]), 6)) for j in order]


def test_silhouette_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    x, label = rng.normal(size=(40, 3)), np.arange(40) % 3
    df = spark.createDataFrame([([float(v) for v in p], int(c)) for p, c in zip(x, label)], "v array<double>, label int")
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    scores = []
    for i in range(40):
        own = (label == label[i]) & (np.arange(40) != i)
        a, b = d[i][own].mean(), min(d[i][label == c].mean() for c in range(3) if c != label[i])
        scores.append((b - a) / max(a, b))
    got = models.silhouettes(df, "v", {"label": F.col("label")}).first()
    assert got["silhouette_label"] == pytest.approx(np.mean(scores), abs=1e-6)


def test_markers_against_plain_welch(spark):
    rng = np.random.default_rng(4)
    expression = rng.poisson(1.0, size=(60, 12)).astype(float)
    expression[:20, 3] += 4
    rows = [(c, f"g{g}", float(expression[c, g])) for c in range(60) for g in range(12) if expression[c, g]]
    values = spark.createDataFrame(rows, "cell_id int, gene string, value double")
    obs = spark.createDataFrame([(c, "a" if c < 20 else "b") for c in range(60)], "cell_id int, kind string")
    got = {(r["kind"], r["gene"]): r for r in cells.marker_genes(values, obs, "kind", None, fdr=1.1, min_lfc=-99).collect()}
    raw = {}
    for g in range(12):
        a, b = expression[:20, g], expression[20:, g]
        raw[g] = (a.mean() - b.mean()) / math.sqrt(a.var(ddof=1) / 20 + b.var(ddof=1) / 40)
        assert got[("a", f"g{g}")]["t"] == pytest.approx(raw[g])
    p = sorted((math.erfc(abs(t) / math.sqrt(2)), f"g{g}") for g, t in raw.items())
    adjusted, low = {}, 1.0
    for rank in range(12, 0, -1):
        low = min(low, p[rank - 1][0] * 12 / rank)
        adjusted[p[rank - 1][1]] = low
    assert all(got[("a", g)]["fdr"] == pytest.approx(v) for g, v in adjusted.items())
    assert cells.marker_genes(values, obs, "kind", 3).filter("kind = 'a'").first()["gene"] == "g3"


def test_isolation_forest_finds_the_far_point(spark):
    rng = random.Random(8)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(400)] + [(1000, 9.0, -9.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    scored = models.isolation_scores(df, "id", ["a", "b"], trees=30)
    assert scored.orderBy(F.desc("anomaly_score")).first()["id"] == 1000
    flagged = models.anomalies(scored, 0.05)
    assert 15 <= flagged.filter("is_anomaly").count() <= 21
    again = models.isolation_scores(df.repartition(7), "id", ["a", "b"], trees=30)
    assert {(r["id"], r["anomaly_score"]) for r in scored.collect()} == {(r["id"], r["anomaly_score"]) for r in again.collect()}


def test_batch_search_equals_single_searches(spark):
    words = "alpha beta gamma delta epsilon zeta".split()
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randint(3, 30)))) for i in range(60)], "id int, body string")
    asked = [(1, "alpha beta"), (2, "zeta"), (3, "nothing")]
    many = search.search_many(spark.createDataFrame(asked, "q int, t string"), "q", "t", docs, "id", "body", 5)
    for q, t in asked:
        single = [(r["id"], round(r["score"], 9)) for r in search.search(docs, "id", "body", t, n=5).collect()]
        batch = [(r["id"], round(r["score"], 9)) for r in many.filter(f"query_id = {q}").orderBy("rank").collect()]
        assert single == batch


def test_dispersion_picks_the_noisy_gene(spark):
    rng = random.Random(9)
    rows = []
    for c in range(80):
        for g in range(30):
            n = rng.randint(4, 6) if g != 7 else (60 if rng.random() < 0.1 else 1)
            rows.append((c, f"g{g:02d}", float(n), c % 2))
    counts = spark.createDataFrame(rows, "cell_id int, gene string, count double, batch int")
    assert cells.variable_genes(counts.drop("batch"), 3, bins=1).first()["gene"] == "g07"
    assert cells.variable_genes(counts, 3, bins=1, batch="batch").first()["gene"] == "g07"
