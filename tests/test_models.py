from __future__ import annotations

import numpy as np
import pytest

from tidemill.functions.clock import SECOND
from tidemill.operators import folds, models

RNG = np.random.default_rng(1)
X = RNG.normal(size=(300, 3))
Y = 0.5 + X @ [1.0, -2.0, 0.25] + RNG.normal(scale=0.1, size=300)


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(k // 100, k * 1000 * SECOND, *map(float, x), float(y)) for k, (x, y) in enumerate(zip(X, Y))]
    return spark.createDataFrame(rows, "day long, etime long, imb_top double, ofi double, trade_flow double, ret_10s_mid double").cache()


def test_ols_and_ridge_solve_the_normal_equations(frame):
    a = np.column_stack([np.ones(300), X])
    assert np.allclose(models.fit(frame, models.Config("ols")).weights, np.linalg.lstsq(a, Y, rcond=None)[0])
    penalty = np.diag([0, 10.0, 10, 10])
    assert np.allclose(models.fit(frame, models.Config("ridge", 10.0)).weights, np.linalg.solve(a.T @ a + penalty, a.T @ Y))


def test_elastic_net_meets_its_optimality_conditions(frame):
    c = models.Config("elastic_net", 0.1, 0.5)
    w = np.array(models.fit(frame, c).weights)
    g = X.T @ (Y - w[0] - X @ w[1:]) / 300 - c.alpha * (1 - c.l1_ratio) * w[1:]
    on = w[1:] != 0
    assert np.allclose(g[on], c.alpha * c.l1_ratio * np.sign(w[1:][on]), atol=1e-6) and (np.abs(g[~on]) <= c.alpha * c.l1_ratio + 1e-6).all()


def test_degree_two_has_nine_columns_and_json_keeps_the_model(frame):
    model = models.fit(frame, models.Config("poly2", 1.0))
    assert len(model.weights) == 10
    assert models.Frozen.from_json(model.to_json()) == model
    assert len(models.grid()) == 17 and len(set(models.grid())) == 17


def test_prices_may_not_be_features(frame):
    with pytest.raises(ValueError):
        models.fit(frame.withColumnRenamed("ofi", "bid_price"), models.Config("ols"), ("bid_price",))


def test_rank_correlation_of_constants_is_null_and_ties_share_ranks(spark):
    d = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (2.0, 3.0), (3.0, 3.0)], "a double, b double")
    assert models.rank_correlation(d.selectExpr("1.0d as a", "b"), "a", "b").first()["rank_ic"] is None
    ra, rb = np.array([1.5, 1.5, 3, 4]), np.array([1, 2, 3.5, 3.5])
    assert models.rank_correlation(d, "a", "b").first()["rank_ic"] == pytest.approx(np.corrcoef(ra, rb)[0, 1])


def test_a_sweep_scores_each_block_off_its_own_rows(frame):
    blocks = folds.blocks(0, 300 * 1000 * SECOND, 3)
    scores = models.sweep(frame, blocks, 0, 0)
    assert scores.count() == 51
    best = models.winner(models.summary(scores)).first()
    assert best["mean_ic"] > 0.95
    own = scores.where("config = 0 and block = 1").first()
    part = slice(100, 200)
    rest = np.r_[0:100, 200:300]
    a = np.column_stack([np.ones(200), X[rest]])
    w = np.linalg.lstsq(a, Y[rest], rcond=None)[0]
    e = Y[part] - w[0] - X[part] @ w[1:]
    assert own["r2_zero"] == pytest.approx(1 - (e @ e) / (Y[part] @ Y[part]))


def test_intervals():
    assert folds.train_intervals(0, 100, [(40, 50)], 5, 2) == [(0, 35), (57, 100)]
    assert folds.train_intervals(0, 100, [(0, 10), (8, 20)], 0, 0) == [(20, 100)]
    assert folds.blocks(0, 10, 3) == [(0, 3), (3, 6), (6, 10)]
    with pytest.raises(ValueError):
        folds.checked([folds.Segment("a", "train", 0, 10), folds.Segment("b", "held_out", 5, 20)], (0, 20))


def test_purge_is_needed(spark):
    """A row just before a block is dropped with the purge and kept without it."""
    d = spark.createDataFrame([(9,), (5,)], "etime long")
    b = [(0, 10), (10, 20)]
    assert [r[0] for r in folds.training_rows(d, b, 1, 3, 0).collect()] == [5]
    assert folds.training_rows(d, b, 1, 0, 0).count() == 2


def test_held_out_is_refused(spark):
    s = folds.Segment("test", "held_out", 0, 10)
    with pytest.raises(PermissionError):
        folds.materialised(spark.createDataFrame([], "day long, etime long, decision_source_rank int"), s, [s])


def test_a_quote_under_a_trade_is_invisible_to_the_age(spark):
    d = spark.createDataFrame([(0, 1, 0), (0, 5, 1), (1, 9, 1)], "day long, etime long, decision_source_rank int")
    assert sorted(tuple(r) for r in folds.with_age(d).select("etime", "book_age").collect()) == [(1, 0), (5, 4), (9, 8)]
    assert folds.with_age(d.where("etime > 1")).where(f"book_age = {folds.NO_QUOTE}").count() == 2
