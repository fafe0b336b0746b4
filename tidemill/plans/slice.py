"""From features to a verdict in three modes: select a configuration, freeze it, and look once at the validation segment."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.lake import Refused, Registry, body_id
from tidemill.operators import folds, models, simulate


def _normalised(train: DataFrame, features: tuple[str, ...]) -> dict[str, tuple[float, float]]:
    out = {}
    for r in models.fit_normalisation(train, features).collect():  # a row a feature
        if r["count"] < 2 or not r["m2"]:
            raise Refused(f"{r['feature']} has no spread")
        out[r["feature"]] = (r["mean"], r["std"])
    return out


def _scaled(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    return models.normalised(df, params, "")


def select(features_: DataFrame, segments: list[folds.Segment], k: int, target: str, purge: int, embargo: int, max_age: int, features: tuple[str, ...] = models.FEATURES) -> dict:
    """The best of the grid over k out-of-fold blocks of the train segment: its number, configuration and scores."""
    segment = next(s for s in segments if s.role == "train")
    train = folds.materialised(features_, segment, segments, label=target, max_age=max_age, purge=purge, embargo=embargo).persist()  # one materialisation serves all blocks
    rows = _scaled(train, _normalised(train, features))
    scores = models.sweep(rows, folds.blocks(segment.start, segment.end, k), purge, embargo, features, target)
    best = models.winner(models.summary(scores)).first()
    train.unpersist()
    return {"config": None} if best is None else {"config": asdict(models.grid()[best["config"]]), **{c: best[c] for c in ("mean_ic", "min_ic", "max_ic", "mean_r2")}}


def freeze(features_: DataFrame, segments: list[folds.Segment], selection: dict, target: str, purge: int, embargo: int, max_age: int, features: tuple[str, ...] = models.FEATURES) -> dict:
    """The selected configuration fitted on all train rows, with the normalisation it needs."""
    if selection["config"] is None:
        raise Refused("nothing was selected")
    segment = next(s for s in segments if s.role == "train")
    train = folds.materialised(features_, segment, segments, label=target, max_age=max_age, purge=purge, embargo=embargo)
    params = _normalised(train, features)
    model = models.fit(_scaled(train, params), models.Config(**selection["config"]), features, target)
    mean = train.agg(F.avg(target)).first()[0]
    return {"model": model.to_json(), "normalisation": {f: list(p) for f, p in params.items()}, "train_mean": mean}


def validate(features_: DataFrame, segments: list[folds.Segment], frozen: dict, target: str, purge: int, embargo: int, max_age: int, registry: Registry, manifest: str, allowance: int = 1, x_bps: int = 0) -> dict:
    """Metrics and gates on the validation segment. Spends a look before anything is read; a failure is recorded as a negative result."""
    segment = next(s for s in segments if s.role == "val")
    registry.look(manifest, segment.name, allowance, {"model": body_id({"m": frozen["model"]})})
    rows = folds.materialised(features_, segment, segments, label=target, max_age=max_age, purge=purge, embargo=embargo)
    params = {f: tuple(p) for f, p in frozen["normalisation"].items()}
    pred = _scaled(rows.select("etime", *params), params).select("etime", models.Frozen.from_json(frozen["model"]).predict().alias("_r"))
    rows = rows.join(pred, "etime").persist()
    metrics = models.r_squared(rows, "_r", target, frozen["train_mean"]).first().asDict() | {"rank_ic": models.rank_correlation(rows, "_r", target).first()["rank_ic"]}
    gate = rows.sparkSession.range(1).select(models.gate(*(F.lit(metrics[m]).cast("double") for m in ("rank_ic", "r2_zero", "r2_mean")))).first()[0]
    priced = rows.where("mid is not null").withColumn("pred", models.price_of_return(F.col("mid"), F.col("_r")))
    result = simulate.closed_pnl(simulate.simulated(priced, x_bps)[1]).first().asDict()
    best = simulate.ceiling(rows, target).first()["pnl_ticks"]
    rows.unpersist()
    if result["trades"]:
        simulate.guard_against_ceiling(result["pnl_ticks"], best, segment.name)
    money = "no_trades" if result["trades"] <= 0 else "pnl_not_positive" if result["pnl_ticks"] <= 0 else "pass"
    out = {**metrics, **result, "ceiling_ticks": best, "forecast_gate": gate, "monetisation_gate": money}
    if gate != "pass" or money != "pass":
        registry.negative({"model": frozen["model"], "segment": segment.name}, f"{gate}, {money}")
    return out
