"""The registry of the engine's own queries over the driver's tables, each with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.clock import DAY, HOUR, MINUTE, SECOND, date_string, days_between
from tidemill.operators import capture, curate, features, folds, labels, models, ordered, quality, simulate
from tidemill.sources import feed as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

WINDOW, H1, H2, GAP = HOUR, 10 * MINUTE, HOUR, 30 * MINUTE
#: 2024-01-05, 2024-01-15 and 2024-01-25 in days since 1970.
D0, D1, D2 = 19727, 19737, 19747
SEGMENTS = [folds.Segment("train", "train", D0 * DAY, D1 * DAY), folds.Segment("val", "val", D1 * DAY, D2 * DAY), folds.Segment("test", "held_out", D2 * DAY, (D2 + 5) * DAY)]


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# Common table expressions for the SQL side.
SIDE = "CASE WHEN is_buyer_maker THEN -1 WHEN NOT is_buyer_maker THEN 1 ELSE 0 END"
MERGED = f"""{src.SQL},
merged AS (SELECT day, etime, source_rank, seq, bid_price, bid_qty, ask_price, ask_qty, trade_price, trade_qty,
                  CASE WHEN source_rank = 1 THEN {SIDE} END AS trade_side FROM feed WHERE coalesce(exec_type, '') <> 'NA')"""
SCAN = f"""{MERGED},
lagged AS (SELECT *, lag(bid_price) OVER o AS b0, lag(bid_qty) OVER o AS bq0, lag(ask_price) OVER o AS a0, lag(ask_qty) OVER o AS aq0,
                  coalesce(CAST(round(trade_qty * 1e8) AS BIGINT) * trade_side, 0) AS signed
           FROM merged WINDOW o AS (PARTITION BY day, source_rank ORDER BY etime, seq)),
moved AS (SELECT *, CASE WHEN b0 IS NOT NULL THEN (CASE WHEN bid_price >= b0 THEN bid_qty ELSE 0.0::DOUBLE END) - (CASE WHEN bid_price <= b0 THEN bq0 ELSE 0.0::DOUBLE END)
                    - (CASE WHEN ask_price <= a0 THEN ask_qty ELSE 0.0::DOUBLE END) + (CASE WHEN ask_price >= a0 THEN aq0 ELSE 0.0::DOUBLE END) END AS o1 FROM lagged),
scan AS (SELECT *, last_value(bid_price IGNORE NULLS) OVER n AS bid, last_value(ask_price IGNORE NULLS) OVER n AS ask,
                last_value(bid_qty IGNORE NULLS) OVER n AS bq, last_value(ask_qty IGNORE NULLS) OVER n AS aq, last_value(o1 IGNORE NULLS) OVER n AS ofi,
                CAST(sum(signed) OVER n - coalesce(sum(signed) OVER p, 0) AS BIGINT) AS flow_scaled,
                CAST(sum(source_rank) OVER n - coalesce(sum(source_rank) OVER p, 0) AS BIGINT) AS in_window,
                sum(1 - source_rank) OVER n AS n_quotes, min(etime) OVER n AS first_etime,
                lead(etime) OVER (PARTITION BY day ORDER BY etime, source_rank, seq) IS DISTINCT FROM etime AS is_decision
         FROM moved WINDOW n AS (PARTITION BY day ORDER BY etime, source_rank, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                           p AS (PARTITION BY day ORDER BY etime RANGE BETWEEN UNBOUNDED PRECEDING AND {WINDOW} PRECEDING)),
decisions AS (SELECT day, etime, CAST(source_rank AS TINYINT) AS decision_source_rank, seq AS decision_seq, bid AS bid_price, ask AS ask_price, (bid + ask) / 2 AS mid, (bq - aq) / (bq + aq) AS imb_top, ofi,
                     flow_scaled, CAST(flow_scaled AS DOUBLE) / 1e8 AS trade_flow, n_quotes < 2 OR etime < first_etime + {WINDOW} AS warmup
              FROM scan WHERE is_decision)"""
LABELS = f"""{SCAN},
mids AS (SELECT etime, max_by((bid_price + ask_price) / 2, seq) AS m FROM quotes GROUP BY etime),
gaps AS (SELECT prev AS s, etime AS e FROM (SELECT etime, lag(etime) OVER (ORDER BY etime) AS prev FROM mids) WHERE etime - prev > {GAP})"""


def labelled(h: int, name: str = "labelled") -> str:
    return f"""{name} AS (SELECT *, CASE WHEN reason IS NULL THEN (m - mid) / mid END AS label FROM (
  SELECT d.*, q.m, CASE WHEN mid IS NULL OR q.m IS NULL THEN 'null_no_mid' WHEN d.etime + {h} > (SELECT max(etime) FROM mids) THEN 'null_past_end'
         WHEN g.e > d.etime THEN 'null_gap' WHEN q.etime <= d.etime THEN 'null_stale' END AS reason
  FROM (SELECT *, etime + {h} AS probe FROM decisions) d ASOF LEFT JOIN mids q ON d.probe >= q.etime ASOF LEFT JOIN gaps g ON d.probe > g.s))"""


AGED = f"""{SCAN}, aged AS (SELECT *, coalesce(etime - last_value(CASE WHEN decision_source_rank = 0 THEN etime END IGNORE NULLS)
  OVER (ORDER BY etime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), {folds.NO_QUOTE}) AS book_age FROM decisions)"""
MODEL = f"{LABELS}, {labelled(H2)}, rows_ AS (SELECT day, etime, imb_top, ofi, trade_flow, label FROM labelled WHERE imb_top IS NOT NULL AND ofi IS NOT NULL AND label IS NOT NULL)"


def _quotes(spark: SparkSession, d: str) -> DataFrame:
    return src.quotes(spark, d)


def _trades(spark: SparkSession, d: str) -> DataFrame:
    return src.trades(spark, d)


def _merged(spark: SparkSession, d: str) -> DataFrame:
    return features.merge(_quotes(spark, d), curate.with_sides(curate.without_placeholders(_trades(spark, d))))


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    return features.decisions(_merged(spark, d), WINDOW)


def _labelled(spark: SparkSession, d: str, h: int) -> DataFrame:
    return labels.labels(_decisions(spark, d), _quotes(spark, d), h, GAP)


def _model_rows(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d, H2).select("day", "etime", *models.FEATURES, "label").dropna()


@query("flagship", f"WITH {LABELS}, {labelled(H2)} SELECT day, count(*) AS n_rows, CAST(sum(flow_scaled) AS BIGINT) AS flow_scaled, count(label) AS labelled, count(reason) AS unlabelled FROM labelled GROUP BY day")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    out = _labelled(spark, d, H2)
    return out.groupBy("day").agg(F.count("*").alias("n_rows"), F.sum(F.rint(F.col("trade_flow") * 1e8).cast("long")).alias("flow_scaled"), F.count("label").alias("labelled"), F.count("reason").alias("unlabelled"))


@query("placeholder_filter", f"WITH {src.SQL} SELECT id, price, qty, exec_type FROM trades WHERE exec_type IS NULL OR exec_type <> 'NA'")
def placeholder_filter(spark, d):
    return curate.without_placeholders(_trades(spark, d)).select("id", "price", "qty", "exec_type")


@query("placeholder_counts", f"WITH {src.SQL} SELECT day, count(*) FILTER (coalesce(exec_type, '') <> 'NA') AS kept, count(*) FILTER (exec_type = 'NA') AS dropped FROM trades GROUP BY day")
def placeholder_counts(spark, d):
    return curate.placeholder_counts(_trades(spark, d), "day")


@query("side_exact", f"WITH {src.SQL} SELECT id, {SIDE} AS trade_side, CASE WHEN is_buyer_maker IS NULL THEN 'unknown' ELSE 'exact_flag' END AS side_method FROM trades")
def side_exact(spark, d):
    return curate.with_sides(_trades(spark, d)).select("id", F.col("trade_side").cast("int").alias("trade_side"), "side_method")


NEAR = f"""{src.SQL}, pq AS (SELECT etime, max_by(bid_price, seq) AS b, max_by(ask_price, seq) AS a FROM quotes GROUP BY etime),
near AS (SELECT t.*, CASE WHEN abs(price - b) < abs(price - a) THEN -1 WHEN abs(price - a) < abs(price - b) THEN 1 ELSE 0 END AS near_side
         FROM trades t ASOF LEFT JOIN pq ON t.etime > pq.etime)"""


@query("side_nearest", f"WITH {NEAR} SELECT id, CASE WHEN is_buyer_maker IS NOT NULL THEN {SIDE} ELSE near_side END AS trade_side, CASE WHEN is_buyer_maker IS NOT NULL THEN 'exact_flag' WHEN near_side <> 0 THEN 'nearest_quote' ELSE 'unknown' END AS side_method FROM near")
def side_nearest(spark, d):
    return curate.with_sides(_trades(spark, d), _quotes(spark, d)).select("id", F.col("trade_side").cast("int").alias("trade_side"), "side_method")


@query("side_agreement", f"WITH {NEAR} SELECT count(*) AS n_rows, count(*) FILTER (near_side = {SIDE}) AS agreeing FROM near WHERE is_buyer_maker IS NOT NULL")
def side_agreement(spark, d):
    return curate.side_agreement(_trades(spark, d), _quotes(spark, d))


REDELIVERED = """again AS (
  SELECT id, seq, etime, rtime, day, price, qty FROM trades
  UNION ALL SELECT id, seq + 1000000, etime, rtime + 1000000000, day, price, qty FROM trades WHERE id % 7 = 0
  UNION ALL SELECT id, seq + 2000000, etime, rtime + 2000000000, day, price + 1, qty FROM trades WHERE id % 35 = 0)"""


def _redelivered(spark, d):
    t = _trades(spark, d).select("id", "seq", "etime", "rtime", "day", "price", "qty")
    same = t.where("id % 7 = 0").withColumns({"seq": F.col("seq") + 1000000, "rtime": F.col("rtime") + SECOND})
    other = t.where("id % 35 = 0").withColumns({"seq": F.col("seq") + 2000000, "rtime": F.col("rtime") + 2 * SECOND, "price": F.col("price") + 1})
    return t.union(same).union(other)


@query("redelivery_dedup", f"""WITH {src.SQL}, {REDELIVERED}, c AS (SELECT id, count(DISTINCT (etime, day, price, qty)) AS n FROM again GROUP BY id)
SELECT a.* FROM again a JOIN c USING (id) WHERE c.n > 1 OR seq < 1000000""")
def redelivery_dedup(spark, d):
    return curate.without_redeliveries(_redelivered(spark, d), "id")


@query("seq_assign", f"WITH {src.SQL} SELECT day, source_rank, id, row_number() OVER (PARTITION BY day, source_rank ORDER BY etime, id) - 1 AS seq FROM feed")
def seq_assign(spark, d):
    f = src.feed(spark, d).select("day", F.col("source_rank").cast("int").alias("source_rank"), "id", "etime", "seq")
    return curate.with_sequence(f, "id", ["day", "source_rank"]).select("day", "source_rank", "id", "seq")


@query("duplicate_keys", f"WITH {src.SQL}, {REDELIVERED} SELECT day, count(*) - count(DISTINCT id) AS duplicates FROM again GROUP BY day")
def duplicate_keys(spark, d):
    return curate.duplicate_keys(_redelivered(spark, d), "id", "day")


def _sources(spark, d):
    t = _trades(spark, d)
    return t.where("id % 17 <> 0 and day % 9 <> 4"), t.where("id % 19 <> 0 and day % 7 <> 3"), t.where("day % 2 = 0").select("day").distinct()


SOURCES = f"{src.SQL}, ar AS (SELECT * FROM trades WHERE id % 17 <> 0 AND day % 9 <> 4), ca AS (SELECT * FROM trades WHERE id % 19 <> 0 AND day % 7 <> 3)"
RECON = f"""{SOURCES}, arn AS (SELECT * FROM ar WHERE coalesce(exec_type, '') <> 'NA'), can AS (SELECT * FROM ca WHERE coalesce(exec_type, '') <> 'NA'), span AS (SELECT day, greatest(a0, c0) AS low, least(a1, c1) AS high FROM (SELECT day, min(id) AS a0, max(id) AS a1 FROM arn GROUP BY day) JOIN (SELECT day, min(id) AS c0, max(id) AS c1 FROM can GROUP BY day) USING (day)),
recon AS (SELECT day, count(*) FILTER (a AND c) AS in_both, count(*) FILTER (NOT c) AS archive_only, count(*) FILTER (NOT a) AS capture_only
  FROM (SELECT day, id, bool_or(a) AS a, bool_or(NOT a) AS c FROM (SELECT day, id, true AS a FROM arn UNION ALL SELECT day, id, false FROM can) GROUP BY day, id)
  JOIN span USING (day) WHERE id BETWEEN low AND high GROUP BY day)"""


@query("reconciliation", f"WITH {RECON} SELECT * FROM recon")
def reconciliation(spark, d):
    a, c, _ = _sources(spark, d)
    return curate.reconciled(a, c, "id", "day")


@query("source_choice", f"""WITH {SOURCES} SELECT day, CASE WHEN bool_or(a) AND day % 2 = 0 THEN 'archive' WHEN bool_or(NOT a) THEN 'capture' ELSE 'archive' END AS source
FROM (SELECT day, true AS a FROM ar UNION ALL SELECT day, false FROM ca) GROUP BY day""")
def source_choice(spark, d):
    return curate.chosen_source(*_sources(spark, d), "day")


@query("curated_trades", f"""WITH {SOURCES}, pick AS (SELECT day, CASE WHEN bool_or(a) AND day % 2 = 0 THEN 'archive' WHEN bool_or(NOT a) THEN 'capture' ELSE 'archive' END AS source
FROM (SELECT day, true AS a FROM ar UNION ALL SELECT day, false FROM ca) GROUP BY day),
taken AS (SELECT ar.*, source FROM ar JOIN pick USING (day) WHERE source = 'archive' UNION ALL SELECT ca.*, source FROM ca JOIN pick USING (day) WHERE source = 'capture')
SELECT day, id, source, {SIDE} AS trade_side, row_number() OVER (PARTITION BY day ORDER BY etime, id) - 1 AS seq FROM taken WHERE coalesce(exec_type, '') <> 'NA'""")
def curated_trades(spark, d):
    out = curate.curated(*_sources(spark, d), "id", "day")
    return out.select("day", "id", "source", F.col("trade_side").cast("int").alias("trade_side"), "seq")


@query("merged_events", f"WITH {MERGED} SELECT day, etime, CAST(source_rank AS TINYINT) AS source_rank, seq, bid_price, ask_price, trade_price, CAST(trade_side AS TINYINT) AS trade_side, row_number() OVER (PARTITION BY day ORDER BY etime, source_rank, seq) AS place FROM merged")
def merged_events(spark, d):
    place = F.row_number().over(ordered.within("day", features.ORDER)).cast("long")
    return _merged(spark, d).select("day", "etime", "source_rank", "seq", "bid_price", "ask_price", "trade_price", "trade_side", place.alias("place"))


@query("order_violations", f"""WITH {src.SQL}, o AS (SELECT *, lag((etime, source_rank, seq)) OVER (PARTITION BY day ORDER BY id) AS prev FROM feed)
SELECT day, count(*) AS violations FROM o WHERE NOT ((etime, source_rank, seq) > prev) GROUP BY day""")
def order_violations(spark, d):
    f = src.feed(spark, d).withColumn("arrival", F.col("id"))
    return ordered.order_violations(f, "day", features.ORDER).groupBy("day").agg(F.count("*").alias("violations"))


@query("decision_rows", f"WITH {SCAN} SELECT * EXCLUDE (flow_scaled) FROM decisions")
def decision_rows(spark, d):
    return _decisions(spark, d)


@query("event_state", f"WITH {SCAN} SELECT day, seq, flow_scaled, in_window, ofi, bid FROM scan")
def event_state(spark, d):
    return features.scanned(_merged(spark, d), WINDOW).select("day", "seq", "flow_scaled", "in_window", "ofi", "bid")


@query("occupancy", f"""WITH {SCAN} SELECT day, max(in_window) AS max_in_window, count(*) FILTER (in_window = 0 AND is_decision) AS empty_windows, count(*) FILTER (source_rank = 0 AND bid_price > ask_price) AS crossed,
count(*) FILTER (source_rank = 0 AND bid_price = ask_price) AS locked, count(*) FILTER (is_decision) AS decision_rows, count(*) AS events FROM scan GROUP BY day""")
def occupancy(spark, d):
    return features.counters(_merged(spark, d), WINDOW)


for _name, _h in (("labels_h1", H1), ("labels_h2", H2)):
    query(_name, f"WITH {LABELS}, {labelled(_h)} SELECT etime, decision_seq, label, reason FROM labelled")(lambda spark, d, h=_h: _labelled(spark, d, h).select("etime", "decision_seq", "label", "reason"))


@query("label_stats", f"""WITH {LABELS}, {labelled(H1)} SELECT count(*) AS n_rows, count(label) AS labelled, {', '.join(f"count(*) FILTER (reason = '{r}') AS {r}" for r in labels.REASONS)},
round(avg(CASE WHEN label = 0 THEN 1.0 WHEN label IS NOT NULL THEN 0.0 END), 9) AS zero_fraction, round(avg(label), 9) AS mean, round(stddev_pop(label), 9) AS std FROM labelled""")
def label_stats(spark, d):
    out = labels.label_stats(_labelled(spark, d, H1))
    return out.withColumns({c: F.round(c, 9) for c in ("zero_fraction", "mean", "std")})


@query("big_gaps", f"WITH {LABELS} SELECT s AS gap_start, e AS gap_end FROM gaps")
def big_gaps(spark, d):
    return labels.big_gaps(_quotes(spark, d), GAP)


@query("asof_disagreement", f"""WITH {LABELS}, firsts AS (SELECT etime, min_by((bid_price + ask_price) / 2, seq) AS m FROM quotes GROUP BY etime)
SELECT count(*) AS compared, count(*) FILTER (a.m <> b.m) AS disagreeing FROM (SELECT etime + {H1} AS t FROM decisions) p ASOF JOIN mids a ON p.t >= a.etime ASOF JOIN firsts b ON p.t <= b.etime""")
def asof_disagreement(spark, d):
    return labels.asof_disagreement(_decisions(spark, d), _quotes(spark, d), H1)


@query("post_gap_tag", f"WITH {LABELS} SELECT d.etime, coalesce(d.etime < g.e + {HOUR}, false) AS post_gap_warmup FROM decisions d ASOF LEFT JOIN gaps g ON d.etime >= g.e")
def post_gap_tag(spark, d):
    windows = labels.big_gaps(_quotes(spark, d), GAP).select(F.col("gap_end").alias("start"), (F.col("gap_end") + HOUR).alias("stop"))
    return labels.post_gap_tags(_decisions(spark, d), windows).select("etime", "post_gap_warmup")


@query("stale_age", f"WITH {AGED} SELECT etime, book_age FROM aged")
def stale_age(spark, d):
    return folds.with_age(_decisions(spark, d)).select("etime", "book_age")


@query("admission", f"""WITH {AGED}, s AS (SELECT CASE WHEN etime >= {D0 * DAY} AND etime < {D1 * DAY} THEN 'train' WHEN etime >= {D1 * DAY} AND etime < {D2 * DAY} THEN 'val' WHEN etime >= {D2 * DAY} AND etime < {(D2 + 5) * DAY} THEN 'test' END AS segment, book_age FROM aged)
SELECT segment, count(*) FILTER (book_age <= {10 * MINUTE}) AS admitted, count(*) FILTER (book_age > {10 * MINUTE} AND book_age <> {folds.NO_QUOTE}) AS stale, count(*) FILTER (book_age = {folds.NO_QUOTE}) AS undefined FROM s WHERE segment IS NOT NULL GROUP BY segment""")
def admission(spark, d):
    return folds.admission_counts(folds.with_age(_decisions(spark, d)), SEGMENTS, 10 * MINUTE)


@query("purge_embargo", f"""WITH {SCAN}, t AS (SELECT etime, etime < {D1 * DAY + HOUR} OR etime >= {D2 * DAY - HOUR} AS purged, etime >= {D1 * DAY + HOUR} AND etime < {D1 * DAY + 2 * HOUR} AS held FROM decisions WHERE etime >= {D1 * DAY} AND etime < {D2 * DAY})
SELECT count(*) FILTER (purged) AS purged, count(*) FILTER (held AND NOT purged) AS embargoed, count(*) FILTER (NOT purged AND NOT held) AS kept FROM t""")
def purge_embargo(spark, d):
    return folds.purge_counts(_decisions(spark, d), SEGMENTS[1], [SEGMENTS[0], SEGMENTS[2]], HOUR, HOUR)


BLOCKS = folds.blocks(D0 * DAY, D1 * DAY, 5)
EXCLUDED = "CASE {} END".format(" ".join(f"WHEN k = {i} THEN etime < {a - HOUR} OR etime >= {b + 2 * HOUR}" for i, (a, b) in enumerate(BLOCKS)))


@query("oof_blocks", f"WITH {SCAN} SELECT k AS block, count(*) FILTER ({EXCLUDED}) AS training_rows, count(*) FILTER (least((etime - {D0 * DAY}) // {BLOCKS[0][1] - BLOCKS[0][0]}, 4) = k) AS own_rows FROM decisions, range(5) r(k) WHERE etime >= {D0 * DAY} AND etime < {D1 * DAY} GROUP BY k")
def oof_blocks(spark, d):
    rows, t = _decisions(spark, d).where(f"etime >= {D0 * DAY} and etime < {D1 * DAY}"), F.col("etime")
    own = folds.block_of(t, D0 * DAY, D1 * DAY, 5)
    each = [F.struct(F.lit(k).cast("long").alias("block"), F.count_if(folds.inside(t, folds.train_intervals(BLOCKS[0][0], BLOCKS[-1][1], [b], HOUR, HOUR))).alias("training_rows"), F.count_if(own == k).alias("own_rows")) for k, b in enumerate(BLOCKS)]
    return rows.agg(F.array(*each).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def _recomputed(df: DataFrame) -> DataFrame:
    return df.withColumn("label", F.when(F.col("decision_seq") % 41 == 0, None).when(F.col("decision_seq") % 43 == 0, F.lit(1.0)).otherwise(F.col("label")))


ERRATA = f"{LABELS}, {labelled(H1)}, again AS (SELECT etime, decision_seq, CASE WHEN decision_seq % 41 = 0 THEN NULL WHEN decision_seq % 43 = 0 THEN 1.0 ELSE label END AS label FROM labelled), cells AS (SELECT etime, decision_seq, CASE WHEN a.label = 0 AND b.label IS NULL THEN 'zero_to_null' ELSE 'other' END AS shape FROM labelled a JOIN again b USING (etime, decision_seq) WHERE a.label IS DISTINCT FROM b.label)"


@query("errata_diff", f"WITH {ERRATA} SELECT * FROM cells")
def errata_diff(spark, d):
    rows = _labelled(spark, d, H1)
    return folds.errata(rows, _recomputed(rows), "label")


@query("errata_mask", f"WITH {ERRATA} SELECT l.etime, l.decision_seq, CASE WHEN c.shape IS NULL THEN label END AS label FROM labelled l LEFT JOIN cells c USING (etime, decision_seq)")
def errata_mask(spark, d):
    rows = _labelled(spark, d, H1)
    return folds.masked(rows, folds.errata(rows, _recomputed(rows), "label"), "label").select("etime", "decision_seq", "label")


@query("segment_rows", f"""WITH {AGED} SELECT etime, decision_seq, book_age FROM aged WHERE etime >= {D0 * DAY} AND etime < {D1 * DAY - HOUR} AND book_age <= {10 * MINUTE}""")
def segment_rows(spark, d):
    return folds.materialised(_decisions(spark, d), SEGMENTS[0], SEGMENTS, max_age=10 * MINUTE, purge=HOUR, embargo=HOUR).select("etime", "decision_seq", "book_age")


@query("norm_fit", f"""WITH {SCAN}, u AS (SELECT etime, unnest([{{'f': 'imb_top', 'v': imb_top}}, {{'f': 'ofi', 'v': ofi}}, {{'f': 'trade_flow', 'v': trade_flow}}], recursive := true) FROM decisions WHERE etime <= {D1 * DAY})
SELECT f AS feature, count(v) AS count, round(avg(v), 9) AS mean, round(var_pop(v) * count(v), 6) AS m2, round(stddev_samp(v), 9) AS std, count(*) - count(v) AS excluded FROM u GROUP BY f""")
def norm_fit(spark, d):
    out = models.fit_normalisation(_decisions(spark, d), models.FEATURES, D1 * DAY)
    return out.withColumns({"mean": F.round("mean", 9), "m2": F.round("m2", 6), "std": F.round("std", 9)})


@query("norm_apply", f"WITH {SCAN} SELECT etime, (imb_top - 0.125::DOUBLE) / 0.5::DOUBLE AS imb_top_z, (trade_flow - 0.01::DOUBLE) / 0.25::DOUBLE AS trade_flow_z FROM decisions")
def norm_apply(spark, d):
    return models.normalised(_decisions(spark, d), {"imb_top": (0.125, 0.5), "trade_flow": (0.01, 0.25)}).select("etime", "imb_top_z", "trade_flow_z")


@query("expanding_z", f"""WITH {SCAN}, x AS (SELECT etime, trade_flow AS v, avg(trade_flow) OVER w AS m, stddev_samp(trade_flow) OVER w AS s FROM decisions WINDOW w AS (ORDER BY etime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT etime, round(CASE WHEN s > 1e-6 THEN (v - m) / s END, 6) AS z FROM x""")
def expanding_z(spark, d):
    return models.expanding_z(_decisions(spark, d), "trade_flow", "z").select("etime", F.round("z", 6).alias("z"))


def _products(names: list[str], alias: str) -> str:
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    return "[" + ", ".join(f"round(sum(({a}) * ({b})), 6)" for a, b in pairs) + f"] AS {alias}"


LINEAR = ["1.0::DOUBLE", *models.FEATURES, "label"]
SQUARE = ["1.0::DOUBLE", *models.FEATURES, "imb_top * imb_top", "imb_top * ofi", "imb_top * trade_flow", "ofi * ofi", "ofi * trade_flow", "trade_flow * trade_flow", "label"]


def _unnested(names: list[str]) -> str:
    return f"WITH {MODEL}, g AS (SELECT {_products(names, 'p')} FROM rows_) SELECT i - 1 AS at, p[i] + 0.0 AS product FROM g, range(1, len(p) + 1) r(i)"


def _gram(spark, d, design):
    g = models.gram(_model_rows(spark, d), design, "label")
    return g.select(F.posexplode("products").alias("at", "product")).select(F.col("at").cast("long").alias("at"), (F.round("product", 6) + 0.0).alias("product"))


@query("gram", _unnested(LINEAR))
def gram(spark, d):
    return _gram(spark, d, {f: F.col(f) for f in models.FEATURES})


@query("poly2_gram", _unnested(SQUARE))
def poly2_gram(spark, d):
    return _gram(spark, d, models.degree_two(models.FEATURES))


def _two(alpha: float) -> str:
    """Both coefficients of a fit on two features, by Cramer's rule."""
    return f"""WITH {MODEL}, s AS (SELECT avg(label) AS my, avg(imb_top) AS m1, avg(ofi) AS m2, var_pop(imb_top) * count(*) + {alpha} AS a11, var_pop(ofi) * count(*) + {alpha} AS a22,
  covar_pop(imb_top, ofi) * count(*) AS a12, covar_pop(label, imb_top) * count(*) AS b1, covar_pop(label, ofi) * count(*) AS b2 FROM rows_),
w AS (SELECT *, (b1 * a22 - b2 * a12) / (a11 * a22 - a12 * a12) AS w1, (b2 * a11 - b1 * a12) / (a11 * a22 - a12 * a12) AS w2 FROM s)
SELECT round(my - w1 * m1 - w2 * m2, 8) AS intercept, round(w1, 8) AS w1, round(w2, 8) AS w2 FROM w"""


for _name, _config in (("ols", models.Config("ols")), ("ridge", models.Config("ridge", 10.0))):

    @query(_name, _two(_config.alpha))
    def _fit_two(spark, d, config=_config):
        w = models.fit(_model_rows(spark, d), config, ("imb_top", "ofi"), "label").weights
        return spark.createDataFrame([tuple(round(x, 8) for x in w)], "intercept double, w1 double, w2 double")


@query("elastic_net", f"""WITH {MODEL}, s AS (SELECT covar_pop(label, ofi) AS c, var_pop(ofi) AS v, avg(label) AS my, avg(ofi) AS mx FROM rows_), w AS (SELECT *, sign(c) * greatest(abs(c) - 1e-6 * 0.5, 0) / (v + 1e-6 * 0.5) AS slope FROM s)
SELECT round(my - slope * mx, 8) AS intercept, round(slope, 8) AS slope FROM w""")
def elastic_net(spark, d):
    w = models.fit(_model_rows(spark, d), models.Config("elastic_net", 1e-6, 0.5), ("ofi",), "label").weights
    return spark.createDataFrame([(round(w[0], 8), round(w[1], 8))], "intercept double, slope double")


@query("predict", f"WITH {SCAN} SELECT etime, round(0.5::DOUBLE + 2.0::DOUBLE * imb_top + -0.25::DOUBLE * ofi + 0.125::DOUBLE * trade_flow, 9) AS pred FROM decisions")
def predict(spark, d):
    model = models.Frozen(models.Config("ols"), models.FEATURES, (0.5, 2.0, -0.25, 0.125))
    return _decisions(spark, d).select("etime", F.round(model.predict(), 9).alias("pred"))


SCORED = f"{MODEL}, scored AS (SELECT *, imb_top / 100 + ofi / 1000 AS pred FROM rows_)"


def _scored(spark, d):
    return _model_rows(spark, d).withColumn("pred", F.col("imb_top") / 100 + F.col("ofi") / 1000)


@query("r2_family", f"""WITH {SCORED} SELECT count(*) AS n, round(1 - sum((label - pred) * (label - pred)) / sum(label * label), 6) AS r2_zero, round(1 - sum((label - pred) * (label - pred)) / (var_pop(label) * count(*)), 6) AS r2_mean,
round(1 - sum((label - 0.01) * (label - 0.01)) / sum(label * label), 6) AS r2_constant FROM scored""")
def r2_family(spark, d):
    out = models.r_squared(_scored(spark, d), "pred", "label", 0.01)
    return out.withColumns({c: F.round(c, 6) for c in ("r2_zero", "r2_mean", "r2_constant")})


@query("rank_ic", f"""WITH {SCORED}, r AS (SELECT rank() OVER (ORDER BY pred) + (count(*) OVER (PARTITION BY pred) - 1) / 2.0 AS a, rank() OVER (ORDER BY label) + (count(*) OVER (PARTITION BY label) - 1) / 2.0 AS b FROM scored)
SELECT count(*) AS n, round(corr(a, b), 6) AS rank_ic FROM r""")
def rank_ic(spark, d):
    return models.rank_correlation(_scored(spark, d), "pred", "label").select("n", F.round("rank_ic", 6).alias("rank_ic"))


@query("rank_ic_by_day", f"""WITH {SCORED}, r AS (SELECT day, rank() OVER (PARTITION BY day ORDER BY pred) + (count(*) OVER (PARTITION BY day, pred) - 1) / 2.0 AS a, rank() OVER (PARTITION BY day ORDER BY label) + (count(*) OVER (PARTITION BY day, label) - 1) / 2.0 AS b FROM scored)
SELECT day, count(*) AS n, CASE WHEN count(*) > 1 THEN round(corr(a, b), 6) END AS rank_ic FROM r GROUP BY day""")
def rank_ic_by_day(spark, d):
    return models.rank_correlation(_scored(spark, d), "pred", "label", ["day"]).select("day", "n", F.round("rank_ic", 6).alias("rank_ic"))


@query("sweep")
def sweep(spark, d):
    return models.sweep(_model_rows(spark, d), BLOCKS, HOUR, HOUR, target="label")


CONFIGS = "configs AS (SELECT l_linenumber AS config, l_quantity - 25 AS mean_ic, l_discount AS mean_r2, l_orderkey % 3 <> 0 AS eligible FROM lineitem)"


@query("config_argmax", f"WITH {CONFIGS} SELECT * FROM (SELECT config, mean_ic, mean_r2, eligible FROM configs WHERE eligible ORDER BY mean_ic DESC, mean_r2 DESC, config LIMIT 1)")
def config_argmax(spark, d):
    li = src.table(spark, d, "lineitem")
    return models.winner(li.select(F.col("l_linenumber").alias("config"), (F.col("l_quantity") - 25).alias("mean_ic"), F.col("l_discount").alias("mean_r2"), (F.col("l_orderkey") % 3 != 0).alias("eligible")))


@query("return_price", f"WITH {SCORED}, l AS (SELECT d.etime, d.mid, s.pred FROM decisions d LEFT JOIN scored s USING (etime) WHERE mid IS NOT NULL) SELECT etime, round(mid * (1 + coalesce(pred, 0)), 6) AS price, pred IS NULL AS filled FROM l")
def return_price(spark, d):
    rows = _decisions(spark, d).where("mid is not null").select("etime", "mid").join(_scored(spark, d).select("etime", "pred"), "etime", "left")
    return rows.select("etime", F.round(models.price_of_return(F.col("mid"), F.col("pred")), 6).alias("price"), F.col("pred").isNull().alias("filled"))


@query("alignment", f"WITH {SCAN} SELECT count(*) FILTER (decision_seq % 59 = 0) AS unmatched, count(*) FILTER (decision_seq % 59 <> 0 AND decision_seq % 61 = 0) AS moved FROM decisions")
def alignment(spark, d):
    frame = _decisions(spark, d).select("etime", "decision_seq")
    table = frame.where("decision_seq % 59 <> 0").withColumn("decision_seq", F.when(F.col("decision_seq") % 61 == 0, -1).otherwise(F.col("decision_seq")))
    return models.aligned(frame, table)


# The simulator, with a prediction and a threshold.
def sim(base: str, rows: str, pred: str, x_bps: int) -> str:
    return f"""{base}, sim AS (SELECT day, etime, CAST(round(bid_price * 10) AS BIGINT) AS bid, CAST(round(ask_price * 10) AS BIGINT) AS ask, {pred} AS pred, row_number() OVER (ORDER BY etime) AS rn FROM {rows}),
trig AS (SELECT *, s // 10000000 > ask + x AS up FROM (SELECT *, CAST(round_even(pred * 1e8, 0) AS BIGINT) AS s, (bid + ask) * {x_bps} // 20000 AS x FROM sim)),
fixed AS (SELECT *, CASE WHEN s % 10000000 = 0 THEN s // 10000000 ELSE s // 10000000 + 1 END < bid - x AS down FROM trig)"""


def walk(base: str, rows: str, pred: str, x_bps: int) -> str:
    """Every row's position by one step after another, and the fills."""
    return f"""RECURSIVE {sim(base, rows, pred, x_bps)}, walk AS (
  SELECT rn, CASE WHEN up THEN 1 WHEN down THEN -1 ELSE 0 END AS position FROM fixed WHERE rn = 1
  UNION ALL SELECT f.rn, CASE WHEN w.position = 0 THEN CASE WHEN up THEN 1 WHEN down THEN -1 ELSE 0 END WHEN w.position > 0 THEN CASE WHEN down THEN -1 ELSE 1 END ELSE CASE WHEN up THEN 1 ELSE -1 END END
  FROM walk w JOIN fixed f ON f.rn = w.rn + 1),
pos AS (SELECT f.*, position, position <> coalesce(lag(position) OVER (ORDER BY rn), 0) AS filled FROM fixed f JOIN walk USING (rn)),
fills AS (SELECT *, 10000000000::HUGEINT * 100000000 // (price * 10000000::HUGEINT) // 100000 * 100000 AS qty, lead(price) OVER (ORDER BY rn) AS next_price FROM (SELECT *, CASE WHEN position > 0 THEN ask ELSE bid END AS price FROM pos WHERE filled))"""


#: Predictions near the mid, scattered by the row's number.
SCATTERED = (SCAN, "decisions WHERE mid IS NOT NULL", "mid * (1 + CAST(decision_seq % 11 - 5 AS DOUBLE) / 100)", 5)
SIM, WALK = sim(*SCATTERED), walk(*SCATTERED)
EQUITY = f"""{WALK}, won AS (SELECT rn, price, position, qty, coalesce(sum(w) OVER (ORDER BY rn), 0) AS realised FROM (SELECT *, lag(position) OVER o * (price - lag(price) OVER o) * lag(qty) OVER o AS w FROM fills WINDOW o AS (ORDER BY rn))),
eq AS (SELECT p.day, p.etime, p.position, CAST(coalesce(w.realised, 0) + coalesce(w.position * (CASE WHEN w.position > 0 THEN p.bid ELSE p.ask END - w.price) * w.qty, 0) AS BIGINT) AS equity FROM pos p ASOF LEFT JOIN won w ON p.rn >= w.rn)"""


def _sim_rows(spark, d):
    return _decisions(spark, d).where("mid is not null").withColumn("pred", F.col("mid") * (1 + (F.col("decision_seq") % 11 - 5).cast("double") / 100))


def _simulated(spark, d):
    return simulate.simulated(_sim_rows(spark, d), x_bps=5)


@query("ticks", f"WITH {SIM} SELECT etime, bid AS bid_ticks, ask AS ask_ticks FROM sim")
def ticks(spark, d):
    return simulate.arrays(_sim_rows(spark, d)).select("etime", "bid_ticks", "ask_ticks")


@query("triggers", f"WITH {SIM} SELECT etime, up AS go_long, down AS go_short FROM fixed")
def triggers(spark, d):
    return simulate.triggers(simulate.arrays(_sim_rows(spark, d)), 5).select("etime", "go_long", "go_short")


@query("sim_refusals", f"WITH {SCAN} SELECT min(etime) AS first_bad, count(*) AS bad_rows FROM decisions WHERE mid IS NOT NULL AND (decision_seq % 17 = 0 OR decision_seq % 19 = 0 OR decision_seq % 23 = 0)")
def sim_refusals(spark, d):
    k, pred = F.col("decision_seq"), F.col("pred")
    odd = F.when(k % 17 == 0, -pred).when(k % 19 == 0, float("nan")).when(k % 23 == 0, None).otherwise(pred)
    return simulate.refusals(simulate.arrays(_sim_rows(spark, d).withColumn("pred", odd)))


@query("position", f"WITH {WALK} SELECT etime, position FROM pos")
def position(spark, d):
    return _simulated(spark, d)[0].select("etime", "position")


@query("trade_log", f"WITH {WALK} SELECT etime, position AS side, price AS price_ticks, CAST(qty AS BIGINT) AS qty_scaled, position AS position_after FROM fills")
def trade_log(spark, d):
    return _simulated(spark, d)[1].select("etime", "side", "price_ticks", "qty_scaled", "position_after")


@query("equity", f"WITH {EQUITY} SELECT etime, position, equity FROM eq")
def equity(spark, d):
    return simulate.equity(*_simulated(spark, d)).select("etime", "position", "equity")


@query("closed_pnl", f"WITH {WALK} SELECT count(*) AS trades, CAST(coalesce(sum(position * (next_price - price)), 0) AS BIGINT) AS pnl_ticks FROM fills")
def closed_pnl(spark, d):
    return simulate.closed_pnl(_simulated(spark, d)[1])


@query("daily_sharpe", f"""WITH {EQUITY}, e AS (SELECT day, max_by(equity, etime) AS e FROM eq GROUP BY day), p AS (SELECT CAST(e - coalesce(lag(e) OVER (ORDER BY day), 0) AS DOUBLE) AS pnl FROM e)
SELECT count(*) AS days, CASE WHEN count(*) >= 5 AND stddev_samp(pnl) > 0 THEN round(avg(pnl) / stddev_samp(pnl) * sqrt(365.0), 8) END AS sharpe FROM p""")
def daily_sharpe(spark, d):
    return simulate.daily_sharpe(simulate.equity(*_simulated(spark, d)), 5).select("days", F.round("sharpe", 8).alias("sharpe"))


@query("ceiling", f"WITH {walk(LABELS + ', ' + labelled(H2), 'labelled WHERE label IS NOT NULL', 'mid * (1 + label)', 0)} SELECT count(*) AS trades, CAST(coalesce(sum(position * (next_price - price)), 0) AS BIGINT) AS pnl_ticks FROM fills")
def ceiling(spark, d):
    return simulate.ceiling(_labelled(spark, d, H2), "label")


# Data quality.
LEDGER = f"""{src.SQL}, ledger AS (SELECT rtime AS gap_start_rtime, rtime + CASE WHEN id % 499 = 0 THEN {5 * HOUR} ELSE (id % 11) * 100000000 END + 1 AS gap_end_rtime, CASE id % 3 WHEN 0 THEN 'merged-silent' WHEN 1 THEN 'merged-silent-late' ELSE 'connection-silent' END AS cause, CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN 1 ELSE 2 END AS ledger_version FROM quotes),
outages AS (SELECT gap_start_rtime AS s, max(gap_end_rtime) AS e FROM ledger WHERE ledger_version >= 2 AND cause LIKE 'merged-silent%' GROUP BY 1),
cut AS (SELECT k AS day, greatest(s, k * {DAY}) AS s, least(e, (k + 1) * {DAY}) AS e FROM (SELECT s, e, unnest(range(s // {DAY}, (e - 1) // {DAY} + 1)) AS k FROM outages))"""


def _ledger(spark, d):
    q, i = _quotes(spark, d), F.col("id")
    long = F.when(i % 499 == 0, 5 * HOUR).otherwise(i % 11 * 100_000_000)
    cause = F.when(i % 3 == 0, "merged-silent").when(i % 3 == 1, "merged-silent-late").otherwise("connection-silent")
    return q.select(F.col("rtime").alias("gap_start_rtime"), (F.col("rtime") + long + 1).alias("gap_end_rtime"), cause.alias("cause"), F.when(i % 4 == 1, 1).when(i % 4 > 1, 2).alias("ledger_version"))


@query("dq_outages", f"WITH {LEDGER} SELECT s AS start, e AS \"end\" FROM outages")
def dq_outages(spark, d):
    return quality.outages(_ledger(spark, d))


@query("dq_split_days", f"WITH {LEDGER} SELECT day, s AS start, e AS \"end\" FROM cut")
def dq_split_days(spark, d):
    return quality.by_day(quality.outages(_ledger(spark, d)))


@query("dq_gap_coverage", f"WITH {LEDGER} SELECT day, CASE WHEN sum(e - s) > 900000000000 THEN 'failed' WHEN sum(e - s) > 60000000000 THEN 'degraded' ELSE 'ok' END AS status, CAST(sum(e - s) AS DOUBLE) / 1e9 AS value, count(*) AS count FROM cut GROUP BY day")
def dq_gap_coverage(spark, d):
    return quality.gap_coverage(_ledger(spark, d)).select("day", "status", "value", "count")


@query("dq_resync", f"WITH {LEDGER} SELECT e // {DAY} AS day, s AS start, e AS \"end\", e + {60 * SECOND} AS stop FROM outages")
def dq_resync(spark, d):
    return quality.resync_windows(_ledger(spark, d))


@query("dq_reconciliation", f"WITH {RECON}, r AS (SELECT *, greatest(100.0::DOUBLE * archive_only / nullif(archive_only + in_both, 0), 100.0::DOUBLE * capture_only / nullif(capture_only + in_both, 0)) AS w FROM recon) SELECT day, CASE WHEN w IS NULL THEN 'n/a' WHEN w > 0.5 THEN 'degraded' ELSE 'ok' END AS status, round(w, 9) AS value, archive_only + capture_only AS count FROM r")
def dq_reconciliation(spark, d):
    return quality.reconciliation(reconciliation(spark, d)).select("day", "status", F.round("value", 9).alias("value"), "count")


@query("dq_placeholder", f"WITH {src.SQL}, c AS (SELECT day, count(*) FILTER (exec_type = 'NA') AS n, count(*) AS t FROM trades GROUP BY day) SELECT day, CASE WHEN 100.0 * n / t > 2 THEN 'degraded' ELSE 'ok' END AS status, round(100.0::DOUBLE * n / t, 9) AS value, n AS count FROM c")
def dq_placeholder(spark, d):
    return quality.placeholder_rate(placeholder_counts(spark, d)).select("day", "status", F.round("value", 9).alias("value"), "count")


@query("dq_probable_loss", f"WITH {src.SQL}, s AS (SELECT day, id - lag(id) OVER w - 1 AS skip, etime - lag(etime) OVER w AS span FROM trades WINDOW w AS (PARTITION BY day ORDER BY id)) SELECT day, CASE WHEN count(skip) = 0 THEN 'n/a' ELSE 'ok' END AS status, CAST(max(skip) FILTER (skip > 10 AND span > {HOUR}) AS DOUBLE) AS value, count(*) FILTER (skip > 10 AND span > {HOUR}) AS count, 'largest skip ' || max(skip) || ', longest step ' || max(span) AS detail FROM s GROUP BY day")
def dq_probable_loss(spark, d):
    return quality.probable_loss(_trades(spark, d), "id", 10, HOUR).select("day", "status", "value", "count", "detail")


@query("dq_crossed", f"WITH {src.SQL} SELECT day, 'ok' AS status, count(*) FILTER (bid_price >= ask_price) AS count FROM quotes GROUP BY day")
def dq_crossed(spark, d):
    return quality.crossed_or_locked(_quotes(spark, d)).select("day", "status", "count")


SPARSE = f"""{src.SQL}, s AS (SELECT day, max(step) AS i, min(etime) - day * {DAY} AS a, (day + 1) * {DAY} - max(etime) AS b FROM (SELECT day, etime, etime - lag(etime) OVER (PARTITION BY day ORDER BY etime) AS step FROM quotes) GROUP BY day),
sparse AS (SELECT day, 'quote' AS stream, CASE WHEN greatest(i, a, b) > {HOUR} THEN 'degraded' ELSE 'ok' END AS status, CAST(greatest(i, a, b) AS DOUBLE) / 1e9 AS value FROM s)"""


@query("dq_sparsity", f"WITH {SPARSE} SELECT day, status, value FROM sparse")
def dq_sparsity(spark, d):
    return quality.sparsity(_quotes(spark, d), HOUR).select("day", "status", "value")


@query("dq_plausibility", f"WITH {src.SQL} SELECT day, CASE WHEN min(etime) >= (day - 1) * {DAY} AND max(etime) <= (day + 2) * {DAY} THEN 'ok' ELSE 'failed' END AS status, min(etime) || '..' || max(etime) AS detail FROM feed GROUP BY day")
def dq_plausibility(spark, d):
    return quality.plausible_times(src.feed(spark, d), "etime", "all").select("day", "status", "detail")


@query("dq_rtime", f"WITH {src.SQL} SELECT day, CASE WHEN min(rtime - etime) >= -60000000000 AND max(rtime - etime) <= 3600000000000 AND max(rtime) <= {(D2 + 1) * DAY} THEN 'ok' ELSE 'failed' END AS status, CAST(max(rtime - etime) AS DOUBLE) / 1e9 AS value FROM trades GROUP BY day")
def dq_rtime(spark, d):
    return quality.plausible_receive_times(_trades(spark, d), "trade", F.lit("capture"), (D2 + 1) * DAY).select("day", "status", "value")


@query("dq_feature", f"""WITH {LABELS}, {labelled(H1)}, s AS (SELECT day, count(*) AS n, count(reason) AS nulls, count(*) FILTER (label = 0) AS zeros, count(*) FILTER (warmup) AS warm, count(*) FILTER (mid IS NULL) AS bare, count(*) FILTER (decision_seq % 97 = 0) AS odd, count(*) FILTER (reason = 'null_gap') AS lost FROM labelled GROUP BY day)
SELECT day, 'feature_label_coverage' AS "check", CASE WHEN 100.0 * nulls / n > 2 THEN 'degraded' ELSE 'ok' END AS status, nulls AS count FROM s UNION ALL SELECT day, 'feature_quantization', 'ok', zeros FROM s UNION ALL SELECT day, 'feature_warmup', 'ok', warm FROM s UNION ALL SELECT day, 'feature_row_filters', 'ok', bare FROM s UNION ALL SELECT day, 'feature_window', CASE WHEN odd > 0 THEN 'failed' ELSE 'ok' END, odd FROM s UNION ALL SELECT day, 'feature_asof_convention', 'ok', lost FROM s""")
def dq_feature(spark, d):
    gap = F.coalesce(F.col("reason") == "null_gap", F.lit(False))
    stats = _labelled(spark, d, H1).groupBy("day").agg(F.count("*").alias("rows"), F.count_if(F.col("mid").isNull()).alias("dropped"), F.count("reason").alias("null_labels"), F.count_if(F.coalesce(F.col("label") == 0, F.lit(False))).alias("zero_labels"), F.count_if("warmup").alias("warmup_rows"), F.lit(True).alias("sidecar"), F.count_if(F.col("decision_seq") % 97 == 0).alias("overflow"), F.count("*").alias("compared"), F.count_if(gap).alias("disagreeing"))
    return quality.feature_checks(stats).select("day", "check", "status", "count")


@query("dq_verdict", f"WITH {SPARSE} SELECT day, stream, status AS verdict FROM sparse UNION ALL SELECT day, 'trade', CASE WHEN 100.0 * count(*) FILTER (exec_type = 'NA') / count(*) > 2 THEN 'degraded' ELSE 'ok' END FROM trades GROUP BY day")
def dq_verdict(spark, d):
    q, t = _quotes(spark, d), _trades(spark, d)
    return quality.verdict(quality.report(quality.sparsity(q, HOUR), quality.crossed_or_locked(q), quality.placeholder_rate(curate.placeholder_counts(t, "day")), quality.probable_loss(t)))


# Capture.
CAPTURE = f"{src.SQL}, cap AS (SELECT 0 AS conn_id, id, day, rtime FROM trades UNION ALL SELECT 1, id, day, rtime + (id % 7) * {100 * SECOND} FROM trades WHERE id % 3 <> 0)"


def _captured(spark, d):
    t = _trades(spark, d)
    return t.select(F.lit(0).alias("conn_id"), "id", "day", "rtime").union(t.where("id % 3 <> 0").select(F.lit(1).alias("conn_id"), "id", "day", F.col("rtime") + F.col("id") % 7 * 100 * SECOND))


#: Up to five deliveries of an id, 0 to 600 s apart: chains in which each is close to the one before it.
CHAINS = f"""{CAPTURE}, chain AS (SELECT * FROM cap UNION ALL SELECT 2, id, day, rtime + {200 * SECOND} FROM trades WHERE id % 2 = 0 UNION ALL SELECT 3, id, day, rtime + {300 * SECOND} FROM trades WHERE id % 5 < 3
  UNION ALL SELECT 4, id, day, rtime + {110 * SECOND} FROM trades WHERE id % 4 = 1), k1 AS (SELECT id, min(rtime) AS t FROM chain GROUP BY id)""" + "".join(f", k{n + 1} AS (SELECT id, min(rtime) AS t FROM chain JOIN k{n} USING (id) WHERE rtime > t + {120 * SECOND} GROUP BY id)" for n in range(1, 5))


@query("dedup_ttl", f"WITH {CHAINS}, kept AS ({' UNION ALL '.join(f'SELECT * FROM k{n}' for n in range(1, 6))}) SELECT min(conn_id) AS conn_id, id, rtime FROM chain JOIN kept USING (id) WHERE rtime = t GROUP BY id, rtime")
def dedup_ttl(spark, d):
    t, rows = _trades(spark, d), _captured(spark, d)
    for conn, some, late in ((2, "id % 2 = 0", 200), (3, "id % 5 < 3", 300), (4, "id % 4 = 1", 110)):
        rows = rows.union(t.where(some).select(F.lit(conn).alias("conn_id"), "id", "day", F.col("rtime") + late * SECOND))
    return capture.first_deliveries(rows, ["id"]).select("conn_id", "id", "rtime")


@query("gap_merged", f"WITH {CAPTURE} SELECT prev AS gap_start_rtime, rtime AS gap_end_rtime FROM (SELECT rtime, lag(rtime) OVER (ORDER BY rtime, conn_id) AS prev FROM cap) WHERE rtime - prev > {HOUR}")
def gap_merged(spark, d):
    c = _captured(spark, d).withColumn("day", F.floor(F.col("rtime") / DAY).cast("long"))
    return capture.merged_gaps(c, HOUR).select("gap_start_rtime", "gap_end_rtime")


@query("gap_connection", f"WITH {CAPTURE} SELECT conn_id, own AS gap_start_rtime, rtime AS gap_end_rtime FROM (SELECT *, lag(rtime) OVER (ORDER BY rtime, conn_id) AS anyone, lag(rtime) OVER (PARTITION BY conn_id ORDER BY rtime) AS own FROM cap) WHERE rtime - own > {HOUR} AND rtime - anyone <= {HOUR}")
def gap_connection(spark, d):
    c = _captured(spark, d).withColumn("day", F.floor(F.col("rtime") / DAY).cast("long"))
    return capture.connection_gaps(c, HOUR).select("conn_id", "gap_start_rtime", "gap_end_rtime")


@query("trade_id_skip", f"WITH {src.SQL}, s AS (SELECT id, max(id) OVER (ORDER BY day, rtime, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM trades) SELECT id, prior, id - prior - 1 AS missing FROM s WHERE id - prior > 1")
def trade_id_skip(spark, d):
    return capture.id_skips(_trades(spark, d))


@query("silent_connections", f"WITH {CAPTURE} SELECT conn_id, {(D2 + 10) * DAY} - max(rtime) AS silent FROM cap GROUP BY conn_id HAVING silent > {HOUR}")
def silent_connections(spark, d):
    return capture.silent_connections(_captured(spark, d), (D2 + 10) * DAY, HOUR)


@query("frames_parsed", f"WITH {src.SQL} SELECT id, CAST(etime // 1000000 * 1000000 AS BIGINT) AS etime, price, qty, is_buyer_maker, exec_type FROM trades WHERE id % 3 <> 0")
def frames_parsed(spark, d):
    t = _trades(spark, d)
    data = F.struct(F.lit("trade").alias("e"), (F.col("etime") / 1000000).cast("long").alias("E"), (F.col("etime") / 1000000).cast("long").alias("T"), F.lit("X").alias("s"), F.col("id").alias("t"), F.col("price").cast("string").alias("p"), F.col("qty").cast("string").alias("q"), F.col("exec_type").alias("X"), F.col("is_buyer_maker").alias("m"))
    frame = F.to_json(F.struct(F.when(F.col("id") % 3 == 0, "x@bookTicker").otherwise("x@trade").alias("stream"), data.alias("data")))
    return capture.parsed_trades(t.select(F.lit(0).alias("conn_id"), "rtime", frame.alias("frame"))).select("id", "etime", "price", "qty", "is_buyer_maker", "exec_type")


@query("union_missing_cols", f"WITH {src.SQL} SELECT id, price, NULL::VARCHAR AS exec_type FROM trades WHERE id % 2 = 0 UNION ALL SELECT id, price, exec_type FROM trades WHERE id % 2 = 1")
def union_missing_cols(spark, d):
    t = _trades(spark, d)
    return t.where("id % 2 = 0").select("id", "price").unionByName(t.where("id % 2 = 1").select("id", "price", "exec_type"), allowMissingColumns=True)


@query("bounds", f"WITH {src.SQL} SELECT source_rank, min(etime) AS low, max(etime) AS high, min(rtime - etime) AS skew_low, max(rtime - etime) AS skew_high, count(*) AS n FROM feed GROUP BY source_rank")
def bounds(spark, d):
    f, skew = src.feed(spark, d), F.col("rtime") - F.col("etime")
    return f.groupBy(F.col("source_rank").cast("int").alias("source_rank")).agg(F.min("etime").alias("low"), F.max("etime").alias("high"), F.min(skew).alias("skew_low"), F.max(skew).alias("skew_high"), F.count("*").alias("n"))


@query("day_slices", f"WITH {src.SQL} SELECT strftime(make_timestamp(day * 86400000000), '%Y-%m-%d') AS date, count(*) AS n FROM feed WHERE etime >= {D0 * DAY} AND etime < {D2 * DAY} GROUP BY day")
def day_slices(spark, d):
    f = src.feed(spark, d).where((F.col("etime") >= D0 * DAY) & (F.col("etime") < D2 * DAY))
    return f.groupBy(date_string(F.col("etime")).alias("date")).agg(F.count("*").alias("n"))


@query("date_range", f"SELECT unnest(range({D0}, {D1} + 1)) AS day")
def date_range(spark, d):
    return spark.range(1).select(F.explode(days_between(F.lit(D0).cast("long"), F.lit(D1).cast("long"))).alias("day"))


# The relational operations that come with the engine's base, on the star schema.
@query("pricing_summary", """SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, d):
    li = src.table(spark, d, "lineitem").where("l_shipdate <= date'1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("long").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("customers_without_orders", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')")
def customers_without_orders(spark, d):
    o = src.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey")
    c = src.table(spark, d, "customer")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")


@query("order_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def order_cube(spark, d):
    return src.table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
