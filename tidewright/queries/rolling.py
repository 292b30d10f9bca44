"""Window indicators and rolling calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rolling as ro
from ..sources import fixtures as fx
from .common import Area, r, rounded

area = Area()
W = 40
W_SQL = "WINDOW w AS (PARTITION BY symbol ORDER BY ts)"
SERIES = "s AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS x FROM bars_1h)"
#: AR(1) of the W closes before, as aggregates over the frame of W - 1 pairs.
AR1 = f"""{SERIES}, m AS (
  SELECT *, CASE WHEN idx >= {W} THEN avg(close) OVER f END AS mu, covar_pop(close, x) OVER p / nullif(var_pop(x) OVER p, 0) AS b1, avg(close) OVER p AS ay, avg(x) OVER p AS ax,
    var_pop(close) OVER p AS vy, var_pop(x) OVER p AS vx, covar_pop(close, x) OVER p AS cxy
  FROM s WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {W} PRECEDING AND 1 PRECEDING), p AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {W - 1} PRECEDING AND 1 PRECEDING)
), a AS (SELECT *, ay - b1 * ax AS b0, least(greatest(b1, 0.01), 0.99) AS phi FROM m WHERE idx >= {W}
), c AS (SELECT *, sqrt(greatest(vy - 2 * phi * cxy + phi * phi * vx + (ay - b0 - phi * ax) * (ay - b0 - phi * ax), 0)) AS sigma FROM a)"""


def close():
    return F.col("close")


def hourly(spark, sf_dir):
    return fx.bars(spark, sf_dir)


def indexed(spark, sf_dir):
    return hourly(spark, sf_dir).withColumn("idx", F.row_number().over(ro.order()) - 1)


@area.add(f"{fx.with_('bars_1h')} SELECT symbol, ts, round(close - lag(close) OVER w, 6) AS change, round(greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)), 6) AS true_range FROM bars_1h {W_SQL}")
def true_range(spark, sf_dir):
    """Change and true range."""
    return hourly(spark, sf_dir).select("symbol", "ts", r(close() - ro.previous(close())).alias("change"), r(ro.true_range(F.col("high"), F.col("low"), close())).alias("true_range"))


@area.add(f"""{fx.with_('bars_1h')} SELECT symbol, ts, round(CASE WHEN count(*) OVER p = 20 THEN max(close) OVER p END, 6) AS hi, round(CASE WHEN count(*) OVER p = 20 THEN min(close) OVER p END, 6) AS lo
 FROM bars_1h WINDOW p AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def donchian_bands(spark, sf_dir):
    """Highest and lowest of twenty closes before."""
    return hourly(spark, sf_dir).select("symbol", "ts", r(ro.highest(close(), 20)).alias("hi"), r(ro.lowest(close(), 20)).alias("lo"))


@area.add(f"""{fx.with_('bars_1h')} SELECT symbol, ts, round(CASE WHEN count(*) OVER p = 20 THEN stddev_samp(close) OVER p END, 6) AS vol
 FROM bars_1h WINDOW p AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def rolling_vol(spark, sf_dir):
    """Deviation of twenty closes before."""
    return hourly(spark, sf_dir).select("symbol", "ts", r(ro.volatility(close())).alias("vol"))


@area.add(f"""{fx.with_('bars_1h')} SELECT symbol, ts, round(CASE WHEN high > low THEN (least(open, close) - low) / (high - low) END, 6) AS wick,
 round(volume / (CASE WHEN count(*) OVER p = 20 THEN avg(volume) OVER p END), 6) AS climax FROM bars_1h WINDOW p AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def wick_ratio_volume_climax(spark, sf_dir):
    """Lower wick, and volume against the mean before."""
    rows = hourly(spark, sf_dir)
    return rows.select("symbol", "ts", r(ro.wick(F.col("open"), F.col("high"), F.col("low"), close())).alias("wick"), r(F.col("volume") / ro.mean(F.col("volume"), 20)).alias("climax"))


@area.add(f"""{fx.with_('bars_1h')}, {AR1} SELECT symbol, ts, round(mu, 7) AS mu, round(phi, 4) AS phi, round(sigma, 4) AS sigma, round(-ln(phi), 4) AS theta, round(sigma / sqrt(greatest(-2 * ln(phi), 1e-12)), 3) AS sigma_stat, round(ln(2) / -ln(phi), 3) AS half_life FROM c""")
def rolling_ar1(spark, sf_dir):
    """AR(1) calibration of forty closes before, and what follows from it."""
    rows = indexed(spark, sf_dir)
    a = ro.ar1(close(), W)
    rows = rows.select("symbol", "ts", "idx", *(v.alias(k) for k, v in a.items())).where(F.col("idx") >= W)
    phi, sigma = F.col("phi"), F.col("sigma")
    return rows.select("symbol", "ts", r("mu", 7).alias("mu"), r("phi", 4).alias("phi"), r("sigma", 4).alias("sigma"), r(ro.theta(phi), 4).alias("theta"), r(ro.stationary_sigma(sigma, phi), 3).alias("sigma_stat"), r(ro.half_life(phi), 3).alias("half_life"))


@area.add(f"""{fx.with_('bars_1h')}, {SERIES} SELECT symbol, ts, round(regr_slope(close, idx) OVER p, 4) AS velocity FROM s WINDOW p AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {W} PRECEDING AND 1 PRECEDING) QUALIFY count(*) OVER p = {W}""")
def trend_velocity(spark, sf_dir):
    """Slope of forty closes before."""
    rows = indexed(spark, sf_dir).select("symbol", "ts", r(ro.velocity(close(), F.col("idx"), W), 4).alias("velocity"))
    return rows.where("velocity is not null")


FRAMES = f"""{AR1}, l AS (SELECT *, list(close) OVER f AS xs FROM s WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {W} PRECEDING AND 1 PRECEDING)),
 e AS (SELECT c.symbol, c.ts, c.idx, c.phi, c.mu, l.xs, list_transform(range(2, {W + 1}), lambda i: l.xs[i] - c.phi * l.xs[i - 1] - (1 - c.phi) * c.mu) AS e FROM c JOIN l USING (symbol, ts))"""


def _frames(spark, sf_dir):
    rows = indexed(spark, sf_dir)
    a = ro.ar1(close(), W)
    rows = rows.select("symbol", "ts", "idx", a["phi"].alias("phi"), a["mu"].alias("mu"), ro.frame(close(), W).alias("xs")).where(F.col("idx") >= W)
    return rows.withColumn("e", ro.residuals(F.col("xs"), F.col("phi"), F.col("mu")))


@area.add(f"""{fx.with_('bars_1h')}, {FRAMES} SELECT symbol, ts, round(list_avg(list_transform(range(2, {W + 1}), lambda i: e[i - 1] * e[i - 1] / greatest(xs[i - 1], 1e-9))), 5) AS sigma2 FROM e""")
def cir_sigma(spark, sf_dir):
    """Level-dependent variance of the calibration residuals."""
    return _frames(spark, sf_dir).select("symbol", "ts", r(ro.cir_sigma(F.col("xs"), F.col("phi"), F.col("mu")), 5).alias("sigma2"))


@area.add(f"""{fx.with_('bars_1h')}, {FRAMES}, k AS (SELECT *, list_stddev_pop(e) AS sd FROM e), q AS (SELECT *, list_filter(e, lambda v: abs(v) <= 2 * sd) AS kept FROM k)
 SELECT symbol, ts, round(CASE WHEN sd <= 0 THEN 1e-6 WHEN len(kept) < 10 THEN sd ELSE list_stddev_pop(kept) END, 3) AS sigma, round(CASE WHEN sd <= 0 OR len(kept) < 10 THEN 0 ELSE (len(e) - len(kept)) / len(e) END, 6) AS share FROM q""")
def jump_split(spark, sf_dir):
    """Diffusion deviation and jump share of the residuals."""
    rows = _frames(spark, sf_dir).withColumn("j", ro.jump_split(F.col("e"), 2.0))
    return rows.select("symbol", "ts", r("j.sigma", 3).alias("sigma"), r("j.share").alias("share"))


@area.add(f"""{fx.with_('bars_1h')}, {FRAMES} SELECT symbol, ts, round(list_aggregate(e, 'quantile_cont', 0.9), 3) AS q90, round(list_aggregate(e, 'quantile_cont', 0.1), 3) AS q10, round(list_aggregate(e, 'quantile_cont', 0.99), 3) AS q99 FROM e""")
def residual_quantiles(spark, sf_dir):
    """Empirical entry and stop bands of the residuals."""
    q = lambda p: r(ro.array_percentile(F.col("e"), F.lit(p)), 3)
    return _frames(spark, sf_dir).select("symbol", "ts", q(0.9).alias("q90"), q(0.1).alias("q10"), q(0.99).alias("q99"))


@area.add(f"""{fx.with_('bars_1h')}, {AR1}, g AS (SELECT *, last_value(CASE WHEN (idx - {W}) % 5 = 0 THEN phi END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts) AS held FROM c) SELECT symbol, ts, round(held, 4) AS phi FROM g""")
def recalib_hold(spark, sf_dir):
    """A calibration held for five bars."""
    rows = indexed(spark, sf_dir).select("symbol", "ts", "idx", ro.ar1(close(), W)["phi"].alias("phi"))
    return rows.select("symbol", "ts", "idx", r(ro.held(F.col("phi"), F.col("idx"), W, 5), 4).alias("phi")).where(F.col("idx") >= W).drop("idx")


@area.add(f"""{fx.with_('bars_1h')}, {SERIES}, d AS (SELECT *, coalesce(close - x, 0) AS d FROM s), l AS (SELECT *, list(d) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS ds FROM d),
 m AS (SELECT symbol, ts, list_transform(ds, lambda v: v - list_avg(ds)) AS c, list_stddev_pop(ds) AS sd FROM l WHERE idx >= 20), y AS (SELECT symbol, ts, sd, list_transform(range(1, 21), lambda i: list_sum(c[1:i])) AS y FROM m)
 SELECT symbol, ts, round(ln((list_max(y) - list_min(y)) / sd) / ln(20), 5) AS hurst FROM y""")
def hurst(spark, sf_dir):
    """Rescaled range of twenty differences."""
    return indexed(spark, sf_dir).select("symbol", "ts", r(ro.hurst(close(), 20), 5).alias("hurst")).where("hurst is not null")


@area.add(f"""{fx.with_('bars_1h')}, v AS (SELECT symbol, ts, (high - low) / close AS v FROM bars_1h WHERE close > 0 AND high > low), q AS (SELECT symbol, quantile_cont(v, 0.33) AS a, quantile_cont(v, 0.67) AS b FROM v GROUP BY symbol),
 s AS (SELECT v.*, CAST(v >= a AS INTEGER) + CAST(v >= b AS INTEGER) AS state FROM v JOIN q USING (symbol)), n AS (SELECT *, lead(state) OVER (PARTITION BY symbol ORDER BY ts) AS next FROM s)
 SELECT symbol, state, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, CAST(sum(CASE WHEN next = 0 THEN 1 ELSE 0 END) AS BIGINT) AS to_0, CAST(sum(CASE WHEN next = 1 THEN 1 ELSE 0 END) AS BIGINT) AS to_1, CAST(sum(CASE WHEN next = 2 THEN 1 ELSE 0 END) AS BIGINT) AS to_2 FROM n GROUP BY 1, 2""")
def hmm_calibrate(spark, sf_dir):
    """Volatility buckets, their emissions and transition counts."""
    v = hourly(spark, sf_dir).where("close > 0 and high > low").select("symbol", "ts", ((F.col("high") - F.col("low")) / close()).alias("v"))
    q = v.groupBy("symbol").agg(F.percentile("v", F.lit(0.33)).alias("a"), F.percentile("v", F.lit(0.67)).alias("b"))
    s = v.join(q, "symbol").withColumn("state", (F.col("v") >= F.col("a")).cast("int") + (F.col("v") >= F.col("b")).cast("int"))
    s = s.withColumn("next", F.lead("state").over(ro.order()))
    to = lambda k: F.sum((F.coalesce("next", F.lit(-1)) == k).cast("long")).alias(f"to_{k}")
    return rounded(s.groupBy("symbol", "state").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), to(0), to(1), to(2)))


QUERIES, ORACLES = area.queries, area.oracles
