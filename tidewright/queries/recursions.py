"""Ordered recursions and strategies; the SQL walks each series with a recursive table."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import tables
from ..operators import recursive as rec
from ..operators import scans, strategies
from ..operators import trades as tr
from ..operators.kernels import Config
from ..sources import fixtures as fx
from .common import Area, r, rounded
from .rolling import AR1, W

area = Area()
HOUR = 3600
NUMBERED = "n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc, lag(high) OVER (PARTITION BY symbol ORDER BY ts) AS ph, lag(low) OVER (PARTITION BY symbol ORDER BY ts) AS pl FROM bars_1h)"


def hourly(spark, sf_dir):
    return fx.bars(spark, sf_dir)


@area.add(f"""{fx.with_('bars_1h', recursive=True)}, {NUMBERED}, y AS (SELECT symbol, ts, i, close AS y FROM n WHERE i = 1 UNION ALL SELECT n.symbol, n.ts, n.i, y.y * (1 - 2.0 / 21) + n.close * 2.0 / 21 FROM n JOIN y ON n.symbol = y.symbol AND n.i = y.i + 1)
 SELECT symbol, ts, round(y, 6) AS ema FROM y""")
def ewm_span20(spark, sf_dir):
    """Exponential mean of span 20."""
    return scans.ewm(hourly(spark, sf_dir), {"close": "ema"}, 2 / 21, HOUR).select("symbol", "ts", r("ema").alias("ema"))


@area.add(f"""{fx.with_('bars_1h', recursive=True)}, {NUMBERED}, t AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM n),
 y AS (SELECT symbol, ts, i, tr AS y FROM t WHERE i = 1 UNION ALL SELECT t.symbol, t.ts, t.i, y.y + (t.tr - y.y) / 14 FROM t JOIN y ON t.symbol = y.symbol AND t.i = y.i + 1)
 SELECT symbol, ts, round(CASE WHEN i >= 14 THEN y END, 6) AS atr FROM y""")
def atr14(spark, sf_dir):
    """Average true range."""
    return scans.atr(hourly(spark, sf_dir), HOUR).select("symbol", "ts", r("atr").alias("atr"))


@area.add(f"""{fx.with_('bars_1h', recursive=True)}, {NUMBERED}, t AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS up, CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS down FROM n),
 y AS (SELECT symbol, ts, i, tr AS a, CAST(up AS DOUBLE) AS u, CAST(down AS DOUBLE) AS d FROM t WHERE i = 1 UNION ALL SELECT t.symbol, t.ts, t.i, a + (tr - a) / 14, u + (up - u) / 14, d + (down - d) / 14 FROM t JOIN y ON t.symbol = y.symbol AND t.i = y.i + 1),
 x AS (SELECT symbol, ts, i, 100 * abs(u - d) / (u + d) AS dx FROM y WHERE i >= 14), z AS (SELECT symbol, ts, i, dx AS z FROM x WHERE i = 14 UNION ALL SELECT x.symbol, x.ts, x.i, z + (dx - z) / 14 FROM x JOIN z ON x.symbol = z.symbol AND x.i = z.i + 1)
 SELECT symbol, ts, round(z, 5) AS adx FROM z WHERE i >= 27""")
def adx14(spark, sf_dir):
    """Directional movement."""
    return scans.adx(hourly(spark, sf_dir), HOUR).select("symbol", "ts", r("adx", 5).alias("adx")).where("adx is not null")


HELD = """h AS (SELECT symbol, ts, idx, close, last_value(CASE WHEN (idx - {w}) % 5 = 0 THEN phi END IGNORE NULLS) OVER o AS phi, last_value(CASE WHEN (idx - {w}) % 5 = 0 THEN mu END IGNORE NULLS) OVER o AS mu, last_value(CASE WHEN (idx - {w}) % 5 = 0 THEN {s} END IGNORE NULLS) OVER o AS s FROM {t} WINDOW o AS (PARTITION BY symbol ORDER BY ts))"""
OU = f"""{AR1}, {HELD.format(w=W, s='sigma * sigma', t='c')}, p AS (SELECT *, s * greatest(1 - phi * phi, 1e-6) AS q FROM h),
 k AS (SELECT symbol, ts, idx, s, phi, close, (phi * mu + (1 - phi) * mu) + ((phi * phi * s + q) / (phi * phi * s + q + s)) * (close - (phi * mu + (1 - phi) * mu)) AS x, (1 - (phi * phi * s + q) / (phi * phi * s + q + s)) * (phi * phi * s + q) AS pp FROM p WHERE idx = {W}
  UNION ALL SELECT p.symbol, p.ts, p.idx, p.s, p.phi, p.close, (p.phi * k.x + (1 - p.phi) * mu) + ((p.phi * p.phi * pp + q) / (p.phi * p.phi * pp + q + p.s)) * (p.close - (p.phi * k.x + (1 - p.phi) * mu)), (1 - (p.phi * p.phi * pp + q) / (p.phi * p.phi * pp + q + p.s)) * (p.phi * p.phi * pp + q) FROM p JOIN k ON p.symbol = k.symbol AND p.idx = k.idx + 1)"""


KALMAN_OU_SQL = f"{fx.with_('bars_1h', recursive=True)}, {OU} SELECT symbol, ts, round(x, 4) AS x, round(sqrt(s) / sqrt(greatest(-2 * ln(phi), 1e-12)), 3) AS sigma_stat FROM k"


@area.add(KALMAN_OU_SQL)
def kalman_ou(spark, sf_dir):
    """Filtered mean with constant variance, calibrated every five bars."""
    rows = rec.mean_filter(hourly(spark, sf_dir), "ou", window=W, recalibrate=5)
    return rows.where("x is not null").select("symbol", "ts", r("x", 4).alias("x"), r("sigma_stat", 3).alias("sigma_stat"))


CIR = f"""{AR1}, l AS (SELECT *, list(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {W} PRECEDING AND 1 PRECEDING) AS xs FROM s),
 e AS (SELECT c.*, list_avg(list_transform(range(2, {W + 1}), lambda i: (l.xs[i] - c.phi * l.xs[i - 1] - (1 - c.phi) * c.mu) * (l.xs[i] - c.phi * l.xs[i - 1] - (1 - c.phi) * c.mu) / greatest(l.xs[i - 1], 1e-9))) AS s2 FROM c JOIN l USING (symbol, ts)),
 {HELD.format(w=W, s='s2', t='e')}, k AS (
  SELECT symbol, ts, idx, s, phi, mu + ((phi * phi * s * mu + s * mu * greatest(1 - phi * phi, 1e-6)) / (phi * phi * s * mu + s * mu * greatest(1 - phi * phi, 1e-6) + s * close)) * (close - mu) AS x,
   (1 - (phi * phi * s * mu + s * mu * greatest(1 - phi * phi, 1e-6)) / (phi * phi * s * mu + s * mu * greatest(1 - phi * phi, 1e-6) + s * close)) * (phi * phi * s * mu + s * mu * greatest(1 - phi * phi, 1e-6)) AS pp FROM h WHERE idx = {W}
  UNION ALL SELECT h.symbol, h.ts, h.idx, h.s, h.phi, (h.phi * k.x + (1 - h.phi) * mu) + ((h.phi * h.phi * pp + h.s * k.x * greatest(1 - h.phi * h.phi, 1e-6)) / (h.phi * h.phi * pp + h.s * k.x * greatest(1 - h.phi * h.phi, 1e-6) + h.s * h.close)) * (h.close - (h.phi * k.x + (1 - h.phi) * mu)),
   (1 - (h.phi * h.phi * pp + h.s * k.x * greatest(1 - h.phi * h.phi, 1e-6)) / (h.phi * h.phi * pp + h.s * k.x * greatest(1 - h.phi * h.phi, 1e-6) + h.s * h.close)) * (h.phi * h.phi * pp + h.s * k.x * greatest(1 - h.phi * h.phi, 1e-6)) FROM h JOIN k ON h.symbol = k.symbol AND h.idx = k.idx + 1)"""


@area.add(f"{fx.with_('bars_1h', recursive=True)}, {CIR} SELECT symbol, ts, round(x, 4) AS x, round(sqrt(s * x / greatest(-2 * ln(phi), 1e-12)), 3) AS sigma_stat FROM k")
def kalman_cir(spark, sf_dir):
    """Filtered mean with level-dependent variance."""
    rows = rec.mean_filter(hourly(spark, sf_dir), "cir", window=W, recalibrate=5)
    return rows.where("x is not null").select("symbol", "ts", r("x", 4).alias("x"), r("sigma_stat", 3).alias("sigma_stat"))


#: The residuals' deviation without jumps, for each calibration.
JUMP = f"""{AR1}, l AS (SELECT *, list(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {W} PRECEDING AND 1 PRECEDING) AS xs FROM s),
 e0 AS (SELECT c.*, list_transform(range(2, {W + 1}), lambda i: l.xs[i] - c.phi * l.xs[i - 1] - (1 - c.phi) * c.mu) AS e FROM c JOIN l USING (symbol, ts)),
 e1 AS (SELECT *, list_stddev_pop(e) AS sd FROM e0), e2 AS (SELECT *, list_filter(e, lambda v: abs(v) <= 3.5 * sd) AS kept FROM e1),
 e AS (SELECT *, greatest(CASE WHEN sd <= 0 THEN 1e-6 WHEN len(kept) < 10 THEN sd ELSE list_stddev_pop(kept) END, 1e-8) AS sj FROM e2),
 {HELD.format(w=W, s='sj * sj', t='e')}, p AS (SELECT *, s * greatest(1 - phi * phi, 1e-6) AS q FROM h), {OU[OU.index('k AS (SELECT symbol, ts, idx, s, phi'):]}"""


@area.add(f"{fx.with_('bars_1h', recursive=True)}, {JUMP} SELECT symbol, ts, round(x, 4) AS x, round(sqrt(s) / sqrt(greatest(-2 * ln(phi), 1e-12)), 3) AS sigma_stat FROM k")
def kalman_jump(spark, sf_dir):
    """Filtered mean with jump-filtered variance."""
    rows = rec.mean_filter(hourly(spark, sf_dir), "jump", window=W, recalibrate=5)
    return rows.where("x is not null").select("symbol", "ts", r("x", 4).alias("x"), r("sigma_stat", 3).alias("sigma_stat"))


#: Clustered variance of given parameters: the state is mean, its variance and the residuals' variance v.
OMEGA, ALPHA, BETA = 0.5, 0.1, 0.85
GARCH = f"""{AR1}, {HELD.format(w=W, s='sigma', t='c')},
 k AS (SELECT symbol, ts, idx, phi, mu + g * (close - mu) AS x, (1 - g) * pa AS pp, {OMEGA} + {ALPHA} * (close - mu) * (close - mu) + {BETA} * v AS v
   FROM (SELECT *, pa / (pa + v) AS g FROM (SELECT *, phi * phi * v + v * greatest(1 - phi * phi, 1e-6) AS pa FROM (SELECT *, {OMEGA} / (1 - {ALPHA} - {BETA}) AS v FROM h WHERE idx = {W})))
  UNION ALL SELECT symbol, ts, idx, phi, ahead + g * (close - ahead), (1 - g) * pa, {OMEGA} + {ALPHA} * (close - ahead) * (close - ahead) + {BETA} * v
   FROM (SELECT *, pa / (pa + v) AS g FROM (SELECT h.symbol, h.ts, h.idx, h.phi, h.close, k.v, h.phi * k.x + (1 - h.phi) * h.mu AS ahead, h.phi * h.phi * k.pp + k.v * greatest(1 - h.phi * h.phi, 1e-6) AS pa FROM h JOIN k ON h.symbol = k.symbol AND h.idx = k.idx + 1)))"""


@area.add(f"{fx.with_('bars_1h', recursive=True)}, {GARCH} SELECT symbol, ts, round(x, 4) AS x, round(sqrt(v / greatest(-2 * ln(phi), 1e-12)), 3) AS sigma_stat FROM k")
def garch_filter(spark, sf_dir):
    """Filtered mean with clustered variance of fixed parameters."""
    rows = rec.mean_filter(hourly(spark, sf_dir), "garch", window=W, recalibrate=5, garch=(OMEGA, ALPHA, BETA))
    return rows.where("x is not null").select("symbol", "ts", r("x", 4).alias("x"), r("sigma_stat", 3).alias("sigma_stat"))


@area.add()
def garch_mle(spark, sf_dir):
    """The same with parameters of maximum likelihood."""
    return rounded(rec.mean_filter(hourly(spark, sf_dir), "garch", window=60, recalibrate=60).where("x is not null").select("symbol", "ts", "x", "sigma_stat"))


#: Regimes: thirds of the first HMM bars' volatility (defaults where there are too few), smoothed moves, and the belief carried bar by bar.
HMM = 200
_IN = "exp(-0.5 * pow((v - means[{i}]) / stds[{i}], 2)) / stds[{i}]"


def _ahead(j: int) -> str:
    return " + ".join(f"moves[{i}][{j}] * b{i}" for i in (1, 2, 3))


REGIMES = f"""nb AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx, CASE WHEN close > 0 THEN (high - low) / close END AS v FROM bars_1h),
 cv AS (SELECT * FROM nb WHERE idx < {HMM} AND v > 0), cq AS (SELECT symbol, count(*) AS n, quantile_cont(v, 0.33) AS qa, quantile_cont(v, 0.67) AS qb FROM cv GROUP BY symbol),
 cs AS (SELECT cv.*, CAST(v >= qa AS INTEGER) + CAST(v >= qb AS INTEGER) AS s, n AS total FROM cv JOIN cq USING (symbol)), cm AS (SELECT *, lead(s) OVER (PARTITION BY symbol ORDER BY idx) AS nx FROM cs),
 base AS (SELECT symbol, s, CASE s WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 2.0 END AS m0, CASE s WHEN 0 THEN 0.2 WHEN 1 THEN 0.3 ELSE 0.6 END AS d0 FROM (SELECT DISTINCT symbol FROM nb), range(3) r(s)),
 em AS (SELECT base.symbol, base.s, CASE WHEN max(total) >= 20 AND count(v) >= 3 THEN avg(v) ELSE max(m0) END AS m, CASE WHEN max(total) >= 20 AND count(v) >= 3 THEN greatest(stddev_pop(v), 1e-6) ELSE max(d0) END AS d FROM base LEFT JOIN cm ON base.symbol = cm.symbol AND base.s = cm.s GROUP BY 1, 2),
 mv AS (SELECT a.symbol, a.s AS i, b.s AS j, count(cm.v) AS n FROM base a JOIN base b ON a.symbol = b.symbol LEFT JOIN cm ON cm.symbol = a.symbol AND cm.s = a.s AND cm.nx = b.s GROUP BY 1, 2, 3),
 par AS (SELECT e.symbol, e.means, e.stds, list_transform([0, 1, 2], lambda i: list_transform([0, 1, 2], lambda j: (CAST(w.ns[3 * i + j + 1] AS DOUBLE) + 0.1) / (w.ns[3 * i + 1] + w.ns[3 * i + 2] + w.ns[3 * i + 3] + 0.3))) AS moves
   FROM (SELECT symbol, list(m ORDER BY m, s) AS means, list(d ORDER BY m, s) AS stds FROM em GROUP BY symbol) e JOIN (SELECT symbol, list(n ORDER BY i, j) AS ns FROM mv GROUP BY symbol) w USING (symbol)),
 rg AS (SELECT symbol, CAST(NULL AS TIMESTAMP) AS ts, CAST({HMM - 1} AS BIGINT) AS idx, CAST(1.0 / 3 AS DOUBLE) AS b1, CAST(1.0 / 3 AS DOUBLE) AS b2, CAST(1.0 / 3 AS DOUBLE) AS b3 FROM par
  UNION ALL SELECT symbol, ts, idx, CASE WHEN t > 0 THEN p1 / t ELSE a1 END, CASE WHEN t > 0 THEN p2 / t ELSE a2 END, CASE WHEN t > 0 THEN p3 / t ELSE a3 END
   FROM (SELECT *, p1 + p2 + p3 AS t FROM (SELECT symbol, ts, idx, CASE WHEN v > 0 THEN a1 ELSE b1 END AS a1, CASE WHEN v > 0 THEN a2 ELSE b2 END AS a2, CASE WHEN v > 0 THEN a3 ELSE b3 END AS a3,
     CASE WHEN v > 0 THEN a1 * ({_IN.format(i=1)}) ELSE 0 END AS p1, CASE WHEN v > 0 THEN a2 * ({_IN.format(i=2)}) ELSE 0 END AS p2, CASE WHEN v > 0 THEN a3 * ({_IN.format(i=3)}) ELSE 0 END AS p3
     FROM (SELECT nb.symbol, nb.ts, CAST(nb.idx AS BIGINT) AS idx, nb.v, par.means, par.stds, rg.b1, rg.b2, rg.b3, {_ahead(1)} AS a1, {_ahead(2)} AS a2, {_ahead(3)} AS a3 FROM rg JOIN nb ON nb.symbol = rg.symbol AND nb.idx = rg.idx + 1 JOIN par ON par.symbol = rg.symbol)))),
 states AS (SELECT symbol, ts, idx, CASE WHEN b1 >= b2 AND b1 >= b3 THEN 0 WHEN b2 >= b3 THEN 1 ELSE 2 END AS state FROM rg WHERE ts IS NOT NULL)"""


@area.add(f"{fx.with_('bars_1h', recursive=True)}, {REGIMES} SELECT symbol, ts, CAST(state AS INTEGER) AS state FROM states")
def hmm_filter(spark, sf_dir):
    """Volatility regime of each bar."""
    rows = hourly(spark, sf_dir).withColumn("v", F.when(F.col("close") > 0, (F.col("high") - F.col("low")) / F.col("close")))
    return rec.regimes(rows, "v", HMM).where("state is not null").select("symbol", "ts", F.col("state").cast("int").alias("state"))


RULE = {"window": W, "recalibrate": 5, "k": 1.0}
#: The un-gated rule as a second walk over the bands: position (-1, 0, 1), and the event of the bar.
POSITION = """b AS (SELECT symbol, ts, idx, close, x, x + sd AS upper, x - sd AS lower FROM (SELECT *, sqrt(s) / sqrt(greatest(-2 * ln(phi), 1e-12)) AS sd FROM k)),
 z AS (SELECT symbol, ts, idx, close, CASE WHEN close > upper THEN -1 WHEN close < lower THEN 1 ELSE 0 END AS pos, CASE WHEN close > upper THEN 'short' WHEN close < lower THEN 'long' END AS signal FROM b WHERE idx = {w}
  UNION ALL SELECT b.symbol, b.ts, b.idx, b.close, CASE WHEN z.pos = 1 AND b.close >= x OR z.pos = -1 AND b.close <= x THEN 0 WHEN z.pos <> 0 THEN z.pos WHEN b.close > upper THEN -1 WHEN b.close < lower THEN 1 ELSE 0 END,
   CASE WHEN z.pos = 1 AND b.close >= x THEN 'close_long' WHEN z.pos = -1 AND b.close <= x THEN 'close_short' WHEN z.pos <> 0 THEN NULL WHEN b.close > upper THEN 'short' WHEN b.close < lower THEN 'long' END FROM b JOIN z ON b.symbol = z.symbol AND b.idx = z.idx + 1)""".format(w=W)


STRATEGY_OU_SQL = f"{fx.with_('bars_1h', recursive=True)}, {OU}, {POSITION} SELECT symbol, ts, CAST(idx AS BIGINT) AS idx, signal FROM z WHERE signal IS NOT NULL"


@area.add(STRATEGY_OU_SQL)
def strategy_ou(spark, sf_dir):
    """Signals of mean reversion with constant variance, no gates."""
    rows = strategies.signals(hourly(spark, sf_dir), "ou", Config(**RULE))
    return rows.where("signal is not null").select("symbol", "ts", "idx", "signal")


@area.add(STRATEGY_OU_SQL)
def run_ou_sql(spark, sf_dir):
    """The same as a table function of SQL."""
    tables.register(spark)
    text = "SELECT symbol, ts, idx, signal FROM run_ou(TABLE(SELECT symbol, ts, open, high, low, close, volume FROM {bars}) PARTITION BY (symbol) ORDER BY (ts), {rule}) WHERE signal IS NOT NULL"
    return spark.sql(text, bars=hourly(spark, sf_dir), rule=json.dumps(RULE))


def _walk_sql(model: str, sd: str, jump: str = "false", z_stop: str = "3.0", sv: str = "s") -> str:
    """The rule with its exits and the regime gate, walked over a model's bands: position, entry and bars held are the state."""
    return f"""{fx.with_('bars_1h', recursive=True)}, {model}, {REGIMES},
 b AS (SELECT k.symbol, k.ts, k.idx, close, x, x + sd AS upper, x - sd AS lower, sd > 0 AND abs(close - x) / sd >= {z_stop} AS far, ln(2) / -ln(phi) AS hl, abs(close - x) < 2.5 * {fx.COST} AS near, coalesce(state = 2, false) AS wild, jump
   FROM (SELECT k0.*, {sd} AS sd, {jump} AS jump FROM (SELECT k.symbol, k.ts, k.idx, k.x, k.{sv} AS s, k.phi, h.close FROM k JOIN h ON k.symbol = h.symbol AND k.idx = h.idx) k0) k LEFT JOIN states ON states.symbol = k.symbol AND states.idx = k.idx),
 z AS (SELECT symbol, CAST({W - 1} AS BIGINT) AS idx, CAST(NULL AS TIMESTAMP) AS ts, 0 AS pos, 0 AS held, CAST(NULL AS VARCHAR) AS signal FROM b GROUP BY symbol
  UNION ALL SELECT symbol, idx, ts, CASE WHEN ev IS NULL THEN pos WHEN pos <> 0 THEN 0 WHEN ev = 'long' THEN 1 ELSE -1 END, CASE WHEN pos <> 0 THEN held + 1 ELSE 0 END, ev
   FROM (SELECT symbol, idx, ts, pos, held, CASE
     WHEN pos <> 0 AND jump THEN 'jump_stop_' || side WHEN pos <> 0 AND far THEN 'z_stop_' || side WHEN pos <> 0 AND held + 1 > 2.0 * hl THEN 'time_stop_' || side
     WHEN pos = 1 AND close >= x OR pos = -1 AND close <= x THEN 'close_' || side WHEN pos <> 0 OR jump OR wild OR near THEN NULL WHEN close > upper THEN 'short' WHEN close < lower THEN 'long' END AS ev
     FROM (SELECT b.*, z.pos, z.held, CASE WHEN z.pos = 1 THEN 'long' ELSE 'short' END AS side FROM b JOIN z ON b.symbol = z.symbol AND b.idx = z.idx + 1)))
 SELECT symbol, ts, idx, signal FROM z WHERE signal IS NOT NULL"""


OU_SD = "sqrt(k0.s) / sqrt(greatest(-2 * ln(k0.phi), 1e-12))"


def _strategy(name: str, model: str, config: Config, doc: str, sql: str | None = None) -> None:
    def query(spark, sf_dir):
        rows = strategies.signals(hourly(spark, sf_dir), model, config).where("signal is not null")
        return rows.select("symbol", "ts", "idx", "signal") if sql else rounded(rows)

    query.__name__, query.__doc__ = name, doc
    area.add(sql)(query)


EXITS = {"z_stop": 3.0, "half_lives": 2.0, "spread": fx.COST, "hmm_bars": HMM}
_strategy("strategy_ou_exits", "ou", Config(**RULE, **EXITS), "Mean reversion with constant variance, its exits and the regime gate.", _walk_sql(OU, OU_SD))
_strategy("strategy_ou_gated", "ou", Config(**RULE, **EXITS, adx_max=40, hurst_n=20, atr_stop=3.0, tau=80, trend=True), "Mean reversion with all exits and gates.")
_strategy("strategy_ou_long_only", "ou", Config(**RULE, side="long_only", wick_min=0.2, volume_mult=0.8), "Longs alone, confirmed by wick and volume.")
_strategy("strategy_cir", "cir", Config(**RULE, **EXITS), "Mean reversion with level-dependent variance.", _walk_sql(CIR, "sqrt(k0.s * k0.x / greatest(-2 * ln(k0.phi), 1e-12))"))
_strategy("strategy_jump", "jump", Config(**RULE, **EXITS, jump_z=3.5), "Mean reversion that stops at jumps.", _walk_sql(JUMP, OU_SD, "abs(k0.close - k0.x) > 3.5 * sqrt(k0.s)"))
_strategy("strategy_garch_fixed", "garch", Config(**RULE, **EXITS, garch=(OMEGA, ALPHA, BETA)), "Mean reversion with clustered variance of given parameters.", _walk_sql(GARCH, "sqrt(k0.s / greatest(-2 * ln(k0.phi), 1e-12))", sv="v"))
_strategy("strategy_garch", "garch", Config(window=W, recalibrate=60, k=1.0, **EXITS), "Mean reversion with clustered variance.")
_strategy("strategy_garch_var", "var", Config(window=W, recalibrate=60, half_lives=2.0, spread=fx.COST, hmm_bars=HMM), "Mean reversion between empirical quantiles.")

TREND = f"""{fx.with_('bars_1h')}, d AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx, CASE WHEN count(*) OVER p = 20 THEN max(close) OVER p END AS hi, CASE WHEN count(*) OVER p = 20 THEN min(close) OVER p END AS lo FROM bars_1h WINDOW p AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
 s AS (SELECT *, coalesce(last_value(CASE WHEN close > hi THEN 1 WHEN close < lo THEN 0 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts), 0) AS state FROM d), b AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY symbol ORDER BY ts), 0) AS before FROM s),
 ev AS (SELECT symbol, ts, idx, close, CASE WHEN state = 1 THEN 'long' ELSE 'close_long' END AS signal FROM b WHERE state <> before)"""
TRADES = f"""{TREND}, l AS (SELECT *, lead(idx) OVER w AS exit_idx, lead(ts) OVER w AS exit_ts, lead(close) OVER w AS exit_close FROM ev WINDOW w AS (PARTITION BY symbol ORDER BY idx)),
 t AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY idx) - 1 AS trade_no, idx AS entry_idx, exit_idx, ts AS entry_ts, exit_ts, close AS entry_close, exit_close, exit_close - close - {fx.COST} AS net_pnl FROM l WHERE signal = 'long' AND exit_idx IS NOT NULL)"""


@area.add(f"{TREND} SELECT symbol, ts, CAST(idx AS BIGINT) AS idx, round(close, 6) AS close, signal FROM ev")
def strategy_trend(spark, sf_dir):
    """Channel breakout, long alone, by the kernel."""
    rows = strategies.signals(hourly(spark, sf_dir), "trend", Config(entry_n=20, exit_n=20, side="long_only"))
    return rows.where("signal is not null").select("symbol", "ts", "idx", r("close").alias("close"), "signal")


@area.add(f"{TREND} SELECT symbol, ts, CAST(idx AS BIGINT) AS idx, round(close, 6) AS close, signal FROM ev")
def channel_signals(spark, sf_dir):
    """The same by window functions alone."""
    return rounded(tr.channel_events(hourly(spark, sf_dir), 20).where("signal is not null"))


def channel_trades(spark, sf_dir):
    return tr.trades(tr.channel_events(hourly(spark, sf_dir), 20), cost=fx.COST)


@area.add(f"{TRADES} SELECT symbol, CAST(trade_no AS BIGINT) AS trade_no, CAST(entry_idx AS BIGINT) AS entry_idx, CAST(exit_idx AS BIGINT) AS exit_idx, entry_ts, exit_ts, round(entry_close, 6) AS entry_close, round(exit_close, 6) AS exit_close, round(net_pnl, 6) AS net_pnl FROM t")
def trades_from_signals(spark, sf_dir):
    """Round trips of the channel breakout."""
    return rounded(channel_trades(spark, sf_dir).drop("side", "pnl"))


QUERIES, ORACLES = area.queries, area.oracles
