"""Parameter grids. cfg_id is the order of emission, which breaks ties."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

from pyspark.sql import DataFrame, SparkSession

from ..operators.kernels import Config

#: Bars that calibrate the volatility regimes.
HMM_BARS = 2000
#: Fixed values of the grids: calibration windows, band widths, (q, noise) pairs, time-outs as shares of the window, channels.
NOISE = ((1.0, 1.0), (2.0, 0.5), (1.0, 0.5), (2.0, 1.0))
DENSE = (40, 60, 80, 120, 160, 200, 240, 320)
SPECS = {
    "ou": {"window": (40, 80, 120, 200), "k": (1.8, 2.2), "noise": NOISE, "share": (1.0, None)},
    "ou_full": {"window": DENSE, "k": (1.8, 2.2), "noise": NOISE, "share": (1.0, 1.5, None)},
    "fixed": {"window": DENSE, "k": (1.8, 2.2), "noise": NOISE, "share": (1.0, 1.5, None)},
    "fixed_trend": {"window": DENSE, "k": (1.8, 2.2), "noise": NOISE, "share": (1.0, 1.5, None), "trend": (False, True)},
    "cir": {"window": (40, 60, 80, 120, 160, 200), "k": (1.8, 2.2), "noise": NOISE[:3], "share": (1.0, 1.5, None)},
    "garch": {"window": (60, 120), "k": (1.8, 2.2), "share": (1.0, None), "recalibrate": (20,)},
    "var": {"entry_pct": (95.0, 97.0, 98.0, 99.0), "stop_pct": (99.0, 99.5), "window": (60,), "share": (1.0,), "recalibrate": (20,)},
    "jump": {"window": (40, 60, 80, 120), "k": (1.8, 2.2), "jump_z": (3.0, 3.5, 4.0), "share": (1.0, None)},
    "trend": {"channel": ((20, 10), (40, 20), (55, 20), (80, 40), (120, 40)), "ema_n": (None, 100, 200), "atr_stop": (None, 2.5)},
    "long_only": {"window": (40, 60, 80, 120, 160, 240), "noise": NOISE, "share": (1.0, 1.5, None), "k": (2.0, 2.8), "trend": (False, True), "z_stop": (3.5,), "side": ("long_only",)},
}
FIELDS = ("window", "recalibrate", "k", "q", "noise", "tau", "z_stop", "half_lives", "spread", "trend", "side", "entry_pct", "stop_pct", "jump_z", "entry_n", "exit_n", "ema_n", "atr_stop")


def points(spec: dict[str, tuple]) -> Iterator[dict]:
    """The points of a spec, its last dimension fastest."""
    for values in product(*spec.values()):
        yield dict(zip(spec, values, strict=True))


def configs(name: str, cost: float | None, hmm_bars: int | None = HMM_BARS, **changes: tuple) -> list[Config]:
    """A named grid; `changes` replace dimensions (fixtures need narrower bands and shorter windows)."""
    out = []
    for p in points(SPECS[name] | changes):
        if name == "trend":
            entry, exit_ = p.pop("channel")
            out.append(Config(entry_n=entry, exit_n=exit_, **p))
            continue
        if name == "var" and p["stop_pct"] <= p["entry_pct"]:
            continue
        q, noise = p.pop("noise", (1.0, 1.0))
        share = p.pop("share")
        p.setdefault("recalibrate", 5)
        if name != "var":
            p.setdefault("z_stop", p["k"] + 1.0)
        out.append(Config(q=q, noise=noise, tau=None if share is None else p["window"] * share, half_lives=2.0, spread=cost, hmm_bars=hmm_bars, **p))
    return out


def frame(spark: SparkSession, name: str, cost: float) -> DataFrame:
    """A grid as rows, cfg_id first."""
    rows = [(i, *(float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in (getattr(c, f) for f in FIELDS))) for i, c in enumerate(configs(name, cost))]
    kinds = {"trend": "boolean", "side": "string"}
    return spark.createDataFrame(rows, "cfg_id int, " + ", ".join(f"`{f}` {kinds.get(f, 'double')}" for f in FIELDS))
