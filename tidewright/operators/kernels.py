"""Recursions and position rules over a series that comes in blocks, for batch and stream alike.

What a series carries from block to block is bounded by its configurations
(a tail of as many rows as the longest window, and a few numbers), so a series
may be of any length. A row's calibration sees only rows before it; the filter
then takes the row's own close. NaN stands for what is not known yet.

A filter depends on window, calibration, noise and drift, and not on bands,
stops and gates: configurations that agree in the former share one filter, and
each finds its entries and exits in the filter's arrays.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

NAN = float("nan")


@dataclass(frozen=True)
class Config:
    """Parameters of a strategy; None (and 0, but for tau and spread) turns an exit or gate off."""

    window: int = 60
    recalibrate: int = 1
    noise: float = 1.0
    q: float = 1.0
    k: float = 1.0
    side: str = "both"
    trend: bool = False
    z_stop: float | None = None
    half_lives: float | None = None
    atr_stop: float | None = None
    atr_n: int = 14
    adx_max: float | None = None
    adx_n: int = 14
    hurst_n: int | None = None
    hmm_bars: int | None = None
    hmm_block: tuple[int, ...] = (2,)
    tau: float | None = None
    spread: float | None = None
    hurdle: float = 2.5
    wick_min: float | None = None
    volume_mult: float | None = None
    jump_z: float = 3.5
    entry_pct: float = 90.0
    stop_pct: float | None = 99.0
    entry_n: int = 55
    exit_n: int = 20
    ema_n: int | None = None
    garch: tuple[float, float, float] | None = None


class Ewm:
    """y = (1 - alpha) y + alpha x from the first number on; a gap repeats y and lets its weight decay."""

    def __init__(self, alpha: float, warmup: int = 0):
        self.alpha, self.warmup, self.y, self.weight, self.seen = alpha, warmup, NAN, 1.0, 0

    def block(self, x: np.ndarray) -> np.ndarray:
        out, alpha, warmup, y, weight, seen = [], self.alpha, self.warmup, self.y, self.weight, self.seen
        for v in x.tolist():
            if v == v:
                seen += 1
                if seen == 1:
                    y = v
                else:
                    weight *= 1 - alpha
                    y = (weight * y + alpha * v) / (weight + alpha)
                weight = 1.0
            elif seen:
                weight *= 1 - alpha
            out.append(y if seen and seen >= warmup else NAN)
        self.y, self.weight, self.seen = y, weight, seen
        return np.array(out)


def ewm(x: np.ndarray, alpha: float, warmup: int = 0) -> np.ndarray:
    return Ewm(alpha, warmup).block(x)


class Atr:
    """Average true range."""

    def __init__(self, n: int):
        self.before, self.mean = NAN, Ewm(1 / n, n)

    def block(self, x: dict[str, np.ndarray]) -> np.ndarray:
        high, low, close = x["high"], x["low"], x["close"]
        before = np.concatenate(([self.before], close[:-1]))
        if len(close):
            self.before = close[-1]
        return self.mean.block(np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before))))


class Adx:
    """Directional movement."""

    def __init__(self, n: int):
        self.high = self.low = NAN
        self.range, self.up, self.down, self.mean = Atr(n), Ewm(1 / n, n), Ewm(1 / n, n), Ewm(1 / n, n)

    def block(self, x: dict[str, np.ndarray]) -> np.ndarray:
        high, low = x["high"], x["low"]
        up, down = np.diff(high, prepend=self.high), -np.diff(low, prepend=self.low)
        if len(high):
            self.high, self.low = high[-1], low[-1]
        with np.errstate(invalid="ignore", divide="ignore"):
            plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
            range_ = self.range.block(x)
            a, b = 100 * self.up.block(plus) / range_, 100 * self.down.block(minus) / range_
            return self.mean.block(np.where(a + b > 0, 100 * np.abs(a - b) / (a + b), NAN))


class Tail:
    """The last n values of a series, set before each block."""

    def __init__(self, n: int):
        self.n, self.x = n, np.zeros(0)

    def block(self, x: np.ndarray) -> tuple[np.ndarray, int]:
        """Tail and block in one, and where the block begins."""
        out, at = np.concatenate((self.x, x)), len(self.x)
        self.x = out[max(len(out) - self.n, 0) :]
        return out, at


def relative_range(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    """(high - low) / close, the volatility that regimes are told by."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(close > 0, (high - low) / close, NAN)


class Hurst:
    """log(range / deviation) / log(n) of the last n differences; the first row's difference is 0."""

    def __init__(self, n: int):
        self.n, self.tail, self.before = n, Tail(n - 1), NAN

    def block(self, close: np.ndarray) -> np.ndarray:
        d = np.diff(close, prepend=self.before if self.before == self.before else close[:1])
        if len(close):
            self.before = close[-1]
        d, at = self.tail.block(d)
        out = np.full(len(d), NAN)
        # A row has n differences besides the first row's own.
        if len(d) >= self.n:
            r = np.lib.stride_tricks.sliding_window_view(d, self.n)
            y, s = np.cumsum(r - r.mean(1, keepdims=True), axis=1), r.std(1)
            with np.errstate(invalid="ignore", divide="ignore"):
                out[self.n - 1 :] = np.where((s > 0) & (np.ptp(y, axis=1) > 0), np.log(np.ptp(y, axis=1) / s) / math.log(self.n), NAN)
        return out[at:]


class Extremes:
    """Greatest and least of the n values before each row."""

    def __init__(self, n: int):
        self.n, self.tail = n, Tail(n)

    def block(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = len(x)
        x, at = self.tail.block(x)
        high, low = np.full(len(x), NAN), np.full(len(x), NAN)
        if len(x) > self.n:
            frames = np.lib.stride_tricks.sliding_window_view(x, self.n)[: len(x) - self.n]
            high[self.n :], low[self.n :] = frames.max(1), frames.min(1)
        return high[at : at + rows], low[at : at + rows]


def finite(x: np.ndarray) -> np.ndarray:
    return x[np.isfinite(x)]


def fit_ar1(x: np.ndarray) -> tuple[float, float, float] | None:
    """mu, phi (held to 0.01..0.99) and the deviation around the fitted line, of the finite numbers; None for fewer than five."""
    x = finite(x)
    if len(x) < 5:
        return None
    a, b = x[:-1], x[1:]
    va = np.var(a)
    if va > 0:
        slope = np.mean((a - a.mean()) * (b - b.mean())) / va
        start = b.mean() - slope * a.mean()
    else:  # a flat window: of all lines through it the one with the least coefficients
        start = b.mean() / (1 + a[0] * a[0])
        slope = start * a[0]
    phi = min(max(slope, 0.01), 0.99)
    sigma = math.sqrt(np.mean((b - start - phi * a) ** 2))
    return float(x.mean()), phi, sigma if sigma > 0 else max(float(x.std()) * 0.01, 1e-9)


def slope(x: np.ndarray) -> float:
    """Least-squares slope against the place; 0 for fewer than five numbers."""
    if len(x) < 5:
        return 0.0
    i = np.arange(len(x)) - (len(x) - 1) / 2
    return float((i * (x - x.mean())).sum() / (i * i).sum())


def residuals(x: np.ndarray, phi: float, mu: float) -> np.ndarray:
    return x[1:] - phi * x[:-1] - (1 - phi) * mu


def cir_sigma2(x: np.ndarray, phi: float, mu: float) -> float:
    out = float(np.mean(residuals(x, phi, mu) ** 2 / np.maximum(x[:-1], 1e-9)))
    return out if out > 0 else max(float(x.var()) * 1e-4, 1e-9)


def jump_split(e: np.ndarray, z: float) -> tuple[float, float]:
    """Deviation of the residuals within z deviations, and the share beyond; of all, and 0, where either would leave too few; 1e-6 for flat ones."""
    s = float(e.std()) if len(e) > 1 else 0.0
    if len(e) < 20:
        return (s if len(e) > 1 else 1e-6), 0.0
    if s <= 0:
        return 1e-6, 0.0
    beyond = np.abs(e) > z * s
    kept = e[~beyond]
    return (s, 0.0) if len(kept) < 10 else (float(kept.std()), float(beyond.mean()))


def garch_nll(e: np.ndarray, omega: float, alpha: float, beta: float) -> float:
    """Negative log likelihood of a GARCH(1,1) path that starts at the residuals' variance; huge outside the bounds."""
    if omega <= 0 or alpha < 0 or beta < 0 or alpha + beta >= 0.999:
        return 1e10
    v, total = max(float(e.var()), 1e-12), 0.0
    for r in e.tolist():
        total += math.log(v) + r * r / v
        v = max(omega + alpha * r * r + beta * v, 1e-12)
    return 0.5 * total


def nelder_mead(f, start: np.ndarray, steps: tuple[float, ...]) -> tuple[np.ndarray, float]:
    """The lowest point of a simplex begun at start, and its value, when the simplex's values agree within 1e-8.

    A step lowers a value or halves the simplex, so it ends; a value that is no number ends it too.
    """
    simplex = [start, *(start + d for d in np.diag(steps))]
    value = [f(p) for p in simplex]
    while True:
        order = np.argsort(value)
        simplex, value = [simplex[i] for i in order], [value[i] for i in order]
        if not value[-1] - value[0] >= 1e-8:
            return simplex[0], value[0]
        centre = np.mean(simplex[:-1], axis=0)
        tried = {c: centre + c * (simplex[-1] - centre) for c in (-1.0, -2.0, 0.5)}
        r = f(tried[-1.0])
        if r < value[0]:
            x = f(tried[-2.0])
            simplex[-1], value[-1] = (tried[-2.0], x) if x < r else (tried[-1.0], r)
        elif r < value[-2]:
            simplex[-1], value[-1] = tried[-1.0], r
        else:
            x = f(tried[0.5])
            if x < value[-1]:
                simplex[-1], value[-1] = tried[0.5], x
            else:
                simplex = [simplex[0], *((p + simplex[0]) / 2 for p in simplex[1:])]
                value = [value[0], *(f(p) for p in simplex[1:])]


def fit_garch(e: np.ndarray) -> tuple[float, float, float]:
    """omega, alpha, beta by Nelder-Mead over (log omega / v, alpha, beta) from (0.05 v, 0.10, 0.85); (v, 0, 0) for fewer than 30 residuals or where no likelihood is finite.

    Points are held to the bounds, so that the simplex moves along them, and
    the search begins anew at its best point until that gains nothing.
    """
    v = max(float(e.var()), 1e-12)
    if len(e) < 30 or not math.isfinite(v):
        return v, 0.0, 0.0
    low = math.log(1e-12 / v)

    def held(p: np.ndarray) -> tuple[float, float, float]:
        w, alpha, beta = min(max(float(p[0]), low), 50.0), max(float(p[1]), 0.0), max(float(p[2]), 0.0)
        share = min(1.0, 0.998999999 / max(alpha + beta, 1e-12))
        return w, alpha * share, beta * share

    def at(p: tuple[float, float, float]) -> tuple[float, float, float]:
        return v * math.exp(p[0]), p[1], p[2]

    best, least, gain = held((math.log(0.05), 0.10, 0.85)), math.inf, math.inf
    while gain > 1e-6:
        p, value = nelder_mead(lambda p: garch_nll(e, *at(held(p))), np.array(best), (0.5, 0.05, -0.1))
        best, gain, least = held(p), least - value, value
    return at(best) if least < 1e10 else (v, 0.0, 0.0)


class Filter:
    """The mean x with variance P of one model; parameters may change under it."""

    def __init__(self, model: str, c: Config):
        self.model, self.c, self.x, self.p, self.v = model, c, None, 0.0, None
        self.mu = self.phi = self.s = 0.0

    def calibrate(self, window: np.ndarray) -> bool:
        window = finite(window)
        fit = fit_ar1(window)
        if fit is None:
            return False
        self.mu, self.phi, self.s = fit
        c = self.c
        self.drift = slope(window) if c.trend else 0.0
        if self.model == "cir":
            self.s = cir_sigma2(window, self.phi, self.mu)
        elif self.model == "jump":
            self.s, self.share = jump_split(residuals(window, self.phi, self.mu), c.jump_z)
            self.s = max(self.s, 1e-8)
        elif self.model in ("garch", "var"):
            e = residuals(window, self.phi, self.mu)
            self.omega, self.alpha, self.beta = c.garch or fit_garch(e)
            if self.v is None:
                total = self.alpha + self.beta
                self.v = max(self.omega / max(1 - total, 1e-6) if total < 1 else float(e.var()), 1e-12)
            if self.model == "var":  # the bands' distances, once for each calibration
                stop = c.stop_pct or 50.0
                self.low, self.high, self.stop_low, self.stop_high = np.percentile(e, (100 - c.entry_pct, c.entry_pct, 100 - stop, stop))
        return True

    def update(self, z: float) -> None:
        c, phi = self.c, self.phi
        room = max(1 - phi * phi, 1e-6)
        if self.model == "cir":
            base = self.s * max(self.mu, 1e-9) if self.x is None else 0.0
            q = lambda: self.s * max(self.x, 1e-9) * room * c.q
            r, first = self.s * max(z, 1e-9) * c.noise, base * c.noise
        elif self.model in ("garch", "var"):
            q, r = (lambda: self.v * room * max(c.q, 1e-6)), self.v * max(c.noise, 0.01)
            first = r
        else:
            var = self.s * self.s
            q, r = (lambda: var * room * max(c.q, 1e-6)), var * max(c.noise, 0.01)
            first = var * c.noise if self.model == "jump" else r
        if self.x is None:
            self.x, self.p = self.mu, first
        mu = self.mu + self.drift
        self.mu = mu
        noise = q()
        ahead = phi * self.x + (1 - phi) * mu
        p = phi * phi * self.p + noise
        gain = p / (p + r) if p + r > 0 else 0.0
        self.x, self.p = ahead + gain * (z - ahead), (1 - gain) * p
        if self.model in ("garch", "var"):
            self.v = max(self.omega + self.alpha * (z - ahead) ** 2 + self.beta * self.v, 1e-12)

    @property
    def theta(self) -> float:
        return -math.log(self.phi)

    @property
    def sigma_stat(self) -> float:
        two = max(2 * self.theta, 1e-12)
        if self.model == "cir":
            return math.sqrt(self.s * max(self.x, 1e-9) / two)
        return math.sqrt(self.v / two) if self.model in ("garch", "var") else self.s / math.sqrt(two)

    @property
    def half_life(self) -> float:
        return math.log(2) / self.theta


class Series:
    """One filter over a series: mean x, sigma_stat, half_life, deviation s and, for percentile bands, the bands' distances; NaN where a row has no calibration."""

    NAMES = ("x", "sigma_stat", "half_life", "s", "low", "high", "stop_low", "stop_high")

    def __init__(self, model: str, c: Config):
        self.model, self.c, self.filter, self.tail, self.seen = model, c, Filter(model, c), Tail(c.window), 0

    def block(self, close: np.ndarray) -> dict[str, np.ndarray]:
        f, c, var = self.filter, self.c, self.model == "var"
        whole, at = self.tail.block(close)
        out = np.full((len(close), len(self.NAMES)), NAN)
        for t, z in enumerate(close.tolist()):
            g = self.seen + t
            if g < c.window or (f.x is None or (g - c.window) % c.recalibrate == 0) and not f.calibrate(whole[at + t - c.window : at + t]):
                continue
            f.update(z)
            out[t, :4] = f.x, f.sigma_stat, f.half_life, f.s
            if var:
                out[t, 4:] = f.low, f.high, f.stop_low, f.stop_high
        self.seen += len(close)
        return dict(zip(self.NAMES, out.T, strict=True))


def filtered(model: str, close: np.ndarray, c: Config) -> dict[str, np.ndarray]:
    return Series(model, c).block(close)


class Regimes:
    """Three volatility states: normal emissions, a transition matrix and a belief."""

    def __init__(self, means: np.ndarray, stds: np.ndarray, moves: np.ndarray):
        self.means, self.stds, self.moves, self.belief = means, stds, moves, np.full(3, 1 / 3)

    @classmethod
    def calibrated(cls, vols: np.ndarray) -> Regimes:
        v = vols[np.isfinite(vols) & (vols > 0)]
        means, stds = np.array([0.5, 1.0, 2.0]), np.array([0.2, 0.3, 0.6])
        moves = np.array([[0.9, 0.08, 0.02], [0.05, 0.9, 0.05], [0.02, 0.08, 0.9]])
        if len(v) < 20:
            return cls(means, stds, moves)
        a, b = np.percentile(v, (33, 67))
        state = (v >= a).astype(int) + (v >= b)
        for s in range(3):
            own = v[state == s]
            if len(own) >= 3:
                means[s], stds[s] = own.mean(), max(own.std(), 1e-6)
        order = np.argsort(means, kind="stable")
        counts = np.zeros((3, 3))
        np.add.at(counts, (state[:-1], state[1:]), 1)
        return cls(means[order], stds[order], (counts + 0.1) / (counts.sum(1, keepdims=True) + 0.3))

    def step(self, v: float) -> int:
        if v == v and v > 0:
            ahead = self.moves.T @ self.belief
            post = ahead * np.exp(-0.5 * ((v - self.means) / self.stds) ** 2) / self.stds / math.sqrt(2 * math.pi)
            self.belief = post / post.sum() if post.sum() > 0 else ahead
        return int(self.belief.argmax())


class Regime:
    """The regime of each row from the calibration rows on; NaN before."""

    def __init__(self, bars: int):
        self.bars, self.vols, self.hmm, self.seen = bars, [], None, 0

    def block(self, vols: np.ndarray, counted: np.ndarray | None = None) -> np.ndarray:
        """counted: the rows that move the belief; all, if not given."""
        out = np.full(len(vols), NAN)
        for t, v in enumerate(vols.tolist()):
            if self.seen + t < self.bars:
                self.vols.append(v)
                continue
            if self.hmm is None:
                self.hmm, self.vols = Regimes.calibrated(np.array(self.vols)), []
            if counted is None or counted[t]:
                out[t] = self.hmm.step(v)
        self.seen += len(vols)
        return out


@dataclass
class Position:
    """-1, 0 or 1, the close of entry and the rows held since."""

    way: int = 0
    entry: float = NAN
    held: int = 0


#: Rows that the search for an exit looks at first; each further look takes twice as many.
LOOK = 32


def events(p: Position, close: np.ndarray, ready: np.ndarray, long_in: np.ndarray, short_in: np.ndarray, exits: list[tuple[str, str, object]]) -> tuple[list[int], list[str]]:
    """Places and names of a block's entries and exits, from one position to the next; p moves on.

    exits in order of precedence: (name, kind, data). kind "row": a mask for
    longs and one for shorts; "held": rows to be held at most; "loss": how far
    the close may go against the entry. Rows that are not ready do not count.
    """
    at, names, n = [], [], len(close)
    entries = np.flatnonzero((long_in | short_in) & ready)
    count = np.cumsum(ready)
    place, since = 0, -p.held  # rows counted up to the entry
    while place < n:
        if not p.way:
            k = int(np.searchsorted(entries, place))
            if k == len(entries):
                break
            place = int(entries[k])
            p.way, p.entry = (-1 if short_in[place] else 1), float(close[place])
            since = int(count[place])
            at.append(place)
            names.append("long" if p.way > 0 else "short")
            place += 1
            continue
        size, found = LOOK, -1
        while place < n and found < 0:
            rows = slice(place, min(place + size, n))
            masks = []
            for _, kind, data in exits:
                if kind == "row":
                    masks.append(data[0 if p.way > 0 else 1][rows])
                elif kind == "held":
                    masks.append(count[rows] - since > data[rows])
                else:
                    masks.append(p.way * (p.entry - close[rows]) >= data[rows])
            hit = np.logical_or.reduce(masks) & ready[rows]
            if hit.any():
                i = int(hit.argmax())
                found = place + i
                at.append(found)
                names.append(next(name for (name, _, _), m in zip(exits, masks, strict=True) if m[i]) + ("long" if p.way > 0 else "short"))
                p.way = 0
            place, size = (found + 1 if found >= 0 else rows.stop), 2 * size
    p.held = int(count[-1]) - since if n and p.way else 0
    return at, names


class Walk:
    """The configurations of one model over one series that comes in blocks.

    block(x: open, high, low, close, volume) gives the first configuration's
    bands and, for each configuration, places (in the block) and names of its
    events.
    """

    def __init__(self, model: str, configs: list[Config]):
        if bad := {c.side for c in configs} - {"both", "long_only", "short_only"}:
            raise ValueError(f"no such side: {bad.pop()}")
        self.model, self.configs, self.seen = model, configs, 0
        self.positions = [Position() for _ in configs]
        self.parts: dict[tuple, object] = {}

    def part(self, kind: type, *key) -> object:
        """The one that configurations share."""
        if (kind, *key) not in self.parts:
            self.parts[kind, *key] = kind(*key)
        return self.parts[kind, *key]

    def filter_of(self, c: Config) -> Config:
        """c with only what its filter depends on."""
        kept = {"window": c.window, "recalibrate": c.recalibrate, "noise": c.noise, "q": c.q, "trend": c.trend, "garch": c.garch}
        if self.model == "jump":
            kept["jump_z"] = c.jump_z
        if self.model == "var":
            kept |= {"entry_pct": c.entry_pct, "stop_pct": c.stop_pct}
        return Config(**kept)

    def block(self, x: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], list[tuple[list[int], list[str]]]]:
        self.now: dict[tuple, object] = {}  # what configurations share of this block
        rule = self.trend if self.model == "trend" else self.mean
        with np.errstate(invalid="ignore", divide="ignore"):
            out = [rule(x, c, p) for c, p in zip(self.configs, self.positions, strict=True)]
        self.seen += len(x["close"])
        return out[0][0], [e for _, e in out]

    def shared(self, f, kind: type, *key):
        """f(part) once for each block."""
        if (kind, *key) not in self.now:
            self.now[kind, *key] = f(self.part(kind, *key))
        return self.now[kind, *key]

    def mean(self, x: dict[str, np.ndarray], c: Config, p: Position) -> tuple[dict[str, np.ndarray], tuple[list[int], list[str]]]:
        """Long below the lower band, short above the upper, out at the mean."""
        z, model, own = x["close"], self.model, self.filter_of(c)
        f = self.shared(lambda s: s.block(z), Series, model, own)
        m, s = f["x"], f["sigma_stat"]
        ready = m == m
        upper, lower = (m + f["high"], m + f["low"]) if model == "var" else (m + c.k * s, m - c.k * s)
        away = np.abs(z - m)
        none = np.zeros(len(z), bool)
        jump = away > c.jump_z * f["s"] if model == "jump" else none
        blocked = jump.copy()
        exits: list[tuple[str, str, object]] = [("jump_stop_", "row", (jump, jump))] if model == "jump" else []
        if model != "var" and c.z_stop:
            far = (s > 0) & (away / s >= c.z_stop)
            exits.append(("z_stop_", "row", (far, far)))
        if model == "var" and c.stop_pct:
            out = ~((m + f["stop_low"] < z) & (z < m + f["stop_high"]))
            exits.append(("var_stop_", "row", (out, out)))
        if c.half_lives:
            exits.append(("time_stop_", "held", c.half_lives * f["half_life"]))
        if c.atr_stop:
            exits.append(("atr_stop_", "loss", c.atr_stop * self.shared(lambda a: a.block(x), Atr, c.atr_n)))
        exits.append(("close_", "row", (z >= m, z <= m)))
        if c.adx_max:
            blocked |= self.shared(lambda a: a.block(x), Adx, c.adx_n) > c.adx_max
        if c.hurst_n:
            blocked |= self.shared(lambda a: a.block(z), Hurst, c.hurst_n) >= 0.5
        if c.hmm_bars:
            vols = relative_range(x["high"], x["low"], z)
            key = (Regime, c.hmm_bars, own)  # the belief moves where the filter has a mean
            if key not in self.now:
                self.now[key] = self.parts.setdefault(key, Regime(c.hmm_bars)).block(vols, ready & np.isfinite(vols))
            blocked |= np.isin(self.now[key], c.hmm_block)
        if c.tau is not None:
            blocked |= f["half_life"] > c.tau
        if c.spread is not None:
            blocked |= away < c.hurdle * c.spread
        short = (z > upper) & (c.side != "long_only")
        long = ~short & (z < lower) & (c.side != "short_only")
        if c.wick_min is not None:
            span = x["high"] - x["low"]
            long &= (span > 0) & ((np.minimum(x["open"], z) - x["low"]) / span >= c.wick_min)
        if c.volume_mult is not None:
            mean = self.shared(lambda t: volume_mean(t, x["volume"]), Tail, 20)
            long &= (mean > 0) & (x["volume"] >= c.volume_mult * mean)
        found = events(p, z, ready, long & ~blocked, short & ~blocked, exits)
        return {"mean_level": m, "sigma_stat": s, "upper_band": upper, "lower_band": lower}, found

    def trend(self, x: dict[str, np.ndarray], c: Config, p: Position) -> tuple[dict[str, np.ndarray], tuple[list[int], list[str]]]:
        """In beyond the entry channel of closes before, out through the exit channel or the ATR stop."""
        z = x["close"]
        top, bottom = self.shared(lambda a: a.block(z), Extremes, c.entry_n)
        above, below = self.shared(lambda a: a.block(z), Extremes, c.exit_n)
        ready = self.seen + np.arange(len(z)) >= max(c.entry_n, c.exit_n, c.ema_n or 0)
        exits: list[tuple[str, str, object]] = [("atr_stop_", "loss", c.atr_stop * self.shared(lambda a: a.block(x), Atr, c.atr_n))] if c.atr_stop else []
        exits.append(("close_", "row", (z < below, z > above)))
        over = under = np.ones(len(z), bool)
        if c.ema_n:
            ema = self.shared(lambda a: a.block(z), Ewm, 2 / (c.ema_n + 1), 0)
            over, under = z > ema, z < ema
        long = (z > top) & over & (c.side != "short_only")
        short = ~long & (z < bottom) & under & (c.side != "long_only")
        return {"entry_high": top, "entry_low": bottom, "exit_high": above, "exit_low": below}, events(p, z, ready, long, short, exits)


def volume_mean(tail: Tail, volume: np.ndarray) -> np.ndarray:
    """Mean of the 20 volumes before each row."""
    rows, n = len(volume), tail.n
    x, at = tail.block(volume)
    out = np.full(len(x), NAN)
    if len(x) > n:
        out[n:] = np.lib.stride_tricks.sliding_window_view(x, n)[: len(x) - n].mean(1)
    return out[at : at + rows]


def run(model: str, x: dict[str, np.ndarray], c: Config) -> dict[str, np.ndarray]:
    """Bands and signals of one series of bars by a model: ou, cir, garch, var, jump or trend."""
    bands, [(at, names)] = Walk(model, [c]).block(x)
    signal = np.full(len(x["close"]), None, object)
    signal[at] = names
    return bands | {"signal": signal}
