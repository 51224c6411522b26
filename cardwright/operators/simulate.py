"""Chemostat simulation and parameter fits: Runge-Kutta steps and a simplex search with numpy inside Spark tasks, many series at once."""

import math
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of fitted parameters, most steps and points, and the simplex search's limits. Fixed values.
BOUNDS = {"mumax": (0.001, 10.0), "Ks": (0.0001, 100.0), "Yxs": (0.001, 5.0)}
MOST_STEPS, POINTS = 50_000, 1_000
ITERATIONS, TOLERANCE = 1_500, 1e-9
#: Points of all series that a task holds at a time, and series that it fits together.
AT_ONCE, SERIES = 1_000_000, 1_000
DEFAULTS = {"mumax": 0.4, "Ks": 0.1, "Yxs": 0.5, "D": 0.2, "Sin": 10.0, "X0": 0.5, "S0": 5.0, "T": 50.0, "dt": 0.1}
#: Names by which model parameters give simulation inputs. Fixed values.
ALIASES = {"mumax": ("mumax", "mu_max"), "Ks": ("ks",), "Yxs": ("yxs",), "D": ("d",), "Sin": ("sin", "s_in"), "X0": ("x0",), "S0": ("s0",)}


def stepper(p: dict[str, np.ndarray]) -> Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(X, S, h) to the next (X, S) by a Runge-Kutta step, for many series at once, a place of the arrays each."""
    mumax, ks, yxs, d, s_in = (np.asarray(p[c], float) for c in ("mumax", "Ks", "Yxs", "D", "Sin"))
    no_yield = yxs == 0
    some, positive = bool(np.any(no_yield)), bool(np.all(ks > 0))

    def rate(x: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = np.maximum(s, 0.0)  # NaN stays
        both = ks + s
        mu = mumax * s / both if positive else np.where(both != 0, mumax * s / both, 0.0)
        made = mu * x
        used = np.where(no_yield, made * math.inf, made / yxs) if some else made / yxs
        return (mu - d) * x, d * (s_in - s) - used

    def step(x: np.ndarray, s: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half, sixth = h / 2, h / 6
        x1, s1 = rate(x, s)
        x2, s2 = rate(x + half * x1, s + half * s1)
        x3, s3 = rate(x + half * x2, s + half * s2)
        x4, s4 = rate(x + h * x3, s + h * s3)
        return x + sixth * (x1 + 2 * x2 + 2 * x3 + x4), s + sixth * (s1 + 2 * s2 + 2 * s3 + s4)

    return step


def fixed(x: np.ndarray, digits: int) -> np.ndarray:
    """``x`` as written with so many digits, halves of its exact value away from zero."""
    shape, x = np.shape(x), np.atleast_1d(np.asarray(x, float))
    scaled = np.abs(x) * 10.0**digits
    out = np.copysign(np.floor(scaled + 0.5) / 10.0**digits, x)
    # where the product's rounding could hide on which side of a half it is, or digits are beyond a double, exact numbers decide
    near = (np.abs(scaled - np.floor(scaled) - 0.5) <= 1e-6 + scaled * 1e-15) | (scaled > 2.0**50)
    whole = ~(np.abs(x) < 2.0**53)
    out[whole] = x[whole]
    for i in np.flatnonzero(near & ~whole):
        out.flat[i] = float(Decimal(float(x.flat[i])).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out.reshape(shape) if shape else float(out[0])


def _columns(frame: pd.DataFrame, given: list[str]) -> dict[str, np.ndarray]:
    """The parameters of each row; absent and null ones take the default."""
    return {c: frame[c].astype(float).fillna(v).to_numpy(float) if c in given else np.full(len(frame), v) for c, v in DEFAULTS.items()}


def _points(keys: pd.Series, names: tuple[str, ...], key: str, t: np.ndarray, x: np.ndarray, s: np.ndarray, shown: np.ndarray) -> pd.DataFrame:
    """Rows of the shown points (a row a step, a column a series), series by series."""
    series, at = np.nonzero(shown.T)
    return pd.DataFrame({key: keys.to_numpy()[series]} | dict(zip(names, (v.T[series, at] for v in (t, x, s)), strict=True)))


def _by_steps(steps: np.ndarray, kept: np.ndarray) -> Iterator[np.ndarray]:
    """Places of series dealt into groups of equal numbers of steps, each of at most AT_ONCE points."""
    for n in np.unique(steps):
        same = np.flatnonzero(steps == n)
        size = max(1, AT_ONCE // int(kept[same].max() + 1))
        yield from (same[i : i + size] for i in range(0, len(same), size))


def simulations(keys: pd.Series, p: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
    """(key, t, X, S) at about a thousand points and the end, t with 4 digits and states with 6; negative states are cut in the output only; ends where a state is not finite."""
    key = keys.name
    steps = np.maximum(1, np.minimum(np.ceil(p["T"] / p["dt"]), MOST_STEPS)).astype(np.int64)
    for at in _by_steps(steps, np.minimum(steps, 2 * POINTS)):
        q, n = {c: v[at] for c, v in p.items()}, int(steps[at[0]])
        h, every, step = q["T"] / n, max(1, n // POINTS), stepper(q)
        x, s, t, good = q["X0"], q["S0"], np.zeros(len(at)), np.ones(len(at), bool)
        rows = [(t, x, s, good)]
        for i in range(1, n + 1):
            (x, s), t = step(x, s, h), t + h
            good = good & np.isfinite(x) & np.isfinite(s)
            if i % every == 0 or i == n:
                rows.append((t, x, s, good))
        t, x, s, good = (np.stack(v) for v in zip(*rows, strict=True))
        cut = lambda v: np.where(v > 0, v, 0.0)
        yield _points(keys.iloc[at], ("t", "X", "S"), key, fixed(t, 4), fixed(cut(x), 6), fixed(cut(s), 6), good)


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows over all shuffle partitions: their work is in their steps and not in their few bytes, by which one task would get all."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def simulate(parameters: DataFrame, key: str = "id") -> DataFrame:
    """(key, t, X, S) for each row of ``parameters`` (key and the columns of DEFAULTS; absent or null ones take the default)."""
    given = [c for c in DEFAULTS if c in parameters.columns]
    kind = parameters.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(all="ignore"):
            for frame in frames:
                yield from simulations(frame[key], _columns(frame, given))

    return _dealt(parameters.select(key, *given), key).mapInPandas(run, f"{key} {kind}, t double, X double, S double")


class Grid:
    """Where series of equally many ascending times meet their fixed grids of steps; the places do not depend on what is fitted."""

    def __init__(self, times: np.ndarray):
        self.series, self.times = times.shape
        end = times[:, -1] if self.times else np.zeros(self.series)
        self.n = np.maximum(1000, np.ceil(end / 0.02)).astype(np.int64) if self.times else np.zeros(self.series, np.int64)
        self.h = np.where(end > 0, end / np.maximum(self.n, 1), 0.0)
        self.n = np.where(self.h > 0, self.n, 0)
        # the grid's times by adding step to step, as they are walked
        self.at, self.rest = np.zeros(times.shape, np.int64), np.zeros(times.shape)
        for i in range(self.series):
            grid = np.add.accumulate(np.concatenate([[0.0], np.full(self.n[i], self.h[i])]))
            self.at[i] = np.searchsorted(grid[1:], times[i] + 1e-9, side="right")
            self.at[i] = np.maximum.accumulate(self.at[i])
            self.rest[i] = times[i] - grid[self.at[i]]


def at_times(grid: Grid, p: dict[str, np.ndarray], chosen: np.ndarray) -> np.ndarray:
    """States (series, times, 2) at the times of the chosen series: one step leads there from the last point of the grid before each; zeros from where they are not finite."""
    at, rest, h = grid.at[chosen], grid.rest[chosen], grid.h[chosen]
    step, x, s, rows = stepper(p), p["X0"], p["S0"], np.arange(len(chosen))[:, None]
    last = int(at.max(initial=0))
    xs, ss = np.empty((last + 1, len(chosen))), np.empty((last + 1, len(chosen)))
    xs[0], ss[0] = x, s
    for k in range(1, last + 1):
        x, s = step(x, s, h)
        x, s = np.maximum(x, 0.0), np.maximum(s, 0.0)  # NaN stays
        xs[k], ss[k] = x, s
    x, s = xs[at, rows], ss[at, rows]
    wide = {c: np.broadcast_to(v[:, None], x.shape) for c, v in p.items()}
    x1, s1 = stepper(wide)(x, s, rest)
    off = rest > 1e-9
    x, s = (np.where(off, np.where(b < 0, 0.0, b), a) for a, b in ((x, x1), (s, s1)))
    good = np.logical_and.accumulate(np.isfinite(x) & np.isfinite(s), axis=1)
    return np.where(good[:, :, None], np.stack([x, s], 2), 0.0)


def dense_curves(keys: pd.Series, p: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
    """(key, t, X, S) on an even grid of 500 to 5 000 steps of about 0.05; ends where a state is not finite."""
    steps = np.minimum(np.maximum(500, np.ceil(p["T"] / 0.05)), 5_000).astype(np.int64)
    for at in _by_steps(steps, steps):
        q, n = {c: v[at] for c, v in p.items()}, int(steps[at[0]])
        h, step, x, s, good, rows = q["T"] / n, stepper(q), q["X0"], q["S0"], np.ones(len(at), bool), []
        for i in range(n + 1):
            rows.append((i * h, x, s, good))
            x, s = (np.maximum(v, 0.0) for v in step(x, s, h))
            good = good & np.isfinite(x) & np.isfinite(s)
        t, x, s, good = (np.stack(v) for v in zip(*rows, strict=True))
        yield _points(keys.iloc[at], ("t", "X", "S"), keys.name, fixed(t, 4), x, s, good)


def _one(run: Callable[[pd.Series, dict[str, np.ndarray]], Iterator[pd.DataFrame]], p: dict[str, float]) -> list[tuple[float, float, float]]:
    with np.errstate(all="ignore"):
        return [row for df in run(pd.Series([0], name="id"), {c: np.array([float(v)]) for c, v in p.items()}) for row in df[["t", "X", "S"]].itertuples(index=False, name=None)]


def simulated(p: dict[str, float]) -> list[tuple[float, float, float]]:
    """(t, X, S) of one series, as ``simulations`` gives them."""
    return _one(simulations, p)


def dense_curve(p: dict[str, float], end: float) -> list[tuple[float, float, float]]:
    """(t, X, S) of one series, as ``dense_curves`` gives them."""
    return _one(dense_curves, p | {"T": end})


def curves(fits: DataFrame, ends: DataFrame, key: str = "series_id") -> DataFrame:
    """(key, t, X, S): the dense curve of each fit (``key`` and columns of DEFAULTS) to the series' end (``key``, T)."""
    rows = fits.drop("T").join(ends.select(key, "T"), key)
    given = [c for c in DEFAULTS if c in rows.columns]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(all="ignore"):
            for frame in frames:
                yield from dense_curves(frame[key], _columns(frame, given))

    return _dealt(rows.select(key, *given), key).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, t double, X double, S double")


def simplex(objective: Callable[[np.ndarray, np.ndarray], np.ndarray], start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nelder-Mead for many series at once, each on its own way: reflection, expansion by 2, contraction inside only, shrinking by a half.

    ``objective`` takes the places of series and a point for each. (best points, their values, iterations).
    """
    m, n = start.shape
    points = np.repeat(start[:, None], n + 1, 1)
    for i in range(n):
        points[:, i + 1, i] += np.where(start[:, i] != 0, 0.05 * start[:, i], 0.025)
    values, took, going = np.stack([objective(np.arange(m), points[:, i]) for i in range(n + 1)], 1), np.full(m, ITERATIONS), np.arange(m)
    for step in range(ITERATIONS):
        order = np.argsort(values[going], axis=1, kind="stable")
        points[going], values[going] = np.take_along_axis(points[going], order[:, :, None], 1), np.take_along_axis(values[going], order, 1)
        done = np.abs(values[going, -1] - values[going, 0]) < TOLERANCE
        took[going[done]] = step
        going = going[~done]
        if not len(going):
            break
        middle, worst = np.mean(points[going, :-1], axis=1), points[going, -1]
        mirrored = middle + (middle - worst)
        v = objective(going, mirrored)
        better, good = v < values[going, 0], v < values[going, -2]
        far, near = middle + 2 * (middle - worst), middle + 0.5 * (worst - middle)
        tried = np.where(better[:, None], far, near)
        again = better | ~good
        w = np.full(len(going), math.inf)
        w[again] = objective(going[again], tried[again])
        second = (better & (w < v)) | (~better & ~good & (w < values[going, -1]))
        first = (better & ~(w < v)) | (~better & good)
        for chosen, z, u in ((first, mirrored, v), (second, tried, w)):
            points[going[chosen], -1], values[going[chosen], -1] = z[chosen], u[chosen]
        shrunk = going[~first & ~second]
        if len(shrunk):
            for i in range(1, n + 1):
                points[shrunk, i] = points[shrunk, 0] + 0.5 * (points[shrunk, i] - points[shrunk, 0])
                values[shrunk, i] = objective(shrunk, points[shrunk, i])
    best = np.argmin(values, axis=1)
    return points[np.arange(m), best], values[np.arange(m), best], took


def fitted(t: np.ndarray, x: np.ndarray, s: np.ndarray, free: tuple[str, ...], p: dict[str, float]) -> dict[str, np.ndarray]:
    """Parameters that fit series of equally many times, a row each, those in ``free`` searched in log space within BOUNDS, with rmse and r2 of X and S. X0 and S0 are each series' first."""
    m, grid = len(t), Grid(t)
    given = {c: np.full(m, float(v)) for c, v in p.items()} | {"X0": x[:, 0], "S0": s[:, 0]}
    scale = [np.maximum(1e-6, np.mean(v * v, axis=1)) for v in (x, s)]

    def with_free(z: np.ndarray, chosen: np.ndarray) -> dict[str, np.ndarray]:
        return {c: v[chosen] for c, v in given.items()} | {name: np.clip(np.exp(z[:, k]), *BOUNDS[name]) for k, name in enumerate(free)}

    def objective(chosen: np.ndarray, z: np.ndarray) -> np.ndarray:
        got = at_times(grid, with_free(z, chosen), chosen)
        off = [np.ascontiguousarray((got[:, :, j] - v[chosen]) ** 2).sum(axis=1) / scale[j][chosen] for j, v in enumerate((x, s))]
        return off[0] + off[1]

    everyone, best, iterations = np.arange(m), given, np.zeros(m)
    if free:
        z, _, iterations = simplex(objective, np.log(np.stack([given[name] for name in free], 1)))
        best = with_free(z, everyone)
    got, out = at_times(grid, best, everyone), {name: best[name] for name in BOUNDS} | {"iterations": iterations.astype(float)}
    for j, (name, v) in enumerate((("X", x), ("S", s))):
        res, tot = np.ascontiguousarray((v - got[:, :, j]) ** 2).sum(axis=1), ((v - v.mean(axis=1)[:, None]) ** 2).sum(axis=1)
        out |= {f"rmse_{name}": np.sqrt(res / v.shape[1]), f"r2_{name}": np.where(tot == 0, 1.0, 1 - res / np.where(tot == 0, 1.0, tot))}
    return out


def fit(series: DataFrame, key: str = "series_id", free: tuple[str, ...] = ("mumax", "Ks", "Yxs"), guess: dict[str, float] | None = None) -> DataFrame:
    """One row a series (key, t, X, S): fitted parameters, iterations, rmse and r2. X0 and S0 come from its first row.

    A series is a measured run of at most some thousand rows. Series are dealt over all shuffle partitions, as a fit's
    work is in its steps and not in its few bytes; a task fits those of equally many rows together, a few hundred at a time.
    """
    p0 = DEFAULTS | {"mumax": 0.5, "Ks": 0.5, "Yxs": 0.5} | (guess or {})
    names = [*BOUNDS, "iterations", "rmse_X", "r2_X", "rmse_S", "r2_S"]
    kind = series.schema[key].dataType.simpleString()

    def together(held: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups: dict[int, list[pd.DataFrame]] = {}
        for g in held:
            groups.setdefault(len(g), []).append(g.sort_values("t"))
        for same in groups.values():
            ends = [max(1000, math.ceil(g["t"].iloc[-1] / 0.02)) if g["t"].iloc[-1] > 0 else 1000 for g in same]
            size = max(1, AT_ONCE // max(ends))
            for i in range(0, len(same), size):
                part = same[i : i + size]
                t, x, s = (np.stack([g[c].to_numpy(float) for g in part]) for c in ("t", "X", "S"))
                got = fitted(t, x, s, free, p0)
                yield pd.DataFrame({key: pd.concat([g[key].iloc[:1] for g in part], ignore_index=True)} | {n: got[n] for n in names})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n_held, rest = [], 0, None
        with np.errstate(all="ignore"):
            for frame in frames:
                frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
                k = frame[key]
                new = np.flatnonzero((k.ne(k.shift()) & ~(k.isna() & k.shift().isna())).to_numpy() | (np.arange(len(frame)) == 0))
                # the last series may go on in the next frame
                for a, b in zip(new[:-1], new[1:], strict=True):
                    held.append(frame.iloc[a:b])
                    n_held += b - a
                rest = frame.iloc[new[-1] :] if len(new) else None
                if len(held) >= SERIES or n_held > AT_ONCE:
                    yield from together(held)
                    held, n_held = [], 0
            if rest is not None:
                held.append(rest)
            yield from together(held)

    return _dealt(series.select(key, "t", "X", "S"), key).sortWithinPartitions(key).mapInPandas(run, f"{key} {kind}, " + ", ".join(f"{n} double" for n in names))


def steady_state(mumax: Column, ks: Column, yxs: Column, d: Column, s_in: Column) -> Column:
    """struct(S, X, washout) of the chemostat at rest."""
    s = d * ks / F.nullif(mumax - d, F.lit(0.0))
    x = yxs * (s_in - s)
    washout = F.coalesce((d <= 0) | (d >= mumax) | (s < 0) | (x < 0), F.lit(True))
    return F.struct(F.when(~washout, s).otherwise(s_in).alias("S"), F.when(~washout, x).otherwise(F.lit(0.0)).alias("X"), washout.alias("washout"))


def checked(parameters: DataFrame) -> DataFrame:
    """``parameters`` with errors (not positive or not finite) and warnings (washout, batch, long steps, nothing to simulate).

    Washout is a dilution above the growth rate at the feed's concentration.
    """
    value = {c: F.coalesce(F.col(c) if c in parameters.columns else F.lit(None).cast("double"), F.lit(v)) for c, v in DEFAULTS.items()}
    bad = lambda c, cond, text: F.when(cond | F.isnan(value[c]) | (F.abs(value[c]) == float("inf")), F.lit(f"{c} {text}"))
    errors = F.array_compact(F.array(*(bad(c, value[c] <= 0, "must be positive") for c in ("mumax", "Ks", "Yxs", "T", "dt")), *(bad(c, value[c] < 0, "must not be negative") for c in ("D", "Sin", "X0", "S0")), F.when((value["dt"] > 0) & (value["T"] > 0) & (value["dt"] >= value["T"]), F.lit("dt must be smaller than T"))))
    most = value["mumax"] * value["Sin"] / F.nullif(value["Ks"] + value["Sin"], F.lit(0.0))
    warnings = F.array_compact(F.array(F.when(value["D"] > most, F.lit("washout")), F.when(value["D"] == 0, F.lit("batch")), F.when(value["dt"] > 0.5, F.lit("long steps")), F.when((value["X0"] == 0) & (value["S0"] == 0), F.lit("nothing to simulate"))))
    return parameters.withColumns({"errors": errors, "warnings": warnings})


def inputs_of(parameters: DataFrame) -> DataFrame:
    """(extraction_id, inputs): simulation inputs from model parameters, by the first alias of each that is there."""
    low = parameters.select("extraction_id", F.lower("symbol").alias("s"), "value")
    pairs = [(name, alias, rank) for name, aliases in ALIASES.items() for rank, alias in enumerate(aliases)]
    table = parameters.sparkSession.createDataFrame(pairs, "input string, s string, rank int")
    found = low.join(F.broadcast(table), "s").groupBy("extraction_id", "input").agg(F.min_by("value", "rank").alias("value"))
    return found.groupBy("extraction_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("input", "value")))).alias("inputs"))


def with_measured(curve: DataFrame, measured: DataFrame, key: str, order: str = "t") -> DataFrame:
    """Fitted and measured points of each series side by side; callers sort what they show."""
    a = curve.select(key, order, *(F.col(c).alias(f"{c}_fit") for c in curve.columns if c not in (key, order)))
    b = measured.select(key, order, *(F.col(c).alias(f"{c}_measured") for c in measured.columns if c not in (key, order)))
    return a.unionByName(b, allowMissingColumns=True)
