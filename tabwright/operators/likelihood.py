"""Seasonal ARIMA by exact Gaussian likelihood, worked out over blocks of a series.

The differenced series is an ARMA process whose lag polynomials are products of an
ordinary and a seasonal one. Written with a single source of error, the state before
the first row decides all shocks: shock t is its value from a zero state less a
linear function of that first state. A block of rows therefore gives, for trial
parameters, the sum of its squared shocks, their products with the state's weights
and the state at its end; two neighbouring blocks combine into one of the same form,
and the first state, normal with the process's own covariance, is integrated out at
the end. No task follows more than a block of rows or a run of blocks.

Partial autocorrelations of every polynomial are the free parameters, so that each
trial is stationary and invertible. A grid of trials, then rounds of Newton steps
with a line search find the maximum; all trials of a round share one pass. Series of
one block go through all rounds in the task that holds the block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.plans.ordering import with_lags
from tabwright.session import stored

#: Rows of a block, and blocks that one task combines.
BLOCK = 4096
RUN = 256
#: Values followed at once in a task.
LOADED = 1 << 20
#: Rounds of Newton steps before a fit is given up as not converged.
ROUNDS = 30
STARTS = (-0.6, 0.1, 0.7)
STEPS = (2.0, 1.0, 0.5, 0.2, 0.05, 0.01)
PART = "length long, size int, trials array<double>, s array<double>, b array<double>, last array<double>"
STATE = (
    "rows long, centre double, scale double, phase string, size int, trials array<double>, free array<double>, "
    "move array<double>, best double, state array<double>, loglik double, variance double, rounds int, converged boolean"
)


@dataclass(frozen=True)
class Orders:
    """ARIMA(p,d,q)(P,D,Q,season); a constant belongs to it where nothing is differenced."""

    p: int = 1
    d: int = 1
    q: int = 1
    seasonal_p: int = 0
    seasonal_d: int = 0
    seasonal_q: int = 0
    season: int = 0

    @property
    def constant(self) -> bool:
        return self.d + self.seasonal_d == 0

    @property
    def groups(self) -> tuple[int, int, int, int]:
        return self.p, self.q, self.seasonal_p, self.seasonal_q

    @property
    def free(self) -> int:
        return sum(self.groups) + self.constant

    @property
    def width(self) -> int:
        """Length of the state."""
        return max(1, self.p + self.seasonal_p * self.season, self.q + self.seasonal_q * self.season)

    @property
    def difference(self) -> np.ndarray:
        """Coefficients of (1 - B)^d (1 - B^season)^D, B being the lag."""
        plain = np.array([(-1.0) ** k * comb(self.d, k) for k in range(self.d + 1)])
        seasonal = np.zeros(self.seasonal_d * self.season + 1)
        for k in range(self.seasonal_d + 1):
            seasonal[k * self.season] = (-1.0) ** k * comb(self.seasonal_d, k)
        return np.convolve(plain, seasonal)

    @property
    def lost(self) -> int:
        """Rows at the start that differencing uses up."""
        return self.d + self.seasonal_d * self.season


def stable(free: np.ndarray) -> np.ndarray:
    """Weights of a stationary autoregression, one per row, from free numbers as partial autocorrelations."""
    partial = free / np.sqrt(1 + free * free)
    weights = np.zeros((len(free), 0))
    for k in range(free.shape[1]):
        last = partial[:, k : k + 1]
        weights = np.concatenate([weights - last * weights[:, ::-1], last], axis=1)
    return weights


def _times(plain: np.ndarray, seasonal: np.ndarray, season: int, width: int) -> np.ndarray:
    """Lags 1 to ``width`` of (1 + plain(B)) (1 + seasonal(B^season)), one product per row."""
    out = np.zeros((len(plain), 1 + max(width, plain.shape[1] + seasonal.shape[1] * season)))
    ones = np.ones((len(plain), 1))
    for j, factor in enumerate(np.concatenate([ones, seasonal], axis=1).T):
        for i, weight in enumerate(np.concatenate([ones, plain], axis=1).T):
            out[:, i + j * season] += weight * factor
    return out[:, 1 : width + 1]


def coefficients(free: np.ndarray, orders: Orders) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phi, theta, mean) of trials: w = mean + sum phi (w - mean) lagged + shock + sum theta shock lagged."""
    cuts = np.cumsum(orders.groups)
    ar, ma, seasonal_ar, seasonal_ma = (stable(x) for x in np.split(free[:, : cuts[-1]], cuts[:-1], axis=1))
    phi = -_times(-ar, -seasonal_ar, orders.season, orders.width)
    theta = _times(-ma, -seasonal_ma, orders.season, orders.width)
    return phi, theta, free[:, cuts[-1]] if orders.constant else np.zeros(len(free))


def passage(theta: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(D, M) of ``length`` rows: how a state is carried over them, and the squared weights it has in their shocks."""
    trials, width = theta.shape
    step = np.zeros((trials, width, width))
    step[:, :, 0] = -theta
    step[:, np.arange(width - 1), np.arange(1, width)] = 1.0
    seen = np.zeros((trials, width, width))
    seen[:, 0, 0] = 1.0
    carried, squares = np.broadcast_to(np.eye(width), step.shape), np.zeros_like(step)
    while length:
        if length & 1:
            squares = squares + carried.transpose(0, 2, 1) @ seen @ carried
            carried = step @ carried
        seen = seen + step.transpose(0, 2, 1) @ seen @ step
        step = step @ step
        length >>= 1
    return carried, squares


def first_spread(phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Covariance of the first state, in units of the shocks' variance."""
    trials, width = phi.shape
    step = np.zeros((trials, width, width))
    step[:, :, 0] = phi
    step[:, np.arange(width - 1), np.arange(1, width)] = 1.0
    gain = (phi + theta)[:, :, None]
    spread = gain @ gain.transpose(0, 2, 1)
    for _ in range(64):
        more = step @ spread @ step.transpose(0, 2, 1)
        spread = spread + more
        if not np.isfinite(more).all() or np.abs(more).max() <= 1e-16 * np.abs(spread).max():
            break
        step = step @ step
    return spread


def follow(values: list[np.ndarray], free: np.ndarray, orders: Orders) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(s, b, last) of blocks, longest first, each with its own trials (block, trial, parameter), from a zero state."""
    blocks, trials = free.shape[:2]
    shape = (blocks, trials, orders.width)
    phi, theta, mean = coefficients(free.reshape(blocks * trials, -1), orders)
    phi, theta, mean = phi.reshape(shape), theta.reshape(shape), mean.reshape(blocks, trials)
    lengths = np.array([len(v) for v in values])
    padded = np.zeros((blocks, lengths.max()))
    for row, v in zip(padded, values):
        row[: len(v)] = v
    s, b, state, weight = np.zeros(shape[:2]), np.zeros(shape), np.zeros(shape), np.zeros(shape)
    weight[:, :, 0] = 1.0
    for t, n in enumerate(np.searchsorted(-lengths, -np.arange(lengths.max()), side="left")):
        w = padded[:n, t, None] - mean[:n]
        shock = w - state[:n, :, 0]
        s[:n] += shock * shock
        b[:n] += shock[:, :, None] * weight[:n]
        after = phi[:n] * w[:, :, None] + theta[:n] * shock[:, :, None]
        after[:, :, :-1] += state[:n, :, 1:]
        state[:n] = after
        ahead = -(weight[:n] * theta[:n]).sum(axis=2)
        weight[:n, :, 1:] = weight[:n, :, :-1].copy()
        weight[:n, :, 0] = ahead
    return s, b, state


def _blocks_of(orders: Orders, ids: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, alike in batch.groupby("size"):
                alike = alike.iloc[np.argsort(-alike["z"].map(len).to_numpy(), kind="stable")]
                low = 0
                while low < len(alike):
                    longest = len(alike["z"].iloc[low])
                    some = alike.iloc[low : low + max(1, LOADED // (longest * max(1, size // 8)))]
                    low += len(some)
                    free = np.stack(some["trials"].to_list()).reshape(len(some), size, orders.free)
                    s, b, last = follow(some["z"].to_list(), free, orders)
                    yield some[[*ids, "block"]].assign(
                        length=some["z"].map(len), size=size, trials=some["trials"], s=list(s),
                        b=list(b.reshape(len(some), -1)), last=list(last.reshape(len(some), -1)),
                    )

    return run


def combined(parts: pd.DataFrame, order: str, orders: Orders) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(length, s, b, last) of neighbouring parts as one."""
    parts = parts.sort_values(order)
    size = int(parts["size"].iloc[0])
    free = np.asarray(parts["trials"].iloc[0], dtype=float).reshape(size, orders.free)
    theta = coefficients(free, orders)[1]
    shape = (size, orders.width, 1)
    s, b, last, length = np.zeros((size, 1, 1)), np.zeros(shape), np.zeros(shape), 0
    before = np.broadcast_to(np.eye(orders.width), (size, orders.width, orders.width))
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for n, s2, b2, last2 in zip(parts["length"], parts["s"], parts["b"], parts["last"]):
        if n not in known:
            known[n] = passage(theta, int(n))
        carried, squares = known[n]
        b2, last2 = np.asarray(b2).reshape(shape), np.asarray(last2).reshape(shape)
        turned = last.transpose(0, 2, 1)
        s = s + np.asarray(s2).reshape(size, 1, 1) - 2 * turned @ b2 + turned @ squares @ last
        b = b + before.transpose(0, 2, 1) @ (b2 - squares @ last)
        last = carried @ last + last2
        before = carried @ before
        length += int(n)
    return length, s, b, last


def criterion(free: np.ndarray, length: int, s: np.ndarray, b: np.ndarray, last: np.ndarray, orders: Orders):
    """(-2 log likelihood / rows less a constant, shock variance, state after the last row) of every trial."""
    phi, theta, _ = coefficients(free, orders)
    spread = first_spread(phi, theta)
    carried, squares = passage(theta, length)
    mixed = np.eye(orders.width) + squares @ spread
    first = spread @ np.linalg.solve(mixed, b)
    rest = (s - b.transpose(0, 2, 1) @ first)[:, 0, 0]
    variance = np.maximum(rest / length, 1e-300)
    value = np.log(variance) + np.linalg.slogdet(mixed)[1] / length
    return np.where(np.isfinite(value), value, np.inf), variance, (carried @ first + last)[:, :, 0]


def _around(free: np.ndarray, step: float = 1e-4) -> np.ndarray:
    """The point, both neighbours on every axis and the further corner of every two axes."""
    axes = step * np.eye(len(free))
    out = [free, *(free + a for a in axes), *(free - a for a in axes)]
    out += [free + axes[i] + axes[j] for i in range(len(free)) for j in range(i)]
    return np.array(out)


def _newton(value: np.ndarray, count: int, step: float = 1e-4) -> np.ndarray:
    """The step to the minimum of the parabola through the values at ``_around``; downhill in every direction."""
    up, down = value[1 : count + 1] - value[0], value[count + 1 : 2 * count + 1] - value[0]
    slope = (up - down) / (2 * step)
    bend = np.diag((up + down) / step**2)
    corner = iter(value[2 * count + 1 :] - value[0])
    for i in range(count):
        for j in range(i):
            bend[i, j] = bend[j, i] = (next(corner) - up[i] - up[j]) / step**2
    roots, axes = np.linalg.eigh(bend)
    move = -axes @ ((axes.T @ slope) / np.maximum(np.abs(roots), 1e-4))
    return move / max(1.0, np.linalg.norm(move))


def next_round(row: dict, orders: Orders) -> dict:
    """A series' state (with length, s, b and last of its trials) after a round: what the trials gave decides on the next."""
    size, length = int(row["size"]), int(row["length"])
    free = np.asarray(row["trials"], dtype=float).reshape(size, orders.free)
    shape = (size, orders.width, 1)
    s, b, last = (np.asarray(row[c]) for c in ("s", "b", "last"))
    value, variance, state = criterion(free, length, s.reshape(size, 1, 1), b.reshape(shape), last.reshape(shape), orders)
    phase, rounds, done = row["phase"], int(row["rounds"]), None
    chosen = 0 if phase == "around" else int(np.argmin(value))
    gain = row["best"] - value[chosen]
    if phase != "step" or gain > 0:
        row.update(
            free=free[chosen].tolist(), best=float(value[chosen]), state=state[chosen].tolist(), variance=float(variance[chosen]),
            loglik=float(-length / 2 * (value[chosen] + 1 + np.log(2 * np.pi))),
        )
    if orders.free == 0 or (phase == "step" and gain < 1e-9):
        done = True
    elif phase == "step" and rounds >= ROUNDS:
        done = False
    elif phase == "around":
        move = _newton(value, orders.free)
        done = True if np.abs(move).max() < 1e-7 else None
        trials, row["phase"] = free[0] + np.outer(STEPS, move), "step"
    else:
        trials, row["phase"] = _around(np.asarray(row["free"])), "around"
    if done is None:
        row.update(trials=trials.ravel().tolist(), size=len(trials), rounds=rounds + (phase == "step"))
    row["converged"] = done
    return row


def _advance(orders: Orders, names: list[str]):
    """One round of every series."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [next_round(r, orders) for r in batch.to_dict("records")]
            yield pd.DataFrame(rows, columns=names).astype({"converged": object})

    return run


def _all_rounds(orders: Orders, ids: list[str], names: list[str]):
    """All rounds of series that are one block each, side by side."""
    step = _blocks_of(orders, ids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch.to_dict("records")
            going = list(range(len(rows)))
            while going:
                for parts in step([pd.DataFrame([{**rows[i], "block": i} for i in going])]):
                    for part in parts.drop(columns=[*ids, "size", "trials"]).to_dict("records"):
                        rows[part["block"]] = next_round({**rows[part["block"]], **part}, orders)
                going = [i for i in going if rows[i]["converged"] is None]
            yield pd.DataFrame(rows, columns=names).astype({"converged": object})

    return run


def differenced(rows: DataFrame, ids: list[str], orders: Orders, value: str = "value") -> DataFrame:
    """(ids, pos, w): the series differenced, without the rows that this uses up; ``pos`` counts from 0 again."""
    weights = {k: c for k, c in enumerate(orders.difference) if c and k}
    if weights:
        rows = with_lags(rows, ids, "pos", {f"_d{k}": (value, k) for k in weights})
    w = F.col(value)
    for k, c in weights.items():
        w = w + F.lit(float(c)) * F.col(f"_d{k}")
    return rows.where(F.col("pos") >= orders.lost).select(*ids, (F.col("pos") - orders.lost).alias("pos"), w.alias("w"))


def fit(rows: DataFrame, ids: list[str], orders: Orders, block: int = BLOCK, run: int = RUN) -> DataFrame:
    """Maximum likelihood fits of series (ids, pos, value), one row each; ``pos`` counts from 0 without gaps.

    Columns: ids, rows (after differencing), centre and scale (w = centre +
    scale * z; parameters are those of z), free, state (after the last row),
    loglik (of w), variance (of w's shocks), rounds, converged. A constant
    series has scale 1 and no shocks. An empty table gives an empty result.
    """
    w = differenced(rows, ids, orders)
    spread = F.coalesce(F.nullif(F.stddev_pop("w"), F.lit(0.0)), F.lit(1.0))
    facts = w.groupBy(*ids).agg(
        F.count(F.lit(1)).alias("rows"), (F.avg("w") if orders.constant else F.lit(0.0)).alias("centre"), spread.alias("scale")
    )
    z = F.struct("pos", ((F.col("w") - F.col("centre")) / F.col("scale")).alias("z"))
    blocks = w.join(facts, ids).groupBy(*ids, F.floor(F.col("pos") / block).alias("block")).agg(F.sort_array(F.collect_list(z)).alias("z"))
    blocks = stored(blocks.select(*ids, "block", F.transform("z", lambda x: x["z"]).alias("z")), "blocks")
    starts = []
    for first in product(*(STARTS if n else (None,) for n in orders.groups)):
        trial = [x for n, v in zip(orders.groups, first) if n for x in [v, *[0.0] * (n - 1)]]
        starts += trial + [0.0] * orders.constant
    size = len(starts) // orders.free if orders.free else 1
    none = F.array().cast("array<double>")
    state = facts.select(
        *ids, "rows", "centre", "scale", F.lit("grid").alias("phase"), F.lit(size).alias("size"),
        F.array(*map(F.lit, starts)).cast("array<double>").alias("trials"), none.alias("free"), none.alias("move"),
        F.lit(float("inf")).alias("best"), none.alias("state"), F.lit(0.0).alias("loglik"), F.lit(0.0).alias("variance"),
        F.lit(0).alias("rounds"), F.lit(None).cast("boolean").alias("converged"),
    )
    keys = T.StructType([rows.schema[i] for i in ids])
    part = T.StructType.fromDDL(PART)
    state_type = T.StructType([*keys, *T.StructType.fromDDL(STATE)])
    block_type = T.StructType([*keys, T.StructField("block", T.LongType()), *part])

    def joined(order: str):
        def one(parts: pd.DataFrame) -> pd.DataFrame:
            length, s, b, last = combined(parts, order, orders)
            row = {**{i: parts[i].iloc[0] for i in [*ids, "run"]}, "length": length, "size": parts["size"].iloc[0],
                   "trials": parts["trials"].iloc[0], "s": s.ravel(), "b": b.ravel(), "last": last.ravel()}
            return pd.DataFrame({k: [v] for k, v in row.items()})

        return one

    run_type = T.StructType([*keys, T.StructField("run", T.LongType()), *part])
    long = F.col("rows") > block
    short = blocks.drop("block").join(state.where(~long), ids).mapInPandas(_all_rounds(orders, ids, state_type.names), state_type)
    state = stored(short.unionByName(state.where(long)), "fits")
    while not state.where(F.col("converged").isNull()).isEmpty():
        going = state.where(F.col("converged").isNull())
        met = blocks.join(going.select(*ids, "size", "trials"), ids)
        parts = met.mapInPandas(_blocks_of(orders, ids), block_type).withColumn("run", F.floor(F.col("block") / run))
        runs = parts.groupBy(*ids, "run").applyInPandas(joined("block"), run_type)
        whole = runs.groupBy(*ids).applyInPandas(joined("run"), run_type).drop("size", "trials", "run")
        moved = going.join(whole, ids).mapInPandas(_advance(orders, state_type.names), state_type)
        state = stored(moved.unionByName(state.where(F.col("converged").isNotNull())), "fits")
    return state.select(
        *ids, "rows", "centre", "scale", "free", "state", (F.col("loglik") - F.col("rows") * F.log("scale")).alias("loglik"),
        (F.col("variance") * F.col("scale") * F.col("scale")).alias("variance"), "rounds", "converged",
    )


def parameters(fits: DataFrame, ids: list[str], orders: Orders) -> DataFrame:
    """(ids, rows, ar, ma, mean, variance, loglik, aic, rounds, converged): fits in the series' own terms.

    ``ar`` and ``ma`` are the weights of lags 1, 2, ... of the multiplied polynomials.
    """
    keys = T.StructType([fits.schema[i] for i in ids])
    made = "rows long, ar array<double>, ma array<double>, mean double, variance double, loglik double, aic double, rounds int, converged boolean"
    whole = T.StructType([*keys, *T.StructType.fromDDL(made)])
    names = whole.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                phi, theta, mean = coefficients(np.asarray(r["free"], dtype=float).reshape(1, -1), orders)
                ar, ma = orders.p + orders.seasonal_p * orders.season, orders.q + orders.seasonal_q * orders.season
                rows.append([*(r[i] for i in ids), r["rows"], phi[0, :ar].tolist(), theta[0, :ma].tolist(),
                             r["centre"] + r["scale"] * mean[0], r["variance"], r["loglik"],
                             2 * (orders.free + 1) - 2 * r["loglik"], r["rounds"], r["converged"]])
            yield pd.DataFrame(rows, columns=names)

    return fits.mapInPandas(run, whole)


def recurrences(fits: DataFrame, tails: DataFrame, ids: list[str], orders: Orders) -> DataFrame:
    """(ids, weights, intercept, tail, impulses): fits as recurrences over the last values (tails: ids, tail, oldest first)."""
    keys = T.StructType([fits.schema[i] for i in ids])
    made = "weights array<double>, intercept double, tail array<double>, impulses array<double>"
    reach = orders.width + orders.lost

    def one(free, state, centre, scale, tail):
        phi, _, mean = coefficients(np.asarray(free, dtype=float).reshape(1, -1), orders)
        phi, level = phi[0], centre + scale * mean[0]
        tail = np.concatenate([np.zeros(reach), np.asarray(tail, dtype=float)])[-reach:]
        recent = (np.convolve(tail, orders.difference, mode="valid") - level)[::-1]
        # What the state holds beyond the weighted past values are the shocks still to come in.
        impulses = [scale * state[h] - phi[h:] @ recent[: len(phi) - h] for h in range(orders.width)]
        weights = -np.convolve(np.append(1.0, -phi), orders.difference)[1:]
        return weights.tolist(), level * (1 - phi.sum()), tail.tolist(), impulses

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [[*(r[i] for i in ids), *one(r["free"], r["state"], r["centre"], r["scale"], r["tail"])] for r in batch.to_dict("records")]
            yield pd.DataFrame(rows, columns=[*ids, "weights", "intercept", "tail", "impulses"])

    return fits.join(tails, ids).mapInPandas(run, T.StructType([*keys, *T.StructType.fromDDL(made)]))
