"""Filling missing cells by a mixture of Gaussians and categoricals.

A record is a vector of numbers and categories of which any part may be missing.
Records belong to one of a few latent groups; in a group numbers are jointly
Gaussian and categories independent. Expectation-maximisation fits the groups on
all records, incomplete ones with their conditional expectations. A missing number
is filled with its conditional expectation given everything observed in the
record, a missing category with the most probable one, and a mask marks each fill.

Plan: the feature columns are packed once into blocks of rows with the same gaps
and written to the shared folder. A round is one pass over the blocks: each task
reduces its own to sufficient statistics, whose number depends on the model only,
and these are summed by Spark before the driver sees them. The start is found on
a bounded number of rows, the fit goes on over all rows until it converges. Filling
needs no shuffle: the fitted model goes along with the function. Features of the record's group (the
means of the same player, say) are pre-aggregated per group and joined with a
salt, since a group may hold a third of all rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.session import durable

SALTS = 8


@dataclass(frozen=True)
class Number:
    """A numeric column and what it can hold; ``whole``: fills are rounded."""

    name: str
    low: float = 0.0
    high: float = float("inf")
    whole: bool = True
    fill: bool = False


@dataclass
class Model:
    numbers: list[str]
    categories: dict[str, list[str]]
    centre: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    mean: np.ndarray
    cov: np.ndarray
    theta: list[np.ndarray] = field(default_factory=list)
    log_likelihood: list[float] = field(default_factory=list)  # mean of a row, by round
    converged: bool = False


def valid(n: Number) -> Column:
    """The column as a double, NULL where absent, NaN or a number that it can't hold."""
    d = F.col(n.name).cast("double")
    ok = ~F.isnan(d) & (d >= n.low)
    if np.isfinite(n.high):
        ok = ok & (d <= n.high)
    return F.when(ok, d)


def must_fill(n: Number) -> Column:
    return valid(n).isNull()


def group_means(df: DataFrame, key: Column, numbers: list[Number]) -> DataFrame:
    """(k, n, mean_<column>...): the means of each group's valid numbers."""
    return df.select(key.alias("k"), *[valid(n).alias(n.name) for n in numbers]).filter("k is not null").groupBy("k").agg(
        *[F.avg(n.name).alias(f"mean_{n.name}") for n in numbers]
    )


def join_group(df: DataFrame, key: Column, dim: DataFrame, spread: Column) -> DataFrame:
    """Left join with a table of one row a key ``k``; rows of a hot key are spread over tasks."""
    dim = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = df.withColumns({"_k": key, "_salt": F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")})
    # a missing key joins nothing; spread, too, so that many of them don't meet in one task
    left = left.withColumn("_k", F.coalesce("_k", F.concat(F.lit("\u0000"), spread.cast("string"))))
    return left.join(dim.withColumnRenamed("k", "_k"), ["_k", "_salt"], "left").drop("_k", "_salt")


# --- the model on packed rows

#: rows of one pattern of gaps in a block, and rows a task holds before it writes blocks
BLOCK, HELD = 1 << 16, 1 << 18
#: rows on which the start of the fit is found; the fit itself is of all rows
START_ROWS = 10_000
#: gain of the mean log-likelihood of a row at which the fit has converged, and rounds at most
TOLERANCE, ROUNDS = 1e-5, 500


def _patterns(numbers: list[str], categories: dict[str, list[str]], batch: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(code of the observed numbers, rows, their observed numbers, their categories or -1)."""
    x = batch[numbers].to_numpy(dtype=float)
    cats = np.stack([pd.Categorical(batch[c], categories=v).codes for c, v in categories.items()], 1) if categories else np.zeros((len(x), 0), dtype=np.int8)
    seen = ~np.isnan(x)
    code = seen @ (1 << np.arange(x.shape[1]))
    for c in np.unique(code):
        rows = np.flatnonzero(code == c)
        yield int(c), rows, x[np.ix_(rows, seen[rows[0]])].astype(np.float32), cats[rows].astype(np.int16)


def _pack(numbers: list[str], categories: dict[str, list[str]]):
    """Rows to blocks (code, n, x, cats, keys) of one pattern of gaps, so that a round works on large arrays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        total = 0

        def blocks() -> Iterator[pd.DataFrame]:
            for code, parts in held.items():
                x, cats, keys = (np.concatenate([p[i] for p in parts]) for i in range(3))
                for at in range(0, len(x), BLOCK):
                    cut = slice(at, at + BLOCK)
                    n = len(x[cut])
                    yield pd.DataFrame({"code": [code], "n": [n], "x": [x[cut].tobytes()], "cats": [cats[cut].tobytes()], "keys": [list(keys[cut])]})

        for batch in batches:
            for code, rows, x, cats in _patterns(numbers, categories, batch):
                held.setdefault(code, []).append((x, cats, batch["row_key"].to_numpy()[rows]))
                total += len(rows)
            if total >= HELD:
                yield from blocks()
                held, total = {}, 0
        yield from blocks()

    return run


class _Step:
    """Expectations under one model; what depends on the pattern of gaps alone is worked out once."""

    def __init__(self, m: Model):
        self.m, self.known = m, {}

    def of(self, code: int):
        if code not in self.known:
            o = (code >> np.arange(len(self.m.numbers))) & 1 == 1
            per = []
            for mu, s in zip(self.m.mean, self.m.cov):
                chol = np.linalg.cholesky(s[np.ix_(o, o)]) if o.any() else np.zeros((0, 0))
                inv = np.linalg.inv(chol) if o.any() else chol
                b = inv.T @ (inv @ s[np.ix_(o, ~o)])
                per.append((mu[o], mu[~o], inv, np.log(np.diag(chol)).sum() + 0.5 * o.sum() * np.log(2 * np.pi), b, s[np.ix_(~o, ~o)] - s[np.ix_(~o, o)] @ b))
            self.known[code] = o, per
        return self.known[code]

    def expect(self, code: int, x: np.ndarray, cats: np.ndarray):
        """(which numbers are observed, responsibilities, per group the expectations of the others, log-likelihood)."""
        o, per = self.of(code)
        x = x.astype(float)
        logp = np.tile(np.log(self.m.weight), (len(x), 1))
        for j, theta in enumerate(self.m.theta):
            c = cats[:, j]
            logp += np.where(c[:, None] >= 0, np.log(theta).T[np.maximum(c, 0)], 0.0)
        gaps = []
        for g, (mu, rest, inv, norm, b, _) in enumerate(per):
            diff = x - mu
            logp[:, g] -= 0.5 * ((diff @ inv.T) ** 2).sum(1) + norm
            gaps.append(rest + diff @ b)
        top = logp.max(1, keepdims=True)
        p = np.exp(logp - top)
        total = p.sum(1, keepdims=True)
        return o, p / total, gaps, float((top + np.log(total)).sum())


def _sums(m: Model, blocks: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """The sufficient statistics of blocks (code, x, cats): log-likelihood, rows, and per group weight, sums, products, counts of categories."""
    k, d = m.mean.shape
    n, s1, s2, ll, rows = np.zeros(k), np.zeros((k, d)), np.zeros((k, d, d)), 0.0, 0
    counts = [np.zeros_like(t) for t in m.theta]
    step = _Step(m)
    for code, x, cats in blocks:
        o, r, gaps, part = step.expect(code, x, cats)
        ll, rows = ll + part, rows + len(x)
        n += r.sum(0)
        full = np.empty((len(x), d))
        full[:, o] = x
        for g in range(k):
            full[:, ~o] = gaps[g]
            w = full * r[:, [g]]
            s1[g] += w.sum(0)
            s2[g] += w.T @ full
            s2[g][np.ix_(~o, ~o)] += r[:, g].sum() * step.of(code)[1][g][5]
        for j, t in enumerate(counts):
            seen = cats[:, j] >= 0
            for g in range(k):
                t[g] += np.bincount(cats[seen, j], weights=r[seen, g], minlength=t.shape[1])
    return np.concatenate([[ll, rows], n, s1.ravel(), s2.ravel(), *[t.ravel() for t in counts]])


def _raw(batch: pd.DataFrame, kinds: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(code, observed numbers, categories) of packed blocks or rows."""
    for code, n, x, cats in zip(batch["code"], batch["n"], batch["x"], batch["cats"]):
        yield code, np.frombuffer(x, np.float32).reshape(n, -1) if x else np.zeros((n, 0), np.float32), np.frombuffer(cats, np.int16).reshape(n, kinds)


def _unpack(m: Model, batch: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The same with standardised numbers."""
    for code, x, cats in _raw(batch, len(m.categories)):
        o = (code >> np.arange(len(m.numbers))) & 1 == 1
        yield code, (x - m.centre[o]) / m.scale[o], cats


def _update(m: Model, flat: np.ndarray) -> float:
    """Maximise ``m`` given the statistics; returns the mean log-likelihood of a row before."""
    groups, d = m.mean.shape
    at = 2
    n = np.maximum(flat[at : at + groups], 1e-6)
    at += groups
    s1 = flat[at : at + groups * d].reshape(groups, d)
    at += groups * d
    s2 = flat[at : at + groups * d * d].reshape(groups, d, d)
    at += groups * d * d
    m.weight = n / n.sum()
    m.mean = s1 / n[:, None]
    # a ridge of one row's weight keeps small and degenerate groups invertible
    m.cov = np.array([(s2[g] - n[g] * np.outer(m.mean[g], m.mean[g]) + np.eye(d)) / (n[g] + 1) + 1e-6 * np.eye(d) for g in range(groups)])
    m.cov = (m.cov + m.cov.transpose(0, 2, 1)) / 2
    m.theta = []
    for v in m.categories.values():
        t = flat[at : at + groups * len(v)].reshape(groups, len(v)) + 1.0
        m.theta.append(t / t.sum(1, keepdims=True))
        at += groups * len(v)
    m.log_likelihood.append(flat[0] / max(flat[1], 1.0))
    return m.log_likelihood[-1]


def _climb(m: Model, statistics, tolerance: float, rounds: int) -> Model:
    """Rounds of expectation and maximisation until a row's mean log-likelihood gains less than ``tolerance``."""
    last = -np.inf
    for _ in range(rounds):
        now = _update(m, statistics(m))
        m.converged = abs(now - last) <= tolerance
        if m.converged:
            break
        last = now
    return m


def _moments(d: int, kinds: int):
    """Of blocks: rows, sums and squares of each number, as (i, v)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((3, d))
        for batch in batches:
            for code, x, _ in _raw(batch, kinds):
                o, x = (code >> np.arange(d)) & 1 == 1, x.astype(float)
                out[0, o] += len(x)
                out[1, o] += x.sum(0)
                out[2, o] += (x**2).sum(0)
        yield pd.DataFrame({"i": np.arange(3 * d), "v": out.ravel()})

    return run


def _some(kinds: int, rows: int):
    """Of a task's blocks the ``rows`` rows with the least key hashes, as blocks of one row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = pd.DataFrame({"h": np.array([], dtype=np.int64), "code": [], "n": [], "x": [], "cats": []})
        for batch in batches:
            for (code, x, cats), keys in zip(_raw(batch, kinds), batch["keys"]):
                h = pd.util.hash_array(np.asarray(keys, dtype=object).astype(str)).view(np.int64)
                first = np.argsort(h, kind="stable")[:rows]
                own = pd.DataFrame({"h": h[first], "code": code, "n": 1, "x": [x[i].tobytes() for i in first], "cats": [cats[i].tobytes() for i in first]})
                kept = pd.concat([kept, own]).nsmallest(rows, "h") if len(kept) else own
        yield kept.astype({"h": np.int64, "code": np.int32, "n": np.int32})

    return run


def start(packed: DataFrame, numbers: list[str], categories: dict[str, list[str]], groups: int = 4, rows: int = START_ROWS) -> tuple[Model | None, pd.DataFrame]:
    """(model, rows) to begin with: one group per band of the first number, between its quantiles in those rows; None without any number."""
    d, kinds = len(numbers), len(categories)
    blocks = packed.select("code", "n", "x", "cats")
    flat = np.zeros(3 * d)
    for i, v in blocks.mapInPandas(_moments(d, kinds), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        flat[i] = v
    n, total, squares = flat.reshape(3, d)
    if not n.any():
        return None, pd.DataFrame()
    centre = total / np.maximum(n, 1)
    spread = np.sqrt(np.maximum(squares / np.maximum(n, 1) - centre**2, 0))
    scale = np.where(spread > 1e-9 * np.maximum(np.abs(centre), 1), spread, 1.0)
    some = packed.mapInPandas(_some(kinds, rows), "h long, code int, n int, x binary, cats binary").orderBy("h", "code", "x").limit(rows).toPandas()  # of a fixed size
    seen = [x[0, 0] for code, x, _ in _raw(some, kinds) if code & 1]
    mean = np.zeros((groups, d))
    if seen:
        mean[:, 0] = (np.quantile(np.array(seen, dtype=float), [(i + 0.5) / groups for i in range(groups)]) - centre[0]) / scale[0] + np.linspace(-0.1, 0.1, groups)
    m = Model(numbers, categories, centre, scale, np.full(groups, 1 / groups), mean, np.repeat(np.eye(d)[None], groups, axis=0), [np.full((groups, len(v)), 1 / len(v)) for v in categories.values()])
    return m, some


def fit(m: Model, some: pd.DataFrame, packed: DataFrame, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> Model:
    """``m`` fitted on all rows, packed, until it converges (``converged`` says whether it did within ``rounds``).

    It first climbs on ``some`` rows, START_ROWS of the least key hashes, then on
    all rows from there, so that few passes over the table are needed. Deterministic up to the order of sums.
    """
    by_code: dict[int, list] = {}
    for code, x, cats in _unpack(m, some):
        by_code.setdefault(code, []).append((x, cats))
    blocks = [(code, np.concatenate([x for x, _ in own]), np.concatenate([c for _, c in own])) for code, own in by_code.items()]
    m = _climb(m, lambda m: _sums(m, blocks), tolerance, rounds)

    def statistics(m: Model) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            flat = _sums(m, (b for batch in batches for b in _unpack(m, batch)))
            yield pd.DataFrame({"i": np.arange(len(flat)), "v": flat})

        summed = packed.select("code", "n", "x", "cats").mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
        return np.array([v for _, v in sorted(summed.collect())])  # as many rows as the model has parameters

    return _climb(m, statistics, tolerance, rounds)


def _cells(m: Model, targets: list[Number], fill_categories: list[str]):
    place = {c: i for i, c in enumerate(m.numbers)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = _Step(m)
        for batch in batches:
            for (code, x, cats), keys in zip(_unpack(m, batch), batch["keys"]):
                o, r, gaps, _ = step.expect(code, x, cats)
                for t in targets:
                    i = place[t.name]
                    if o[i]:
                        continue
                    v = sum(r[:, g] * gaps[g][:, (~o)[:i].sum()] for g in range(len(gaps))) * m.scale[i] + m.centre[i]
                    v = np.clip(v, t.low, t.high)
                    yield pd.DataFrame({"row_key": keys, "column_name": t.name, "number": np.rint(v) if t.whole else v, "category": None})
                for c in fill_categories:
                    i = list(m.categories).index(c)
                    gap = cats[:, i] < 0
                    best = (r[gap] @ m.theta[i]).argmax(1)
                    yield pd.DataFrame({"row_key": np.asarray(keys)[gap], "column_name": c, "number": np.nan, "category": np.array(m.categories[c], dtype=object)[best]})

    return run


def fitted(features: DataFrame, numbers: list[Number], categories: dict[str, list[str]] | None = None, groups: int = 4, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> tuple[Model | None, DataFrame, DataFrame]:
    """(model, packed rows, plain rows) of ``features``; the model is None without any number."""
    categories = categories or {}
    x = features.select("row_key", *[valid(n).alias(n.name) for n in numbers], *[F.col(c).cast("string").alias(c) for c in categories])
    names, key = [n.name for n in numbers], dict(x.dtypes)["row_key"]
    # the joins and checks behind the features are done once
    packed = durable(x.mapInPandas(_pack(names, categories), f"code int, n int, x binary, cats binary, keys array<{key}>"))
    m, some = start(packed, names, categories, groups)
    return (m if m is None else fit(m, some, packed, tolerance, rounds)), packed, x


def fill_cells(features: DataFrame, numbers: list[Number], categories: dict[str, list[str]] | None = None, fill_categories: list[str] = (), groups: int = 4, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """(row_key, column_name, number, category): one row for each cell that must be filled, with its fill.

    ``features`` has row_key and the numeric and categorical columns; numbers
    outside what their column can hold count as missing, and so do categories
    that aren't listed. Rows in which nothing is observed get the overall
    expectation. A table without any number has nothing to learn from: its cells
    come out with NULL fills. An empty table gives no rows. Repeated rows are
    filled each; they weigh in the fit as often as they occur.
    """
    targets = [n for n in numbers if n.fill]
    m, packed, x = fitted(features, numbers, categories, groups, tolerance, rounds)
    schema = f"row_key {dict(x.dtypes)['row_key']}, column_name string, number double, category string"
    if m is None:
        cells = F.array_compact(F.array(*[F.when(F.col(t.name).isNull(), t.name) for t in targets], *[F.when(F.col(c).isNull(), c) for c in fill_categories]))
        return x.select("row_key", F.explode(cells).alias("column_name"), F.lit(None).cast("double").alias("number"), F.lit(None).cast("string").alias("category"))
    if not m.converged:
        warnings.warn(f"the fit gained {m.log_likelihood[-1] - m.log_likelihood[-2]:.2g} a row in its last round of {rounds}", stacklevel=2)
    if not fill_categories:
        whole = sum(1 << m.numbers.index(t.name) for t in targets)
        packed = packed.filter(F.col("code").bitwiseAND(whole) != whole)
    return packed.mapInPandas(_cells(m, targets, list(fill_categories)), schema)


def fill_table(df: DataFrame, row_key: str, cells: DataFrame, numbers: list[Number]) -> DataFrame:
    """``df`` with its cells filled, and a boolean ``<column>_filled`` for each column that may be."""
    targets = [n for n in numbers if n.fill]
    wide = cells.groupBy("row_key").agg(*[F.max(F.when(F.col("column_name") == t.name, F.col("number"))).alias(f"_fill_{t.name}") for t in targets], *[F.max(F.col("column_name") == t.name).alias(f"_gap_{t.name}") for t in targets])
    out = df.join(wide.withColumnRenamed("row_key", "_row_key"), F.col(row_key) == F.col("_row_key"), "left")
    for t in targets:
        kind = dict(df.dtypes)[t.name]
        marked = F.coalesce(F.col(f"_gap_{t.name}"), F.lit(False))
        out = out.withColumns({t.name: F.when(marked, F.col(f"_fill_{t.name}").cast(kind)).otherwise(F.col(t.name)), f"{t.name}_filled": marked})
    return out.drop("_row_key", *[f"_fill_{t.name}" for t in targets], *[f"_gap_{t.name}" for t in targets])
