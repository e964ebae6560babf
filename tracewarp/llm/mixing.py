"""Mixing sources to target weights by entropy balancing.

Each document gets a rate: how often it should appear. Among all rates that give every category of the constraint
columns its target number of tokens, the ones closest to 1 in Kullback-Leibler divergence over tokens are
exponential tilts, ``rate = exp(sum of the multipliers of the document's categories)``. The multipliers minimise a
convex dual, ``sum(tokens * exp(multipliers of the categories)) - sum(multiplier * target)``, by damped Newton steps.

The dual depends on documents only through the tokens of each combination of categories, so one pass over the corpus
leaves an exact table of cells, however many documents there are; each Newton step is a distributed sum over the
cells of the dual's value, gradient and Hessian. Rates become copies by a coin from a hash of the document's id, with
no shuffle: copies average the rate, and are floor(rate) or one more.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarp.llm.common import map_arrow, quoted, unused, written

#: Token shares are raised to this power and scaled to sum to 1, where no targets are given.
TEMPER = 0.7
#: Upper bounds of the bands of document length whose token shares are kept.
BANDS = (128, 512, 2048)
TOLERANCE, MAX_STEPS = 1e-10, 60
#: A step changes no multiplier by more than LONGEST, is halved up to HALVINGS times until it helps, and the steps end
#: after STALLED that left the error almost as it was: then no rates meet the targets.
LONGEST, HALVINGS, STALLED = 4.0, 12, 5
#: Most categories of all constraints together: the Hessian of so many is solved on the driver.
MAX_CATEGORIES = 5000
SEED = 1
#: Largest error of given targets, as a share of all tokens, that is taken for met.
UNMET = 1e-3


@dataclass
class Tilt:
    """Multipliers by (constraint, category), the steps taken, and the largest error of a target as a share of all tokens."""

    multipliers: dict[tuple[int, str], float]
    steps: int
    error: float


class UnmetTargets(ValueError):
    """No rates meet the given targets, or the corpus has none of their values."""


def token_count(text_col: str = "text") -> Column:
    """Words between white space; 0 for null and blank texts."""
    return F.coalesce(F.regexp_count(quoted(text_col), F.lit(r"\S+")), F.lit(0)).cast("long")


def length_band(tokens: Column) -> Column:
    out = F.lit(str(len(BANDS)))
    for i in reversed(range(len(BANDS))):
        out = F.when(tokens <= BANDS[i], str(i)).otherwise(out)
    return out


def category(c: Column) -> Column:
    """Text for any value, null apart from every other."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


def cells(docs: DataFrame, constraints: list[Column], tokens: Column) -> DataFrame:
    """(c0, c1, ..., tokens): the tokens of each combination of categories."""
    return docs.select(*(category(c).alias(f"c{i}") for i, c in enumerate(constraints)), tokens.alias("tokens")).groupBy(
        *(f"c{i}" for i in range(len(constraints)))
    ).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")


def _sums(table: DataFrame, n: int, index: dict[tuple[int, str], int], lam: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Of the dual's exponential part: value, gradient and Hessian, summed in the executors."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            cats = [b.column(i).to_pylist() for i in range(n)]
            at = np.array([[index.get((i, v), -1) for v in c] for i, c in enumerate(cats)], np.int64).reshape(n, -1)
            inside = (at >= 0).all(0)
            at, t = at[:, inside], b.column(n).to_numpy(zero_copy_only=False)[inside].astype(float)
            w = t * np.exp(lam[at].sum(0))
            i, j = (np.concatenate([at[k[q]] for k in np.ndindex(n, n)]) for q in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(np.tile(w, n * n))], ["i", "j", "w"])

    rows = map_arrow(table, run, "i long, j long, w double").groupBy("i", "j").agg(F.sum("w").alias("w")).collect()
    h = np.zeros((len(lam), len(lam)))
    for r in rows:
        h[r.i, r.j] += r.w
    first = [k for (c, _), k in index.items() if c == 0]
    return float(np.diag(h)[first].sum()), np.diag(h).copy(), h


def solve(table: DataFrame, shares: list[dict[str, float]]) -> Tilt:
    """The tilt of ``table`` (see :func:`cells`) toward token ``shares`` by category, each summing to 1.

    Categories without a positive share get no tokens: documents in them have rate 0. Targets that no rates meet give
    the tilt at which the steps ended, and its error.
    """
    index = {}
    for c, s in enumerate(shares):
        for v in sorted(s):
            if s[v] > 0:
                index[c, v] = len(index)
    if len(index) > MAX_CATEGORIES:
        raise ValueError(f"{len(index)} categories; at most {MAX_CATEGORIES}")
    if not index:
        return Tilt({}, 0, 0.0)
    target, n = np.array([shares[c][v] for c, v in index]), len(shares)
    lam = np.zeros(len(index))
    total = table.agg(F.sum("tokens")).first()[0]
    scaled = table.withColumn("tokens", F.col("tokens") / F.lit(float(total)))
    value, g, h = _sums(scaled, n, index, lam)
    value -= lam @ target
    error, steps, stalled = np.abs(g - target).max(), 0, 0
    while error > TOLERANCE and steps < MAX_STEPS and stalled < STALLED:
        # The categories of a constraint cover the same tokens, so the Hessian has a null space: least squares.
        d = np.linalg.lstsq(h, target - g, rcond=1e-12)[0]
        size, slope = min(1.0, LONGEST / max(np.abs(d).max(), 1e-300)), (g - target) @ d
        for _ in range(HALVINGS):
            tried = lam + size * d
            v, g2, h2 = _sums(scaled, n, index, tried)
            v -= tried @ target
            after = np.abs(g2 - target).max()
            if v <= value + 1e-4 * size * slope or after < error:
                break
            size /= 2
        else:
            break
        steps, stalled = steps + 1, stalled + 1 if after > 0.9 * error else 0
        lam, value, g, h, error = tried, v, g2, h2, after
    return Tilt({k: float(lam[i]) for k, i in index.items()}, steps, float(error))


def _rate(constraints: list[Column], tilt: Tilt) -> Column:
    """exp of the sum of multipliers; 0 for a document in a category without one."""
    log = F.lit(0.0)
    for i, c in enumerate(constraints):
        known = [x for (k, v), m in tilt.multipliers.items() if k == i for x in (F.lit(v), F.lit(m))]
        log = log + (F.try_element_at(F.create_map(*known), category(c)) if known else F.lit(None).cast("double"))
    return F.coalesce(F.exp(log), F.lit(0.0))


def coin(id_col: str, seed: int = SEED) -> Column:
    """A number in [0, 1) from a hash of the id; rows that repeat an id share it."""
    h = F.md5(F.concat(F.coalesce(quoted(id_col).cast("string"), F.lit("null")), F.lit(f":{seed}")))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def tempered(table: DataFrame, n: int, power: float | list[float]) -> list[dict[str, float]]:
    """For each constraint the token shares of ``table`` to the power, scaled to sum to 1."""
    out = []
    for i in range(n):
        p = power[i] if isinstance(power, list) else power
        got = {r[0]: float(r[1]) for r in table.groupBy(f"c{i}").agg(F.sum("tokens")).collect()}
        all_ = sum(got.values())
        s = {v: (t / all_) ** p for v, t in got.items()}
        out.append({v: x / sum(s.values()) for v, x in s.items()})
    return out


def rated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: tuple[str, ...] = ("source", "lang"), targets: dict[str, dict] | None = None, power: float = TEMPER) -> tuple[DataFrame, Tilt]:
    """The documents with ``tokens``, ``rate`` and ``copies`` (replacing columns of these names), and the tilt.

    The constraints are the token shares of each of ``columns`` and of the bands of document length; all tokens
    together stay as many. A column's ``targets`` are shares by value (scaled to sum to 1; values that the corpus
    lacks are left out, values without one get rate 0); otherwise its present shares are tempered by ``power``. Bands
    keep their shares. Given targets that can't be met to ``UNMET``, or of whose values the corpus has none, are an
    :class:`UnmetTargets`; tempered shares that exclude each other, as in tables of a few rows, give the nearest tilt
    and a warning. A null value is a category of its own. Texts that are null or blank have 0 tokens and count
    nowhere, but are rated like others; a combination of categories with no tokens at all may have any rate. Rows that
    repeat are rated alike and count each. An empty table gives none.
    """
    docs = docs.select(*(quoted(c) for c in docs.columns if c.lower() not in ("tokens", "rate", "copies") or c in columns))
    if clash := [c for c in columns if c.lower() in ("tokens", "rate", "copies")]:
        raise ValueError(f"{clash} can't be constraint columns")
    docs = docs.withColumn("tokens", token_count(text_col))
    tokens = F.col("tokens")
    constraints = [*(quoted(c) for c in columns), length_band(tokens)]
    table = written(cells(docs, constraints, tokens), "cells")
    n = len(constraints)
    shares = tempered(table, n, [power] * len(columns) + [1.0])
    for i, c in enumerate(columns):
        if targets and c in targets:
            given = {("null" if v is None else f"={v}"): float(x) for v, x in targets[c].items()}
            given = {v: x for v, x in given.items() if v in shares[i] and x > 0}
            if shares[i] and not given:
                raise UnmetTargets(f"no document with tokens has a value of the targets of {c}")
            shares[i] = {v: x / sum(given.values()) for v, x in given.items()}
    tilt = solve(table, shares)
    if tilt.error > UNMET:
        if targets:
            raise UnmetTargets(f"the targets can't be met together: off by {tilt.error:.2%} of all tokens")
        warnings.warn(f"the tempered shares exclude each other: the nearest tilt is off by {tilt.error:.2%} of all tokens", stacklevel=2)
    out = docs.withColumn("rate", _rate(constraints, tilt))
    return out.withColumn("copies", F.floor(F.col("rate") + coin(id_col)).cast("int")), tilt


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: tuple[str, ...] = ("source", "lang"), targets: dict[str, dict] | None = None, power: float = TEMPER) -> DataFrame:
    """The documents, each repeated its number of copies (0: it goes), with the columns they had; see :func:`rated`."""
    ids = unused(docs.columns, "__copies")
    rows, _ = rated(docs.withColumns({unused(docs.columns, f"__had_{c}"): quoted(c) for c in docs.columns if c.lower() in ("tokens", "rate", "copies")}), id_col, text_col, columns, targets, power)
    back = [quoted(unused(docs.columns, f"__had_{c}")).alias(c) if c.lower() in ("tokens", "rate", "copies") else quoted(c) for c in docs.columns]
    # No filter on the copies: it would be pushed below the count of tokens and repeat it. No copies explode to no row.
    repeated = rows.withColumn(ids, F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
    return repeated.select(*back)
