"""Whitening of embeddings by hierarchical merging of singular value decompositions.

The vectors to fit on are each distinct vector once, in whole numbers.  A partition's state is its number of
vectors, their sum, mean, singular values and right singular vectors, all of them.  Blocks of rows, then
partitions, then groups of states are merged: the scaled right vectors of both sides and one row that corrects
for the distance of the means are stacked and decomposed again, which loses nothing beyond rounding.  Partition
states are written to the shared folder and merged ``FAN_IN`` at a time by Spark until one is left; a
state has as many numbers as a square of the dimension, whatever the number of rows.  Eigenvectors of the covariance
are the right singular vectors, eigenvalues the squared singular values over n.

Defined results: vectors that are null or hold null or non-finite entries are dropped, and so are those whose length is
not the most frequent one (the longer of a tie); null ids and repeated rows are kept; components without variance are
not given out, so equal vectors alone have none; an empty table gives no rows; further columns are not read, so they
cannot clash.  Quantised entries are held within +-2^52 (embeddings lie far below).  ``deviation`` is exact, null beyond 63 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm.storage import Scratch

FAN_IN = 16
BLOCK_ROWS = 4096
COMPONENTS = 16
STATE = "n long, total array<decimal(38,0)>, mean array<double>, s array<double>, vt array<double>"


@dataclass
class State:
    """Count, exact sum, mean, singular values and right singular vectors (rows) of centred rows."""

    n: int
    total: list[int]
    mean: np.ndarray
    s: np.ndarray
    vt: np.ndarray

    @property
    def values(self) -> np.ndarray:
        return self.s**2 / self.n


def decompose(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All singular values and right vectors of ``rows``, at most one for each dimension."""
    if len(rows) > rows.shape[1]:
        rows = np.linalg.qr(rows, mode="r")
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    return s, vt


def of_rows(x: np.ndarray, total: list[int]) -> State:
    """``total`` is the exact sum of whole-number rows."""
    mean = np.array([t / len(x) for t in total])
    s, vt = decompose(x - mean)
    return State(len(x), total, mean, s, vt)


def merge(a: State, b: State) -> State:
    n, apart = a.n + b.n, b.mean - a.mean
    s, vt = decompose(np.vstack([a.s[:, None] * a.vt, b.s[:, None] * b.vt, np.sqrt(a.n * b.n / n) * apart]))
    return State(n, [x + y for x, y in zip(a.total, b.total, strict=True)], a.mean + apart * (b.n / n), s, vt)


def merge_all(states: list[State]) -> State:
    """Merge in pairs, level by level, so that each row passes few decompositions."""
    while len(states) > 1:
        states = [merge(*states[i : i + 2]) if i + 1 < len(states) else states[i] for i in range(0, len(states), 2)]
    return states[0]


def _record(state: State) -> pa.RecordBatch:
    from decimal import Decimal

    columns = [[state.n], [[Decimal(t) for t in state.total]], [state.mean], [state.s], [state.vt.ravel()]]
    kinds = [pa.int64(), pa.list_(pa.decimal128(38, 0)), *[pa.list_(pa.float64())] * 3]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["n", "total", "mean", "s", "vt"])


def _state(row: dict) -> State:
    mean = np.asarray(row["mean"], float)
    return State(int(row["n"]), [int(t) for t in row["total"]], mean, np.asarray(row["s"], float), np.asarray(row["vt"], float).reshape(-1, len(mean)))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _fit_partition(exact: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels: list[State | None] = []  # like a binary counter: level k holds 2^k blocks
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                x = matrix(batch.column("x").slice(at, BLOCK_ROWS))
                state = of_rows(x, [int(t) for t in (x.astype(object).sum(0) if exact and np.abs(x).max(initial=0) > 1 << 50 else x.sum(0))] if exact else (x.sum(0)).tolist())
                k = 0
                while k < len(levels) and levels[k] is not None:
                    state, levels[k], k = merge(levels[k], state), None, k + 1
                levels += [None] * (k + 1 - len(levels))
                levels[k] = state
        if left := [s for s in levels if s is not None]:
            state = merge_all(left)
            yield _record(state if exact else State(state.n, [0] * len(state.mean), state.mean, state.s, state.vt))

    return run


def fit(rows: DataFrame, scratch: Scratch, name: str = "states", exact: bool = True) -> State | None:
    """The merged state of all rows of the column ``x``; None for no rows.

    With ``exact``, x holds whole numbers and ``total`` their exact sums.
    """
    states = scratch.keep(rows.select("x").mapInArrow(_fit_partition(exact), STATE), f"{name}-0")
    level, left = 0, states.count()

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        from decimal import Decimal

        found = merge_all([_state(r) for r in group.to_dict("records")])
        return pd.DataFrame([{"n": found.n, "total": [Decimal(t) for t in found.total], "mean": found.mean, "s": found.s, "vt": found.vt.ravel()}])

    while left > 1:
        groups = -(-left // FAN_IN)
        numbered = states.withColumn("g", F.pmod(F.xxhash64("n", "mean", "s"), F.lit(groups)))
        level += 1
        states = scratch.keep(numbered.groupBy("g").applyInPandas(lambda g: merged(g.drop(columns="g")), STATE), f"{name}-{level}")
        left = states.count()
    row = states.first()
    return _state(row.asDict()) if row else None


def quantised(embeddings: DataFrame, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """vec_id and the whole numbers ``x`` of all rows with a usable vector of the most frequent length."""
    v = F.col(vector)
    good = v.isNotNull() & F.forall(v, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    sized = embeddings.where(good).select(F.col(id_col).alias("vec_id"), v.alias("v"))
    lengths = sized.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("k")).where("d > 0").orderBy(F.desc("k"), F.desc("d")).first()
    bound = float(1 << 52)
    entry = lambda c: (F.least(F.greatest(F.floor(F.lit(64.0) * c.cast("double")).cast("double"), F.lit(-bound)), F.lit(bound)).cast("long") + F.lit(1_000_000).cast("long"))
    return sized.where(F.size("v") == (lengths.d if lengths else -1)).select("vec_id", F.transform("v", entry).alias("x"))


@dataclass(frozen=True)
class Whitening:
    """What projects a vector: the fit list's size and sums, unit directions by falling variance, and their variances."""

    n: int
    total: tuple[int, ...]
    directions: np.ndarray
    variances: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """x - total / n, and the exact sum of squares of n * x - total (None beyond 63 bits)."""
        small = self.n * (int(np.abs(x).max(initial=0)) + 1) < 1 << 62
        apart = self.n * x - np.array(self.total, np.int64) if small else self.n * x.astype(object) - np.array(self.total, object)
        exact = apart if small and len(apart) and np.square(apart.astype(float)).sum(1).max() < 2.0**62 else apart.astype(object)
        return (apart / self.n).astype(float), [int(t) if t < 1 << 63 else None for t in (exact**2).sum(1)]


def whitening_of(state: State, components: int = COMPONENTS) -> Whitening:
    values, trace = state.values, float(state.values.sum())
    usable = int((state.s > max(state.s[0], np.abs(state.mean).max()) * len(state.mean) * 4 * np.finfo(float).eps).sum()) if trace > 0 else 0
    kept = min(components, usable)
    return Whitening(state.n, tuple(state.total), state.vt[:kept], values[:kept], trace)


def _project(model: Whitening) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            centred, deviation = model.centred(matrix(batch.column("x")))
            out = centred @ model.directions.T / np.sqrt(model.variances)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))
            rest = [batch.column(c) for c in batch.schema.names if c != "x"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(deviation, pa.int64()), lists], names=[*(c for c in batch.schema.names if c != "x"), "deviation", "x"])

    return run


def project(rows: DataFrame, model: Whitening) -> DataFrame:
    """Replace ``x`` by its whitened coordinates and add ``deviation``."""
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "x"]
    return rows.mapInArrow(_project(model), ", ".join([*kept, "deviation long", "x array<double>"]))


def whiten(embeddings: DataFrame, *, components: int = COMPONENTS, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """Each usable row's whitened coordinates, with the figures of the fit."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "whitening")
    rows = quantised(embeddings, vector, id_col)
    fitted = scratch.keep(rows.select("x").distinct(), "distinct")
    state = fit(fitted, scratch)
    kind = rows.schema["vec_id"].dataType.simpleString()
    model = whitening_of(state, components) if state else None
    if model is None or not len(model.variances):
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    check = fit(project(fitted, model), scratch, "check", exact=False)
    covariance = check.vt.T @ (check.values[:, None] * check.vt)
    error = float(np.abs(covariance - np.eye(len(covariance))).max())
    explained: Column = F.element_at(F.array(*[F.lit(float(v / model.trace)) for v in model.variances]), F.col("pos") + 1)
    coordinates = project(rows, model).select("vec_id", "deviation", F.posexplode("x").alias("pos", "whitened"))
    return coordinates.select("vec_id", (F.col("pos") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of all embeddings, 16 components."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
