"""Whitening of embeddings by exact covariances, found from squares alone (polarisation).

Entries become whole numbers x = floor(64 c) + 1000000. One pass sums them; a second one sums the squares of the centred
values of every dimension and of the sum of every two dimensions, exactly. Half the difference between the variance of a
sum and the variances of its parts is their covariance; the matrix of all goes to ``eigh``. What the driver gets is one
number for each pair of dimensions, whatever the number of rows.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import table

#: Components returned at most.
COMPONENTS = 32
#: Components whose variance is below this share of the largest one are rounding alone and are left out.
LEAST = 1e-12
#: Most dimensions: a task holds a few square matrices of this width, the driver one.
WIDEST = 2048


def whole_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, x array<long>`` of the rows whose vector holds finite numbers only; null vectors go too."""
    v = F.col(f"`{vector}`")
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    kept = rows.where(v.isNotNull() & F.forall(v, finite))
    whole = F.transform(v, lambda c: F.when(finite(c), F.floor(c.cast("double") * 64) + 1_000_000))
    return kept.select(F.col(f"`{key}`").cast("long").alias(key), whole.alias("x"))


def sums(whole: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and their exact sum; vectors of several lengths raise ``ValueError``."""
    one = whole.agg(F.count("*").alias("n"), F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    if not one["n"]:
        return 0, []
    if one["least"] != one["most"]:
        raise ValueError(f"vectors have {one['least']} to {one['most']} entries")
    if one["most"] > WIDEST:
        raise ValueError(f"vectors have at most {WIDEST} entries")
    each = whole.select(F.posexplode("x").alias("d", "x")).groupBy("d").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s")).collect()
    found = {r["d"]: int(r["s"]) for r in each}
    return one["n"], [found[d] for d in range(one["most"])]


def _matrix(column) -> np.ndarray:
    """The vectors of an Arrow list column as one matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def squares(whole: DataFrame, n: int, total: list[int]) -> dict[tuple[int, int], int]:
    """The exact sum over all vectors of ``(n (x_i + x_j) - S_i - S_j)^2`` for i < j, and of ``(n x_i - S_i)^2`` for i = j.

    Rows are centred on the whole number next to the mean, so that the squares of a batch fit 64 bits (checked; else Python's
    integers are used); what is left of the mean is put in at the end, exactly: the sum of ``(n u - r)^2`` over rows whose u
    add up to r is n^2 times the sum of u^2, less n r^2.
    """
    d = len(total)
    middle = [round(Fraction(s, n)) for s in total]
    rest = [s - n * m for s, m in zip(total, middle, strict=True)]
    upper = np.triu_indices(d)

    def gather(batches):
        kept: np.ndarray | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                u = _matrix(batch.column(0).slice(at, 1024)) - np.array(middle, np.int64)
                if int(np.abs(u).max(initial=0)) >= 2**25:
                    u = u.astype(object)
                found = np.zeros((d, d), object)
                for i in range(d):
                    both = u[:, i:] + u[:, i : i + 1]
                    both[:, 0] = u[:, i]
                    found[i, i:] = (both * both).sum(axis=0)
                kept = found if kept is None else kept + found
        if kept is not None:
            yield pd.DataFrame({"i": upper[0], "j": upper[1], "q": [str(x) for x in kept[upper]]})

    parts = whole.select("x").mapInArrow(_framed(gather), "i int, j int, q string")
    each = parts.groupBy("i", "j").agg(F.sum(F.col("q").cast("decimal(38,0)")).alias("q")).collect()
    found = {}
    for r in each:
        i, j = r["i"], r["j"]
        left = rest[i] if i == j else rest[i] + rest[j]
        found[i, j] = n * n * int(r["q"]) - n * left * left
    return found


def _framed(gather):
    """A generator of pandas frames as one of Arrow batches."""

    def run(batches):
        import pyarrow as pa

        for frame in gather(batches):
            frame = frame.astype({c: "int32" for c in frame.columns if c in ("i", "j")})
            yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    return run


def covariance(squared: dict[tuple[int, int], int], n: int, d: int) -> np.ndarray:
    """Covariances (divisor n) of x: half of what the square of a sum has over the squares of its parts."""
    out = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            twice = 2 * squared[i, i] if i == j else squared[i, j] - squared[i, i] - squared[j, j]
            out[i, j] = out[j, i] = float(Fraction(twice, 2 * n**3))
    return out


def components(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues from large to small, their unit vectors as columns, and the trace; those of no variance are left out."""
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > LEAST * max(values.max(initial=0.0), 0.0)]
    return values[order], vectors[:, order], float(np.trace(v))


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error`` for each vector and component.

    Null vectors and those with null or non-finite entries are dropped; repeated rows and null keys stay and count; other
    columns are ignored, whatever their names. Without any vector, or with vectors that are all the same or have no
    entries, there are no components and no rows. Vectors of several lengths raise ``ValueError``, and so do deviations
    beyond 64 bits. Three passes over the vectors: sums, squares, and the whitened values, whose covariance is measured.
    """
    schema = f"{key} long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = rows.sparkSession
    whole = whole_vectors(rows, key, vector)
    n, total = sums(whole)
    if not total:
        return spark.createDataFrame([], schema)
    values, basis, trace = components(covariance(squares(whole, n, total), n, len(total)), most)
    if not len(values):
        return spark.createDataFrame([], schema)
    k = len(values)
    middle = np.array([round(Fraction(s, n)) for s in total], np.int64)
    rest = np.array([s - n * int(m) for s, m in zip(total, middle, strict=True)], np.int64)
    scaled = basis / np.sqrt(values)
    explained = values / trace

    def project(x: np.ndarray) -> np.ndarray:
        return ((x - middle) - rest / n) @ scaled

    def moments(batches):
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                w = project(_matrix(batch.column(0).slice(at, 4096)))
                first += w.sum(axis=0)
                second += w.T @ w
        i, j = np.indices((k, k + 1))
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "m": np.c_[second, first].ravel()})

    found = np.zeros((k, k + 1))
    for r in whole.select("x").mapInArrow(_framed(moments), "i int, j int, m double").groupBy("i", "j").agg(F.sum("m").alias("m")).collect():
        found[r["i"], r["j"]] = r["m"] / n
    error = float(np.abs(found[:, :k] - np.outer(found[:, k], found[:, k]) - np.eye(k)).max())

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _matrix(part.column(1))
                u = x - middle
                if int(np.abs(u).max(initial=0)) * n >= 2**62:
                    u = u.astype(object)
                z = u * n - rest
                if float((z.astype(float) ** 2).sum(axis=1).max(initial=0.0)) >= 2**63:
                    raise ValueError("a deviation is beyond 64 bits")
                m = len(part)
                dev = pa.array((z * z).sum(axis=1).astype(np.int64)).take(pa.array(np.repeat(np.arange(m), k)))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), dev,
                        pa.array(project(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    ],
                    names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return whole.mapInArrow(work, schema)


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of ``embeddings``, whitened on up to 32 components."""
    return whiten(table(spark, sf_dir, "embeddings"))
