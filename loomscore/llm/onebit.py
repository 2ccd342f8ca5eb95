"""Approximate nearest neighbours by randomly rotated one-bit codes, with error bounds that choose what is reranked."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

#: Bits to which a rotated query is rounded; the rounding is part of the error bound.
PLANES = 8


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each vector: its code (the signs of the rotated components, packed into 64-bit words), its norm, and the cosine
    between it and its code's vector, by which estimates are corrected."""
    rotated = vectors @ turn
    norm = np.linalg.norm(vectors, axis=1)
    fit = np.abs(rotated).sum(axis=1) / (np.sqrt(vectors.shape[1]) * norm)
    bits = np.zeros((len(vectors), -(-vectors.shape[1] // 64) * 64), bool)
    bits[:, : vectors.shape[1]] = rotated > 0
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64), norm, fit


def estimate(
    codes: np.ndarray, norm: np.ndarray, fit: np.ndarray, queries: np.ndarray, turn: np.ndarray, sigmas: float
) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries by codes), and how far the true ones may be away."""
    dim = queries.shape[1]
    rotated = queries @ turn
    low = rotated.min(axis=1, keepdims=True)
    step = np.maximum(rotated.max(axis=1, keepdims=True) - low, 1e-300) / (2**PLANES - 1)
    level = np.zeros((len(queries), codes.shape[1] * 64), np.uint8)
    level[:, :dim] = np.rint((rotated - low) / step)
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    total = np.zeros((len(queries), len(codes)))
    for k in range(PLANES):
        plane = np.packbits((level >> k) & 1, axis=1, bitorder="little").view(np.uint64)
        for w in range(codes.shape[1]):
            total += np.bitwise_count(plane[:, w : w + 1] & codes[:, w]) * float(2**k)
    chosen = step * total + low * ones
    whole = step * level[:, :dim].sum(axis=1, keepdims=True) + low * dim
    cosine = (2 * chosen - whole) / np.sqrt(dim)
    away = np.linalg.norm(queries, axis=1)[:, None] * (sigmas * np.sqrt(np.maximum(0, 1 - fit**2) / max(1, dim - 1)))
    away = away + step * np.sqrt(dim) / 2
    scale = norm / fit
    return cosine * scale, away * scale


def nearest(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    every: int = 20,
    k: int = 20,
    sigmas: float = 3.0,
    data_block: int = 32768,
    query_block: int = 32768,
    seed: int = 11,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose key is divisible by `every`, the k rows with the largest inner product.

    Rows are encoded where they lie. The query set meets all rows in blocks: rows are dealt by hash into runs of about
    data_block, queries into runs of about query_block, and each pair of runs is one group; keys are distinct, so a run is as even as a hash
    deals. There, all codes are estimated; the 4k best estimates are scored exactly, and a row is reranked with its
    original vector if its upper bound reaches the k-th of those scores. With 3 sigmas a true neighbour is missed about once in a thousand. The k best of each
    group are merged by query. Scores are exact inner products in double precision; ties go to the smaller key.

    What is shuffled grows with queries times rows, as the query set is a share of the rows: n (n / every) (1 / data_block + 1 / query_block)
    vectors for n rows, in the precision of the column (vectors travel with their codes: of a large group of near copies all would be
    candidates of each other, and as pairs they would be the square of the group). At most k rows for each query and run of data come out.

    Vectors that are null, zero, or hold a null or non-finite component, and rows with a null key, take no part; vectors of
    unlike length are not compared; of rows that repeat a key one stands, the one with the greatest vector in the order of arrays, so the
    order of rows changes nothing; other columns are not read; an empty table gives an empty result."""
    kind = vectors.schema[vector].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("v"))
    sound = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(sound)
    rows = rows.groupBy("id").agg(F.max("v").alias("v")).withColumn("dim", F.size("v"))

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                own = batch.filter(pa.array(dims == dim))
                x = own.column(1).flatten().to_numpy().reshape(-1, dim).astype(np.float64)
                codes, norm, fit = encode(x, rotation(dim, seed))
                packed = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), own.column(2), packed, pa.array(norm), pa.array(fit)],
                    names=["id", "v", "dim", "code", "norm", "fit"],
                )

    coded = settle(rows.mapInArrow(code, f"id long, v {kind}, dim int, code binary, norm double, fit double"))
    n = coded.count()
    # A small table is cut finer, so that all cores have a run.
    cores = min(vectors.sparkSession.sparkContext.defaultParallelism, n // 1024)
    across, down = max(1, cores, -(-n // data_block)), max(1, -(-(n // every) // query_block))
    grid = lambda runs: F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))
    data = coded.withColumn("r", F.pmod(F.xxhash64("id"), F.lit(across)).cast("int")).withColumn("c", grid(down))
    asked = coded.filter(F.col("id") % every == 0).select("id", "v", "dim")
    asked = asked.withColumn("c", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(down)).cast("int")).withColumn("r", grid(across))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if left.empty or right.empty:
            return empty
        left = left.sort_values("id")
        asked = right.sort_values("id")
        dim = int(left["dim"].iloc[0])
        turn = rotation(dim, seed)
        ids, x = left["id"].to_numpy(), np.stack(left["v"].to_numpy()).astype(np.float64)
        codes = np.frombuffer(b"".join(left["code"]), np.uint64).reshape(len(left), -1)
        norm, fit = left["norm"].to_numpy(), left["fit"].to_numpy()
        names, q = asked["id"].to_numpy(), np.stack(asked["v"].to_numpy()).astype(np.float64)
        out = []
        for at in range(0, len(q), 32):
            guess, away = estimate(codes, norm, fit, q[at : at + 32], turn, sigmas)
            own = ids == names[at : at + 32, None]
            guess[own] = -np.inf
            upper = guess + away
            for j in range(len(guess)):
                first = np.argpartition(guess[j], -4 * k)[-4 * k :] if len(ids) > 4 * k else np.arange(len(ids))
                first = first[guess[j][first] > -np.inf]
                exact = np.sort((x[first] * q[at + j]).sum(axis=1))
                bar = exact[-k] if len(exact) >= k else -np.inf
                near = np.flatnonzero((upper[j] >= bar) & (upper[j] > -np.inf))
                score = (x[near] * q[at + j]).sum(axis=1)  # row by row, so that equal vectors have equal scores
                best = near[np.lexsort((ids[near], -score))[:k]]
                out.append((np.full(len(best), names[at + j]), ids[best], (x[best] * q[at + j]).sum(axis=1)))
        a, b, c = map(np.concatenate, zip(*out, strict=True))
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": c})

    by = ["dim", "r", "c"]
    found = data.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
