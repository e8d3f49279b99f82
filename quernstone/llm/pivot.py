"""Exact top-k by inner product over a pivot-distance index.

Vectors become whole numbers, floor(scale * x).  With M the longest vector's length, each stored vector
gets one more coordinate, sqrt(M^2 - |v|^2), and each query a zero: then |q' - v'|^2 =
|q|^2 + M^2 - 2 q.v, so the largest inner products are the least distances and the triangle
inequality holds for them.

- Index: every vector is keyed by its nearest pivot and its distance to it.  Distances are cut
  into annuli of about ``block`` rows.  Pivots and annuli grow with the rows, up to MOST_ANNULI annuli; then the annuli grow.
  For each annulus the least and greatest distance to *every* pivot is known.
- Search: by the triangle inequality, a query is at least as far from an annulus's vectors as its distance to any
  pivot lies outside that annulus's range.  Annuli are visited in order of this bound: first as many as
  hold more than k rows, then some four times as many in each round.  The k-th score found so far is the limit; annuli
  whose bound doesn't allow it are never visited, and only scores that reach it leave a block.

Annuli, not pairs, are shuffled: each meets the queries that visit it in groups of at most QUERIES and
is scored as one matrix product.  An annulus with more than 16 * ``block`` rows is split by a hash.  Pivots are fitted on the ``sample`` vectors
with the least hash of their id; pivots (at most 64) and ranges (64 * MOST_ANNULI) are the only things broadcast.
How much is ruled out depends on the vectors: in clusters most of it, in many dimensions without structure nothing.

Defined results: a vector that is null or holds a null or a value that isn't finite (or isn't when scaled) takes
no part, nor does a null vec_id; a vector shorter than the longest counts as if filled up with zeros;
of rows that share a vec_id each is a candidate for the others and a query of its own (their results
have the same query_id); ties go to the smaller vec_id; fewer than k candidates give fewer rows; products
beyond 53 bits are computed in whole numbers; ranks follow them up to 38 digits, scores
are cut to 64 bits; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored

SCALE = 1024
SAMPLE = 4096
BLOCK = 1024
MOST_PIVOTS = 64
MOST_ANNULI = 4096
QUERIES = 8192
GROWTH = 4
_LONG = 1 << 63


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v array<double> (whole numbers) of the vectors that take part."""
    x = F.col("embedding")
    scaled = lambda e: F.lit(float(scale)) * e.cast("double")
    fine = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(scaled(e)) & (F.abs(scaled(e)) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null").where(fine)
    whole = lambda e: F.when(F.abs(scaled(e)) < 2.0**53, F.floor(scaled(e)).cast("double")).otherwise(scaled(e))
    return rows.select("vec_id", F.transform("embedding", whole).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers; floating-point matrix product where it is exact, else 64-bit or any whole numbers."""
    if not q.size or not v.size:
        return np.zeros((len(q), len(v)), dtype=np.int64)
    most = float(np.abs(q).max()) * float(np.abs(v).max()) * q.shape[1]
    if most < 2.0**53:
        return (q @ v.T).astype(np.int64)
    if most < 2.0**62 and max(np.abs(q).max(), np.abs(v).max()) < 2.0**62:
        return q.astype(np.int64) @ v.T.astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], dtype=object)
    return whole(q) @ whole(v).T


def _lifted(v: np.ndarray, longest: float) -> np.ndarray:
    v = v.astype(np.float64)
    rest = np.sqrt(np.maximum(longest * longest - (v * v).sum(1), 0.0))
    return np.hstack([v, rest[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


class Pivots:
    """Pivots (lifted) and the bounds of each one's annuli."""

    def __init__(self, sample: np.ndarray, longest: float, pivots: int, annuli: int):
        self.longest = longest
        np.seterr(over="ignore", invalid="ignore")
        lifted = _lifted(sample, longest)
        rng = np.random.default_rng(1)
        self.at = lifted[rng.permutation(len(lifted))[: min(pivots, len(lifted))]]
        for _ in range(5):  # a few rounds of k-means
            near = _distances(lifted, self.at).argmin(1)
            self.at = np.stack([lifted[near == p].mean(0) if (near == p).any() else self.at[p] for p in range(len(self.at))])
        d = _distances(lifted, self.at)
        near = d.argmin(1)
        cuts = [np.quantile(d[near == p, p], np.linspace(0, 1, annuli + 1)[1:-1]) if (near == p).any() else np.zeros(annuli - 1) for p in range(len(self.at))]
        self.cuts = np.stack(cuts)
        self.annuli = annuli

    def keyed(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Annulus number (over all pivots) of each vector and its distances to all pivots."""
        d = _distances(_lifted(v, self.longest), self.at)
        p = d.argmin(1)
        return p * self.annuli + (d[np.arange(len(d)), p][:, None] > self.cuts[p]).sum(1), d


def _keyed(width: int, pivots):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                ring, _ = pivots.value.keyed(_matrix(batch.column(2), width))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ring.astype(np.int32))], ["row", "vec_id", "v", "ring"])

    return go


def _ranges(width: int, pivots):
    """Rows of each annulus in a batch and their least and greatest distance to each pivot."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            ring = batch.column(1).to_numpy()
            _, d = pivots.value.keyed(_matrix(batch.column(0), width))
            order = np.argsort(ring, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(ring[order]) != 0))
            k = d.shape[1]
            least, most = np.minimum.reduceat(d[order], first), np.maximum.reduceat(d[order], first)
            n = np.diff(np.append(first, len(ring)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ring[order][first], k)), pa.array(np.tile(np.arange(k, dtype=np.int32), len(first))), pa.array(np.repeat(n, k)), pa.array(least.reshape(-1)), pa.array(most.reshape(-1))],
                ["ring", "pivot", "n", "lo", "hi"],
            )

    return go


class Annuli:
    """Number, rows and ranges to all pivots of the annuli that hold rows."""

    def __init__(self, number: np.ndarray, rows: np.ndarray, least: np.ndarray, most: np.ndarray):
        self.number, self.rows, self.least, self.most = number, rows, least, most

    def bounds(self, d: np.ndarray) -> np.ndarray:
        """Least possible distance of each query to each annulus, from the queries' distances to the pivots."""
        bound = np.zeros((len(d), len(self.number)))
        for p in range(d.shape[1]):
            at = d[:, p][:, None]
            np.maximum(bound, np.fmax(self.least[:, p] - at, at - self.most[:, p]), out=bound)
        return np.where(np.isfinite(bound), bound, 0.0)


def _visits(width: int, pivots, annuli, k: int, turn: int):
    """The annuli of a round: first those with the least bounds that hold enough rows, then further ones that the limit allows."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, a = pivots.value, annuli.value
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                q = _matrix(part.column(2), width)
                bound = a.bounds(_distances(np.hstack([q, np.zeros((len(q), 1))]), p.at))
                order = np.argsort(bound, axis=1, kind="stable")
                held = np.cumsum(a.rows[order], axis=1) - a.rows[order]
                first, place = np.zeros_like(bound, dtype=bool), np.empty_like(order)
                np.put_along_axis(first, order, held < k + 1, axis=1)
                np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
                limit = part.column(3).to_numpy(zero_copy_only=False)  # null: fewer than k found, so nothing is ruled out
                if turn == 0:
                    take = first
                else:
                    length = np.sqrt((q**2).sum(1))
                    reach = np.sqrt(np.maximum(length**2 + p.longest**2 - 2.0 * limit, 0.0))
                    beyond = bound > (reach + 1e-6 * (1.0 + p.longest + length))[:, None]  # false if a limit is null
                    take = ~first & ~beyond & (place < GROWTH ** (turn + 1)) & (place >= (GROWTH**turn if turn > 1 else 0))
                i, r = np.nonzero(take)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(i)), part.column(1).take(pa.array(i)), part.column(2).take(pa.array(i)), part.column(3).take(pa.array(i)), pa.array(a.number[r].astype(np.int32)), pa.array(a.rows[r])],
                    ["query", "query_id", "q", "least", "ring", "rows"],
                )

    return go


def _score(width: int, k: int, wide: bool):
    kind = pa.decimal128(38, 0) if wide else pa.int64()
    schema = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", kind)])
    most = 10**38 - 1

    def go(visits: pa.Table, block: pa.Table) -> pa.Table:
        if not visits.num_rows or not block.num_rows:
            return schema.empty_table()
        ids = block["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, rows, v = ids[order], block["row"].to_numpy()[order], _matrix(block["v"], width)[order]
        asking, names, limits = (visits[c].to_numpy() for c in ("query", "query_id", "least"))
        q = _matrix(visits["q"], width)
        out = []
        for a in range(0, len(q), 256):
            s = products(q[a : a + 256], v)
            for i, scores in enumerate(s):
                fit = rows != asking[a + i]
                limit = limits[a + i]
                if not np.isnan(limit):
                    fit &= scores >= limit - 1e-9 * abs(limit)
                fit = np.flatnonzero(fit)
                best = fit[np.argsort(-scores[fit], kind="stable")[:k]]
                found = pa.array([Decimal(max(-most, min(most, x))) for x in scores[best].tolist()], kind) if wide else pa.array(scores[best])
                out.append(pa.table([pa.array(np.full(len(best), asking[a + i])), pa.array(np.full(len(best), names[a + i])), pa.array(ids[best]), found], schema=schema))
        return pa.concat_tables(out)

    return go


def top_k(vectors: DataFrame, queries: Column, k: int = 10, scale: int = SCALE, pivots: int | None = None, annuli: int | None = None, sample: int = SAMPLE, block: int = BLOCK, report: list | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose row fits ``queries`` (a predicate on vec_id), its k best others.

    ``pivots`` and ``annuli`` (of each pivot): by default by the number of rows.  ``report`` takes up, for each
    round, how many rows were in the annuli visited (summed over the queries); asking for it costs a job each."""
    spark = vectors.sparkSession
    rows = quantized(vectors, scale)
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    n, width, longest, most = rows.agg(F.count("*"), F.max(F.size("v")), F.sqrt(F.max(square)), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(1, width)
    wide = width * (most or 0.0) ** 2 >= 2.0**62
    wanted = max(1, min(MOST_ANNULI, math.ceil(n / block)))
    pivots = pivots or max(1, min(MOST_PIVOTS, round(math.sqrt(wanted))))
    annuli = annuli or max(1, math.ceil(wanted / pivots))
    filled = rows.select("vec_id", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v"))).alias("v"))
    chosen = filled.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).select("v").toArrow()
    model = spark.sparkContext.broadcast(Pivots(_matrix(chosen["v"], width), longest, pivots, annuli))
    numbered = filled.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")
    index = stored(numbered.mapInArrow(_keyed(width, model), "row long, vec_id long, v array<double>, ring int"), "index")
    ranges = index.select("v", "ring").mapInArrow(_ranges(width, model), "ring int, pivot int, n long, lo double, hi double")
    found = ranges.groupBy("ring", "pivot").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("ring", "pivot").toArrow()
    table = {c: found[c].to_numpy().reshape(-1, len(model.value.at)) for c in found.column_names}
    held = Annuli(table["ring"][:, 0], table["n"][:, 0], table["lo"], table["hi"])
    shared = spark.sparkContext.broadcast(held)
    parts = F.create_map(*[F.lit(int(x)) for number, size in zip(held.number, held.rows, strict=True) for x in (number, math.ceil(size / (16 * block)))])
    asked = index.where(queries).select("row", "vec_id", "v")
    slices = math.ceil(max(1, asked.count()) / QUERIES)
    blocks = index.withColumn("part", F.pmod(F.xxhash64("row"), parts[F.col("ring")]).cast("int")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    kind = "decimal(38,0)" if wide else "long"
    best = None
    turn = 0
    while turn == 0 or GROWTH**turn < len(held.number) or turn == 1:
        if best is None:
            limited = asked.withColumn("least", F.lit(None).cast("double"))
        else:
            limits = best.where(F.col("rank") == k).select(F.col("query").alias("row"), F.col("score").cast("double").alias("least"))
            limited = asked.join(limits, "row", "left").select("row", "vec_id", "v", "least")
        visits = limited.mapInArrow(_visits(width, model, shared, k, turn), "query long, query_id long, q array<double>, least double, ring int, rows long")
        if report is not None:
            report.append(visits.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])
        visits = visits.withColumn("part", F.explode(F.sequence(F.lit(0), parts[F.col("ring")] - 1))).withColumn("slice", F.pmod(F.xxhash64("query"), F.lit(slices)).cast("int"))
        keys = ["ring", "part", "slice"]
        scores = visits.groupBy(*keys).cogroup(blocks.select(*keys, "row", "vec_id", "v").groupBy(*keys)).applyInArrow(_score(width, k, wide), f"query long, query_id long, vec_id long, score {kind}")
        best = _best(scores if best is None else best.drop("rank").union(scores), k)
        turn += 1
        if turn == 1 or GROWTH**turn < len(held.number):
            best = stored(best, "best")
    score = F.least(F.greatest("score", F.lit(-_LONG)), F.lit(_LONG - 1)) if wide else F.col("score")
    return best.select("query_id", "rank", "vec_id", score.cast("long").alias("score"))


def _best(scores: DataFrame, k: int) -> DataFrame:
    """The k best of each query: Spark's rank limit cuts before the shuffle, too."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
