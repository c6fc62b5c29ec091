"""The k most similar vectors by cosine, exactly, as a block matrix join.

Vectors travel as int8 codes with a bound on what they leave out. Base vectors are cut into stripes, queries into groups; a cell
of the grid holds one stripe and streams one group past it. Within a stripe vectors are ordered by pivots into tiles, and a
tile that is too far from a query by its centroid and radius is skipped. The product of codes and its bounds leave few pairs
that can enter a query's list; only these fetch their floats, are computed again in double precision and merged by heaps.
Nothing is lost to quantisation: the result equals brute force.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from docmill.session import cut_lineage

#: Most base vectors in a stripe, most queries in a group, base vectors in a tile, vectors in a block on the wire.
STRIPE, GROUP, TILE, BLOCK = 1 << 20, 1 << 20, 4_096, 1_024
#: Rows of a side that is broadcast (at most 16 MB for the pairs, 26 MB for query vectors of 64 numbers); a longer one is joined by shuffle.
MOST_BROADCAST = 100_000


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of unit vectors, the scale of each, and the norm of what each leaves out."""
    scale = np.maximum(np.abs(unit).max(1, initial=0.0), 1e-12) / 127
    codes = np.rint(unit / scale[:, None])
    rest = unit - codes * scale[:, None]
    return codes.astype(np.int8), scale.astype(np.float32), (np.sqrt((rest * rest).sum(1)) + 1e-7).astype(np.float32)


def unit_vectors(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def raise_floor(k: int, q: np.ndarray, low: np.ndarray, heap: np.ndarray) -> None:
    """Merges lower bounds (q, low) into the heaps of the k highest of each query, in place."""
    touched = np.unique(q)
    if not len(touched):
        return
    qs = np.concatenate([q, np.repeat(touched, k)])
    ls = np.concatenate([low, heap[touched].ravel()])
    order = np.lexsort((-ls, qs))
    qs, ls = qs[order], ls[order]
    heap[touched] = ls[np.searchsorted(qs, touched)[:, None] + np.arange(k)[None, :]]


class Stripe:
    """The base vectors of one cell: ids, codes, scales and bounds, in tiles around pivots."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, scale: np.ndarray, rest: np.ndarray):
        n = len(ids)
        pivots = codes[:: max(1, n // max(1, min(256, n // 1024)))][:256].astype(np.float32)
        pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
        near = np.concatenate([(codes[i : i + TILE].astype(np.float32) @ pivots.T).argmax(1) for i in range(0, n, TILE)]) if n else np.zeros(0, int)
        order = np.argsort(near, kind="stable")
        cuts = np.concatenate([[0], np.nonzero(np.diff(near[order]))[0] + 1, [n]]) if n else np.zeros(1, int)
        self.tiles = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            for lo in range(a, b, TILE):
                at = order[lo : min(lo + TILE, b)]
                c = codes[at].astype(np.float32)
                length = np.linalg.norm(c, axis=1)
                centre = (c / length[:, None]).mean(0)
                centre /= max(float(np.linalg.norm(centre)), 1e-12)
                reach = np.arccos(np.clip(c @ centre / length, -1, 1)) + np.arcsin(np.minimum(rest[at], 1))
                # the bound is one more number of the vector, so that one product gives what a pair may reach
                self.tiles.append((ids[at], np.hstack([c * scale[at, None], rest[at, None]]).T.copy(), rest[at], float(reach.max()), centre))
        self.centres = np.stack([t[4] for t in self.tiles]) if self.tiles else np.zeros((0, codes.shape[1]), np.float32)
        self.radii = np.array([t[3] for t in self.tiles], np.float32)
        self.skipped = 0

    def survivors(self, k: int, q_ids: np.ndarray, codes: np.ndarray, scale: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, ...]:
        """(place of the query, base id, lower bound, upper bound) of all pairs that may be among the k best of a query in this stripe."""
        q = codes.astype(np.float32)
        n = len(q)
        angle = np.arccos(np.clip(q @ self.centres.T / np.linalg.norm(q, axis=1)[:, None], -1, 1))
        best = np.cos(np.maximum(angle - self.radii[None, :] - np.arcsin(np.minimum(rest, 1))[:, None], 0)) + 1e-5  # what a tile may reach
        heap = np.full((n, k), -np.inf, np.float32)
        spare = 1 + float(rest.max(initial=0))
        q = np.hstack([q * scale[:, None], np.full((n, 1), spare, np.float32)])
        held: list[tuple[np.ndarray, ...]] = []
        for t in np.argsort(-best.mean(0)) if n and self.tiles else ():
            ids, c, b_rest, _, _ = self.tiles[t]
            rows = np.nonzero(best[:, t] >= heap[:, -1])[0]
            self.skipped += n - len(rows)
            if not len(rows):
                continue
            # <q,b> = <q',b'> + <q',rb> + <rq,b'> + <rq,rb>, where |q'| <= 1 + |rq| and |b'| <= 1 + |rb|
            every = len(rows) == n
            reach = (q if every else q[rows]) @ c  # with the bound of the base vector
            own = rest[rows] * (1 + 3 * float(b_rest.max())) + 1e-5
            floor = heap[rows, -1]
            fresh = floor == -np.inf
            if fresh.any() and len(ids) > k + 1:  # one more than k, as the query itself may be among them
                low = np.partition(reach[fresh] - 2 * spare * b_rest[None, :], -(k + 1), axis=1)[:, -(k + 1)]
                floor[fresh] = low - own[fresh]
            r, col = np.divmod(np.flatnonzero(reach >= (floor - own)[:, None]), len(ids))
            keep = q_ids[rows[r]] != ids[col]
            r, col = r[keep], col[keep]
            error = own[r] + spare * b_rest[col]
            high = reach[r, col] + own[r]
            raise_floor(k, rows[r], high - 2 * error, heap)
            held.append((rows[r], ids[col], high - 2 * error, high))
        if not held:
            return np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.float32)
        row, ids, low, high = (np.concatenate(x) for x in zip(*held))
        keep = high >= heap[row, -1]
        return row[keep], ids[keep], low[keep], high[keep]


def proper(values: pa.Array, dim: int) -> np.ndarray:
    """Which lists are vectors of `dim` finite numbers, not all zero."""
    lengths = np.asarray(values.value_lengths().fill_null(-1))
    fits = lengths == dim
    at = np.nonzero(fits)[0]
    if len(at):
        flat = values.take(pa.array(at)).flatten()
        x = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)  # null elements turn into NaN
        fits[at] = np.isfinite(x).all(1) & (x != 0).any(1)
    return fits


def grid(n_base: int, n_query: int, cores: int, stripe: int = STRIPE, group: int = GROUP) -> tuple[int, int]:
    """(stripes, groups): as few as the sizes allow, and more stripes where cores would be idle."""
    stripes = max(math.ceil(n_base / stripe), min(2 * cores, math.ceil(n_base / TILE)), 1)
    return stripes, max(math.ceil(n_query / group), 1)


BLOCKS = pa.schema([("cell", pa.int32()), ("role", pa.int8()), ("ids", pa.binary()), ("codes", pa.binary()), ("scales", pa.binary()), ("rests", pa.binary())])


def blocks_of(batches: Iterator[pa.RecordBatch], dim: int, stripes: int, groups: int) -> Iterator[pa.RecordBatch]:
    """The vectors of (id, v, is_query) as blocks of codes for all cells that need them: role 0 for base, 1 for queries.

    A record batch goes out for each stripe or group, so what is held at once does not grow with the grid.
    """
    for batch in batches:
        good = np.nonzero(proper(batch.column("v"), dim))[0]
        if not len(good):
            continue
        ids = batch.column("id").to_numpy(zero_copy_only=False)[good]
        x = batch.column("v").take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        codes, scale, rest = quantise(unit_vectors(x))
        is_query = np.asarray(batch.column("is_query").to_numpy(zero_copy_only=False)).astype(bool)[good]
        mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        stripe, group = (mixed >> np.uint64(33)) % np.uint64(stripes), (mixed >> np.uint64(31)) % np.uint64(groups)
        plan = [(stripe == s, 0, range(s * groups, (s + 1) * groups)) for s in range(stripes)]
        plan += [(is_query & (group == g), 1, range(g, stripes * groups, groups)) for g in range(groups)]
        for mask, role, cells in plan:
            at = np.nonzero(mask)[0]
            for lo in range(0, len(at), BLOCK):
                part = at[lo : lo + BLOCK]
                block = ids[part].tobytes(), codes[part].tobytes(), scale[part].tobytes(), rest[part].tobytes()
                for first in range(cells.start, cells.stop, cells.step * 64):
                    some = range(first, min(first + 64 * cells.step, cells.stop), cells.step)
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([role] * len(some), pa.int8()), *[pa.array([b] * len(some), pa.binary()) for b in block]], schema=BLOCKS)


def survivors_of(batches: Iterator[pa.RecordBatch], k: int, dim: int) -> Iterator[pa.RecordBatch]:
    """The surviving pairs of cells whose blocks come in order: first the base of a cell, then its queries, block by block."""
    current, base, stripe = None, [], None
    for batch in batches:
        for cell, role, *block in zip(*(batch.column(i) for i in range(6))):
            parts = [np.frombuffer(b.as_buffer(), t) for b, t in zip(block, (np.int64, np.int8, np.float32, np.float32))]
            parts[1] = parts[1].reshape(-1, dim)
            if cell.as_py() != current:
                current, base, stripe = cell.as_py(), [], None
            if role.as_py() == 0:
                base.append(parts)
                continue
            if not base:
                continue
            stripe = stripe or Stripe(*(np.concatenate(x) for x in zip(*base)))
            row, ids, low, high = stripe.survivors(k, *parts)
            for lo in range(0, len(row), 1 << 18):
                cut = slice(lo, lo + (1 << 18))
                yield pa.RecordBatch.from_arrays([pa.array(parts[0][row[cut]]), pa.array(ids[cut]), pa.array(low[cut]), pa.array(high[cut])], ["query_id", "neighbor_id", "low", "high"])


def similarities(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """(query_id, neighbor_id, similarity) of pairs with their floats, in double precision."""
    rows = lambda c: unit_vectors(c.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
    for batch in batches:
        sims = np.einsum("ij,ij->i", rows(batch.column("qv")), rows(batch.column("bv"))) if len(batch) else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("neighbor_id"), pa.array(sims)], ["query_id", "neighbor_id", "similarity"])


def often_repeated(rows: DataFrame, k: int, dim: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows without what copies make superfluous, lists of the queries among the copies).

    Of a vector with more than k + 1 exact copies each copy has k others as its nearest, those with the smallest ids, and no
    list of another vector holds more than the k smallest. So those stay as base and the copies need no search: a vector that
    a third of all rows repeat costs no more than one of its own. Copies are told by a 128-bit hash, counted over all rows.
    """
    keys = ["h1", "h2"]
    keyed = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(7), "v")})
    often = cut_lineage(keyed.groupBy(*keys).count().where(F.col("count") > k + 1).select(*keys))
    n = often.count()
    if not n:
        return rows, None
    side = F.broadcast(often) if n <= MOST_BROADCAST else often
    good = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    copies = keyed.join(side, keys, "left_semi").where(good).select("id", "is_query", "v", *keys)
    first = copies.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).where(F.col("n") <= k + 1)
    kept = cut_lineage(first)
    lists = kept.groupBy(*keys).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    asked = copies.where("is_query").select("id", *keys).join(F.broadcast(lists) if n <= MOST_BROADCAST else lists, keys)
    direct = asked.select(F.col("id").alias("query_id"), F.posexplode(F.slice(F.filter("ids", lambda x: x != F.col("id")), 1, k)).alias("pos", "neighbor_id"))
    direct = direct.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "neighbor_id", F.lit(1.0).alias("similarity"))
    rest = keyed.join(side, keys, "left_anti").select("id", "v", "is_query")
    return rest.unionByName(kept.where(F.col("n") <= k).select("id", "v", F.lit(False).alias("is_query"))), direct


def nearest(vectors: DataFrame, k: int = 5, dim: int = 64, id_col: str = "vec_id", vector_col: str = "vectors", query: Column | None = None, cores: int | None = None, stripe: int = STRIPE, group: int = GROUP) -> DataFrame:
    """(query_id, rank, neighbor_id, similarity): the k base vectors most similar to each query, the query itself excluded.

    All proper vectors are base vectors; those for which `query` holds (default: all) are queries. Vectors that are null, of
    another length, all zero or hold null, NaN or infinity take no part; fewer than k + 1 proper vectors give shorter lists.
    Equal similarities are ordered by id. Repeated vectors under other ids are neighbours like any other; the id must be unique.

    The codes of a base vector (80 bytes at 64 numbers) go to as many cells as there are query groups, those of a query to as
    many as there are stripes. A cell holds one stripe and streams its queries, and each cell is a partition of its own.
    Floats are read for surviving pairs only. Counts come from one pass over the id column.
    """
    spark = vectors.sparkSession
    picked = F.lit(True) if query is None else F.coalesce(query, F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v"), picked.alias("is_query")).where(
        F.col("id").isNotNull() & (F.size("v") == dim)
    )
    rows, direct = often_repeated(rows, k, dim)
    n_base, n_query = vectors.agg(F.count("*"), F.count_if(picked)).first()
    stripes, groups = grid(n_base, n_query, cores or spark.sparkContext.defaultParallelism, stripe, group)
    blocks = rows.mapInArrow(lambda b: blocks_of(b, dim, stripes, groups), "cell int, role byte, ids binary, codes binary, scales binary, rests binary")
    blocks = blocks.repartitionById(stripes * groups, "cell").sortWithinPartitions("cell", "role")
    pairs = blocks.mapInArrow(lambda b: survivors_of(b, k, dim), "query_id long, neighbor_id long, low float, high float")
    by_low = Window.partitionBy("query_id").orderBy(F.desc("low"), "neighbor_id")
    pairs = pairs.withColumn("_n", F.row_number().over(by_low))
    floor = F.max(F.when(F.col("_n") == k, F.col("low"))).over(Window.partitionBy("query_id"))
    pairs = cut_lineage(pairs.withColumn("_floor", floor).where(F.col("_floor").isNull() | (F.col("high") >= F.col("_floor"))).select("query_id", "neighbor_id"))
    small = pairs.count() <= MOST_BROADCAST
    held = rows.select("id", "v")
    with_base = held.join(F.broadcast(pairs) if small else pairs, F.col("id") == F.col("neighbor_id")).select("query_id", "neighbor_id", F.col("v").alias("bv"))
    queries = rows.where("is_query").select("id", F.col("v").alias("qv"))
    both = with_base.join(F.broadcast(queries) if n_query <= MOST_BROADCAST else queries, F.col("id") == F.col("query_id")).select("query_id", "neighbor_id", "qv", "bv")
    found = both.mapInArrow(lambda b: similarities(b, dim), "query_id long, neighbor_id long, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "neighbor_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "similarity")
    return found if direct is None else found.unionByName(direct)


def neighbor_pairs(found: DataFrame) -> DataFrame:
    """Distinct unordered pairs (vec_a < vec_b) of the rows of nearest()."""
    return found.select(F.least("query_id", "neighbor_id").alias("vec_a"), F.greatest("query_id", "neighbor_id").alias("vec_b")).distinct()


def brute_force(ids: np.ndarray, x: np.ndarray, k: int) -> pd.DataFrame:
    """For tests: the same lists from one full product."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.einsum("ik,jk->ij", unit, unit)
    np.fill_diagonal(sims, -np.inf)
    rows = []
    for i in range(len(ids)):
        best = np.lexsort((ids, -sims[i]))[: min(k, len(ids) - 1)]
        rows += [(ids[i], r + 1, ids[j]) for r, j in enumerate(best)]
    return pd.DataFrame(rows, columns=["query_id", "rank", "neighbor_id"])
