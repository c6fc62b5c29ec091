"""Exact retrieval by cosine with parent context."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from docmill.functions.text import preview

#: Most query vectors that are broadcast as one matrix; more go through a grid of blocks. Most chunks and queries of a cell of that grid, and of a block.
MOST_QUERIES, STRIPE, GROUP, BLOCK = 1000, 1 << 17, 1 << 13, 1024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null where one is null or has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def score(distance: Column) -> Column:
    """Similarity from a cosine distance: not below 0, four decimals."""
    return F.round(F.greatest(F.lit(0.0), 1 - distance), 4)


def units(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(places of the vectors of finite numbers that have a length, these as rows of length one). All must have one dimension."""
    sizes = np.asarray(vectors.value_lengths().fill_null(0))
    at = np.nonzero(sizes > 0)[0]
    if not len(at):
        return at, np.zeros((0, 0))
    if len(set(sizes[at])) > 1:
        raise ValueError(f"vectors of {sorted(set(sizes[at]))} numbers among those compared")
    x = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), -1)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    x = x[good] / np.abs(x[good]).max(1, keepdims=True)
    return at[good], x / np.sqrt((x * x).sum(1, keepdims=True))


class Best:
    """The k most similar of all rows seen so far for each of some queries; equal similarities by id."""

    def __init__(self, k: int, query: np.ndarray):
        self.k, self.query = k, query
        self.of, self.ids, self.sims = np.zeros(0, int), np.zeros(0, object), np.zeros(0)
        self.floor = np.full(len(query), -np.inf)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        sims = self.query @ x.T
        if len(ids) > self.k:
            self.floor = np.maximum(self.floor, np.partition(sims, -self.k, axis=1)[:, -self.k])
        q, c = np.nonzero(sims >= self.floor[:, None])
        of, held, sims = np.concatenate([self.of, q]), np.concatenate([self.ids, ids[c]]), np.concatenate([self.sims, sims[q, c]])
        order = np.lexsort((np.unique(held, return_inverse=True)[1], -sims, of))
        of = of[order]
        keep = np.arange(len(of)) - np.searchsorted(of, of) < self.k
        self.of, self.ids, self.sims = of[keep], held[order][keep], sims[order][keep]
        full = np.bincount(self.of, minlength=len(self.query)) >= self.k
        last = np.searchsorted(self.of, np.nonzero(full)[0], "right") - 1
        self.floor[full] = np.maximum(self.floor[full], self.sims[last])

    def rows(self, query_ids: pa.Array, kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([query_ids.take(pa.array(self.of)), pa.array(self.ids.tolist(), kind), pa.array(1 - self.sims)], ["query_id", "id", "distance"])


def _few(rows: DataFrame, queries: DataFrame, k: int, schema: str) -> DataFrame:
    """Pairs by a matrix of all queries in every task; each task sends k rows a query."""
    held = queries.toArrow()
    at, matrix = units(held.column("query_vector").combine_chunks())
    shared = rows.sparkSession.sparkContext.broadcast((held.column("query_id").combine_chunks().take(pa.array(at)), matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        best, kind = Best(k, matrix), None
        for batch in batches:
            kind = batch.column("id").type
            at, x = units(batch.column("v"))
            if len(at) and len(matrix):
                best.add(batch.column("id").take(pa.array(at)).to_numpy(zero_copy_only=False), x)
        if kind is not None:
            yield best.rows(ids, kind)

    return rows.mapInArrow(run, schema)


def _many(rows: DataFrame, queries: DataFrame, k: int, schema: str, stripe: int, group: int) -> DataFrame:
    """Pairs by a grid: chunks in stripes, queries in groups, each cell a partition that holds one group and streams its stripe."""
    stripes, groups = (max(1, math.ceil(df.count() / most)) for df, most in ((rows, stripe), (queries, group)))
    kinds = schema.split(", ")[0].split()[1], schema.split(", ")[1].split()[1]

    def pack(role: int, ids: str, vector: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, other = (stripes, groups) if role else (groups, stripes)
            for batch in batches:
                at, x = units(batch.column(vector))
                part = np.asarray(batch.column("part").to_numpy(zero_copy_only=False))[at] % own
                for p in range(own):
                    mine = np.nonzero(part == p)[0]
                    for lo in range(0, len(mine), BLOCK):
                        some = mine[lo : lo + BLOCK]
                        held, values = batch.column(ids).take(pa.array(at[some])).to_pylist(), x[some].tobytes()
                        for o in range(other):
                            cell = p * groups + o if role else o * groups + p
                            none: list = []
                            yield pa.RecordBatch.from_pydict({"cell": pa.array([cell], pa.int32()), "role": pa.array([role], pa.int8()), "query_ids": pa.array([none if role else held], pa.list_(q_kind)), "ids": pa.array([held if role else none], pa.list_(c_kind)), "vals": pa.array([values], pa.binary())})

        return run

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, q_ids, q, best = None, [], [], None
        for batch in batches:
            for cell, role, query_ids, ids, vals in zip(*(batch.column(i) for i in range(5))):
                if cell.as_py() != current:
                    if best:
                        yield best.rows(pa.array(q_ids, q_kind), c_kind)
                    current, q_ids, q, best = cell.as_py(), [], [], None
                n = len(query_ids.values) if role.as_py() == 0 else len(ids.values)
                x = np.frombuffer(vals.as_buffer(), float).reshape(n, -1)
                if role.as_py() == 0:
                    q_ids += query_ids.as_py()
                    q.append(x)
                elif q:
                    best = best or Best(k, np.concatenate(q))
                    best.add(np.array(ids.as_py() + [None], object)[:-1], x)
        if best:
            yield best.rows(pa.array(q_ids, q_kind), c_kind)

    q_kind, c_kind = (pa.string() if t == "string" else {"int": pa.int32(), "bigint": pa.int64(), "smallint": pa.int16()}[t] for t in kinds)
    block = f"cell int, role byte, query_ids array<{kinds[0]}>, ids array<{kinds[1]}>, vals binary"
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 30)).cast("int").alias("part")
    both = rows.select("id", "v", part("id")).mapInArrow(pack(1, "id", "v"), block).unionByName(queries.select("query_id", "query_vector", part("query_id")).mapInArrow(pack(0, "query_id", "query_vector"), block))
    return both.repartitionById(stripes * groups, "cell").sortWithinPartitions("cell", "role").mapInArrow(run, schema)


def top_k(chunks: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "child_id", vector: str = "embedding", stripe: int = STRIPE, group: int = GROUP) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest chunks of each query (query_id, query_vector); ties by id.

    Up to MOST_QUERIES queries go to every task as one matrix; more go through a grid of blocks, each of which meets every
    other once. Either way a task keeps its own k best of a query before anything is shuffled. k below 1 counts as 1. Chunks
    and queries without vector, with a zero vector or with NaN are left out; ids are texts or integers.
    """
    k = max(1, k)
    queries = queries.select("query_id", "query_vector")
    rows = chunks.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).where(F.col("id").isNotNull())
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, distance double"
    few = queries.limit(MOST_QUERIES + 1).count() <= MOST_QUERIES
    pairs = _few(rows, queries, k, schema) if few else _many(rows, queries, k, schema, stripe, group)
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "distance")


def with_parents(hits: DataFrame, chunks: DataFrame, parents: DataFrame, id_col: str = "child_id", missing: str = "") -> DataFrame:
    """hits with child text, parent id, parent text (`missing` where the parent is unknown) and score."""
    held = chunks.select(id_col, "parent_id", F.col("content").alias("child_text"))
    full = parents.groupBy("parent_id").agg(F.min("content").alias("parent_text"))
    return hits.join(held, id_col, "left").join(full, "parent_id", "left").select("query_id", "rank", id_col, "parent_id", "child_text", F.coalesce("parent_text", F.lit(missing)).alias("parent_text"), score(F.col("distance")).alias("score"))


def shown(hits: DataFrame, show: str = "both") -> DataFrame:
    """The columns for one of the modes child, parent, both."""
    columns = {"child": ["child_text"], "parent": ["parent_text"], "both": ["child_text", "parent_text"]}
    if show not in columns:
        raise ValueError("show must be child, parent or both")
    return hits.select("query_id", "rank", "score", *columns[show])


def query_report(hits: DataFrame, most: int = 3, signs: int = 200) -> DataFrame:
    """The first hits of each query with the start of their parent, of the child where there is none."""
    text = F.coalesce(F.nullif("parent_text", F.lit("")), F.col("child_text"))
    return hits.where(F.col("rank") <= most).select("query_id", "rank", "score", preview(text, signs).alias("preview"))


def flatten_result(result: DataFrame) -> DataFrame:
    """Rows of a nested query result: ids, documents, distances as parallel arrays, one inner array for each query; the first query's counts."""
    first = lambda c: F.coalesce(F.get(F.col(c), F.lit(0)), F.array())
    zipped = F.arrays_zip(first("ids").alias("id"), first("documents").alias("document"), first("distances").alias("distance"))
    return result.select(F.posexplode(zipped).alias("pos", "r")).select((F.col("pos") + 1).alias("rank"), "r.id", "r.document", "r.distance")
