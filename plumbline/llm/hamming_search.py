"""Exact top-k search of binary codes by incremental multi-index hashing.

A code of 64 bits is indexed under each of its SEGMENTS 16-bit segments. A query probes segment after segment, first at
segment radius 0, then 1, and so on. Once segments 0..a were probed at radius r (and the others at r - 1), every code
within Hamming distance r * SEGMENTS + a has been met, as a code further than that in all segments is further in all.
A query stops when so many verified codes lie within the proven distance as it wants.

Distribution: codes are deduplicated (a code keeps the k + 1 smallest of its ids: by the order of results no other can
ever be wanted), dealt to row blocks and query blocks of bounded size, searched block by block, and the best of all
blocks are merged. Results are ordered by distance, then id; a query's own id is left out.

Null codes and rows without an id take no part. Repeated (id, code) rows count once. With fewer than k other rows a
query gets those there are.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENTS, WIDTH = 4, 16
ROW_BLOCK, QUERY_BLOCK = 2_000_000, 500_000
#: Query codes that one vector step handles, and the least that are worth a task of their own.
_STEP, _TASK_QUERIES = 128, 512


def sign_code(embedding: Column) -> Column:
    """The signs of a vector's first 64 entries as bits (positive: 1; null, NaN or missing: 0); null for a null vector."""
    bits = F.transform(embedding, lambda x, i: F.when((x > 0) & ~F.isnan(x) & (i < 64), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


class MultiIndex:
    """Distinct codes under their segments."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order, self.start = [], []
        for a in range(SEGMENTS):
            part = self.segment(codes, a)
            self.order.append(np.argsort(part, kind="stable"))
            self.start.append(np.concatenate([[0], np.cumsum(np.bincount(part, minlength=1 << WIDTH))]))

    @staticmethod
    def segment(codes: np.ndarray, a: int) -> np.ndarray:
        return (codes >> np.uint64(a * WIDTH)).astype(np.uint16)

    @staticmethod
    def flips(radius: int) -> np.ndarray:
        return np.array([sum(1 << b for b in c) for c in combinations(range(WIDTH), radius)], dtype=np.uint16)

    def search(self, queries: np.ndarray, copies: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, code, distance) triples that hold at least the ``want`` nearest of each query; a code counts ``copies`` times."""
        out: list[tuple] = []
        found = np.zeros((len(queries), SEGMENTS * WIDTH + 1), dtype=np.int64)
        active = np.arange(len(queries))
        enough = min(want, int(copies.sum()))
        for radius in range(WIDTH + 1):
            flips = self.flips(radius)
            for a in range(SEGMENTS):
                if not len(active):
                    break
                q = queries[active]
                probe = (self.segment(q, a)[:, None] ^ flips[None, :]).astype(np.int64)
                first, last = self.start[a][probe], self.start[a][probe + 1]
                n = (last - first).ravel()
                own = np.repeat(np.repeat(active, len(flips)), n)
                at = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first.ravel(), n)
                code = self.order[a][at]
                apart = self.codes[code] ^ queries[own]
                new = np.ones(len(own), dtype=bool)  # met neither in an earlier segment at this radius nor before it
                for b in range(SEGMENTS):
                    if b != a:
                        new &= np.bitwise_count(self.segment(apart, b)) >= radius + (b < a)
                own, code, apart = own[new], code[new], apart[new]
                far = np.bitwise_count(apart).astype(np.int64)
                np.add.at(found, (own, far), copies[code])
                out.append((own, code, far))
                proven = radius * SEGMENTS + a
                active = active[found[active, : proven + 1].sum(axis=1) < enough]
        own, code, far = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, dtype=np.int64),) * 3
        reach = (np.cumsum(found, axis=1) < enough).sum(axis=1)
        near = far <= reach[own]
        return own[near], code[near], far[near]


def _search_block(rows: pa.Table, queries: pa.Table, want: int) -> pa.Table:
    codes = rows.column("code").to_numpy().view(np.uint64)
    ids = rows.column("ids").combine_chunks()
    ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
    flat, copies = ids.flatten().to_numpy(zero_copy_only=False), pa.compute.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(copies) - copies
    asked = queries.column("code").to_numpy().view(np.uint64)
    index, parts = MultiIndex(codes), []
    for s in range(0, len(asked), _STEP):
        own, code, far = index.search(asked[s : s + _STEP], copies, want)
        n = copies[code]
        own, far = np.repeat(own, n), np.repeat(far, n)
        ident = flat[np.repeat(first[code], n) + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)]
        order = np.lexsort((ident, far, own))
        own, far, ident = own[order], far[order], ident[order]
        rank = np.arange(len(own)) - np.searchsorted(own, own)
        best = rank < want
        parts.append(pa.table({"code": pa.array(asked[s + own[best]].view(np.int64)), "distance": pa.array(far[best].astype(np.int32)), "id": pa.array(ident[best])}))
    return pa.concat_tables(parts)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, id, distance) for queries (id, code) against rows (id, code); codes are 64-bit numbers."""
    spark = rows.sparkSession
    rows = rows.where("id is not null and code is not null").select("id", "code")
    queries = queries.where("id is not null and code is not null").select("id", "code").distinct()
    own = Window.partitionBy("code").orderBy("id")
    few = rows.groupBy("code", "id").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(own)).where(F.col("r") <= k + 1)
    codes = few.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    asked = queries.select("code").distinct()
    n_rows, n_asked = rows.count(), asked.count()
    row_blocks = max(1, -(-n_rows // ROW_BLOCK))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    query_blocks = max(1, -(-n_asked // QUERY_BLOCK), min(-(-tasks // row_blocks), -(-n_asked // _TASK_QUERIES)))
    block = lambda n: F.pmod(F.xxhash64("code", F.lit(n)), F.lit(n)).cast("int")
    left = codes.withColumn("b", block(row_blocks)).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = asked.withColumn("c", block(query_blocks)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    want = k + 1
    empty = pa.table({"code": pa.array([], pa.int64()), "distance": pa.array([], pa.int32()), "id": pa.array([], pa.int64())})

    def search(rows_of: pa.Table, queries_of: pa.Table) -> pa.Table:
        return _search_block(rows_of, queries_of, want) if rows_of.num_rows and queries_of.num_rows else empty

    met = left.groupBy("b", "c").cogroup(right.groupBy("b", "c")).applyInArrow(search, "code long, distance int, id long")
    best = met.groupBy("code").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "id"))), 1, want).alias("near"))
    answered = queries.join(best, "code").select(F.col("id").alias("query_id"), F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k).alias("near"))
    return answered.select("query_id", F.posexplode("near").alias("pos", "hit")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.id").alias("id"), F.col("hit.distance").alias("distance"))
