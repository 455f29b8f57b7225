"""Exact search for the highest inner products: MaxScore over signed postings of blocks of vectors."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from monthloom.llm.workspace import written

BLOCK = "part int, block int, size int, dims int, ids binary, vectors binary"
HITS = "query_block string, slot int, query_id long, vec_id long, score long"


def whole_components(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component as a double; null if the vector or a component is null or not finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(good, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def blocked(rows: DataFrame, size: int) -> DataFrame:
    """Rows (id, vector of whole numbers) in blocks of at most ``size`` as they lie in their partitions, never one by one.

    Shorter vectors of a block are filled up with zeros, which leaves inner products as they are.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids, vectors, block = [], [], 0

        def row(ids: list, vectors: list, block: int) -> pa.RecordBatch:
            dims = max(map(len, vectors))
            matrix = np.zeros((len(ids), dims), "<i8")
            for i, v in enumerate(vectors):
                matrix[i, : len(v)] = v
            values = (part, block, len(ids), dims, np.array(ids, "<i8").tobytes(), matrix.tobytes())
            types = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            arrays = [pa.array([v], t) for v, t in zip(values, types)]
            return pa.record_batch(arrays, ["part", "block", "size", "dims", "ids", "vectors"])

        for batch in batches:
            ids += batch.column(0).to_pylist()
            vectors += [v.values.to_numpy(zero_copy_only=False) for v in batch.column(1)]
            while len(ids) >= size:
                yield row(ids[:size], vectors[:size], block)
                ids, vectors, block = ids[size:], vectors[size:], block + 1
        if ids:
            yield row(ids, vectors, block)

    return rows.mapInArrow(run, BLOCK)


class Postings:
    """One block of vectors by term: a term is a component with a sign, its postings are the rows of that sign."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors, self.columns = ids, vectors, np.ascontiguousarray(vectors.T)
        self.high, self.low = vectors.max(axis=0), vectors.min(axis=0)

    def best(self, query: np.ndarray, own: int, k: int, scores: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge this block's rows into a query's best so far: (scores, ids), best first, ties by smaller id.

        Terms whose bounds together stay below the k-th score so far are not essential: a row that only they reach
        cannot enter. Postings of essential terms are added up; the others are then probed from the highest bound on,
        only for rows whose sum with the bounds still to come reaches the k-th score.
        """
        dims = min(len(query), len(self.high))
        terms = np.flatnonzero(query[:dims])
        weight = query[terms]
        # What a term can add to a score at most; components of the other sign add less than nothing.
        bound = np.maximum(np.where(weight > 0, self.high[terms], self.low[terms]) * weight, 0)
        order = np.argsort(-bound, kind="stable")
        terms, weight, bound = terms[order], weight[order], bound[order]
        rest = np.append(np.cumsum(bound[::-1])[::-1], 0)
        full = len(found) >= k
        least = scores[-1] if full else None
        essential = int(np.searchsorted(-rest, -least, side="right")) if full else 0
        if full and rest[0] < least:
            return scores, found
        # Rows that no essential term raises score at most what is left after them, or 0 when every term is essential;
        # only when that stays below the k-th score may they be passed over.
        if full and essential and (essential < len(rest) or least > 0):
            reached = np.zeros(len(self.ids), bool)
            for t, w in zip(terms[:essential].tolist(), weight[:essential].tolist()):
                reached |= self.columns[t] * w > 0
            rows = np.flatnonzero(reached)
        else:
            rows = np.arange(len(self.ids))
        rows = rows[self.ids[rows] != own]
        total = np.zeros(len(rows), np.int64)
        step = 8
        for a in range(0, len(terms), step):
            total += self.vectors[np.ix_(rows, terms[a : a + step])] @ weight[a : a + step]
            if full:
                keep = total + rest[min(a + step, len(terms))] >= least
                if not keep.all():
                    rows, total = rows[keep], total[keep]
        if len(rows) > 4 * k:
            cut = np.partition(total, len(total) - k)[len(total) - k]
            rows, total = rows[total >= cut], total[total >= cut]
        scores, found = np.concatenate([scores, total]), np.concatenate([found, self.ids[rows]])
        top = np.lexsort((found, -scores))[:k]
        return scores[top], found[top]


def top_k(queries: DataFrame, rows: DataFrame, k: int = 10, query_block: int = 512, row_block: int = 4096) -> DataFrame:
    """Each query's ``k`` highest integer inner products: (query_id, rank, vec_id, score), ties to the smaller id.

    Both tables have (vec_id, vector of whole numbers). Rows are packed in blocks once, and each block of queries
    meets each block of rows: (queries / 512) * (rows / 4096) pairs of names, to which the vectors are joined. A task
    carries each query's best from block to block, which is what lets later blocks be skipped. Only these best rows are
    merged. Rows with a null id, a null vector or null components take no part. A query's own id is not among its
    results; rows that repeat count each. An id that is a query several times is answered as often. Vectors shorter
    than the query count as ended by zeros. Sums must stay within 64 bits.
    """

    def usable(df: DataFrame) -> DataFrame:
        return df.select(F.col("vec_id").cast("long"), "vector").where("vec_id is not null and vector is not null")

    asked = written(blocked(usable(queries), query_block), "queries")
    held = written(blocked(usable(rows), row_block), "vectors")
    names = asked.select(F.concat_ws("-", "part", "block").alias("query_block"))
    asked = asked.select(
        F.concat_ws("-", "part", "block").alias("query_block"), F.col("dims").alias("q_dims"),
        F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"),
    )
    # The stated queries against all rows, block by block: only names of blocks are paired.
    pairs = held.select("part", "block").crossJoin(names)
    met = pairs.join(asked, "query_block").join(held.drop("size"), ["part", "block"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, tuple[np.ndarray, list]] = {}
        none = np.zeros(0, np.int64)
        for batch in batches:
            for r in batch.to_pylist():
                vectors = np.frombuffer(r["vectors"], "<i8").reshape(-1, r["dims"])
                postings = Postings(np.frombuffer(r["ids"], "<i8"), vectors)
                name = r["query_block"]
                if name not in best:
                    best[name] = np.frombuffer(r["q_ids"], "<i8"), [(none, none)] * (len(r["q_ids"]) // 8)
                ids, tops = best[name]
                asks = np.frombuffer(r["q_vectors"], "<i8").reshape(-1, r["q_dims"])
                for i in range(len(ids)):
                    tops[i] = postings.best(asks[i], int(ids[i]), k, *tops[i])
                if len(best) > 500:  # bounds what a task carries; the merge takes several lists of a query
                    yield from emit(best)
                    best.clear()
        yield from emit(best)

    def emit(best: dict) -> Iterator[pa.RecordBatch]:
        for name, (ids, tops) in best.items():
            counts = [len(t[0]) for t in tops]
            slot = np.repeat(np.arange(len(ids)), counts)
            if len(slot):
                arrays = [
                    pa.array([name] * len(slot)), pa.array(slot.astype(np.int32)), pa.array(ids[slot]),
                    pa.array(np.concatenate([t[1] for t in tops])), pa.array(np.concatenate([t[0] for t in tops])),
                ]
                yield pa.record_batch(arrays, ["query_block", "slot", "query_id", "vec_id", "score"])

    hits = met.select("query_block", "q_dims", "q_ids", "q_vectors", "dims", "ids", "vectors").mapInArrow(run, HITS)
    place = Window.partitionBy("query_block", "slot").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
