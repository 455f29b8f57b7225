"""Hard negatives for anchors by angular triangle filtering: only rows whose score bounds meet a wanted window are scored.

Each row stores its norm and its angles to a few fixed reference directions. For an anchor ``a`` and a row ``v`` and any
direction ``u``, the angle between ``a`` and ``v`` lies within ``|∠(a,u) − ∠(v,u)|`` and ``∠(a,u) + ∠(v,u)``; over all
directions this gives an interval of cosines, which times both norms (widened for rounding) bounds the integer score.

1. Positives: per anchor, the same-label rows that can still be among the first ``positives`` are those whose upper
   bound reaches the ``positives``-th largest lower bound; only they are scored, block by block, and the blocks' bests merged.
2. Negatives: per anchor, only different-label rows whose bounds meet the union of its positives' windows are scored; each
   positive keeps its first ``negatives`` within its own window, block by block, merged as before.

Anchors and rows meet in blocks: every pair of an anchor block and a row block is one group of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from monthloom.llm.topk import whole_components
from monthloom.llm.workspace import written

STORED = "vec_id long, label long, dims int, q binary, norm double, angles binary"
BEST = "anchor_id long, vec_id long, score long"
FOUND = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def _directions(count: int, dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((count, dims))


def stored_angles(rows: DataFrame, dims: int, directions: int, seed: int) -> DataFrame:
    """Per row (vec_id, label, whole vector q): its norm and its angles to ``directions`` fixed directions, padded to ``dims``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = _directions(directions, dims, seed)
        refs /= np.linalg.norm(refs, axis=1, keepdims=True)
        for batch in batches:
            q = batch.column(2)
            count = len(batch)
            sizes = np.diff(q.offsets.to_numpy()) if count else np.zeros(0, np.int64)
            flat = q.values.to_numpy(zero_copy_only=False).astype(np.int64)
            matrix = np.zeros((count, dims), np.int64)
            matrix[np.repeat(np.arange(count), sizes), np.concatenate([np.arange(s) for s in sizes]) if count else []] = flat
            norm = np.sqrt((matrix.astype(np.float64) ** 2).sum(axis=1))
            cos = (matrix @ refs.T) / np.where(norm > 0, norm, 1.0)[:, None]
            angles = np.arccos(np.clip(cos, -1.0, 1.0))
            yield pa.record_batch(
                [
                    batch.column(0), batch.column(1), pa.array(np.full(count, dims, np.int32)),
                    pa.array([m.tobytes() for m in matrix], pa.binary()), pa.array(norm),
                    pa.array([a.tobytes() for a in angles], pa.binary()),
                ],
                ["vec_id", "label", "dims", "q", "norm", "angles"],
            )

    return rows.select("vec_id", "label", "q").mapInArrow(run, STORED)


def _unpacked(frame: pd.DataFrame) -> tuple[np.ndarray, ...]:
    dims = int(frame["dims"].iloc[0])
    q = np.frombuffer(b"".join(frame["q"]), np.int64).reshape(-1, dims)
    angles = np.frombuffer(b"".join(frame["angles"]), np.float64).reshape(len(frame), -1)
    return frame["vec_id"].to_numpy(np.int64), frame["label"].to_numpy(np.int64), q, frame["norm"].to_numpy(), angles


def score_bounds(a_norm: np.ndarray, a_angles: np.ndarray, b_norm: np.ndarray, b_angles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of every anchor-row inner product, safe against rounding of the stored angles."""
    low = np.zeros((len(a_norm), len(b_norm)))
    high = np.full((len(a_norm), len(b_norm)), np.pi)
    for r in range(a_angles.shape[1]):
        np.maximum(low, np.abs(a_angles[:, r, None] - b_angles[None, :, r]), out=low)
        np.minimum(high, a_angles[:, r, None] + b_angles[None, :, r], out=high)
    norms = a_norm[:, None] * b_norm[None, :]
    slack = norms * 1e-6 + 1.0
    return norms * np.cos(np.minimum(high, np.pi)) - slack, norms * np.cos(low) + slack


def _first(ids: np.ndarray, scores: np.ndarray, count: int) -> np.ndarray:
    """Places of the ``count`` highest scores, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:count]


def _positives(count: int, chunk: int):
    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(rows):
            a_id, a_label, a_q, a_norm, a_ang = _unpacked(anchors)
            b_id, b_label, b_q, b_norm, b_ang = _unpacked(rows)
            for s in range(0, len(a_id), chunk):
                part = slice(s, s + chunk)
                low, high = score_bounds(a_norm[part], a_ang[part], b_norm, b_ang)
                same = (b_label[None, :] == a_label[part, None]) & (b_id[None, :] != a_id[part, None])
                low = np.where(same, low, -np.inf)
                kth = np.partition(low, -count, axis=1)[:, -count] if len(b_id) >= count else np.full(len(low), -np.inf)
                wanted = same & (high >= kth[:, None])
                for i, anchor in enumerate(range(s, min(s + chunk, len(a_id)))):
                    at = np.flatnonzero(wanted[i])
                    scores = b_q[at] @ a_q[anchor]
                    for j in _first(b_id[at], scores, count):
                        out.append((a_id[anchor], b_id[at[j]], scores[j]))
        return pd.DataFrame(out, columns=["anchor_id", "vec_id", "score"])

    return run


def _negatives(count: int, chunk: int):
    def run(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(rows):
            a_id, a_label, a_q, a_norm, a_ang = _unpacked(anchors)
            b_id, b_label, b_q, b_norm, b_ang = _unpacked(rows)
            positives = list(anchors["positives"])
            for s in range(0, len(a_id), chunk):
                part = slice(s, s + chunk)
                low, high = score_bounds(a_norm[part], a_ang[part], b_norm, b_ang)
                for i, anchor in enumerate(range(s, min(s + chunk, len(a_id)))):
                    held = [(int(p["vec_id"]), int(p["score"])) for p in positives[anchor] if p["score"] >= 0]
                    if not held:
                        continue
                    bottom, top = 0.8 * min(p for _, p in held), max(p for _, p in held)
                    at = np.flatnonzero((b_label != a_label[anchor]) & (high[i] >= bottom) & (low[i] <= top))
                    scores = b_q[at] @ a_q[anchor]
                    for positive, p in held:
                        inside = np.flatnonzero((80 * p <= 100 * scores) & (scores <= p))
                        for j in _first(b_id[at[inside]], scores[inside], count):
                            out.append((a_id[anchor], positive, p, b_id[at[inside[j]]], scores[inside[j]]))
        return pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return run


def _paired(anchors: DataFrame, rows: DataFrame, anchor_groups: int, row_groups: int):
    """Every anchor block beside every row block, as one group each."""
    a = anchors.withColumn("a_block", F.pmod(F.xxhash64("vec_id"), F.lit(anchor_groups)).cast("int")).withColumn(
        "r_block", F.explode(F.sequence(F.lit(0), F.lit(row_groups - 1)))
    )
    r = rows.withColumn("r_block", F.pmod(F.xxhash64("vec_id"), F.lit(row_groups)).cast("int")).withColumn(
        "a_block", F.explode(F.sequence(F.lit(0), F.lit(anchor_groups - 1)))
    )
    return a.groupBy("a_block", "r_block").cogroup(r.groupBy("a_block", "r_block"))


def _firsts(found: DataFrame, by: list[str], score: str, vec: str, count: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(vec))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def hard_negatives(
    embeddings: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, scale: int = 256,
    directions: int = 8, anchor_block: int = 2048, row_block: int = 16384, chunk: int = 64, seed: int = 3,
    vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows where ``anchor`` holds.

    ``anchor`` is a condition on the column ``vec_id``. 
    Rows with a null vec_id, label or vector, or a null or non-finite component, take no part. Components become
    floor(scale * x); scores are integer inner products, higher first, ties to smaller vec_id. An anchor's positives are its
    first ``positives`` other rows of its label (all, if fewer); per positive, the first ``negatives`` rows of another label
    with 80 * positive_score <= 100 * negative_score <= 100 * positive_score. A negative positive score has no window.
    Rows sharing a vec_id count once, as the one with the smallest label, then the smallest whole vector; other
    columns are not read. Empty input: no rows.
    """
    q = whole_components(F.col(vector_col), scale)
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), q.alias("q")
    ).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("q").isNotNull())
    # One row per vec_id; min of a struct combines on the map side, so a vec_id of many rows is no hot group.
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r")).select("vec_id", "r.label", "r.q")
    sizes = rows.agg(F.max(F.size("q")).alias("dims"), F.count("*").alias("n"), F.sum(anchor.cast("int")).alias("a")).first()
    if not sizes["n"] or not sizes["a"]:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    stored = written(stored_angles(rows, max(1, sizes["dims"]), directions, seed), "angles")
    # The two sides of each pairing get columns of their own, as a self-join needs.
    anchors, everyone = stored.where(anchor), stored.select(*(F.col(c).alias(c) for c in stored.columns))
    a_groups, r_groups = math.ceil(sizes["a"] / anchor_block), math.ceil(sizes["n"] / row_block)

    best = _paired(anchors, everyone, a_groups, r_groups).applyInPandas(_positives(positives, chunk), BEST)
    best = _firsts(best, ["anchor_id"], "score", "vec_id", positives)
    held = best.groupBy("anchor_id").agg(F.collect_list(F.struct("vec_id", "score")).alias("positives"))
    with_positives = anchors.join(held.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    found = _paired(with_positives, everyone, a_groups, r_groups).applyInPandas(_negatives(negatives, chunk), FOUND)
    found = _firsts(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")
