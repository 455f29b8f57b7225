"""Concatenate and cut: fixed windows over one long run of ids."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from monthloom.llm.tokens import SLICE, encoded, in_slices
from monthloom.llm.workspace import written

PIECES = (
    "doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
    "is_first boolean, is_last boolean"
)


def with_bases(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Give each row ``base``, the ids of all partitions before its own.

    ``parts`` has (part, n_tokens) once or several times per partition. There is one total per task of the pass that
    wrote the rows, so the prefix sums and the broadcast are bounded by the number of tasks, not by rows.
    """
    totals = parts.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    return rows.join(F.broadcast(bases), "part")


def cut_pieces(batches: Iterable[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Pieces of (doc_id, at, n_tokens, ids) rows, cut where a window ends."""
    # Views, cuts and the pieces made of them are held for a slice at a time, not for a whole batch.
    for batch in in_slices(batches, SLICE):
        docs_, ids = batch.column("doc_id"), batch.column("ids")
        first = batch.column("at").to_numpy()
        counts = batch.column("n_tokens").to_numpy()
        windows = (first + counts - 1) // window - first // window + 1
        row = np.repeat(np.arange(len(counts)), windows)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        sequence = first[row] // window + nth
        begin = np.maximum(sequence * window, first[row])
        end = np.minimum((sequence + 1) * window, first[row] + counts[row])
        start, length = begin - first[row], end - begin
        # Pieces follow each other as the ids do, so they share the ids' buffer and only have offsets of their own. (An
        # array made from memoryviews would keep each view, and its ids, for the life of the worker.)
        ids = ids.cast(pa.large_binary())
        at = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
        offsets = np.append(at[row] + 4 * start, at[-1:]) - at[0]
        flat = ids.buffers()[2].slice(at[0], at[-1] - at[0])
        cuts = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(offsets.astype(np.int32)), flat])
        yield pa.record_batch(
            [
                docs_.take(pa.array(row)), pa.array(start), pa.array(length), cuts,
                pa.array(counts[row]), pa.array(sequence), pa.array(begin - sequence * window),
                pa.array(start == 0), pa.array(end == first[row] + counts[row]),
            ],
            ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "is_first", "is_last"],
        )


def pack(
    docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pack all texts into sequences of ``window`` ids; one row per piece of a document in a sequence.

    First pass: encode, and total the ids of each partition. Second pass: prefix sums of the totals give every
    document its place in the one run of all ids, and each is cut where a window ends. Only the last sequence is
    shorter. Pieces are the boundary records: ``sequence_id`` and ``offset`` say where the piece lies, ``start`` where
    it lies in its document, and the ids themselves are in ``ids`` (little-endian unsigned 32-bit).

    Rows without text (null or empty) consist of their end id. Repeated rows and null ids are packed like any other,
    as many times as they occur. A text of any length is cut into as many pieces as needed. An empty table gives no
    rows. Other columns of ``docs`` are not looked at.
    """
    table = written(encoded(docs, tokenizer, end_id, id_col, text_col), "packing")

    placed = with_bases(table, table.select("part", "n_tokens"))
    placed = placed.select("doc_id", (F.col("base") + F.col("local_start")).alias("at"), "n_tokens", "ids")
    return placed.mapInArrow(lambda batches: cut_pieces(batches, window), PIECES.format(kind=placed.schema["doc_id"].dataType.simpleString()))


def sequences(pieces: DataFrame) -> DataFrame:
    """The sequences themselves: ids of all pieces in order, and where documents begin in them."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id", "start")))
    grouped = pieces.groupBy("sequence_id").agg(ordered.alias("pieces"), F.sum("length").alias("length"))
    return grouped.select(
        "sequence_id", "length",
        F.aggregate("pieces", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"])).alias("ids"),
        F.transform("pieces", lambda p: F.struct(p["doc_id"], p["start"], p["offset"])).alias("boundaries"),
    )
