"""Flat files of token ids with 64-bit document offsets, written and memory-mapped by tasks."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs as filesystems
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthloom.llm.packing import with_bases
from monthloom.llm.tokens import SLICE, Encoder, in_slices
from monthloom.llm.workspace import new_folder

MANIFEST = "part int, docs long, n_tokens long, width int"


def shared(folder: str) -> tuple[filesystems.FileSystem, str]:
    """The file system and path of a folder that Spark names with or without a scheme."""
    if folder.startswith("file:"):
        return filesystems.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    if "://" not in folder:
        return filesystems.LocalFileSystem(), folder
    return filesystems.FileSystem.from_uri(folder)


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Write the ids of all texts in ascending order of ``id_col``; each text is closed by ``end_id``.

    Part ``k`` has three files: ``k.ids``, nothing but unsigned integers (16 bits wide if the vocabulary allows, else
    32, little-endian); ``k.offsets``, one signed 64-bit integer more than documents, counted in ids from the part's
    begin; ``k.keys``, the documents' ids as an Arrow file. The folder's ``manifest`` table has each part's counts, from
    whose prefix sums the parts' bases in the whole follow. Tasks write under a name of their own and then rename, so
    an attempt that dies leaves nothing that is read.

    Null texts count as empty, null ids come first, equal ids stay in the order of the input, and a hot id is spread
    over several parts. An empty table gives an empty manifest.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        counts = write_part(batches, folder, context.partitionId(), context.taskAttemptId(), tokenizer, end_id)
        if counts:
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int32())
            yield pa.record_batch([pa.array([v], t) for v, t in zip(counts, types)], ["part", "docs", "n_tokens", "width"])

    narrow = docs.select(
        F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"),
        F.monotonically_increasing_id().alias("place"),
    )
    ordered = narrow.repartitionByRange("key", "place").sortWithinPartitions("key", "place")
    # One row per part, gathered into a few files: a file of its own per part costs an executor several processes (the
    # `chmod` of Hadoop's local file system), each of which passes for a second JVM of the same memory while it starts.
    manifest = ordered.mapInArrow(run, MANIFEST).repartition(docs.sparkSession.sparkContext.defaultParallelism)
    manifest.write.parquet(f"{folder}/manifest")


def write_part(
    batches: Iterable[pa.RecordBatch], folder: str, part: int, attempt: int, tokenizer: str, end_id: int
) -> tuple[int, int, int, int] | None:
    """Write the files of one part from its (key, text) rows; the manifest's row, or none without rows.

    Ids and keys go to their files slice by slice. Of what was written, only offsets are held: kept keys would keep the
    texts they came with.
    """
    slices = in_slices(batches, SLICE)
    first = next(slices, None)
    if first is None:
        return None
    schema = pa.schema([("key", first.schema.field(0).type)])
    slices = chain([first], slices)
    del first
    encoder = Encoder.of_process(tokenizer)
    width = 2 if max(encoder.vocabulary, end_id + 1) <= 1 << 16 else 4
    end = np.array([end_id], "<u4").tobytes()
    system, base = shared(folder)
    system.create_dir(base, recursive=True)
    name = f"{base}/.{part}-{attempt}"
    offsets, total = [np.zeros(1, np.int64)], 0
    with (
        system.open_output_stream(f"{name}.ids") as out,
        system.open_output_stream(f"{name}.keys") as file, pa.ipc.new_file(file, schema) as writer,
    ):
        for batch in slices:
            ids = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
            counts = np.array([len(x) // 4 + 1 for x in ids], np.int64)
            flat = np.frombuffer(b"".join([y for x in ids for y in (x, end)]), "<u4")
            out.write(flat.astype(f"<u{width}").tobytes())
            writer.write_batch(pa.record_batch([batch.column(0)], schema))
            offsets.append(total + np.cumsum(counts))
            total += int(counts.sum())
    with system.open_output_stream(f"{name}.offsets") as out:
        out.write(np.concatenate(offsets).astype("<i8").tobytes())
    for kind in ("ids", "offsets", "keys"):
        system.move(f"{name}.{kind}", f"{base}/{part}.{kind}")
    return part, sum(map(len, offsets)) - 1, total, width


def read_token_files(spark: SparkSession, folder: str, key_type: str = "long", with_ids: bool = False) -> DataFrame:
    """One row per document from the files: key, place of its first id in the whole, count and checksum of its ids.

    The checksum is the unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers. ``with_ids`` adds them.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = shared(folder)
        local = isinstance(system, filesystems.LocalFileSystem)
        for batch in batches:
            for part, first, width in zip(*(batch.column(c).to_pylist() for c in ("part", "base", "width"))):
                opened = pa.memory_map if local else system.open_input_file
                with opened(f"{base}/{part}.ids") as ids, opened(f"{base}/{part}.offsets") as places:
                    offsets = np.frombuffer(places.read_buffer(), "<i8")
                    with opened(f"{base}/{part}.keys") as file:
                        keys = pa.ipc.open_file(file).read_all().column("key").combine_chunks()
                        # Slices of as many ids as fit SLICE bytes; a longer single document is a slice of its own.
                        starts = np.flatnonzero(np.diff(offsets[1:] * 4 // SLICE, prepend=-1)).tolist()
                        for a, b in zip(starts, [*starts[1:], len(keys)]):
                            yield _documents(keys[a:b], offsets[a : b + 1], first, width, ids, with_ids)

    columns = f"key {key_type}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    # One row per part: dealt out so that each task maps a few files.
    parts = with_bases(manifest, manifest).repartition(manifest.sparkSession.sparkContext.defaultParallelism)
    return parts.mapInArrow(run, columns)


def _documents(keys, offsets: np.ndarray, first: int, width: int, file, with_ids: bool) -> pa.RecordBatch:
    low = int(offsets[0])
    file.seek(low * width)
    flat = np.frombuffer(file.read_buffer(int(offsets[-1] - low) * width), f"<u{width}").astype("<u4")
    bytes_ = [flat[a:b].tobytes() for a, b in zip((offsets[:-1] - low).tolist(), (offsets[1:] - low).tolist())]
    columns = {
        "key": keys, "start": pa.array(offsets[:-1] + first), "n_tokens": pa.array(np.diff(offsets)),
        "ids_crc32": pa.array([zlib.crc32(b) for b in bytes_], pa.int64()),
    }
    if with_ids:
        columns["ids"] = pa.array(bytes_, pa.binary())
    return pa.record_batch(columns)


def token_files(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"):
    """Write to a new folder under ``spark.checkpoint.dir`` and read back."""
    folder = new_folder(docs.sparkSession, "tokens")
    write_token_files(docs, folder, tokenizer, end_id, id_col, text_col)
    return read_token_files(docs.sparkSession, folder, docs.schema[id_col].dataType.simpleString())
