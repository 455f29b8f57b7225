"""Which names occur more than once: 64-bit names of many rows, dealt out packed by bucket and sorted bucket by bucket."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from monthloom.llm.tokens import in_slices
from monthloom.session import shuffle_partitions

# Names that a map task holds before it deals them out.
HELD = 1_000_000
PACKED = "bucket int, answered boolean, keys binary, counts binary, names binary, common binary"
GROUPED = "group int, keys binary, counts binary, names binary"
ANSWERS = "key long, names binary"
HASH_BASE = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RollingHash:
    """Hashes of byte runs anywhere in a text, equal for equal runs: differences of prefix sums modulo 2**64."""

    def __init__(self):
        self.values = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64)
        self.power = self.inverse = np.ones(1, np.uint64)

    def sums(self, flat: np.ndarray) -> np.ndarray:
        n = len(flat) + 1
        if len(self.power) < n:
            one = np.ones(1, np.uint64)
            grow = (np.full(n - 1, b, np.uint64) for b in (HASH_BASE, pow(HASH_BASE, -1, 1 << 64)))
            self.power, self.inverse = (np.concatenate([one, np.multiply.accumulate(g)]) for g in grow)
        out = np.zeros(n, np.uint64)
        np.cumsum(self.values[flat] * self.power[: n - 1], out=out[1:])
        return out

    def runs(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * self.inverse[start])


def canonical(names: np.ndarray, width: int, buckets: int) -> np.ndarray:
    """A name as answers give it: its bucket above its lowest ``width`` bytes; the name itself if whole."""
    if width == 8:
        return names
    bucket = (names >> np.uint64(48)) % np.uint64(buckets)
    return (bucket << np.uint64(48)) | (names & np.uint64((1 << 8 * width) - 1))


def _pack(names: np.ndarray, width: int) -> bytes:
    return names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(raw: bytes, width: int) -> np.ndarray:
    wide = np.zeros((len(raw) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return wide.view("<u8").ravel()


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(values)))


def _by_key(keys: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, how many names each has, and the names in that order."""
    order = np.argsort(keys, kind="stable")
    first, counts = _runs(keys[order])
    return keys[order][first], counts, names[order]


Namer = Callable[[pa.RecordBatch], tuple[list[int], list[np.ndarray]]]


def occurrences(rows: DataFrame, namer: Callable[[], Namer], wanted: str, width: int = 8) -> tuple[DataFrame, int]:
    """Of each row's names, those that occur again ("repeated") or nowhere else ("single"), and the number of buckets.

    In a task, ``namer()`` gives a function from a batch of ``rows`` to keys and, for each, an array of 64-bit names of
    the text that the key stands for. A name occurs again if another key has it, or the same row twice; rows of the same
    key are the same text and count once. Answers are (key, names): one row per key that has any, with its distinct
    canonical names (see above), sorted, as little-endian bytes.

    Map tasks settle what they can: a name that occurs twice in what a task holds is repeated, which is sent as one
    mark, so a name that a third of all rows have reaches its bucket once per million names. What is left is dealt out
    as packed arrays, one row per bucket; names are cut to ``width`` bytes besides their bucket. The receiving task sorts
    one bucket at a time, so its memory is that of a bucket, whose number is ``spark.sql.shuffle.partitions``.
    """
    buckets = min(shuffle_partitions(rows.sparkSession), 1 << 15)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, names, held, turn, name = [], [], 0, 0, namer()
        for batch in in_slices(batches):
            for key, found in zip(*name(batch)):
                keys.append(key)
                names.append(found)
                held += len(found)
                if held >= HELD:
                    yield packed(keys, names, turn)
                    keys, names, held, turn = [], [], 0, turn + 1
        if held:
            yield packed(keys, names, turn)

    def packed(key_list: list[int], name_list: list[np.ndarray], turn: int) -> pa.RecordBatch:
        _, first = np.unique(np.array(key_list, np.int64), return_index=True)
        owner = np.repeat(first, [len(name_list[i]) for i in first.tolist()])
        key = np.array(key_list, np.int64)[owner]
        name = canonical(np.concatenate([name_list[i] for i in first.tolist()]), width, buckets)
        order = np.argsort(name, kind="stable")
        name, key = name[order], key[order]
        start, length = _runs(name)
        again = np.repeat(length > 1, length)
        out = {c: [] for c in ("bucket", "answered", "keys", "counts", "names", "common")}

        def row(bucket: int, answered: bool, key: np.ndarray, name: np.ndarray, common: np.ndarray, size: int) -> None:
            distinct, counts, ordered = _by_key(key, name)
            values = (
                bucket, answered, distinct.tobytes(), counts.astype("<u4").tobytes(), _pack(ordered, size), _pack(common, size),
            )
            for column, value in zip(out.values(), values):
                column.append(value)

        none = name[:0]
        if wanted == "repeated" and again.any():
            # Settled here; these rows only pass through, and may go anywhere.
            row(int(name[0] % np.uint64(buckets) + np.uint64(turn)) % buckets, True, key[again], name[again], none, 8)
        marks, key, name = name[start[length > 1]], key[~again], name[~again]
        of_mark, of_name = (((x >> np.uint64(48)) % np.uint64(buckets)).astype(np.int64) for x in (marks, name))
        order, mark_order = np.argsort(of_name, kind="stable"), np.argsort(of_mark, kind="stable")
        edges = np.searchsorted(of_name[order], np.arange(buckets + 1))
        mark_edges = np.searchsorted(of_mark[mark_order], np.arange(buckets + 1))
        for b in range(buckets):
            mine, marked = order[edges[b] : edges[b + 1]], mark_order[mark_edges[b] : mark_edges[b + 1]]
            if len(mine) or len(marked):
                row(b, False, key[mine], name[mine], marks[marked], width)
        types = (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.record_batch([pa.array(v, t) for v, t in zip(out.values(), types)], list(out))

    def settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["answered"]:
                    counts = np.frombuffer(r["counts"], "<u4").astype(np.int64)
                    yield answers(np.frombuffer(r["keys"], "<i8"), counts, np.frombuffer(r["names"], "<u8"))
                    continue
                if r["bucket"] != bucket and parts:
                    yield from solved(parts, bucket)
                    parts = []
                bucket = r["bucket"]
                parts.append(r)
        if parts:
            yield from solved(parts, bucket)

    def solved(parts: list[dict], bucket: int) -> Iterator[pa.RecordBatch]:
        listed = np.concatenate([np.frombuffer(r["keys"], "<i8") for r in parts])
        distinct, place = np.unique(listed, return_inverse=True)
        owner = np.repeat(place.astype(np.int32), np.concatenate([np.frombuffer(r["counts"], "<u4") for r in parts]))
        name = _unpack(b"".join([r["names"] for r in parts]), width)
        common = np.unique(_unpack(b"".join([r["common"] for r in parts]), width))
        order = np.argsort(name)
        name, owner = name[order], owner[order]
        first, length = _runs(name)
        if not len(first):
            return
        again = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
        again = np.repeat(again | np.isin(name[first], common), length)
        chosen = again if wanted == "repeated" else ~again
        key, name = distinct[owner[chosen]], name[chosen]
        if width < 8:
            name = name | np.uint64(bucket << 48)
        if len(name):
            yield answers(*_by_key(key, name))

    def answers(keys: np.ndarray, counts: np.ndarray, names: np.ndarray) -> pa.RecordBatch:
        """Answers packed by groups of keys: a bucket has one row per group, not one per key."""
        group = (mixed(keys.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        first = np.cumsum(counts) - counts
        out = {"group": [], "keys": [], "counts": [], "names": []}
        start, length = _runs(group[order])
        for s, n in zip(start.tolist(), length.tolist()):
            mine = order[s : s + n]
            at = np.repeat(first[mine] - (np.cumsum(counts[mine]) - counts[mine]), counts[mine]) + np.arange(counts[mine].sum())
            values = (int(group[mine[0]]), keys[mine].tobytes(), counts[mine].astype("<u4").tobytes(), names[at].tobytes())
            for column, value in zip(out.values(), values):
                column.append(value)
        types = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.record_batch([pa.array(v, t) for v, t in zip(out.values(), types)], list(out))

    def unite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["group"] != group and parts:
                    yield united(parts)
                    parts = []
                group = r["group"]
                parts.append(r)
        if parts:
            yield united(parts)

    def united(parts: list[dict]) -> pa.RecordBatch:
        listed = np.concatenate([np.frombuffer(r["keys"], "<i8") for r in parts])
        counts = np.concatenate([np.frombuffer(r["counts"], "<u4") for r in parts])
        key, names = np.repeat(listed, counts), np.frombuffer(b"".join([r["names"] for r in parts]), "<u8")
        order = np.lexsort((names, key))
        key, names = key[order], names[order]
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (names[1:] != names[:-1])])
        key, names = key[fresh], names[fresh]
        first, length = _runs(key)
        rows_ = [names[a : a + n].tobytes() for a, n in zip(first.tolist(), length.tolist())]
        return pa.record_batch([pa.array(key[first]), pa.array(rows_, pa.binary())], ["key", "names"])

    dealt = rows.mapInArrow(deal, PACKED).repartition(buckets, "bucket").sortWithinPartitions("answered", "bucket")
    grouped = dealt.mapInArrow(settle, GROUPED).repartition(buckets, "group").sortWithinPartitions("group")
    return grouped.mapInArrow(unite, ANSWERS), buckets
