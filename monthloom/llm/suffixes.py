"""Suffix-array dedup: repeated byte strings by a difference cover and suffix buckets."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.llm.names import Namer, RollingHash, canonical, occurrences
from monthloom.llm.tokens import in_slices
from monthloom.llm.workspace import written

REMOVED = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def difference_cover(q: int) -> tuple[int, np.ndarray]:
    """A period v = q * q + q + 1 and q + 1 residues whose differences are all residues (q prime).

    The powers of a generator of the field of q ** 3 elements that lie in a plane through 0, as exponents modulo v.
    """
    v, order = q * q + q + 1, q**3 - 1
    factors = [p for p in range(2, order) if order % p == 0 and all(p % d for d in range(2, int(p**0.5) + 1))]

    def times(a: tuple, b: tuple, c: tuple) -> tuple:
        """Product modulo x ** 3 = c0 + c1 x + c2 x ** 2."""
        full = [0] * 5
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                full[i + j] += x * y
        for d in (4, 3):
            for i in range(3):
                full[d - 3 + i] += full[d] * c[i]
        return tuple(x % q for x in full[:3])

    def power(n: int, c: tuple) -> tuple:
        out, base = (1, 0, 0), (0, 1, 0)
        while n:
            if n & 1:
                out = times(out, base, c)
            base, n = times(base, base, c), n >> 1
        return out

    generators = ((c0, c1, c2) for c0 in range(1, q) for c1 in range(q) for c2 in range(q))
    c = next(
        c for c in generators if power(order, c) == (1, 0, 0) and all(power(order // p, c) != (1, 0, 0) for p in factors)
    )
    element, cover = (1, 0, 0), []
    for i in range(v):
        if element[2] == 0:
            cover.append(i)
        element = times(element, (0, 1, 0), c)
    return v, np.array(cover)


class Cover:
    """Sample places of a text: those whose residue is in the cover. ``least`` is the length of repeats sought.

    Any two places have an offset below v at which both are sample places. So if the strings of ``least`` bytes at two
    places are equal, they hold a pair of equal sample strings, of ``length`` = least - v + 1 bytes, at such an offset.
    Offsets fall into ranges of ``step``; all strings of ``least`` bytes of a range hold the same ``inner`` bytes, which
    start a multiple of ``step`` before the sample place.
    """

    step = 39

    def __init__(self, least: int, q: int = 17):
        self.v, self.residues = difference_cover(q)
        self.least, self.length, self.inner = least, least - self.v + 1, least - self.step + 1
        if self.length < 16:
            raise ValueError("repeats must be longer than the cover's period by 16 bytes at least")

    def places(self, n: int) -> np.ndarray:
        """Sample places with a whole sample string in a text of n bytes."""
        if n < self.least:
            return np.zeros(0, np.int64)
        all_ = (np.arange(0, n, self.v)[:, None] + self.residues).ravel()
        return all_[all_ + self.length <= n]

    def inner_places(self, n: int, places: np.ndarray) -> np.ndarray:
        """Where the inner strings of all ranges around these sample places start."""
        all_ = np.unique(places[:, None] - np.arange(0, self.v, self.step))
        return all_[(all_ >= 0) & (all_ + self.inner <= n)]

    def candidates(self, n: int, inner: np.ndarray) -> np.ndarray:
        """Places of strings of ``least`` bytes that hold one of these inner strings."""
        change = np.zeros(n + 2, np.int32)
        np.add.at(change, np.maximum(inner - self.step + 1, 0), 1)
        np.add.at(change, inner + 1, -1)
        return np.flatnonzero(np.cumsum(change)[: n - self.least + 1] > 0)


def _text_hashes(batch_texts: list[bytes], hasher: RollingHash) -> tuple[np.ndarray, np.ndarray]:
    return hasher.sums(np.frombuffer(b"".join(batch_texts), np.uint8)), np.cumsum([0, *map(len, batch_texts)])


def repeated_spans(docs: DataFrame, least: int = 400, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Remove every byte that a string of ``least`` bytes covers which also starts elsewhere, in this or another row.

    Texts are UTF-8 bytes. A row of the result per row of ``docs``: doc_id, n_bytes, n_removed, n_spans (maximal runs
    removed), kept_sha256 of the bytes left, and with ``keep_text`` those bytes as ``kept``.

    1. Sample suffixes, at the places of a difference cover (18 of 307), are named by a hash of their first 94 bytes,
       and the names are sorted in buckets: these are the sample ranks. Sample places whose name stands alone end there.
    2. Around the others, the eight inner strings (362 bytes) are named and sorted likewise, which tells the ranges of
       suffixes that may be repeats. By the cover, none is missed.
    3. These suffixes, in place of all, are sorted one bucket at a time. What would be ties of hundreds of bytes to
       compare is settled by names of all ``least`` bytes; bucket sizes, not texts, bound the memory. A suffix whose name
       stands alone is dropped, the rest are repeats. Their bytes are removed.

    Copies of a text count as one in these steps, and are removed whole if at least ``least`` bytes long. Only texts with a
    repeated sample are shuffled on. Null texts count as empty: no bytes, no spans. Null ids and repeated rows are rows
    like others. Strings are told apart by 64-bit hashes besides their bucket.
    """
    cover = Cover(least)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("key", F.xxhash64("text"))

    def sampler() -> Namer:
        hasher = RollingHash()

        def sample(batch: pa.RecordBatch) -> tuple[list[int], list[np.ndarray]]:
            texts = batch.column(1).to_pylist()
            sums, starts = _text_hashes(texts, hasher)
            places = [cover.places(len(t)) + start for t, start in zip(texts, starts.tolist())]
            return batch.column(0).to_pylist(), [hasher.runs(sums, at, at + cover.length) for at in places]

        return sample

    long_ = base.where(F.octet_length("text") >= least)
    ranks, buckets = occurrences(long_.select("key", "text"), sampler, "repeated", width=4)
    ranked = ranks.withColumnRenamed("names", "ranks")
    copied = long_.groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1")
    wanted = ranked.join(copied, "key", "full").select("key", "ranks", F.col("copies").isNotNull().alias("copied"))
    first = written(base.join(wanted, "key"), "sampled")

    def inner(hasher: RollingHash, text: bytes, ranks: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Prefix sums of the text, places of inner strings around repeated samples, and their names."""
        sums = hasher.sums(np.frombuffer(text, np.uint8))
        at = cover.places(len(text))
        names = canonical(hasher.runs(sums, at, at + cover.length), 4, buckets)
        at = at[np.isin(names, np.frombuffer(ranks or b"", "<u8"))]
        at = cover.inner_places(len(text), at)
        return sums, at, hasher.runs(sums, at, at + cover.inner)

    def possible(hasher: RollingHash, text: bytes, ranks: bytes | None, inners: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """Places of suffixes that may be repeats, and their names."""
        if not inners:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        sums, at, names = inner(hasher, text, ranks)
        at = at[np.isin(canonical(names, 4, buckets), np.frombuffer(inners, "<u8"))]
        at = cover.candidates(len(text), at)
        return at, hasher.runs(sums, at, at + least)

    def named(name) -> Callable[[], Namer]:
        """Names by key for rows of the key and what ``name`` takes; of copies in a row, the first is enough."""

        def start() -> Namer:
            hasher, last = RollingHash(), None

            def run(batch: pa.RecordBatch) -> tuple[list[int], list[np.ndarray]]:
                nonlocal last
                keys, names = [], []
                for key, *values in zip(*(c.to_pylist() for c in batch.columns)):
                    if key != last:
                        keys.append(key)
                        names.append(name(hasher, *values))
                        last = key
                return keys, names

            return run

        return start

    sampled = first.where("ranks is not null").select("key", "text", "ranks")
    found, _ = occurrences(sampled, named(lambda *a: inner(*a)[2]), "repeated", width=4)
    inners = found.withColumnRenamed("names", "inners")
    held = written(first.join(inners, "key", "left").where("copied or inners is not null"), "ranged")
    ranged = held.where("inners is not null").select("key", "text", "ranks", "inners")
    lone, _ = occurrences(ranged, named(lambda *a: possible(*a)[1]), "single", width=8)
    alone = lone.withColumnRenamed("names", "alone")

    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = RollingHash()
        columns = ("text", "ranks", "inners", "copied", "alone")
        for batch in in_slices(batches, 1 << 20):
            out = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            for text, ranks, inners, copied, alone in zip(*(batch.column(c).to_pylist() for c in columns)):
                if copied:
                    covered = np.ones(len(text), bool)
                else:
                    at, names = possible(hasher, text, ranks, inners)
                    at = at[~np.isin(names, np.frombuffer(alone or b"", "<u8"))]
                    change = np.zeros(len(text) + 1, np.int32)
                    np.add.at(change, at, 1)
                    np.add.at(change, at + least, -1)
                    covered = np.cumsum(change[:-1]) > 0
                edge = np.diff(np.concatenate([[0], covered.astype(np.int8)]))
                kept = np.frombuffer(text, np.uint8)[~covered].tobytes()
                values = (len(text), int(covered.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest(), kept if keep_text else None)
                for column, value in zip(out.values(), values):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            arrays = [pa.array(v, t) for v, t in zip(out.values(), types)]
            yield pa.record_batch([batch.column("doc_id"), *arrays], ["doc_id", *out])

    kind = base.schema["doc_id"].dataType.simpleString()
    changed = held.join(alone, "key", "left").select("doc_id", "text", "ranks", "inners", "copied", "alone")
    changed = changed.mapInArrow(remove, f"doc_id {kind}, {REMOVED}")
    none = F.lit(0).cast("long")
    # Rows without any repeat need their digests only, which are computed before anything is shuffled.
    rest = base.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("kept_sha256"), *([F.col("text").alias("kept")] if keep_text else []))
    rest = rest.join(held.select("key").distinct(), "key", "left_anti")
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else [])]
    return changed.select(*columns).union(rest.withColumns({"n_removed": none, "n_spans": none}).select(*columns))
