"""Tokens of two tokenizers aligned on the bytes of each text, with corpus-wide counts of linked id pairs.

The byte offsets where tokens end form two rising arrays. Where an end of A is also an end of B, the index shift between
the arrays says on which diagonal the walk is; a stretch of common ends on one diagonal, next to each other, is a run of
one-to-one groups and is taken at once. Only between runs, where the ends part, lie irregular groups. Texts whose tokens
spell the same bytes end together in both arrays, so a whole slice of texts is walked as one pair of arrays. Linked pairs are
the A and B tokens whose byte ranges overlap.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from monthloom.llm.tokens import Encoder, in_slices
from monthloom.llm.workspace import written
from monthloom.session import fits_broadcast

ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "link_a array<long>, link_b array<long>, link_m array<long>"
)
_BYTE_PIECE = re.compile(r"<0x([0-9A-Fa-f]{2})>")


def _byte_level_table() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves,
    the other bytes in rising order take the code points from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(others)}


class Pair:
    """Both tokenizers and the bytes of every id, loaded once per Python worker."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.pieces = Encoder.of_process(a_path)
        self.special = self.pieces.special
        table = _byte_level_table()
        vocab = self.a.get_vocab(with_added_tokens=True)
        added = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            plain = piece in added or any(c not in table for c in piece)
            self.a_bytes[i] = piece.encode("utf-8") if plain else bytes(table[c] for c in piece)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            byte = _BYTE_PIECE.fullmatch(piece)
            self.b_bytes.append(bytes([int(byte.group(1), 16)]) if byte else piece.replace("▁", " ").encode("utf-8"))
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        self.a_flat, self.b_flat = (np.frombuffer(b"".join(t), np.uint8) for t in (self.a_bytes, self.b_bytes))
        self.a_start, self.b_start = (np.cumsum(n) - n for n in (self.a_len, self.b_len))

    @staticmethod
    def _spelled(ids: np.ndarray, flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> bytes:
        """The bytes of ``ids`` in a row, gathered at once."""
        sizes = length[ids]
        before = np.cumsum(sizes) - sizes
        return flat[np.repeat(start[ids] - before, sizes) + np.arange(int(sizes.sum()))].tobytes()

    @classmethod
    def of_process(cls, a_path: str, b_path: str) -> Pair:
        held = sys.__dict__.setdefault("_monthloom_pairs", {})
        if (a_path, b_path) not in held:
            held[(a_path, b_path)] = cls(a_path, b_path)
        return held[(a_path, b_path)]

    def _a_ids(self, texts: list[str]) -> list[np.ndarray]:
        """A ids of each text, with each distinct piece encoded once; special tokens' strings go to the library as plain text."""
        plain = [i for i, t in enumerate(texts) if not any(s in t for s in self.special)]
        rest = sorted(set(range(len(texts))) - set(plain))
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
        for i, x in zip(plain, self.pieces.encode([texts[i] for i in plain])):
            out[i] = np.frombuffer(x, "<u4").astype(np.int64)
        for i, e in zip(rest, self.a.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            out[i] = np.asarray(e.ids, np.int64)
        return out

    def tokens(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """A and B ids of each text; both empty where a text is null or empty or its tokens do not spell blank + text."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(texts)
        live = [i for i, t in enumerate(texts) if t]
        a_ids = self._a_ids([" " + texts[i] for i in live])
        b_ids = self.b.encode([texts[i] for i in live], num_threads=1)
        for i, a, b in zip(live, a_ids, b_ids):
            b = np.asarray(b, np.int64)
            whole = (" " + texts[i]).encode("utf-8")
            if self._spelled(b, self.b_flat, self.b_start, self.b_len) != whole:
                continue
            if self._spelled(a, self.a_flat, self.a_start, self.a_len) != whole:
                # Pieces are looked up by hash; the library has the last word.
                a = np.asarray(self.a.encode(" " + texts[i], add_special_tokens=False).ids, np.int64)
                if self._spelled(a, self.a_flat, self.a_start, self.a_len) != whole:
                    continue
            out[i] = (a, b)
        return out


def diagonal_runs(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First A place, first B place and length of every run: common ends next to each other on one diagonal.

    A run's first end closes the irregular or one-to-one group before it; each further end closes a one-to-one group.
    """
    near = np.minimum(np.searchsorted(b_end, a_end), max(len(b_end) - 1, 0))
    x = np.flatnonzero(b_end[near] == a_end) if len(b_end) else near
    y = near[x]
    starts = np.flatnonzero((np.diff(x, prepend=-2) != 1) | (np.diff(y, prepend=-2) != 1))
    return x[starts], y[starts], np.diff(np.append(starts, len(x)))


def group_stops(a_end, b_end) -> tuple[np.ndarray, np.ndarray]:
    """Where each group stops in A and in B (exclusive), for two rising end arrays with the same last value: every end
    of every run on a diagonal."""
    x, y, length = diagonal_runs(np.asarray(a_end), np.asarray(b_end))
    along = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length) + 1
    return np.repeat(x, length) + along, np.repeat(y, length) + along


def aligned_groups(a_end, b_end) -> list[tuple[int, int, int, int]]:
    """Groups as (first A, last A + 1, first B, last B + 1)."""
    a_stop, b_stop = (x.tolist() for x in group_stops(a_end, b_end))
    return list(zip([0, *a_stop[:-1]], a_stop, [0, *b_stop[:-1]], b_stop))


def groups_bytes(a: np.ndarray, b: np.ndarray, a_stop: np.ndarray, b_stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3;`` as ASCII, each group's A ids, then its B ids, groups in order; and where each group stops."""
    a_size, b_size = np.diff(a_stop, prepend=0), np.diff(b_stop, prepend=0)
    before = np.cumsum(a_size + b_size) - (a_size + b_size)
    at_a = np.arange(len(a)) + np.repeat(before - (a_stop - a_size), a_size)
    at_b = np.arange(len(b)) + np.repeat(before + a_size - (b_stop - b_size), b_size)
    ids, marks = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[at_a], ids[at_b] = a, b
    marks[at_a[a_stop - 1]], marks[at_b[b_stop - 1]] = ord("|"), ord(";")
    width = len(str(int(ids.max(initial=0))))
    powers = 10 ** np.arange(width - 1, -1, -1)
    # One row per id: its digits to the right, its mark behind them; leading places are left out.
    cells = np.empty((len(ids), width + 1), np.uint8)
    used = np.ones((len(ids), width + 1), bool)
    for k, p in enumerate(powers.tolist()):
        cells[:, k] = ids // p % 10 + ord("0")
        used[:, k] = (ids >= p) | (k == width - 1)
    cells[:, width] = marks
    ends = np.cumsum(used.sum(axis=1))
    return cells[used], ends[at_b[b_stop - 1]]


def linked_places(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all A and B tokens whose byte ranges overlap: every stretch between two neighbouring ends, of either side,
    lies in one A token and one B token, and each overlapping pair has one such stretch."""
    in_b, in_a = np.searchsorted(b_end, a_end), np.searchsorted(a_end, b_end)
    alone = np.flatnonzero(a_end[in_a] != b_end) if len(a_end) else in_a
    return np.r_[np.arange(len(a_end)), in_a[alone]], np.r_[in_b, alone]


def align_slice(pair: Pair, tokens: list[tuple[np.ndarray, np.ndarray]]):
    """(n_a, n_b, n_groups, n_links) per text, digests of the groups' texts, and the distinct linked id pairs of each text:
    offsets of the texts, A ids, B ids, occurrences."""
    n_a, n_b = (np.array([len(t[k]) for t in tokens], np.int64) for k in (0, 1))
    a, b = (np.concatenate([*(t[k] for t in tokens), np.zeros(0, np.int64)]) for k in (0, 1))
    # The texts' tokens spell the same bytes, so each text ends at one place of both arrays.
    a_end, b_end = np.cumsum(pair.a_len[a]), np.cumsum(pair.b_len[b])
    a_stop, b_stop = group_stops(a_end, b_end)
    groups = np.searchsorted(a_stop, np.cumsum(n_a), side="right")
    flat, ends = groups_bytes(a, b, a_stop, b_stop)
    cuts = np.append(0, ends)[groups].tolist()
    digests = [hashlib.sha256(flat[x : y - 1]).hexdigest() if y > x else "" for x, y in zip([0, *cuts[:-1]], cuts)]
    x, y = linked_places(a_end, b_end)
    text = np.repeat(np.arange(len(tokens)), n_a)[x]
    wide, high = np.int64(len(pair.b_len)), np.int64(len(pair.b_len)) * len(pair.a_len)
    keys, counts = np.unique(text * high + a[x] * wide + b[y], return_counts=True)
    offsets = np.searchsorted(keys, np.arange(len(tokens) + 1) * high)
    numbers = np.stack([n_a, n_b, np.diff(groups, prepend=0), np.bincount(text, minlength=len(tokens))], axis=1)
    keys %= high
    return numbers, digests, (offsets, keys // wide, keys % wide, counts)


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and its linked id pairs with their multiplicity."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair.of_process(a_path, b_path)
        for batch in in_slices(batches, rows=200):
            numbers, digests, (offsets, *links) = align_slice(pair, pair.tokens(batch.column(1).to_pylist()))
            lists = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(x)) for x in links]
            arrays = [batch.column(0).cast(pa.int64()), *(pa.array(numbers[:, k]) for k in range(4)), pa.array(digests, pa.string()), *lists]
            names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "link_a", "link_b", "link_m"]
            yield pa.record_batch(arrays, names)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, ALIGNED)


def alignment_counts(docs: DataFrame, a_path: str, b_path: str, salts: int = 64, **columns) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is ``a_path`` (a tokenizers file) on blank + text, B is ``b_path`` (a sentencepiece model) on the text; special
    tokens' strings are plain text. Null or empty texts, and texts whose A or B token bytes do not spell blank + text,
    have no tokens: zeros and an empty ``groups_sha256``. An id pair's count is the number of distinct non-null doc_ids
    that link it (repeated rows are one document; rows with a null doc_id are returned, with n_best and count_sum 0, but
    not counted). ``n_best``
    counts links whose pair count is the highest of their A id, ties included; ``count_sum`` adds the counts of all links.
    Other columns are not read.
    """
    # A fixed number per row, written with it, keys the links; rows with the same doc_id and text get equal sums.
    rows = written(aligned(docs, a_path, b_path, **columns).withColumn("rid", F.monotonically_increasing_id()), "aligned")
    known = rows.where(F.col("doc_id").isNotNull())
    links = F.arrays_zip(F.col("link_a").alias("a"), F.col("link_b").alias("b"), F.col("link_m").alias("m"))
    held = known.select("rid", F.explode(links).alias("l")).select("rid", "l.*")
    # A row's pairs are distinct, so those of a doc_id of one row are counted where they lie; only doc_ids of several rows
    # have theirs made distinct first.
    repeated = written(known.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    ends = F.arrays_zip(F.col("link_a").alias("a"), F.col("link_b").alias("b"))
    listed = lambda some: some.select("doc_id", F.explode(ends).alias("l")).select("doc_id", "l.*")
    once = listed(known.join(repeated, "doc_id", "left_anti"))
    again = listed(known.join(repeated, "doc_id", "left_semi")).distinct()
    pairs = once.union(again).groupBy("a", "b").agg(F.count("*").alias("count"))
    pairs = pairs.withColumn("best", F.max("count").over(Window.partitionBy("a")))
    if fits_broadcast(pairs):
        met = held.join(F.broadcast(pairs), ["a", "b"])
    else:
        spread = pairs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = held.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(salts)))
        met = salted.join(spread, ["a", "b", "salt"])
    sums = met.groupBy("rid").agg(
        F.sum(F.when(F.col("count") == F.col("best"), F.col("m")).otherwise(0)).alias("n_best"),
        F.sum(F.col("m") * F.col("count")).alias("count_sum"),
    )
    per_doc = rows.drop("link_a", "link_b", "link_m").join(sums, "rid", "left")
    return per_doc.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256",
    )
