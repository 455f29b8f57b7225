"""Token ids of whole texts by a public tokenizer file."""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds of code points, as byte-level vocabularies of this family tell them apart when they cut a text into pieces.
LETTER, NUMBER, OTHER, SPACE, END = range(5)
# Code points from here on, and white space that regex libraries class differently, go to the library with their text.
SETTLED = 0x250
# Endings that stay with their apostrophe.
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")

# Fixed value: bytes of text that are encoded at once. The hash, sort and piece arrays of a slice are many times its size.
SLICE = 1 << 18

ENCODED = "part int, doc_id {kind}, local_start long, n_tokens long, ids binary"


def _kinds() -> np.ndarray:
    """Kind of each settled code point; 255 marks the unsettled."""
    kinds = np.full(SETTLED, OTHER, np.uint8)
    for code in range(SETTLED):
        first = unicodedata.category(chr(code))[0]
        if first in "LN":
            kinds[code] = LETTER if first == "L" else NUMBER
        elif chr(code).isspace():
            kinds[code] = SPACE if code not in (*range(0x1C, 0x20), 0x85) else 255
    return kinds


class Encoder:
    """The ids that the library gives for each whole text, with every distinct piece encoded by it once.

    Merges never cross pieces, so pieces are found on whole batches in numpy, known ones are looked up by a 64-bit
    hash with their length, and only new ones go through the library; at most ``remembered`` are kept. Tokenizers that
    cut texts in another way, texts with unsettled code points or a special token's string are encoded whole.
    """

    def __init__(self, path: str, remembered: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        plan = json.loads(self.library.to_str())
        cut = plan["pre_tokenizer"] or {}
        self.by_piece = plan["normalizer"] is None and cut == {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True,
        }
        self.special = [t["content"] for t in plan["added_tokens"]]
        self.vocabulary = self.library.get_vocab_size()
        self.kinds = _kinds()
        self.odd = re.compile("[^" + "".join(re.escape(chr(c)) for c in np.flatnonzero(self.kinds != 255)) + "]")
        self.remembered = remembered
        names = self.library.get_vocab()
        self.token_bytes = np.zeros(max(names.values()) + 1, np.int64)
        self.token_bytes[list(names.values())] = [len(x) for x in names]
        self.values = np.random.default_rng(7).integers(1, 1 << 63, SETTLED, np.uint64) | np.uint64(1)
        self.power = self.inverse = np.ones(1, np.uint64)
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.first = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.count, self.ids = np.zeros(0, np.uint32), np.zeros(0, np.uint32)

    @classmethod
    def of_process(cls, path: str) -> Encoder:
        """One per Python worker, so that later tasks know the pieces of earlier ones."""
        held = sys.__dict__.setdefault("_monthloom_encoders", {})
        if path not in held:
            held[path] = cls(path)
        return held[path]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        settled = [i for i, t in enumerate(texts) if self._settled(t)]
        rest = sorted(set(range(len(texts))) - set(settled))
        found = self.library.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)
        for i, e in zip(rest, found):
            out[i] = np.asarray(e.ids, "<u4").tobytes()
        if settled:
            flat, ends = self._settled_ids([texts[i] for i in settled])
            low = 0
            for i, high in zip(settled, ends.tolist()):
                out[i] = flat[low:high].tobytes()
                low = high
        return out

    def _settled(self, text: str) -> bool:
        return self.by_piece and not self.odd.search(text) and not any(s in text for s in self.special)

    def _settled_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text's ids end."""
        joined = "\0".join(texts) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        kind = self.kinds[codes]
        closing = np.cumsum([len(t) + 1 for t in texts]) - 1
        kind[closing] = END
        starts = self._starts(codes, kind)
        at = np.flatnonzero(starts)
        ends = np.append(at[1:], len(codes))
        hashes = self._hash(codes, at, ends)
        if len(self.hashes) > self.remembered:
            self._forget()
        distinct, example, which = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, distinct)
        known = place < len(self.hashes)
        known[known] = self.hashes[place[known]] == distinct[known]
        new = np.flatnonzero(~known)
        if len(new):
            self._learn(distinct[new], [joined[at[i] : ends[i]] for i in example[new].tolist()])
            place = np.searchsorted(self.hashes, distinct)
        place = place[which]
        count = self.count[place].astype(np.int64)
        closed = kind[at] == END
        count[closed] = 0
        total = np.cumsum(count)
        flat = self.ids[np.repeat(self.first[place] - (total - count), count) + np.arange(total[-1])]
        return flat.astype("<u4", copy=False), total[closed]

    @staticmethod
    def _starts(codes: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Where pieces start. A blank joins the run after it; other white space before a run stays apart from it."""
        start = np.ones(len(codes), bool)
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == END)
        begins = np.flatnonzero(start[1:] & (kind[1:] < SPACE) & (kind[:-1] == SPACE)) + 1
        blank = codes[begins - 1] == 0x20
        start[begins[blank]] = False
        start[begins - 1] = True
        quote = np.flatnonzero((codes[:-1] == 0x27) & start[:-1] & (kind[1:] == LETTER))
        for i in quote.tolist():
            if codes[i] == 0x27 and start[i]:
                letters = "".join(map(chr, codes[i + 1 : i + 3].tolist()))
                for ending in ENDINGS:
                    if letters.startswith(ending):
                        start[i + 1] = False
                        start[i + 1 + len(ending)] = True
                        break
        return start

    def _hash(self, codes: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(codes) + 1
        if len(self.power) < n:
            base = 0x9E3779B97F4A7C15
            grow = np.full(n - 1, base, np.uint64), np.full(n - 1, pow(base, -1, 1 << 64), np.uint64)
            one = np.ones(1, np.uint64)
            self.power, self.inverse = (np.concatenate([one, np.multiply.accumulate(g)]) for g in grow)
        sums = np.zeros(n, np.uint64)
        np.cumsum(self.values[codes] * self.power[: n - 1], out=sums[1:])
        found = (sums[ends] - sums[at]) * self.inverse[at] + (ends - at).astype(np.uint64)
        found ^= found >> np.uint64(31)
        return found * np.uint64(0xD6E8FEB86659FD93)

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        """Encode new pieces. Those of one blank and letters are encoded many in a row, as the library parts them."""
        plain = [p[0] == " " and p[1:].isalpha() for p in pieces]
        order = sorted(range(len(pieces)), key=plain.__getitem__)
        split = len(pieces) - sum(plain)
        alone = self.library.encode_batch_fast([pieces[i] for i in order[:split]], add_special_tokens=False)
        rows = [order[i : i + 500] for i in range(split, len(order), 500)]
        many = self.library.encode_batch_fast(["".join([pieces[i] for i in r]) for r in rows], add_special_tokens=False)
        ids = [np.asarray(e.ids, np.uint32) for e in alone]
        counts = [len(x) for x in ids]
        for row, e in zip(rows, many):
            found = np.asarray(e.ids, np.uint32)
            bytes_before = np.concatenate([[0], np.cumsum(self.token_bytes[found])])
            cuts = np.cumsum([len(pieces[i].encode()) for i in row])
            last = np.searchsorted(bytes_before, cuts)
            counts.extend(np.diff(last, prepend=0).tolist())
            ids.append(found)
        counts = np.asarray(counts, np.int64)
        first = len(self.ids) + np.cumsum(counts) - counts
        sort = np.argsort(hashes[order])
        hashes = hashes[order][sort]
        where = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, where, hashes)
        self.first = np.insert(self.first, where, first[sort].astype(np.uint32))
        self.count = np.insert(self.count, where, counts[sort].astype(np.uint32))
        self.ids = np.concatenate([self.ids, *ids])


def in_slices(batches: Iterable[pa.RecordBatch], size: int = 1 << 20, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches in slices of about ``size`` bytes at most; a longer single row is a slice of its own."""
    for batch in batches:
        step = max(1, min(rows, int(batch.num_rows * size / max(batch.nbytes, 1))))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def text_slices(texts: pa.Array, size: int = SLICE) -> Iterator[pa.Array]:
    """Slices of about ``size`` bytes, whatever the lengths; only one slice's texts are Python objects at a time."""
    part = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // size
    starts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
    for a, b in zip(starts, [*starts[1:], len(texts)]):
        yield texts.slice(a, b - a)


def encoded(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's ids, closed by ``end_id``, with its place in its partition.

    Null texts count as empty: they have the end id only. Rows keep their order; a row's ids do not depend on others.
    Each task writes its partition number and the ids before the row in the partition, which later become offsets.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = Encoder.of_process(tokenizer), TaskContext.get().partitionId(), 0
        for batch in in_slices(batches, SLICE):
            ids = [x + end for x in encoder.encode([t or "" for t in batch.column(1).to_pylist()])]
            counts = np.array([len(x) // 4 for x in ids], np.int64)
            starts = before + np.cumsum(counts) - counts
            before += int(counts.sum())
            columns = [
                pa.array(np.full(len(ids), part, np.int32)), batch.column(0), pa.array(starts), pa.array(counts),
                pa.array(ids, pa.binary()),
            ]
            yield pa.record_batch(columns, ["part", "doc_id", "local_start", "n_tokens", "ids"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, ENCODED.format(kind=narrow.schema["doc_id"].dataType.simpleString()))
