"""Passages of words that recur across documents: chosen by hashes, located by Aho-Corasick automata.

1. Anchors: of each window of ``width`` consecutive words, the run of about half as many words with the smallest hash.
   Equal windows have the same anchor, and neighbouring windows mostly share theirs, so there are few. Anchors that only one
   text has are dropped (see ``names``); only windows of the other anchors can recur, which spares the rest any shuffle.
2. Confirm: these windows get a 96-bit key each, and the smallest doc_id that has the key. A document wants the windows
   that a smaller doc_id has too.
3. Locate: documents go by in shards of about ``shard_bytes`` of text. The passages that a shard's documents want are
   compiled into one automaton over words, through which these documents stream; it reports every occurrence, overlaps
   included. An automaton is bounded by its shard's text, and no document meets more than one.
4. A word is removed when it lies in an occurrence of a passage that a document with a smaller doc_id has.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from monthloom.llm.names import Namer, RollingHash, canonical, mixed, occurrences
from monthloom.llm.tokens import in_slices

# The characters between words, and the bytes of an anchor's name besides its bucket.
_SPLIT = re.compile(r"[\x20\x09-\x0D]+")
NAME_BYTES = 6
HELD = "doc_id long, key long, h1 long, h2 int"
OUTCOME = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def split_words(text: str | None) -> list[str]:
    """Words between separators, unchanged; a null text has none."""
    return [w for w in _SPLIT.split(text or "") if w]


@dataclass
class Words:
    """All words of some texts, in order: where each text's words begin in the arrays (and the end), each word's place in
    the bytes, and two hashes of it."""

    flat: bytes
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    one: np.ndarray
    two: np.ndarray

    def runs(self, hashes: np.ndarray, width: int) -> np.ndarray:
        """A hash of the ``width`` words from each word on; the last words have none."""
        n = max(len(hashes) - width + 1, 0)
        out = np.zeros(n, np.uint64)
        for j in range(width):
            out += hashes[j : j + n] * np.uint64(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) | 1)
        return mixed(out)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and text of every window that lies in one text."""
        sizes = np.diff(self.bounds)
        counts = np.maximum(sizes - width + 1, 0)
        text = np.repeat(np.arange(len(sizes)), counts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
        return self.bounds[text] + nth, text

    def anchors(self, width: int, first: np.ndarray) -> np.ndarray:
        """The smallest hash of a run of ``width // 2`` words in each window."""
        part = max(width // 2, 1)
        runs = self.runs(self.one, part)
        least = runs[first]
        for j in range(1, width - part + 1):
            least = np.minimum(least, runs[first + j])
        return least


class Reader:
    """Words and their hashes, for the texts of one task."""

    def __init__(self):
        self.hashers = RollingHash(), RollingHash()
        self.hashers[1].values = np.random.default_rng(12).integers(1, 1 << 63, 256, np.uint64)

    def words(self, texts: list[bytes]) -> Words:
        joined = b" ".join([*texts, b""])
        flat = np.frombuffer(joined, np.uint8)
        space = (flat == 32) | ((flat >= 9) & (flat <= 13))
        start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        end = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
        bounds = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        return Words(joined, bounds, start, end, *(h.runs(h.sums(flat), start, end) for h in self.hashers))


def _namer(width: int):
    """Anchors of (key, text) rows."""

    def start() -> Namer:
        reader = Reader()

        def run(batch: pa.RecordBatch) -> tuple[list[int], list[np.ndarray]]:
            words = reader.words(batch.column(1).to_pylist())
            first, text = words.windows(width)
            found = words.anchors(width, first)
            edges = np.searchsorted(text, np.arange(batch.num_rows + 1)).tolist()
            return batch.column(0).to_pylist(), [np.unique(found[a:b]) for a, b in zip(edges, edges[1:])]

        return run

    return start


def _candidates(width: int, buckets: int, group_bytes: int):
    """(doc_id, key, h1, h2) of the windows whose anchor is among the row's names."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in in_slices(batches, group_bytes):
            words = reader.words(batch.column("text").to_pylist())
            first, text = words.windows(width)
            found = canonical(words.anchors(width, first), NAME_BYTES, buckets)
            edges = np.searchsorted(text, np.arange(batch.num_rows + 1)).tolist()
            names = [np.frombuffer(x, "<u8") for x in batch.column("names").to_pylist()]
            keep = np.concatenate([*(np.isin(found[a:b], n) for a, b, n in zip(edges, edges[1:], names)), np.zeros(0, bool)])
            first, text = first[keep], text[keep]
            h1, h2 = (words.runs(h, width)[first] for h in (words.one, words.two))
            rows = [batch.column(c).take(pa.array(text)) for c in ("doc_id", "key")]
            yield pa.record_batch([*rows, pa.array(h1.view(np.int64)), pa.array((h2 >> np.uint64(32)).astype(np.uint32).view(np.int32))], ["doc_id", "key", "h1", "h2"])

    return run


def _located(words: Words, width: int, wanted: list[np.ndarray]) -> np.ndarray:
    """Which words of a shard are removed: occurrences of the passages that their document wants, by one automaton."""
    import ahocorasick

    covered = np.zeros(len(words.start) + 1, np.int64)
    passages = np.unique(np.concatenate([*wanted, np.zeros(0, np.int64)]))
    if not len(passages):
        return covered[:-1] > 0
    first, _ = words.windows(width)
    keys, at = np.unique(words.runs(words.one, width)[first].view(np.int64), return_index=True)
    found = np.isin(keys, passages)
    # Words as small numbers, the same for the same word.
    numbers = np.unique(words.one, return_inverse=True)[1].tolist()
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, f in zip(keys[found].tolist(), first[at[found]].tolist()):
        automaton.add_word(tuple(numbers[f : f + width]), key)
    automaton.make_automaton()
    bounds = words.bounds.tolist()
    for i, mine in enumerate(wanted):
        if len(mine):
            own = set(mine.tolist())
            ends = [e for e, key in automaton.iter(tuple(numbers[bounds[i] : bounds[i + 1]])) if key in own]
            ends = np.array(ends, np.int64) + bounds[i] + 1
            np.add.at(covered, ends - width, 1)
            np.add.at(covered, ends, -1)
    return np.cumsum(covered[:-1]) > 0


def _outcome(width: int, shard_bytes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in in_slices(batches, shard_bytes):
            texts, lists = batch.column("text").to_pylist(), batch.column("wanted")
            words = reader.words(texts)
            edges = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            removed = _located(words, width, np.split(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), edges[:-1]))
            sums = np.diff(np.concatenate([[0], np.cumsum(removed)])[words.bounds])
            bounds, stay = words.bounds.tolist(), (~removed).tolist()
            # A text's bytes between ASCII white space are its words.
            kept = [
                b" ".join(compress(t.split(), stay[a:b]) if gone else t.split())
                for t, a, b, gone in zip(texts, bounds, bounds[1:], sums.tolist())
            ]
            digests = pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(np.diff(words.bounds)), pa.array(sums), digests],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return run


def repeated_passages(
    docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text",
    shard_bytes: int = 1 << 18, group_bytes: int = 1 << 18, salts: int = 32,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (kept words joined by one blank, UTF-8).

    Words are runs of characters other than blank and tab to carriage return, unchanged; a null text has none. A word is
    removed when a window of ``width`` words around it also starts in a document with a smaller doc_id; windows are judged
    on the input. Rows with a null doc_id neither remove nor lose words. Rows with the same doc_id remove nothing from each
    other; repeated rows (same doc_id and text) get equal rows. Texts shorter than a window lose nothing. Other
    columns are neither read nor returned, whatever their names.

    ``group_bytes`` of text are hashed at once, ``shard_bytes`` share an automaton; ``salts`` is no longer used, since a
    document has a window's key in few rows and no key is joined with its rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    keyed = base.where(F.col("doc_id").isNotNull()).withColumn("key", F.xxhash64("doc_id", "text"))
    anchors, buckets = occurrences(keyed.select("key", "text"), _namer(width), "repeated", NAME_BYTES)
    # Both joins with the rows are by the same key, so the rows' shuffle is written once and read twice.
    met = keyed.join(anchors, "key").select("doc_id", "key", "text", "names")
    held = met.mapInArrow(_candidates(width, buckets, group_bytes), HELD)
    low = F.min("doc_id").over(Window.partitionBy("h1", "h2"))
    later = held.withColumn("lo", low).where(F.col("doc_id") > F.col("lo"))
    wanted = later.groupBy("key").agg(F.collect_set("h1").alias("wanted"))
    # Rows without a doc_id want nothing, and stay where they are.
    known = keyed.join(wanted, "key", "left").select("doc_id", "text", "wanted")
    unknown = base.where(F.col("doc_id").isNull()).withColumn("wanted", F.lit(None).cast(known.schema["wanted"].dataType))
    outcome = _outcome(width, shard_bytes)
    return known.mapInArrow(outcome, OUTCOME).unionByName(unknown.mapInArrow(outcome, OUTCOME))
