"""Quality classifier: learned byte filters over overlapping chunks of the whole document, max-pooled."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.llm.tokens import text_slices

WIDTH, HALF, FILTERS, HIDDEN = 6, 128, 24, 16


@dataclass
class ByteConvNet:
    """Filters over ``WIDTH`` bytes, rectified, their maximum per chunk; a dense layer per chunk; its maximum and mean
    over the document's chunks; one logit.

    A chunk is two blocks of ``HALF`` places, so each block lies in two chunks. A filter of a byte sequence is a sum of
    one learned weight per offset and byte, thus one table per offset; pairs of tables are added up for scoring.
    """

    tables: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray
    dense: np.ndarray  # (FILTERS, HIDDEN)
    dense_bias: np.ndarray
    last: np.ndarray  # (2 * HIDDEN,)
    last_bias: float

    @classmethod
    def fresh(cls, seed: int) -> ByteConvNet:
        r = np.random.default_rng(seed)
        tables = r.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        dense = r.normal(0, (2 / FILTERS) ** 0.5, (FILTERS, HIDDEN)).astype(np.float32)
        last = r.normal(0, HIDDEN**-0.5, 2 * HIDDEN).astype(np.float32)
        return cls(tables, np.zeros(FILTERS, np.float32), dense, np.zeros(HIDDEN, np.float32), last, 0.0)

    def parameters(self) -> list[np.ndarray]:
        return [self.tables, self.bias, self.dense, self.dense_bias, self.last]

    def block_maxima(self, flat: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Largest activation of each filter per block; ``flat`` has a whole number of blocks and WIDTH zeros more."""
        blocks = (len(flat) - WIDTH) // HALF
        out = np.empty((blocks, FILTERS), np.float32)
        step = 256
        sums, more = (np.empty((step * HALF, FILTERS), np.float32) for _ in range(2))
        wide = flat[:-1].astype(np.int32) * 256 + flat[1:]
        for a in range(0, blocks, step):
            n = (min(a + step, blocks) - a) * HALF
            low = a * HALF
            np.take(pairs[0], wide[low : low + n], axis=0, out=sums[:n], mode="clip")
            for k in range(1, WIDTH // 2):
                np.take(pairs[k], wide[low + 2 * k : low + 2 * k + n], axis=0, out=more[:n], mode="clip")
                sums[:n] += more[:n]
            out[a : a + n // HALF] = sums[:n].reshape(-1, HALF, FILTERS).max(axis=1)
        return np.maximum(out + self.bias, 0)

    def pair_tables(self) -> np.ndarray:
        pairs = self.tables[0::2, :, None, :] + self.tables[1::2, None, :, :]
        return np.ascontiguousarray(pairs.reshape(WIDTH // 2, 65536, FILTERS))

    def logits(self, texts: list[bytes], pairs: np.ndarray) -> np.ndarray:
        flat, blocks = laid_out(texts)
        pooled = self.block_maxima(flat, pairs)
        chunks, counts = chunked(pooled, blocks)
        hidden = np.maximum(chunks @ self.dense + self.dense_bias, 0)
        first = np.cumsum(counts) - counts
        features = np.hstack([np.maximum.reduceat(hidden, first), np.add.reduceat(hidden, first) / counts[:, None]])
        return features @ self.last + self.last_bias


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, each filled up with zeros to whole blocks and WIDTH zeros at least."""
    blocks = np.array([-(-(len(t) + WIDTH) // HALF) for t in texts])
    return np.frombuffer(b"".join([*(t.ljust(b * HALF, b"\0") for t, b in zip(texts, blocks.tolist())), bytes(WIDTH)]), np.uint8), blocks


def chunked(pooled: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maxima of each two neighbouring blocks of a document; a document of one block is one chunk."""
    both = np.maximum(pooled[:-1], pooled[1:]) if len(pooled) > 1 else pooled[:0]
    both = np.vstack([both, pooled[-1:]])
    ends = np.cumsum(blocks) - 1
    keep = np.ones(len(pooled), bool)
    keep[ends[blocks > 1]] = False
    both[ends[blocks == 1]] = pooled[ends[blocks == 1]]
    return both[keep], np.maximum(blocks - 1, 1)


def fit_network(texts: list[bytes], labels: np.ndarray, epochs: int = 24, rate: float = 0.004, seed: int = 1) -> ByteConvNet:
    """Adam on balanced log loss in batches of 64, then the logit is shifted to the labels' true shares by the caller."""
    net, r = ByteConvNet.fresh(seed), np.random.default_rng(seed)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in [*net.parameters(), np.zeros(1, np.float32)]]
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    t, batches = 0, max(1, len(texts) // 64)
    for epoch in range(epochs):
        for rows in np.array_split(r.permutation(len(texts)), batches):
            t += 1
            grads = _gradients(net, [texts[i] for i in rows.tolist()], labels[rows], weight[rows])
            now = rate * min(1.0, 2 * (1 - t / (epochs * batches + 1)))
            last_bias = np.array([net.last_bias], np.float32)
            for p, g, (m, v) in zip([*net.parameters(), last_bias], grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= now * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-7) + (now * 0.01 * p if p.ndim > 1 else 0)
            net.last_bias = float(last_bias[0])
    return net


def _gradients(net: ByteConvNet, texts: list[bytes], labels: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    flat, blocks = laid_out(texts)
    places = len(flat) - WIDTH
    sums = sum(net.tables[k][flat[k : k + places]] for k in range(WIDTH)).reshape(-1, HALF, FILTERS)
    where = sums.argmax(axis=1)  # the place in its block that gives each filter's maximum
    pooled = np.maximum(np.take_along_axis(sums, where[:, None, :], 1)[:, 0] + net.bias, 0)
    chunks, counts = chunked(pooled, blocks)
    first = np.cumsum(counts) - counts
    doc = np.repeat(np.arange(len(texts)), counts)
    hidden = np.maximum(chunks @ net.dense + net.dense_bias, 0)
    top = np.maximum.reduceat(hidden, first)
    features = np.hstack([top, np.add.reduceat(hidden, first) / counts[:, None]])
    share = 1 / (1 + np.exp(-(features @ net.last + net.last_bias)))
    d_logit = ((share - labels) * weight / len(texts)).astype(np.float32)
    d_features = d_logit[:, None] * net.last
    is_top = hidden == top[doc]
    ties = np.maximum(np.add.reduceat(is_top.astype(np.float32), first), 1)
    d_hidden = is_top * (d_features[:, :HIDDEN] / ties)[doc] + (d_features[:, HIDDEN:] / counts[:, None])[doc]
    d_hidden = d_hidden * (hidden > 0)
    d_chunks = d_hidden @ net.dense.T
    # A chunk's maximum is that of one of its two blocks.
    start = np.cumsum(blocks) - blocks
    left = start[doc] + np.arange(len(doc)) - first[doc]
    right = left + (blocks[doc] > 1)
    from_right = pooled[right] > pooled[left]
    d_pooled = np.zeros_like(pooled)
    np.add.at(d_pooled, left, d_chunks * ~from_right)
    np.add.at(d_pooled, right, d_chunks * from_right)
    d_pooled *= pooled > 0
    d_tables = np.empty_like(net.tables)
    at = np.arange(len(pooled))[:, None] * HALF + where
    column = np.broadcast_to(np.arange(FILTERS), at.shape)
    for k in range(WIDTH):
        cell = flat[at + k].astype(np.int64) * FILTERS + column
        d_tables[k] = np.bincount(cell.ravel(), d_pooled.ravel(), 256 * FILTERS).reshape(256, FILTERS)
    return [
        d_tables, d_pooled.sum(axis=0), chunks.T @ d_hidden, d_hidden.sum(axis=0), features.T @ d_logit,
        np.array([d_logit.sum()], np.float32),
    ]


def _spread(text: bytes, pieces: int) -> bytes:
    """A text as training sees it: whole if short, else evenly spaced pieces from its first to its last byte."""
    size = 2 * HALF - WIDTH
    if len(text) <= pieces * size:
        return text
    return b"".join([text[a : a + size] for a in np.linspace(0, len(text) - size, pieces).astype(int).tolist()])


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = 1000, pieces: int = 6, epochs: int = 20,
    id_col: str = "doc_id", text_col: str = "text",
) -> ByteConvNet:
    """Learn from at most ``per_label`` labelled documents of each label and ``pieces`` pieces of each.

    Both bounds hold at any size: which rows are taken follows from a hash of their ids, and no more than
    2 * per_label * pieces * 250 bytes reach the driver, which trains in numpy with a fixed seed. Rows without a 0 or 1
    label or an id are not learned from; of several rows with one id, one is. The logit is shifted to the share of ones
    among all of ``labels``. Without both labels, the score is that share everywhere (0.5 without any label).
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    ones, count = known.agg(F.sum("label"), F.count("*")).first()
    chosen = [known.where(f"label = {v}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for v in (0, 1)]
    # At most 2 * per_label rows.
    sample = F.broadcast(chosen[0].union(chosen[1]))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    texts = texts.join(sample, "doc_id")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spread = [_spread(t or b"", pieces) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(spread, pa.binary()), batch.column("label")], ["doc_id", "text", "label"])

    kind = known.schema["doc_id"].dataType.simpleString()
    read = texts.mapInArrow(cut, f"doc_id {kind}, text binary, label int").groupBy("doc_id")
    rows = read.agg(F.min("text").alias("text"), F.min("label").alias("label")).orderBy("doc_id").collect()
    share = (ones or 0) / count if count else 0.5
    targets = np.array([r["label"] for r in rows], np.float32)
    if len(set(targets.tolist())) < 2:
        net = ByteConvNet.fresh(1)
        net.last[:] = 0
    else:
        net = fit_network([bytes(r["text"]) for r in rows], targets, epochs)
    share = min(max(share, 1e-3), 1 - 1e-3)
    net.last_bias += float(np.log(share / (1 - share)))
    return net


def scores(net: ByteConvNet):
    """A function from a text column to the probability of label 1.

    The text's UTF-8 bytes are the only input. All chunks of a text count, however long it is; null and empty texts
    are scored as a chunk of zeros.
    """

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pairs = net.pair_tables()
        for texts in batches:
            logits = [net.logits(part.to_pylist(), pairs) for part in text_slices(texts, 1 << 20)]
            logits = np.concatenate([*logits, np.zeros(0)]).astype(np.float64)
            yield pa.array(1 / (1 + np.exp(-logits.clip(-60, 60))))

    return lambda text: run(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def score(docs: DataFrame, net: ByteConvNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row. Rows neither move nor meet; repeated rows have the same score."""
    return docs.select(F.col(id_col).alias("doc_id"), scores(net)(F.col(text_col)).alias("score"))
