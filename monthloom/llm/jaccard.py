"""N-gram Jaccard join: prefixes under several global orders, verified exactly, down to linked classes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom.llm.components import components
from monthloom.llm.names import Namer, RollingHash, mixed, occurrences
from monthloom.llm.tokens import in_slices
from monthloom.llm.workspace import written

SETS = "key long, n long, names binary"
# Orders of tokens by hash, besides the order by how many sets have the token.
SALTS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)
STAR_ROUNDS = 3


def shingle_sets(texts: list[bytes], k: int, hasher: RollingHash) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of ``k`` words; all its words as one shingle if it has fewer.

    Words are runs of bytes other than blanks and 0x09-0x0D, with A-Z in lower case.
    """
    flat = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    upper = (flat >= 65) & (flat <= 90)
    flat = np.where(upper, flat + 32, flat).astype(np.uint8)
    space = (flat == 32) | ((flat >= 9) & (flat <= 13))
    before = np.concatenate([[True], space[:-1]])
    start = np.flatnonzero(~space & before)
    after = np.concatenate([space[1:], [True]])
    end = np.flatnonzero(~space & after) + 1
    words = hasher.runs(hasher.sums(flat), start, end)
    factors = [np.uint64(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) | 1) for j in range(k)]
    runs = np.zeros(max(len(words) - k + 1, 0), np.uint64)
    for j, f in enumerate(factors):
        runs += words[j : len(words) - k + 1 + j] * f if len(runs) else runs
    runs = mixed(runs)
    bounds = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        elif b > a:
            whole = np.append(words[a:b] * np.array(factors[: b - a]), np.uint64(b - a))
            out.append(mixed(whole.sum(keepdims=True)))
        else:
            out.append(words[:0])
    return out


def _namer(k: int):
    """Shingle hashes of (key, text) rows."""

    def start() -> Namer:
        hasher = RollingHash()
        return lambda batch: (batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist(), k, hasher))

    return start


def _exploded(sets: DataFrame) -> DataFrame:
    """(key, name), one row per name."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [np.frombuffer(x.as_buffer(), "<i8") for x in batch.column(1)]
            keys = np.repeat(batch.column(0).to_numpy(), [len(x) for x in names])
            yield pa.record_batch([pa.array(keys), pa.array(np.concatenate([*names, keys[:0]]))], ["key", "name"])

    return sets.select("key", "names").mapInArrow(run, "key long, name long")


def _prefix_length(n: Column, percent: int) -> Column:
    """Tokens of which two sets of ``n`` and more must share one: n - ceil(percent * n / 100) + 1."""
    return n - F.floor((n * percent + 99) / 100) + 1


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that are links: those that share a prefix token under every hash order, then exactly."""
    left = sets.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("names").alias("names_a"))
    right = sets.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("names").alias("names_b"))

    def prefix(names: np.ndarray, n: int, salt: int) -> np.ndarray:
        # Tokens that no other set has come first in every order; they are not among the names.
        length = n - -(-percent * n // 100) + 1 - (n - len(names))
        ranked = mixed(names ^ np.uint64(salt))
        return ranked if length >= len(ranked) else np.partition(ranked, length - 1)[:length]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[int, tuple] = {}
        for batch in batches:
            a, b, n_a, n_b = (batch.column(c).to_pylist() for c in ("a", "b", "n_a", "n_b"))
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), "<u8") for c in ("names_a", "names_b"))
                if len(of) > 2000:
                    of.clear()
                for key, names, n in ((a[i], x, n_a[i]), (b[i], y, n_b[i])):
                    if key not in of:
                        of[key] = [np.sort(prefix(names, n, s)) for s in SALTS]
                if not all(np.isin(p, q).any() for p, q in zip(of[a[i]], of[b[i]])):
                    continue
                same = len(x) + len(y) - len(np.union1d(x, y))
                if 100 * same >= percent * (n_a[i] + n_b[i] - same):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    met = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "names_a", "names_b")
    return met.mapInArrow(run, "a long, b long")


def _with_component(rows: DataFrame, links: DataFrame | None) -> DataFrame:
    if links is None:
        return rows.withColumn("component", F.col("key"))
    found = components(links).withColumnRenamed("node", "key")
    return rows.join(found, "key", "left").withColumn("component", F.coalesce("component", "key"))


def similar_classes(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of texts whose sets of ``k``-word shingles are linked: (doc_id, n_shingles, component_id, key, component).

    Two sets are linked if 100 * intersection >= ``percent`` * union. ``component_id`` is the smallest doc_id that links
    reach; ``key`` is a hash of the text, ``component`` the smallest such hash in the class. Equal texts are one node, with no link to find; the rows of a class may be as
    many as they like, since the smallest id per class is a partial aggregate.

    1. Shingles that no other text has cannot be shared. Names of all shingles are dealt out packed and sorted bucket by
       bucket (see ``names``). A text goes on only if its shared shingles could make up ``percent`` of its set.
    2. Prefix filter under a global order: tokens that only one set has first, then the rarer before the more frequent
       among the sets left. Linked sets share a token of their prefixes, so frequent passages hardly ever pair sets.
    3. Of a token's sets, no pairs are listed at first: each set is paired with the one other set that most of its
       tokens point to (one of another class, with few tokens of its own), for a few rounds, and classes merge by the links found. Then
       every pair of different classes is a candidate that shares a prefix token after which both have enough left. So a group of near copies costs pairs
       in proportion to its size, and no link between classes is missed.
    4. Candidates must also share a prefix token under two other global orders, by salted hashes, and are then verified
       on the exact sets.

    Texts without words, null texts too, have n_shingles 0 and are linked with nothing, not with each other. Null ids
    stay, and are never a class's smallest id unless it has no other. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("key", F.xxhash64("text"))
    texts = base.select("key", "text")
    answers, _ = occurrences(texts, _namer(k), "repeated", width=6)

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = RollingHash()
        for batch in in_slices(batches, 1 << 20):
            counts = [len(s) for s in shingle_sets(batch.column(2).to_pylist(), k, hasher)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["doc_id", "key", "n"])

    kind = base.schema["doc_id"].dataType.simpleString()
    rows = written(base.select("doc_id", "key", "text").mapInArrow(counted, f"doc_id {kind}, key long, n long"), "rows")
    counts = rows.groupBy("key").agg(F.max("n").alias("n"))
    enough = F.octet_length("names") / 8 * 100 >= F.col("n") * percent
    sets = written(answers.join(counts, "key").where(enough).select("key", "n", "names"), "sets")

    tokens = _exploded(sets)
    frequency = tokens.groupBy("name").agg(F.count("*").alias("df"))
    ranked = tokens.join(frequency.where("df > 1"), "name").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("df", "name"))).alias("ranked"))
    # Tokens of one set come first in its prefix; what they leave of it is taken from the others.
    places = _prefix_length(F.col("n"), percent) - (F.col("n") - F.size("ranked"))
    prefixes = ranked.join(sets.select("key", "n"), "key").where(places > 0)
    unique = F.col("n") - F.size("ranked")
    cut = F.slice("ranked", F.lit(1), places.cast("int"))
    prefixes = prefixes.select("key", "n", unique.alias("unique"), F.posexplode(cut).alias("at", "t"))
    prefixes = prefixes.select("key", "n", "unique", "t.name", (F.col("n") - F.col("unique") - F.col("at")).alias("left"))
    prefixes = written(prefixes, "prefixes")

    links = None
    for turn in range(STAR_ROUNDS):
        placed = _with_component(prefixes, links)
        # The set with the fewest tokens of its own is likely the one that the others are copies of; later rounds vary it.
        rank = F.struct(F.col("unique") + F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(1 + 4 * turn)), "key")
        ends = placed.groupBy("name").agg(F.min(F.struct(rank.alias("rank"), "component")).alias("low"))
        ends = ends.select("name", F.col("low.rank.key").alias("low_key"), F.col("low.component").alias("low"))
        pointed = placed.join(ends, "name").where("component <> low")
        best = pointed.groupBy("key", "low_key").agg(F.count("*").alias("votes"))
        best = best.groupBy("key").agg(F.max_by("low_key", F.struct("votes", "low_key")).alias("b"))
        found = written(_verified(best.select(F.col("key").alias("a"), "b"), sets, percent), "links")
        links = found if links is None else links.union(found)
    placed = written(_with_component(prefixes, links), "placed")
    ends = placed.groupBy("name").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    open_ = placed.join(ends.where("low <> high").select("name"), "name").select("name", "key", "n", "left", "component")
    other = open_.select("name", F.col("key").alias("b"), *(F.col(c).alias(f"{c}_b") for c in ("n", "left", "component")))
    # From their first common token on, two sets have no more in common than the shorter rest of them.
    most = F.least("left", "left_b")
    fits = (most * 100 >= (F.col("n") + F.col("n_b") - most) * percent) & (F.col("component") < F.col("component_b"))
    pairs = open_.join(other, "name").where(fits).select(F.col("key").alias("a"), "b").distinct()
    links = links.union(written(_verified(pairs, sets, percent), "links"))

    classes = components(links).withColumnRenamed("node", "key")
    labelled = rows.join(classes, "key", "left").withColumn("component", F.coalesce("component", "key"))
    labelled = labelled.where("n > 0")
    least = labelled.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    columns = ("doc_id", "n", "component_id", "key", "component")
    wordless = rows.where("n = 0").withColumns({"component_id": F.col("doc_id"), "component": F.lit(None).cast("long")})
    result = labelled.join(least, "component").select(*columns).union(wordless.select(*columns))
    return result.withColumnRenamed("n", "n_shingles")


def _has_words(text: Column) -> Column:
    return text.rlike(r"[^\x20\x09-\x0D]")


def one_per_class(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: of each class the one with the smallest id.

    Ids that are null come last; of rows with one id, a hash of the text decides, and of rows equal in both one stays.
    Rows without words are linked with nothing and stay, however often they occur.
    """
    classes = similar_classes(docs, k, percent, id_col, text_col).where("n_shingles > 0")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key"))
    kept = classes.groupBy("component").agg(F.min(order).alias("kept")).select("kept.doc_id", "kept.key")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # Names of our own beside the columns of docs, whatever those are called.
    named = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("doc_id"), text.cast("binary").alias("text"))
    named = named.where(_has_words(F.col("text").cast("string"))).select("row", "doc_id", F.xxhash64("text").alias("key"))
    same = named["doc_id"].eqNullSafe(kept["doc_id"]) & (named["key"] == kept["key"])
    stay = named.join(kept, same).select(named["key"], named["doc_id"], "row")
    stay = stay.groupBy("key", "doc_id").agg(F.any_value("row").alias("row")).select("row.*")
    return stay.union(docs.where(~_has_words(text)))

