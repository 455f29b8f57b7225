"""Benchmark decontamination: spaced seeds find aligned overlaps that some substituted words do not hide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom.llm.secretscan import blob_of
from monthloom.llm.textwords import joined_small, positions, word_hashes

# Word offsets that a seed looks at; it ignores the words between. Any 20 aligned words of which at most 4 differ agree
# in all offsets of one of these masks at least (a test goes through all cases).
MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 2, 4, 8, 9), (0, 1, 2, 4, 5, 6))


def _seed(words: Column, at: Column, number: int, mask: tuple[int, ...]) -> Column:
    return F.xxhash64(F.lit(number), *(F.get(words, at + o) for o in mask))


def seeds(rows: DataFrame, masks: tuple[tuple[int, ...], ...], *keep: str) -> DataFrame:
    """A row per word and mask that fits in the text from that word on: ``keep``, ``words``, ``at``, ``seed``."""
    made = [F.when(F.col("at") + m[-1] < F.size("words"), _seed(F.col("words"), F.col("at"), i, m)) for i, m in enumerate(masks)]
    exploded = rows.select(*keep, "words", "at", F.explode(F.array(*made)).alias("seed"))
    return exploded.where("seed is not null")


def overlap(found: Column, item: Column, window: int) -> Column:
    """The largest share of equal words in any ``window`` aligned words; the whole item if it is shorter."""
    same = F.zip_with(found, item, lambda a, b: F.coalesce(a == b, F.lit(False)).cast("int"))
    size = F.least(F.size(item), F.lit(window))
    zero = F.struct(same.alias("same"), F.lit(0).alias("now"), F.lit(0).alias("best"))
    return F.aggregate(
        F.sequence(F.lit(0), F.size(item) - 1), zero,
        lambda s, i: _advanced(s, F.get(s["same"], i) - F.when(i >= size, F.get(s["same"], i - size)).otherwise(0)),
        lambda s: s["best"] / size,
    )


def _advanced(state: Column, by: Column) -> Column:
    now = state["now"] + by
    return F.struct(state["same"].alias("same"), now.alias("now"), F.greatest(state["best"], now).alias("best"))


def held_items(
    docs: DataFrame, benchmark: DataFrame, window: int = 20, least: float = 0.8, masks: tuple[tuple[int, ...], ...] = MASKS,
    text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Which benchmark items the texts hold: (blob, items, overlap) for each distinct text that holds any.

    An item is held if ``window`` of its words in a row (all, if it has fewer) stand in the document with at most a
    share of 1 - ``least`` substituted. Hashes of both sides' words under each mask are joined; around a hit, the item
    is laid over the document and equal words are counted. Only hits survive the join, so nothing but them and the
    results is shuffled; hits of equal texts meet in the map tasks. The benchmark side is broadcast up to a fixed number
    of rows, counted first, and joined by shuffles beyond it.

    ``items`` is sorted; ``overlap`` is the largest share. Items whose text is null or has fewer words than the shortest
    mask spans are not looked for; items of fewer than ``window`` words are found if a mask agrees. Repeated items are
    reported each. Either table may be empty.
    """
    item_words = F.filter(word_hashes(F.col(item_text_col)), lambda w: w != F.xxhash64(F.lit("")))
    items = benchmark.select(F.col(item_col).alias("item_id"), item_words.alias("item")).where(F.size("item") > 0)
    asked = items.select("item_id", "item", F.posexplode("item").alias("at", "w")).withColumnRenamed("item", "words")
    asked = seeds(asked, masks, "item_id").select("seed", F.col("words").alias("item"), F.col("at").alias("item_at"), "item_id")
    hits = joined_small(seeds(positions(docs, text_col), masks, "blob"), asked, ["seed"], asked.count())
    begin = F.col("at") - F.col("item_at")
    # Words before the document's begin count as different.
    before = F.array_repeat(F.lit(None).cast("long"), F.greatest(-begin, F.lit(0)))
    length = F.size("item") - F.greatest(-begin, F.lit(0))
    laid = F.concat(before, F.slice("words", F.greatest(begin, F.lit(0)) + 1, length))
    # One row per diagonal. The words under the item are cut out here, in the stage of the join: rows carry them only.
    laid = hits.select("blob", "item_id", "item", begin.alias("begin"), laid.alias("laid"))
    laid = laid.groupBy("blob", "item_id", "begin").agg(F.any_value("item").alias("item"), F.any_value("laid").alias("laid"))
    shares = laid.select("blob", "item_id", overlap(F.col("laid"), F.col("item"), window).alias("share"))
    shares = shares.where(F.col("share") >= least)
    best = shares.groupBy("blob", "item_id").agg(F.max("share").alias("share"))
    return best.groupBy("blob").agg(F.sort_array(F.collect_list("item_id")).alias("items"), F.max("share").alias("overlap"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", **options) -> DataFrame:
    """One row per row of ``docs``: (doc_id, items, overlap) as ``held_items`` finds them.

    ``items`` is empty and ``overlap`` null where nothing is held, as for null and empty texts. Repeated documents have
    the same result each; null ids are kept.
    """
    held = held_items(docs, benchmark, text_col=text_col, item_col=item_col, **options)
    kind = benchmark.schema[item_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), blob_of(F.col(text_col)).alias("blob")).join(held, "blob", "left")
    return rows.select("doc_id", F.coalesce("items", F.array().cast(f"array<{kind}>")).alias("items"), "overlap")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text holds no benchmark item."""
    held = held_items(docs, benchmark, text_col=text_col, **options)
    return docs.join(held, blob_of(docs[text_col]) == held["blob"], "left_anti")
