"""Words of texts as columns: runs between white space and ASCII punctuation, in lower case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 2_000_000


def word_hashes(text: Column) -> Column:
    """A 64-bit hash per word, in order. A text that begins or ends with a separator has an empty word there."""
    words = F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[\s\p{Punct}]+")
    return F.transform(words, lambda w: F.xxhash64(w))


def positions(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per word: (blob, words, at). ``words`` is the whole text's array, so steps after can look around.

    The array is only referred to, not copied, as long as Spark fuses the steps after into the same stage. (The outer
    form spares a filter that would split every text a second time; there is always at least one word, maybe empty.)
    """
    from monthloom.llm.secretscan import blob_of

    read = docs.select(blob_of(F.col(text_col)).alias("blob"), word_hashes(F.col(text_col)).alias("words"))
    return read.select("blob", "words", F.posexplode_outer("words").alias("at", "word")).drop("word")


def joined_small(rows: DataFrame, small: DataFrame, on: list[str], count: int) -> DataFrame:
    """An equi-join with a table of ``count`` rows: broadcast up to a fixed number of rows, by shuffles beyond it."""
    return rows.join(F.broadcast(small) if count <= BROADCAST_ROWS else small, on)
