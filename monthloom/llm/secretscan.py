"""Secret scans: an incremental ledger of contents, scanned once per version of the rules."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom.llm.tokens import text_slices
from monthloom.llm.workspace import written

FINDING = "array<struct<start:int,rank:int,kind:string,end:int,base:boolean>>"
LEDGER = f"blob binary, rule_version string, findings {FINDING}"


@dataclass(frozen=True)
class Rule:
    """Leftmost, non-overlapping matches whose ``group`` has ``least`` characters or more; shorter ones are dropped."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    base: bool = False
    any_case: bool = False


# The patterns, lengths and order of kinds that results must agree on.
BASE_RULES = (
    Rule(
        "assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        least=12, group=2, base=True, any_case=True,
    ),
    Rule("access", "AKIA[A-Z0-9]+", least=18, base=True),
    Rule("hex", "[0-9a-f]+", least=16, base=True),
)
# What this method adds: keys and tokens that their form alone gives away.
ADDED_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?"),
    Rule("platform_token", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,})"),
    Rule("web_token", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"),
)
RULES = BASE_RULES + ADDED_RULES


def rule_version(rules: Iterable[Rule]) -> str:
    """Changes whenever a rule does."""
    return hashlib.sha256(repr(tuple(rules)).encode()).hexdigest()[:16]


def blob_of(text: Column) -> Column:
    """The content address of a text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def _finder(rule: Rule):
    """A function from a text to its (start, end) spans.

    A rule of one repeated class finds the same long matches if the repetition itself asks for the length.
    """
    pattern = rule.pattern
    if re.fullmatch(r"\[[^\]]+\]\+", pattern) and rule.group == 0:
        pattern = f"{pattern[:-1]}{{{rule.least},}}"
    found = re.compile(pattern, re.ASCII | re.IGNORECASE if rule.any_case else re.ASCII)
    return lambda text: [m.span() for m in found.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def findings_of(rules: tuple[Rule, ...]):
    """A function from a text to its findings by start, then by the order of the rules."""
    finders = [_finder(r) for r in rules]

    def find(text: str) -> list[tuple]:
        spans = [(s, i, rules[i].kind, e, rules[i].base) for i, f in enumerate(finders) for s, e in f(text)]
        return sorted(spans)

    return find


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """New rows of the ledger: contents of ``docs`` that have not been scanned by this version of the rules.

    Texts are addressed by their SHA-256. Copies meet in the map tasks before anything moves, so a content that a third
    of all rows have costs one row per task. ``ledger`` has (blob, rule_version, findings) of earlier scans; only its
    two key columns are read. The result also holds contents without findings, which is what spares them next time.
    """
    version = rule_version(rules)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    blobs = docs.select(blob_of(F.col(text_col)).alias("blob"), text.alias("text"))
    blobs = blobs.groupBy("blob").agg(F.any_value("text").alias("text"))
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == version).select("blob")
        blobs = blobs.join(seen, "blob", "left_anti")

    @F.arrow_udf(FINDING)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finder = findings_of(rules)
        kind = pa.list_(pa.struct({"start": pa.int32(), "rank": pa.int32(), "kind": pa.string(), "end": pa.int32(), "base": pa.bool_()}))
        for texts in batches:
            yield pa.array([finder(t) for part in text_slices(texts) for t in part.to_pylist()], kind)

    return blobs.select("blob", F.lit(version).alias("rule_version"), find("text").alias("findings"))


def findings_by_path(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Join findings back to every row of ``docs`` that has the content: (doc_id, blob, findings), none being empty."""
    known = ledger.where((F.col("rule_version") == rule_version(rules)) & (F.size("findings") > 0)).select("blob", "findings")
    paths = docs.select(F.col(id_col).alias("doc_id"), blob_of(F.col(text_col)).alias("blob"))
    joined = paths.join(known, "blob", "left")
    return joined.select("doc_id", "blob", F.coalesce("findings", F.array().cast(FINDING)).alias("findings"))


def span_text(findings: Column) -> Column:
    """``kind:start:end`` of each finding, joined by commas."""
    one = lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))
    return F.array_join(F.transform(findings, one), ",")


def redacted(text: Column, findings: Column, mark: str = "[secret]") -> Column:
    """``text`` with every found span replaced; overlapping spans become one mark."""
    step = lambda a, f: F.when(f["end"] <= a["at"], a).otherwise(
        F.struct(
            F.concat(
                a["text"],
                F.when(f["start"] >= a["at"], F.concat(F.substring(text, a["at"] + 1, f["start"] - a["at"]), F.lit(mark)))
                .otherwise(F.lit("")),
            ).alias("text"),
            f["end"].alias("at"),
        )
    )
    zero = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    end = lambda a: F.concat(a["text"], F.substring(text, a["at"] + 1, F.length(text)))
    return F.when(F.size(findings) == 0, text).otherwise(F.aggregate(findings, zero, step, end))


def redacted_rows(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, and a mark in place of each secret of their text; null stays null."""
    found = written(scan(docs, rules, text_col=text_col), "ledger").where(F.size("findings") > 0).select("blob", "findings")
    # Names of our own beside the columns of docs, whatever those are called.
    named = docs.select(F.struct(*docs.columns).alias("row"), blob_of(F.col(text_col)).alias("blob"))
    joined = named.join(found, "blob", "left")
    text = F.col("row")[text_col]
    clean = F.when(F.col("findings").isNull(), text).otherwise(redacted(text, F.col("findings")))
    return joined.select(*((clean if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns))
