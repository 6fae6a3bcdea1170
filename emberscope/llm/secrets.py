"""Secret scan with an incremental blob ledger; DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its content.  The ledger holds the findings of each pair of
blob and rule version that was ever scanned.  A run scans only pairs that the ledger does not hold, each once however
many paths and versions have the content, and joins the findings back to all paths.

Positions without Python: ``regexp_replace`` puts a mark before and after each match; the pieces between marks give the
offsets.  The two marks are control characters that no rule can match; where a text has them itself they are first
replaced by another one, which changes no position.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberscope.llm.common import hot_join, saved

_OPEN, _CLOSE, _PLAIN = "\x01", "\x02", "\x03"
SPAN = "struct<start:int,rank:int,end:int,kind:string>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern, and the least length of one of its groups."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: Patterns and lengths of the base kinds, then the kinds this scan adds.
#: Runs of one class are maximal, so their least length is in the pattern; failing runs are consumed either way.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN (?:[A-Z]{1,20} ){0,4}PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
BASE = ("assign", "access", "hex")
RULE_VERSION = "1"


def found_spans(text: F.Column, rule: Rule, rank: int) -> F.Column:
    """Spans of the matches of one rule, leftmost and not overlapping, in code points."""
    marked = F.regexp_replace(text, F.lit(rule.pattern), F.lit(f"{_OPEN}$0{_CLOSE}"))
    pieces = F.split(marked, _OPEN, -1)

    def step(state: F.Column, piece: F.Column) -> F.Column:
        match = F.substring_index(piece, _CLOSE, 1)
        span = F.struct(
            state["at"].alias("start"), F.lit(rank).alias("rank"), (state["at"] + F.length(match)).alias("end"),
            (F.length(F.regexp_extract(match, rule.pattern, rule.group)) if rule.least else F.lit(0)).alias("size"),
        )
        return F.struct(
            (state["at"] + F.length(piece) - 1).alias("at"),
            F.when(span["size"] >= rule.least, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"),
        )

    start = F.struct(
        F.length(F.element_at(pieces, 1)).alias("at"),
        F.array().cast("array<struct<start:int,rank:int,end:int,size:int>>").alias("out"),
    )
    walked = F.aggregate(F.slice(pieces, 2, F.size(pieces)), start, step, lambda state: state["out"])
    return F.transform(walked, lambda x: F.struct(x["start"], x["rank"], x["end"], F.lit(rule.kind).alias("kind")))


def scan_texts(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(blob, text)`` to ``(blob, spans)``, the spans of all rules by start, then rule."""
    # one marked text at a time: the columns of a projection each, so that no expression is taken twice
    clean = blobs.select("blob", F.translate("text", _OPEN + _CLOSE, _PLAIN * 2).alias("text"))
    found = clean.select("blob", *(found_spans(F.col("text"), rule, i).alias(rule.kind) for i, rule in enumerate(rules)))
    return found.select("blob", F.array_sort(F.concat(*(F.col(rule.kind) for rule in rules))).alias("spans"))


def scan(
    versions: DataFrame, ledger: DataFrame | None = None, text: str = "text",
    rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION,
) -> tuple[DataFrame, DataFrame]:
    """Scan versions against a ledger; return the findings of every version and what the ledger gains.

    ``versions``: any columns (path, revision, ...) and ``text``; all but the text come back with ``blob`` and
    ``spans``.  A null text is empty.  ``ledger``: ``(blob, rule_version, spans)`` of earlier runs; the second
    result has the same columns, is written already, and is to be appended to it.  Repeated rows come back as often as they
    came; an empty table gives an empty result.
    """
    kept = [x for x in versions.columns if x not in (text, "blob", "spans")]
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    blob = F.unhex(F.sha2(content, 256))
    paths = saved(versions.select(*kept, blob.alias("blob")))
    fresh = versions.select(blob.alias("blob"), content.alias("text"))
    known = None
    if ledger is not None:
        known = ledger.where(F.col("rule_version") == rule_version).select("blob", "spans").dropDuplicates(["blob"])
        fresh = fresh.join(known.select("blob"), "blob", "left_anti")
    fresh = fresh.groupBy("blob").agg(F.any_value("text").alias("text"))  # copies are one row per task before the shuffle
    gained = saved(scan_texts(fresh, rules).select("blob", F.lit(rule_version).alias("rule_version"), "spans"))
    every = gained.select("blob", "spans")
    every = every if known is None else every.unionByName(known)
    counts = saved(paths.groupBy("blob").agg(F.count("*").alias("n")))  # a blob may have most of the paths
    return hot_join(paths, every, counts, ["blob"]).select(*kept, "blob", "spans"), gained


def listed(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def of_kind(kind: str) -> F.Column:
    return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")


def scan_runs(versions: DataFrame, runs: int, order: F.Column, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The findings of versions that arrive in several runs, and the ledger after the last of them.

    ``order``: a number that never changes for a version; it decides the run in which it arrives.  Every version is in one
    of the runs.  A run scans the blobs that the ledger of the runs before it does not hold.
    """
    found = ledger = None
    for run in range(runs):
        arrived = versions.where(F.pmod(order, F.lit(runs)) == run)
        findings, gained = scan(arrived, ledger, text)
        found = findings if found is None else found.unionByName(findings)
        ledger = gained if ledger is None else ledger.unionByName(gained)
    return found, ledger


#: Runs in which the query takes the documents, as if they had arrived one after the other.
RUNS = 2


def secrets_by_document(documents: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans and the list of all spans of each document.

    A document is a path with one version.  The documents arrive in ``RUNS`` runs against a ledger that starts empty, so a
    text that was seen in an earlier run is not scanned again; the result of all runs together is that of one.
    """
    findings, _ = scan_runs(documents.select("doc_id", "text"), RUNS, F.xxhash64("doc_id"))
    base = F.filter("spans", lambda x: x["rank"] < len(BASE))
    counts = (of_kind(k).alias(f"n_{k}") for k in BASE)
    return findings.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
