"""Secret scan over an incremental blob ledger.

Every version of a text is addressed by its content (SHA-256).  The
ledger is a Parquet table with one row per scanned (blob, rule version)
and its findings.  ``scan`` looks only at pairs the ledger lacks, reads
the text of one carrier per unseen blob, appends the pairs, and joins
findings back to every path that carries the blob.

Only DataFrame functions: matches come from ``regexp_extract_all``, their
places from the lengths of the pieces that ``split`` leaves between them,
summed along the text by a window over the match rows.

Defined cases: a null text counts as empty and shares the blob of the
empty text; repeated rows and copies are scanned once and reported for
each row; a blob that several increments hold counts once; a null path is a path like any other; a text without findings
is in the ledger with none; empty tables give empty results; other input
columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.lookup import materialise
from .columns import text_or_empty


class Rule(NamedTuple):
    """``group`` must have ``least`` characters or the match is dropped."""
    kind: str
    pattern: str
    group: int
    least: int


BASE = (
    Rule("assign", r"(?i)(password|passwd|secret|token|api_?key)[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # whole runs of 24 and more: the same spans as all runs with the short ones dropped
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 1),
    Rule("hosted_token", r"(gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10})[A-Za-z0-9-]*", 0, 1),
    Rule("url_login", r"[a-z][a-z0-9+.-]*://[^\x20\x09-\x0D:/@]+:[^\x20\x09-\x0D:/@]+@", 0, 1),
)
RULES = BASE + MORE


def rules_version(rules=RULES) -> str:
    """Digest of the rules: any change of one is a new version."""
    return hashlib.sha256(repr([tuple(r) for r in rules]).encode()).hexdigest()[:16]


LEDGER_SCHEMA = ("blob string, rule_version string, "
                 "findings array<struct<start:bigint,rank:int,kind:string,stop:bigint>>")


def blob_id(text: Column) -> Column:
    return F.sha2(text_or_empty(text).cast("binary"), 256)


def _raw_matches(t: Column, rank: int, rule: Rule) -> Column:
    """Array of (rank, kind, gap before, length, kept) in text order."""
    p = F.lit(rule.pattern)
    zipped = F.arrays_zip(
        F.split(t, rule.pattern).alias("gap"), F.regexp_extract_all(t, p, F.lit(0)).alias("hit"),
        F.regexp_extract_all(t, p, F.lit(rule.group)).alias("part"))
    found = F.transform(F.filter(zipped, lambda x: x["hit"].isNotNull()), lambda x: F.struct(
        F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"),
        F.char_length(x["gap"]).cast("long").alias("gap"), F.char_length(x["hit"]).cast("long").alias("len"),
        (F.char_length(x["part"]) >= rule.least).alias("ok")))
    return F.when(t.rlike(rule.pattern), found).otherwise(
        F.array().cast("array<struct<rank:int,kind:string,gap:bigint,len:bigint,ok:boolean>>"))


def find_spans(blobs: DataFrame, rules=RULES) -> DataFrame:
    """(blob, findings) of every input row (blob, text) with findings.

    Only lengths of gaps and matches leave the text's row; the running
    sum along one text and rule gives code-point offsets.
    """
    t = F.col("text")
    per_rule = F.array(*[_raw_matches(t, i, r) for i, r in enumerate(rules)])
    hits = blobs.select("blob", F.explode(per_rule).alias("m")).where(F.size("m") > 0) \
        .select("blob", F.posexplode("m").alias("pos", "x")).select("blob", "pos", "x.*") \
        .dropDuplicates(["blob", "rank", "pos"])  # a carrier row may be repeated
    along = Window.partitionBy("blob", "rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = hits.withColumn("stop", F.sum(F.col("gap") + F.col("len")).over(along)).where("ok")
    span = F.struct((F.col("stop") - F.col("len")).alias("start"), "rank", "kind", "stop")
    return placed.groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("findings"))


def unseen(paths: DataFrame, ledger: DataFrame, version: str) -> DataFrame:
    """One carrier (blob, path) of every blob not yet scanned by ``version``."""
    done = ledger.where(F.col("rule_version") == version).select("blob")
    return paths.groupBy("blob").agg(F.min("path").alias("path")).join(done, "blob", "left_anti")


def scan_unseen(docs: DataFrame, ledger: DataFrame, path: str = "doc_id", text: str = "text",
                rules=RULES, version: str | None = None) -> DataFrame:
    """Ledger rows for the (blob, version) pairs that ``ledger`` lacks; the
    version is that of the rules unless named."""
    version = version or rules_version(rules)
    versions = docs.select(F.col(path).alias("path"), blob_id(F.col(text)).alias("blob"),
                           text_or_empty(F.col(text)).alias("text"))
    todo = unseen(versions.select("path", "blob"), ledger, version)
    on = [versions["blob"] == todo["blob"], versions["path"].eqNullSafe(todo["path"])]
    found = find_spans(versions.join(todo, on, "left_semi"), rules)
    return todo.join(found, "blob", "left").select(
        "blob", F.lit(version).alias("rule_version"), _or_none(F.col("findings")).alias("findings"))


def _or_none(findings: Column) -> Column:
    return F.coalesce(findings, F.array().cast(
        "array<struct<start:bigint,rank:int,kind:string,stop:bigint>>"))


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], LEDGER_SCHEMA)


def scan(docs: DataFrame, ledger_path: str, path: str = "doc_id", text: str = "text",
         rules=RULES, version: str | None = None) -> DataFrame:
    """Bring the ledger at ``ledger_path`` (a shared folder) up to date with
    ``docs`` and return (path, findings) for every input row.

    Each call appends one immutable increment folder, so a failed call
    leaves the ledger as it was; calls that scan the same blobs at the same
    time write equal rows, which count once.
    """
    spark = docs.sparkSession
    version = version or rules_version(rules)
    before = read_ledger(spark, ledger_path)
    scan_unseen(docs, before, path, text, rules, version) \
        .write.parquet(f"{ledger_path}/increment={uuid.uuid4().hex}")
    return join_back(docs, read_ledger(spark, ledger_path), path, text, version)


def read_ledger(spark, ledger_path: str) -> DataFrame:
    """All increments written so far; none yet: an empty ledger."""
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(f"{ledger_path}/increment=*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty_ledger(spark)


def join_back(docs: DataFrame, ledger: DataFrame, path: str = "doc_id", text: str = "text",
              version: str | None = None) -> DataFrame:
    """(path, findings) of every row; only ids and digests are shuffled.
    Increments may repeat a blob: it is folded before the join."""
    # folded apart from the join, whose hot blobs adaptive execution can split only between plain shuffles
    known = materialise(ledger.where(F.col("rule_version") == (version or rules_version()))
                        .groupBy("blob").agg(F.first("findings").alias("findings")))
    rows = docs.select(F.col(path).alias("path"), blob_id(F.col(text)).alias("blob"))
    return rows.join(known, "blob", "left").select("path", "blob", _or_none(F.col("findings")).alias("findings"))


def spans_text(findings: Column) -> Column:
    """kind:start:end of every span by start, then kind as listed."""
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def secret_report(docs: DataFrame, ledger_path: str) -> DataFrame:
    """Contract columns of query ``op7``."""
    found = scan(docs.select("doc_id", "text"), ledger_path)
    f = F.col("findings")
    base = F.filter(f, lambda x: x["rank"] < len(BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter(f, lambda x: x["kind"] == kind)).cast("long")

    return found.select(
        F.col("path").alias("doc_id"), *[count(r.kind).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"),
        spans_text(f).alias("spans"))
