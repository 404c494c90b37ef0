"""Secret scans with an incremental blob ledger (operator 2).

Every historical version of every path is content-addressed (SHA-256 of its
UTF-8 bytes).  The ledger is a Parquet table partitioned by rule and rule
version; it holds one row per blob that the rule version has scanned, with the
spans found (an empty list for a clean blob).  A scan reads the ledger, keeps
the (blob, rule version) pairs it has not seen, runs only the outstanding rules
over one copy of each such blob, appends the new rows, and joins the findings
back to all paths.  A new version of one file costs one blob; a new version of
one rule costs that rule over all blobs.

Shuffles: equal blobs are reduced to one row per task before the shuffle
(partial aggregate), so a blob that a third of all paths hold is one row per
task; the join back to the paths is a plain left join that adaptive execution
splits where one blob is hot.  Texts are never collected or broadcast.

Defined cases: a null text is the empty blob; null paths and versions are kept
as they are; repeated (path, version, text) rows each get the findings; an empty
table gives an empty result; extra columns, whatever their names, are ignored.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from actuaria.llm.common import in_parts, read
from actuaria.session import scratch_path


@dataclass(frozen=True)
class Rule:
    """A pattern of one kind.  ``group``/``least``: a match counts if that
    group has so many characters; a failing match still consumes its text."""

    kind: str
    version: int
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules, in the order in which ties are listed.  For
#: ``access`` and ``hex`` the least length stands in the pattern: a run that is
#: too short cannot hold a longer match, so both ways find the same spans.
BASE_RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         least=6, group=2, any_case=True),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)

LEDGER_SCHEMA = "blob binary, kind string, rule_version int, spans array<struct<start:bigint,stop:bigint>>"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def find_spans(rule: Rule, compiled: re.Pattern, text: str) -> list[dict]:
    """Leftmost non-overlapping matches of the rule, code points, end exclusive."""
    return [{"start": m.start(), "stop": m.end()} for m in compiled.finditer(text)
            if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _compiled(rules) -> dict:
    return {r.key: (r, re.compile(r.pattern, re.A | (re.I if r.any_case else 0))) for r in rules}


def content_address(versions: DataFrame, text: str = "text") -> DataFrame:
    """``path`` (the other columns as a struct), ``content`` (the text, null:
    empty) and ``blob`` (its SHA-256)."""
    keep = [versions[c] for c in versions.columns if c != text]
    content = F.coalesce(versions[text], F.lit(""))
    return versions.select(F.struct(*keep).alias("path"), content.alias("content"),
                           F.unhex(F.sha2(content, 256)).alias("blob"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger; an empty one where nothing has been scanned yet."""
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER_SCHEMA)


def outstanding(blobs: DataFrame, ledger: DataFrame, rules) -> DataFrame:
    """(blob, content, todo): the rule versions that have not seen the blob."""
    every = F.array(*(F.lit(r.key) for r in rules))
    done = ledger.groupBy("blob").agg(
        F.collect_set(F.concat_ws("@", "kind", "rule_version")).alias("done"))
    todo = F.array_except(every, F.coalesce("done", F.array().cast("array<string>")))
    return (blobs.join(done, "blob", "left").select("blob", "content", todo.alias("todo"))
            .filter(F.size("todo") > 0))


def scan(todo: DataFrame, rules) -> DataFrame:
    """Run the outstanding rules over each blob, an Arrow batch at a time."""
    rules = tuple(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = _compiled(rules)
        for batch in in_parts(batches):
            blob, kind, version, spans = [], [], [], []
            for b, text, keys in zip(batch.column("blob"), batch.column("content"), batch.column("todo")):
                b, text = b.as_py(), text.as_py()
                for key in keys.as_py():
                    rule, pattern = compiled[key]
                    blob.append(b)
                    kind.append(rule.kind)
                    version.append(rule.version)
                    spans.append(find_spans(rule, pattern, text))
            yield pa.RecordBatch.from_arrays(
                [pa.array(blob, pa.binary()), pa.array(kind, pa.string()), pa.array(version, pa.int32()),
                 pa.array(spans, SPANS)], names=["blob", "kind", "rule_version", "spans"])

    return todo.mapInArrow(run, LEDGER_SCHEMA)


def update_ledger(versions: DataFrame, path: str, rules=BASE_RULES) -> None:
    """Scan what the ledger at ``path`` has not seen and append it.

    ``versions`` holds ``blob`` and ``content`` (:func:`content_address`).
    """
    spark = versions.sparkSession
    blobs = versions.groupBy("blob").agg(F.first("content").alias("content"))
    new = scan(outstanding(blobs, read_ledger(spark, path), rules), rules)
    new.write.mode("append").partitionBy("kind", "rule_version").parquet(path)


def findings(ledger: DataFrame, rules=BASE_RULES) -> DataFrame:
    """One row per blob that has findings under the given rule versions:
    n_<kind>, spans (kind:start:end by start, then rule order, comma-joined)."""
    order = F.coalesce(*(F.when((F.col("kind") == r.kind) & (F.col("rule_version") == r.version), F.lit(i))
                         for i, r in enumerate(rules)))
    hits = (ledger.withColumn("rule", order).filter(F.col("rule").isNotNull() & (F.size("spans") > 0))
            .select("blob", F.transform("spans", lambda s: F.struct(
                s["start"].alias("start"), F.col("rule").alias("rule"), s["stop"].alias("stop"),
                F.col("kind").alias("kind"))).alias("spans")))
    # a pair that two writers scanned, or a retried append wrote twice, counts once
    hits = hits.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_set("spans"))).alias("spans"))
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    return hits.select("blob", text.alias("spans"), *(_count(r.kind).alias(f"n_{r.kind}") for r in rules))


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def scan_versions(versions: DataFrame, ledger_path: str, rules=BASE_RULES, text: str = "text") -> DataFrame:
    """Update the ledger and return every version row with its findings:
    path (a struct of the given columns without the text, so that no name can
    clash), blob, n_<kind> and spans."""
    blobs = content_address(versions, text)
    update_ledger(blobs.select("blob", "content"), ledger_path, rules)
    found = findings(read_ledger(versions.sparkSession, ledger_path), rules)
    return blobs.select("path", "blob").join(found, "blob", "left").select(
        "path", F.lower(F.hex("blob")).alias("blob"),
        *(F.coalesce(f"n_{r.kind}", F.lit(0).cast("long")).alias(f"n_{r.kind}") for r in rules),
        F.coalesce("spans", F.lit("")).alias("spans"))


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the whole ``documents`` table as one version of each path.

    The ledger adds no spans to those of the base rules, so ``spans`` lists the
    base spans and ``base_sha256`` is their digest.
    """
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    out = scan_versions(docs, scratch_path(spark, "secret-ledger"))
    return out.select("path.doc_id", "n_assign", "n_access", "n_hex",
                      F.sha2(F.col("spans"), 256).alias("base_sha256"), "spans", "blob")


#: The hex rule's second version, of the incremental passes: only runs of the length of a digest of 128 bits or more.
LONGER_HEX = Rule("hex", 2, r"[0-9a-f]{32,}")


def ledger_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: ``documents`` as a store that grows between scans, by one ledger.

    The first pass sees the rows with even ids, the second all of them, the third all of them under a new version of one
    rule.  Per pass: rows seen, distinct blobs among them, (blob, rule version) pairs that it scanned, pairs that the
    ledger holds after it, and hex spans found in all rows seen."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    ledger = scratch_path(spark, "secret-ledger")
    passes = ((docs.filter("doc_id % 2 = 0"), BASE_RULES), (docs, BASE_RULES), (docs, (*BASE_RULES[:2], LONGER_HEX)))
    out, before = [], 0
    for number, (versions, rules) in enumerate(passes, 1):
        seen = scan_versions(versions, ledger, rules).agg(
            F.count(F.lit(1)).alias("n_rows"), F.countDistinct("blob").alias("n_blobs"),
            F.coalesce(F.sum("n_hex"), F.lit(0).cast("long")).alias("n_hex")).first()
        pairs = read_ledger(spark, ledger).count()
        out.append((number, seen["n_rows"], seen["n_blobs"], pairs - before, pairs, seen["n_hex"]))
        before = pairs
    return spark.createDataFrame(out, "pass int, n_rows bigint, n_blobs bigint, n_scanned bigint, n_ledger bigint, n_hex bigint")


PASSES_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT count(*) FILTER (doc_id % 2 = 0) AS even_rows, count(*) AS all_rows,
  count(DISTINCT text) FILTER (doc_id % 2 = 0) AS even, count(DISTINCT text) AS every,
  coalesce(sum(len(regexp_extract_all(text, '[0-9a-f]{24,}'))) FILTER (doc_id % 2 = 0), 0) AS even_hex,
  coalesce(sum(len(regexp_extract_all(text, '[0-9a-f]{24,}'))), 0) AS all_hex,
  coalesce(sum(len(regexp_extract_all(text, '[0-9a-f]{32,}'))), 0) AS long_hex FROM d)
SELECT CAST(1 AS INTEGER) AS pass, even_rows AS n_rows, even AS n_blobs, 3 * even AS n_scanned, 3 * even AS n_ledger,
  CAST(even_hex AS BIGINT) AS n_hex FROM n
UNION ALL SELECT CAST(2 AS INTEGER), all_rows, every, 3 * (every - even), 3 * every, CAST(all_hex AS BIGINT) FROM n
UNION ALL SELECT CAST(3 AS INTEGER), all_rows, every, every, 4 * every, CAST(long_hex AS BIGINT) FROM n
"""
