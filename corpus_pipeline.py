"""Corpus pipeline: language ID, near-duplicate removal, secret masking, mixing, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next one's ``docs``.  All but the
last return the columns of ``documents``.

Decisions: documents without any letter, or whose language stays ambiguous, go;
of each group of near-duplicates (word shingles of five, likeness 0.75, through any chain of
links) the one with the least id stays; secrets are masked in place, character for character,
so that offsets keep; sources are repeated towards the target mixture, nothing is dropped;
the result is the packed pieces.

Defined cases are those of the operators; an empty table passes through every stage, and
columns that the table has beyond the known ones are kept.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actuaria.llm import jaccard, language, mixing, packing, secrets
from actuaria.llm.common import read, staged
from actuaria.session import scratch_path

#: A document whose nearest codeword has less than this share is rejected.
CLEAR = 0.4
#: Texts that Spark hands to Python at a time: ten thousand, its default, are tens of megabytes on both sides of each task.
TEXTS_PER_BATCH = 2000


def few_texts(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size to what whole texts need; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(name))
    if not 0 < rows <= TEXTS_PER_BATCH:
        spark.conf.set(name, str(TEXTS_PER_BATCH))


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (operator 9): keeps documents with a recognised language."""
    few_texts(spark)
    rows = docs.select(docs["doc_id"].alias("id"), docs["text"].alias("text"), docs["lang"].alias("lang"))
    model = language.fit(rows.filter(~language.held_out(F.col("id"))))
    if not model.languages:  # nothing to learn from: no language can be told, so none is ambiguous
        return docs.filter(docs["text"].rlike(r"\p{L}"))
    return docs.filter(language.recognised(model, CLEAR)(docs["text"]))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (operator 6): one document of each group stays, the one with the least id.

    Rows that repeat a kept id with the same text are copies and go; a null id links with nothing and stays."""
    few_texts(spark)
    joined = jaccard.jaccard_components(docs.select("doc_id", "text")).select("doc_id", "component_id")
    gone = staged(joined.filter("component_id <> doc_id").select("doc_id").distinct(), "pipeline-copies")
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    twice = staged(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"), "pipeline-twice")
    if twice.isEmpty():
        return kept
    # only rows whose id (or null id) is there more than once are compared whole
    again = kept.join(twice, "doc_id", "left_semi").unionByName(kept.filter("doc_id IS NULL")).select(*docs.columns)
    return kept.filter("doc_id IS NOT NULL").join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(
        again.dropDuplicates())


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans (operator 2): every span found is overwritten with asterisks."""
    few_texts(spark)
    ledger = scratch_path(spark, "secret-ledger")
    found = secrets.scan_versions(docs.select("doc_id", "text"), ledger).filter("spans <> ''")
    found = staged(found.select(F.unhex("blob").alias("blob"), "spans").distinct(), "pipeline-secrets")
    spans = F.transform(F.split("spans", ","), lambda s: F.struct(
        F.split(s, ":")[1].cast("int").alias("a"), F.split(s, ":")[2].cast("int").alias("b")))
    masked = F.aggregate(spans, F.col("row.text"), lambda t, s: F.concat(
        F.substring(t, F.lit(1), s["a"]), F.repeat(F.lit("*"), s["b"] - s["a"]),
        F.substring(t, s["b"] + 1, F.length(t) - s["b"])))
    rows = docs.select(F.unhex(F.sha2(F.coalesce(docs["text"], F.lit("")), 256)).alias("blob"),
                       F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    text = F.when(F.col("spans").isNotNull(), masked).otherwise(F.col("row.text"))
    return rows.join(found, "blob", "left").select(*(
        (text if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights (operator 3): every document plays at least once."""
    few_texts(spark)
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing (operator 7): the pieces of all documents."""
    few_texts(spark)
    return packing.packed(docs)


STAGES = [("language ID", identify), ("n-gram Jaccard join", drop_near_duplicates), ("secret scans", mask_secrets),
          ("mixing", mix), ("packing", pack)]

#: Not expressible in SQL (a fitted classifier, a tokenizer); tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
