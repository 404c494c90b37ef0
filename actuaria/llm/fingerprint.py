"""Document fingerprints: bottom-k sketches of shingle hashes (operator 1).

A text's sketch is the ``k`` smallest distinct 64-bit hashes of its five-word
shingles, ascending.  Sketches of parts merge into the sketch of the union, and
two sketches estimate resemblance, containment and the number of distinct
shingles; below ``k`` shingles all of these are exact.  Everything is a column
expression on the JVM.

``with_next`` attaches each document's successor in descending id order without a
global window: ids are cut into about equally filled ranges, each range is one
window group, and the first row of each range is also sent to the range before
it (the first row of all to the last range).  One shuffle moves every text once;
only range bounds and range heads, as many as there are ranges, reach the driver.

Defined cases: a null text is empty; a text without words has an empty sketch;
two empty sketches resemble each other fully (1.0), an empty and a non-empty one
not at all (0.0); null ids come last; rows with equal ids are ordered by text,
null first; a single row is its own successor; an empty table gives an empty
result; extra columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from actuaria.llm.common import power_of_two, read, shingle_hashes, width

K = 128


def sketch(text: Column, k: int = K) -> Column:
    """The ``k`` smallest distinct shingle hashes, ascending."""
    return F.slice(shingle_hashes(text), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two sketched sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def compared(a: Column, b: Column, k: int = K) -> Column:
    """The part of the union that both sketches vouch for: all of it where both hold their whole sets."""
    whole = (F.size(a) < k) & (F.size(b) < k)
    return F.when(whole, F.array_union(a, b)).otherwise(merged(a, b, k))


def resemblance(a: Column, b: Column, union: Column) -> Column:
    """Estimated Jaccard likeness of two sketched sets, given :func:`compared`; exact for sets below ``k``."""
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles (exact below ``k``)."""
    share = (F.element_at(a, -1).cast("double") + 2.0 ** 63) / 2.0 ** 64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(likeness: Column, size_a: Column, size_b: Column) -> Column:
    """Estimated share of set a that lies in set b (1 for an empty a)."""
    common = likeness / (1 + likeness) * (size_a + size_b)
    return F.when(size_a == 0, F.lit(1.0)).otherwise(F.least(common / size_a, F.lit(1.0)))


def hex_text(a: Column) -> Column:
    """A sketch as text: 16 hex digits per hash, ascending as signed numbers."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def merge_sketches(parts: DataFrame, key: str, part: str, k: int = K) -> DataFrame:
    """(key, sketch): sketches of many parts merged per key.

    Each task keeps ``k`` hashes per key before the shuffle (ranked-window limit), so a key with any
    number of parts sends k hashes per task."""
    hashes = parts.select(F.col(key).alias("key"), F.explode_outer(part).alias("h")).distinct()
    first = Window.partitionBy("key").orderBy(F.col("h").asc_nulls_last())
    kept = hashes.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k)
    return kept.groupBy("key").agg(F.sort_array(F.collect_list("h")).alias("sketch")).withColumnRenamed("key", key)


def _longs(values: list[int]) -> Column:
    """A constant array of longs (one literal, folded once)."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _position(value: Column, cuts: list[int]) -> Column:
    """How many of the ascending ``cuts`` are <= value, by halving."""
    if not cuts:
        return F.lit(0)
    at = _longs(cuts)
    steps, p = [], power_of_two(len(cuts) + 1)
    while p:
        steps.append(p)
        p >>= 1
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda a, s: F.when(
        (a + s <= len(cuts)) & (F.get(at, a + s - 1) <= value), a + s).otherwise(a))


def with_next(rows: DataFrame, id: str, text: str, carry: list[str]) -> DataFrame:
    """``rows`` plus ``next``: a struct of the ``carry`` columns of the next row in descending id order."""
    order = F.coalesce(F.col(id).cast("long"), F.lit(-(1 << 63)))
    ranges = min(1 << 16, 4 * width(rows.sparkSession))
    keys = rows.select(order.alias("o"))
    bounds = keys.approxQuantile("o", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges))
    cuts = sorted({int(b) for b in bounds})
    heads = {r["b"]: r["o"] for r in keys.groupBy(_position(F.col("o"), cuts).alias("b")).agg(
        F.max("o").alias("o")).collect()}
    if not heads:
        return rows.withColumn("next", F.struct(*(F.col(c) for c in carry)))
    full = sorted(heads)
    before = dict(zip(full, full[1:] + full[:1]))
    numbers = range(max(full) + 1)
    own, o = _position(F.col("o"), cuts), F.col("o")
    placed = rows.withColumn("o", order).withColumn("range", own)
    is_head = o == F.get(_longs([heads.get(i, 0) for i in numbers]), F.col("range"))
    there = F.get(_longs([before.get(i, 0) for i in numbers]), F.col("range")).cast("int")
    place = lambda r, e: F.struct(r.alias("range"), F.lit(e).alias("edge"))
    sent = placed.withColumn("place", F.explode(F.when(
        is_head, F.array(place(F.col("range"), 0), place(there, 1))).otherwise(F.array(place(F.col("range"), 0)))))
    window = Window.partitionBy("place.range").orderBy("place.edge", o.desc(), F.col(text).asc())
    led = sent.withColumn("next", F.lead(F.struct(*(F.col(c) for c in carry))).over(window))
    return led.filter(F.col("place.edge") == 0).drop("o", "range", "place")


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next text."""
    rows = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", sketch(F.col("text"), k).alias("own"))
    led = with_next(rows, "doc_id", "text", ["text", "own"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = led.select(
        "doc_id", "own", F.col("next.own").alias("nxt"), n.cast("long").alias("n_chars"),
        F.concat(F.substring("text", F.lit(1), n - half), F.substring("next.text", F.lit(1), half)).alias("e"))
    edited = edited.select("doc_id", "own", "nxt", "n_chars", F.sha2(F.col("e"), 256).alias("edited_sha256"),
                           sketch(F.col("e"), k).alias("ed"))
    edited = edited.withColumns({"u_ed": compared(F.col("own"), F.col("ed"), k),
                                 "u_next": compared(F.col("own"), F.col("nxt"), k)})
    out = edited.select(
        "doc_id", "n_chars", "edited_sha256", "own", "ed",
        resemblance(F.col("own"), F.col("ed"), F.col("u_ed")).alias("near_edited"),
        resemblance(F.col("own"), F.col("nxt"), F.col("u_next")).alias("near_next"),
        distinct_shingles(F.col("own"), k).alias("shingles_est"), distinct_shingles(F.col("ed"), k).alias("e_est"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", hex_text(F.col("own")).alias("fingerprint"),
        hex_text(F.col("ed")).alias("edited_fingerprint"), "near_edited", "near_next", "shingles_est",
        containment(F.col("near_edited"), F.col("shingles_est"), F.col("e_est")).alias("contained_in_edited"))


def fingerprint_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the whole ``documents`` table."""
    return fingerprints(read(spark, sf_dir, "documents", "doc_id", "text"))
