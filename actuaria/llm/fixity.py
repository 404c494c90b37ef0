"""Merkle fixity audit of WARC records (operator 8).

A replica is a table of records (file, pos, offset, length, payload digest).
Records of a file are the leaves, keyed by what they are and not by where they lie:
the id's place in its file's id range (for null ids, the rank among the file's
records).  ``FAN`` consecutive keys form a node that covers one ordered id range,
``FAN`` nodes form the next level, up to one node per file, and file roots are
combined by ranges of the file number up to the archive's root.  Every node is one
grouped aggregate over at most ``FAN`` children, so no group grows with the archive.
A node hashes its records and their offset ranges relative to its own start, so a
branch that has only moved as a whole keeps its hash.

The audit compares the roots of two replicas and joins the children of
mismatching nodes only, level by level, down to the records: a damaged, missing
or additional record costs one branch, also where it moves the records behind it.
Records are joined under open leaves only.  All others are taken from the primary:
equal hashes vouch for their bytes and layout, and the starts of the equal nodes
tell how far they have moved.
``record_report`` gives every record its status by identity (a record that only lies
elsewhere is ``shifted``); ``audit_report`` compares what lies at each position.

Defined cases: null urls and payloads count as empty; rows with a null id lie in
files of their own, dealt by a hash; repeated rows are records of their own (told
apart by their position); an empty table gives no tree, and against a full
replica everything is ``missing``; extra columns are ignored.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from actuaria.llm.common import read, staged

FAN = 16
#: Ids per WARC file.
FILE_IDS = 1024


def warc_head(url: Column, id: Column, size: Column) -> Column:
    """Header block of a WARC resource record."""
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        size.cast("string"), F.lit("\r\n\r\n"))


def records(pages: DataFrame, id: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """The pages as WARC records: file, pos, offset, length, sha (of header, body and the closing blank lines)."""
    rows = pages.select(pages[id].alias("id"), F.coalesce(pages[url], F.lit("")).alias("url"),
                        F.coalesce(pages[body], F.lit("")).alias("body"))
    record = F.concat(warc_head(F.col("url"), F.col("id"), F.octet_length("body")), F.col("body"), F.lit("\r\n\r\n"))
    file = F.coalesce(F.floor(F.col("id") / FILE_IDS), -1 - F.pmod(F.xxhash64("url", "body"), F.lit(FILE_IDS)))
    rows = rows.select("id", file.cast("long").alias("file"), F.sha2(record, 256).alias("sha"),
                       F.octet_length(record).cast("long").alias("length"))
    order = Window.partitionBy("file").orderBy("id", "sha")
    before = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("file", (F.row_number().over(order) - 1).cast("long").alias("pos"), "id",
                       F.coalesce(before, F.lit(0)).cast("long").alias("offset"), "length", "sha")


def keyed_records(records: DataFrame) -> DataFrame:
    """The records with their leaf (slot) and, among equal ids, their number (copy) in the order of the digests:
    an id's records stay together, and no record's key depends on other ids."""
    copy = F.row_number().over(Window.partitionBy("file", "id").orderBy("sha", "pos")) - 1
    named = records.filter("id IS NOT NULL").withColumn("copy", copy.cast("long")).withColumn(
        "slot", F.pmod(F.col("id"), F.lit(FILE_IDS)).cast("long"))
    # null ids: a record is its digest; equal ones are counted, and leaves are ranges of digests
    alike = F.row_number().over(Window.partitionBy("file", "sha").orderBy("pos")) - 1
    unnamed = records.filter("id IS NULL").withColumn("copy", alike.cast("long")).withColumn(
        "slot", F.pmod(F.xxhash64("sha"), F.lit(FILE_IDS)).cast("long"))
    return named.unionByName(unnamed)


def parents(nodes: DataFrame, number: Column, *tree: str) -> DataFrame:
    """The level above: ``FAN`` consecutive nodes make one; its hash covers the children's numbers and hashes in order
    and where each lies within the parent; ``start`` and ``stop`` are its offset range, ``pos`` its first position."""
    kid = lambda k: F.concat_ws(":", k["node"], k["start"] - F.col("start"), k["stop"] - F.col("start"),
                                k["pos"] - F.col("pos"), k["hash"])
    return (nodes.withColumn("up", number).groupBy(*tree, "up")
            .agg(F.sort_array(F.collect_list(F.struct("node", "start", "stop", "pos", "hash"))).alias("kids"),
                 F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("pos").alias("pos"))
            .select(*tree, F.col("up").alias("node"), "start", "stop", "pos",
                    F.sha2(F.array_join(F.transform("kids", kid), ","), 256).alias("hash")))


def _depth(nodes: int) -> int:
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // FAN), levels + 1
    return levels


def build_tree(leaves: DataFrame, depth: int, file_depth: int) -> list[DataFrame]:
    """Levels from the records up: ``depth`` within each file, then ``file_depth`` over the files.

    Every level has (file, node, start, stop, pos, hash); above the files ``file`` is 0 and ``node`` numbers
    ranges of files."""
    record = F.struct("copy", F.coalesce(F.col("id").cast("string"), F.lit("null")).alias("id"), "pos", "offset", "length", "sha")
    own = lambda r: F.concat_ws("|", r["id"], r["copy"], r["pos"] - F.col("pos"), r["offset"] - F.col("start"),
                                r["length"], r["sha"])
    level = (leaves.groupBy("file", F.col("slot").alias("node"))  # one record, save for equal or null ids
             .agg(F.sort_array(F.collect_list(record)).alias("own"), F.min("offset").alias("start"),
                  F.max(F.col("offset") + F.col("length")).alias("stop"), F.min("pos").alias("pos"))
             .select("file", "node", "start", "stop", "pos",
                     F.sha2(F.array_join(F.transform("own", own), ","), 256).alias("hash")))
    levels = [staged(level, "merkle")]
    for _ in range(depth):
        levels.append(staged(parents(levels[-1], F.floor(F.col("node") / FAN).cast("long"), "file"), "merkle"))
    top = levels[-1].withColumns({"node": F.col("file"), "file": F.lit(0).cast("long")})
    for _ in range(file_depth):
        top = staged(parents(top, F.floor(F.col("node") / FAN).cast("long"), "file"), "merkle")
        levels.append(top)
    return levels


def compared(a: DataFrame, b: DataFrame, within: DataFrame | None) -> DataFrame:
    """(file, node, differs, d_pos, d_offset) of two replicas' nodes of one level, only below the mismatching parents
    ``within``, where given: whether the hashes differ (or one replica lacks the node), and how far an equal node has moved."""
    def side(level: DataFrame, name: str) -> DataFrame:
        level = level.select("file", "node", *(F.col(c).alias(f"{c}_{name}") for c in ("start", "pos", "hash")))
        return level if within is None else level.join(within, ["file", "node"], "left_semi")
    return side(a, "a").join(side(b, "b"), ["file", "node"], "full").select(
        "file", "node", (~F.col("hash_a").eqNullSafe(F.col("hash_b"))).alias("differs"),
        (F.col("pos_b") - F.col("pos_a")).alias("d_pos"), (F.col("start_b") - F.col("start_a")).alias("d_offset"))


def children(nodes: DataFrame, files: bool) -> DataFrame:
    """Numbers of the children that the mismatching nodes can have."""
    kid = nodes.select("file", F.explode(F.sequence(F.col("node") * FAN, F.col("node") * FAN + FAN - 1)).alias("node"))
    return kid.select(F.col("node").alias("file"), F.lit(0).cast("long").alias("node")) if files else kid


PLACES = "file bigint, slot bigint, open boolean, d_pos bigint, d_offset bigint"


def _descend(primary: DataFrame, replica: DataFrame) -> tuple[DataFrame, list[int]]:
    """The leaves of mismatching files, and the nodes opened at each level from the root.

    A leaf (file, slot) is open if its own hash differs; else it lies under an equal node, which says how far its
    records have moved (d_pos, d_offset).  Files without a row here are equal throughout."""
    spark = primary.sparkSession
    size = primary.select("file").unionByName(replica.select("file")).agg(
        F.min("file").alias("low"), F.max("file").alias("high")).first()
    depth = max(1, _depth(FILE_IDS))
    # ranges of negative and positive file numbers meet in node 0 or -1; two more levels join them
    file_depth = max(1, _depth(max(abs(size["low"] or 0), abs(size["high"] or 0)) + 1))
    a, b = build_tree(primary, depth, file_depth), build_tree(replica, depth, file_depth)
    opened: list[int] = []
    within, places = None, spark.createDataFrame([], PLACES)
    for at in range(len(a) - 1, -1, -1):
        found = staged(compared(a[at], b[at], within), "mismatch")
        bad = found.filter("differs").select("file", "node")
        opened.append(bad.count())
        if at < depth:  # below the files: what is equal settles its whole range of leaves
            slots = F.sequence(F.col("node") * FAN ** at, (F.col("node") + 1) * FAN ** at - 1)
            places = places.unionByName(found.filter("NOT differs").select(
                "file", F.explode(slots).alias("slot"), F.lit(False).alias("open"), "d_pos", "d_offset"))
        if not opened[-1]:
            return staged(places, "warc-places"), opened
        if at:
            within = children(bad, files=at == depth + 1)
    nothing = F.lit(None).cast("long")
    return staged(places.unionByName(bad.select("file", F.col("node").alias("slot"), F.lit(True).alias("open"),
                                                nothing.alias("d_pos"), nothing.alias("d_offset"))), "warc-places"), opened


@dataclass
class Located:
    """Keyed records of two replicas, the leaves of mismatching files (``PLACES``) and the nodes opened at each level."""

    primary: DataFrame
    replica: DataFrame
    places: DataFrame
    opened: list[int]

    def to_join(self, moved: bool) -> tuple[DataFrame, DataFrame]:
        """The records of both replicas that have to be compared one by one: those of open leaves and,
        if ``moved``, of leaves that lie elsewhere."""
        which = self.places.filter(F.col("open") | (F.lit(moved) & ((F.col("d_pos") != 0) | (F.col("d_offset") != 0))))
        return tuple(x.join(which.select("file", "slot"), ["file", "slot"], "left_semi") for x in (self.primary, self.replica))

    def settled(self) -> DataFrame:
        """The primary's records outside open leaves, with how far they have moved; the tree vouches for their bytes."""
        return self.primary.join(self.places, ["file", "slot"], "left").filter(
            "open IS NULL OR NOT open").withColumns(
                {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("d_pos", "d_offset")}).drop("open")


def located(primary: DataFrame, replica: DataFrame) -> Located:
    """Build both trees and descend into their mismatching branches."""
    a = staged(keyed_records(primary), "warc-keyed")
    b = staged(keyed_records(replica), "warc-keyed")
    return Located(a, b, *_descend(a, b))


KEYS = ["file", "slot", "who", "copy"]


def _by_identity(found: Located) -> DataFrame:
    """The records of open leaves of both replicas, side by side."""
    who = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("null "), F.col("sha")))
    a, b = (x.withColumn("who", who) for x in found.to_join(moved=False))
    r = b.select(*KEYS, F.col("id").alias("replica_id"), F.col("pos").alias("replica_pos"),
                 F.col("offset").alias("replica_offset"), F.col("sha").alias("replica_sha"))
    return a.select(*KEYS, "id", "pos", "offset", "length", "sha").join(r, KEYS, "full")


def audit(primary: DataFrame, replica: DataFrame) -> tuple[DataFrame, list[int]]:
    """Differing records (file, pos) of two replicas, with the position in the replica of an additional one, and
    the nodes opened at each level from the root."""
    found = located(primary, replica)
    bad = _by_identity(found).filter(~F.col("sha").eqNullSafe(F.col("replica_sha")))
    return bad.select("file", F.coalesce("pos", "replica_pos").alias("pos")), found.opened


REPORT = ["file", "id", "pos", "replica_pos", "offset", "replica_offset", "length", "sha", "replica_sha", "status"]


def record_report(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Every record of either replica by its identity: intact, shifted (only its position or offset differs),
    altered, missing (in the replica) or additional.

    Records of open leaves are joined; all others are the primary's, moved as the equal node above them has moved."""
    found = located(primary, replica)
    moved = (F.col("pos") != F.col("replica_pos")) | (F.col("offset") != F.col("replica_offset"))
    status = (F.when(F.col("replica_sha").isNull(), "missing").when(F.col("sha").isNull(), "additional")
              .when(F.col("sha") != F.col("replica_sha"), "altered").when(moved, "shifted").otherwise("intact"))
    joined = _by_identity(found).withColumns({"status": status, "id": F.coalesce("id", "replica_id")})
    rest = found.settled().withColumns({
        "replica_pos": F.col("pos") + F.col("d_pos"), "replica_offset": F.col("offset") + F.col("d_offset"),
        "replica_sha": F.col("sha"),
        "status": F.when((F.col("d_pos") != 0) | (F.col("d_offset") != 0), "shifted").otherwise("intact")})
    return joined.select(*REPORT).unionByName(rest.select(*REPORT))


def audit_report(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """What lies at each position of either replica: intact, altered (other bytes, or the same ones at another
    offset), missing (nothing in the replica) or additional.  Which records are damaged: :func:`record_report`.

    Positions are compared in open leaves and in those that lie elsewhere; the rest is intact where it is."""
    found = located(primary, replica)
    keys = ["file", "pos"]
    a, b = found.to_join(moved=True)
    r = b.select(*keys, F.col("offset").alias("replica_offset"), F.col("length").alias("replica_length"),
                 F.col("sha").alias("replica_sha"))
    both = a.select(*keys, "id", "offset", "length", "sha").join(r, keys, "full")
    same = ((F.col("sha") == F.col("replica_sha")) & (F.col("offset") == F.col("replica_offset"))
            & (F.col("length") == F.col("replica_length")))
    status = (F.when(F.col("replica_sha").isNull(), "missing").when(F.col("sha").isNull(), "additional")
              .when(same, "intact").otherwise("altered"))
    rest = found.settled().filter("d_pos = 0 AND d_offset = 0").select(
        *keys, "id", "offset", "length", "sha", F.col("sha").alias("replica_sha"), F.lit("intact").alias("status"))
    return both.select(*keys, "id", "offset", "length", "sha", "replica_sha", status.alias("status")).unionByName(rest)


def damaged(pages: DataFrame) -> DataFrame:
    """A second copy of the pages as a faulty store would return it: in every 97th
    page the last 16 characters are lost, and the last page of every 5th file is gone."""
    last = (F.col("page_id") % FILE_IDS == FILE_IDS - 1) & (F.floor(F.col("page_id") / FILE_IDS) % 5 == 0)
    body = F.when(F.col("page_id") % 97 == 0,
                  F.substring("html", F.lit(1), F.greatest(F.length("html") - 16, F.lit(0)))).otherwise(F.col("html"))
    return pages.select("page_id", "url", body.alias("html")).filter(~F.coalesce(last, F.lit(False)))


def fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the WARC records of the whole ``pages`` table against a damaged copy derived from it."""
    pages = read(spark, sf_dir, "pages", "page_id", "url", "html")
    out = audit_report(staged(records(pages), "warc-primary"), staged(records(damaged(pages)), "warc-replica"))
    return out.withColumnRenamed("id", "page_id")


def record_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: as :func:`fixity_audit`, by the records' identity instead of their position."""
    pages = read(spark, sf_dir, "pages", "page_id", "url", "html")
    out = record_report(staged(records(pages), "warc-primary"), staged(records(damaged(pages)), "warc-replica"))
    return out.withColumnRenamed("id", "page_id")


def _records_sql(source: str) -> str:
    return f"""
 SELECT file, row_number() OVER (PARTITION BY file ORDER BY page_id, sha) - 1 AS pos, page_id, length, sha,
  coalesce(CAST(sum(length) OVER (PARTITION BY file ORDER BY page_id, sha
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS "offset"
 FROM (SELECT page_id, page_id // {FILE_IDS} AS file, sha256(rec) AS sha, strlen(rec) AS length
  FROM (SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
    || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url
    || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: '
    || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html
    || chr(13) || chr(10) || chr(13) || chr(10) AS rec FROM {source}))"""


FIXITY_SQL = f"""
WITH a AS ({_records_sql("pages")}),
r AS (SELECT page_id, url, CASE WHEN page_id % 97 = 0 THEN substr(html, 1, greatest(length(html) - 16, 0))
       ELSE html END AS html FROM pages
      WHERE NOT (page_id % {FILE_IDS} = {FILE_IDS} - 1 AND (page_id // {FILE_IDS}) % 5 = 0)),
b AS ({_records_sql("r")})
SELECT file, pos, a.page_id AS page_id, a."offset" AS "offset", a.length AS length, a.sha AS sha, b.sha AS replica_sha,
 CASE WHEN b.sha IS NULL THEN 'missing' WHEN a.sha IS NULL THEN 'additional'
      WHEN a.sha = b.sha AND a."offset" = b."offset" AND a.length = b.length THEN 'intact' ELSE 'altered' END AS status
FROM a FULL JOIN b USING (file, pos)
"""

RECORD_SQL = FIXITY_SQL[:FIXITY_SQL.index("SELECT file, pos, a.page_id")] + """
SELECT coalesce(a.file, b.file) AS file, coalesce(a.page_id, b.page_id) AS page_id, a.pos AS pos, b.pos AS replica_pos,
 a."offset" AS "offset", b."offset" AS replica_offset, a.length AS length, a.sha AS sha, b.sha AS replica_sha,
 CASE WHEN b.sha IS NULL THEN 'missing' WHEN a.sha IS NULL THEN 'additional' WHEN a.sha <> b.sha THEN 'altered'
      WHEN a.pos <> b.pos OR a."offset" <> b."offset" THEN 'shifted' ELSE 'intact' END AS status
FROM a FULL JOIN b ON a.page_id = b.page_id
"""
