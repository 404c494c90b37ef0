"""The audit finds exactly the damaged records and opens one branch for each."""
from pyspark.sql import functions as F

from actuaria.llm import common, fixity


def pages(spark, n=3000):
    return spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i * 7}</p>" * 3) for i in range(n)],
                                 "page_id bigint, url string, html string")


def audited(spark, html):
    a = common.staged(fixity.records(pages(spark)), "a")
    b = common.staged(fixity.records(pages(spark).withColumn("html", html).filter("html IS NOT NULL")), "b")
    bad, opened = fixity.audit(a, b)
    report = fixity.record_report(a, b).collect()
    return {(r.file, r.pos) for r in bad.collect()}, opened, report


def ids(report, status):
    return {r.id for r in report if r.status == status}


def test_exact_records_and_nodes(spark):
    hurt, places = [5, 2047, 2500], {(0, 5), (1, 1023), (2, 452)}
    of = F.col("page_id").isin(hurt)
    branches = [1, 3, 3, 3, 3, 3]  # the root, three files, and one node a level for each record
    for html, status in ((F.translate("html", "p", "q"), "altered"), (F.substring("html", 1, 8), "altered"),
                         (F.lit(None), "missing")):
        bad, opened, report = audited(spark, F.when(of, html).otherwise(F.col("html")))
        assert bad == places and ids(report, status) == set(hurt)
        assert opened[0] == 1 and max(opened) == 3 and opened[-1] == 3 and len(opened) <= len(branches)
        others = {r.status for r in report if r.id not in hurt}
        assert others <= {"intact", "shifted"} and len(report) == 3000
    assert ids(report, "shifted") == set(range(6, 1024)) | set(range(2501, 3000))


def test_null_and_equal_ids(spark):
    rows = [(1, "u", "x"), (1, "u", "y"), (1, "u", "y"), (None, "n", "x"), (None, "n", "x"), (7, "v", "z")]
    kind = "page_id bigint, url string, html string"
    a = fixity.records(spark.createDataFrame(rows, kind))
    same = fixity.record_report(a, a)
    assert {r.status for r in same.collect()} == {"intact"} and same.count() == 6
    b = fixity.records(spark.createDataFrame(rows[:4] + rows[5:], kind))
    got = sorted((r.status, r.id is None) for r in fixity.record_report(a, b).collect() if r.status != "intact")
    assert got == [("missing", True)]


def test_only_records_of_open_leaves_are_joined(spark):
    hurt = [5, 1024, 2500]
    a = common.staged(fixity.records(pages(spark)), "a")
    shorter = F.when(F.col("page_id").isin(hurt), F.substring("html", 1, 8)).otherwise(F.col("html"))
    b = common.staged(fixity.records(pages(spark).withColumn("html", shorter)), "b")
    found = fixity.located(a, b)
    joined = found.to_join(moved=False)
    assert [sorted(r.id for r in x.collect()) for x in joined] == [hurt, hurt] and found.settled().count() == 2997
    # the positional report also compares what lies elsewhere: everything behind the damage in its file
    assert [x.count() for x in found.to_join(moved=True)] == [1024 - 5 + 1024 + 3000 - 2500] * 2
    # the settled records' places in the replica are computed, not looked up
    place = {r.id: (r.pos, r.offset) for r in b.collect()}
    report = fixity.record_report(a, b).collect()
    assert {r.id: (r.replica_pos, r.replica_offset) for r in report} == place
    assert {r.id for r in report if r.status == "altered"} == set(hurt)


def test_reports_equal_a_plain_comparison(spark):
    """Damaged, lost and added records, null and equal ids: every row as a full join of all records gives it."""
    rows = [(i // 2 if i % 50 == 0 else i, f"u{i}", "x" * (i % 7)) for i in range(2200)] + [
        (None, f"n{i % 40}", "y" * (i % 3)) for i in range(60)]
    kind = "page_id bigint, url string, html string"
    other = [(i, u, h + "!" if i is not None and i % 401 == 0 else h) for k, (i, u, h) in enumerate(rows) if k % 333 != 7]
    other += [(5000, "new", "z"), (12, "again", "z")]
    a = common.staged(fixity.records(spark.createDataFrame(rows, kind)), "a")
    b = common.staged(fixity.records(spark.createDataFrame(other, kind)), "b")
    mine, theirs = ({(r.file, r.pos): r for r in x.collect()} for x in (a, b))
    want = {}
    for at in mine.keys() | theirs.keys():
        m, t = mine.get(at), theirs.get(at)
        same = m and t and (m.sha, m.offset, m.length) == (t.sha, t.offset, t.length)
        want[at] = (m and m.sha, t and t.sha, "missing" if not t else "additional" if not m else "intact" if same else "altered")
    got = fixity.audit_report(a, b).collect()
    assert len(got) == len(want) and {(r.file, r.pos): (r.sha, r.replica_sha, r.status) for r in got} == want
    report = fixity.record_report(a, b).collect()
    assert sum(r.sha is not None for r in report) == len(rows) and sum(r.replica_sha is not None for r in report) == len(other)
    for r in report:  # both sides of each row are real records at the places given
        assert r.sha is None or mine[r.file, r.pos].sha == r.sha
        assert r.replica_sha is None or theirs[r.file, r.replica_pos].sha == r.replica_sha
        assert r.status != "intact" or (r.sha, r.pos, r.offset) == (r.replica_sha, r.replica_pos, r.replica_offset)
        assert r.status != "shifted" or (r.sha == r.replica_sha and (r.pos, r.offset) != (r.replica_pos, r.replica_offset))
