from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.llm import fixity

PAGES = "page_id long, url string, html string, archive int, status string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], PAGES)


def found(df):
    return {(r.archive, r.offset): r.status for r in df.collect()}


def test_damage_is_located(spark, work):
    """Changed, missing and extra records over several tree levels, against a plain comparison."""
    rows = [(i, f"http://x/{i}", "<p>" + "é" * (i * 37 % 5000) + "</p>") for i in range(1500)]
    records = work.keep(fixity.warc_records(pages(spark, rows)))
    assert records.agg(F.max("offset")).first()[0] > fixity.RANGE_BYTES * fixity.FANOUT
    broken = records.where("page_id not in (3, 999, 1499)").withColumn(
        "record", F.when(F.col("page_id").isin(0, 700, 1203), F.concat(F.expr("left(record, 40)"), F.lit("?")))
        .otherwise(F.col("record")))
    extra = spark.createDataFrame([("pages-0", 10 ** 9, 9, "new"), ("other", 0, 9, "new")],
                                  "archive string, offset long, length long, record string")
    replica = work.keep(broken.select("archive", "offset", "length", "record").unionByName(extra))
    place = {r.page_id: (r.archive, r.offset) for r in records.collect()}
    assert found(fixity.audit(records, replica, work)) == (
        {place[i]: "changed" for i in (0, 700, 1203)} | {place[i]: "missing" for i in (3, 999, 1499)}
        | {("pages-0", 10 ** 9): "extra", ("other", 0): "extra"})
    assert found(fixity.audit(records, records, work)) == {}


def test_only_differing_branches_are_read_on(spark, work):
    rows = [(i, "u", "x" * 3000) for i in range(900)]
    records = work.keep(fixity.warc_records(pages(spark, rows)))
    a = fixity.leaves(records)
    levels = fixity.merkle_levels(a, fixity._height(a), work)
    assert [x.count() for x in levels][-1] == 1 and len(levels) > 2
    assert levels[0].count() >= 900 * 3000 // fixity.RANGE_BYTES


def test_edges(spark, work):
    rows = [(None, None, None), (None, "u", ""), (1, None, "a\r\n\r\nWARC/1.0\r\nb"), (1, None, "a\r\n\r\nWARC/1.0\r\nb"),
            (2, "line\r\nbreak", "é" * 100_000), (-5, "", "x")]
    records = work.keep(fixity.warc_records(pages(spark, rows)))
    assert records.count() == len(rows)
    assert found(fixity.audit(records, records, work)) == {}
    none = records.limit(0)
    assert set(found(fixity.audit(records, none, work)).values()) == {"missing"}
    assert set(found(fixity.audit(none, records, work)).values()) == {"extra"}
    assert found(fixity.audit(none, none, work)) == {}


def test_files_round_trip(spark, work):
    rows = [(i, f"http://x/{i}", f"<p>{i}</p>" * (i % 50)) for i in range(2300)]
    rows[7] = (7, "u", "before\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nafter")
    rows[2299] = (2299, "u", "ends\r\n\r\n")
    records = work.keep(fixity.warc_records(pages(spark, rows)))
    path = work.path("warc")
    fixity.write_warc(records, path)
    columns = ["archive", "offset", "length", "record"]
    back = {tuple(r) for r in fixity.read_warc(spark, path).select(columns).collect()}
    assert back == {tuple(r) for r in records.select(columns).collect()}
    assert found(fixity.audit(records, fixity.read_warc(spark, path), work)) == {}
