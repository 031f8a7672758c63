"""Fixity audit of WARC replicas with Merkle trees over offset ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lexloom.llm.store import Workspace, table

#: Bytes of an archive that one leaf range of the tree covers, and children of a node.
RANGE_BYTES = 1 << 16
FANOUT = 16
#: Pages in an archive.
ARCHIVE_PAGES = 1000
END = "\r\n\r\n"


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC response record without its trailing blank lines."""
    body = F.coalesce(html.cast("string"), F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">\r\nWARC-Target-URI: "),
        F.regexp_replace(F.coalesce(url.cast("string"), F.lit("")), r"[\r\n]", ""),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit(END), body)


def warc_records(pages: DataFrame) -> DataFrame:
    """``archive, offset, length, page_id, record`` of pages laid out as WARC archives.

    ``pages`` has ``page_id, url, html``. Consecutive ids share an archive of ``ARCHIVE_PAGES``
    pages (null ids are spread over archives of their own by content); offsets are prefix sums in the
    order of id, url and content. ``length`` includes the two line ends after a record.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"),
                        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
                        warc_record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    rows = rows.withColumn("archive", F.when(
        F.col("page_id").isNotNull(), F.concat(F.lit("pages-"), F.floor(
            F.col("page_id") / ARCHIVE_PAGES).cast("string"))).otherwise(
        F.concat(F.lit("none-"), F.substring(F.md5("record"), 1, 4))))
    before = (Window.partitionBy("archive").orderBy("page_id", "url", "record")
              .rowsBetween(Window.unboundedPreceding, -1))
    length = (F.octet_length("record") + len(END)).cast("long")
    return rows.withColumn("length", length).select(
        "archive", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"), "length",
        "page_id", "record")


def write_warc(records: DataFrame, path: str) -> None:
    """Write records as WARC files, one folder per archive, through Spark's own writer."""
    (records.repartition("archive").sortWithinPartitions("archive", "offset")
     .select("archive", "record").write.partitionBy("archive").option("lineSep", END).text(path))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``archive, offset, length, record`` of files that ``write_warc`` wrote.

    Files are cut where a record ends and the next begins. Page content that looks like such a
    place is put together again by the length that the record's header states.
    """
    cut = END + "WARC/1.0\r\n"
    parts = (spark.read.option("lineSep", cut).text(path)
             .select("archive", F.input_file_name().alias("file"),
                     F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("at"), "value"))
    order = Window.partitionBy("archive", "file").orderBy("block", "at")
    parts = parts.withColumn("n", F.row_number().over(order)).withColumn(
        "last", F.lead("value").over(order).isNull())
    # The first part still has its version line, the last one the two line ends.
    text = F.when(F.col("n") == 1, F.col("value")).otherwise(F.concat(F.lit("WARC/1.0\r\n"), "value"))
    text = F.when(F.col("last"), F.regexp_replace(text, r"\r\n\r\n\z", "")).otherwise(text)
    head = F.substring_index("text", END, 1)
    stated = F.regexp_extract(head, r"Content-Length: ([0-9]{1,18})", 1).cast("long")
    parts = parts.withColumn("text", text).withColumn("size", F.octet_length("text").cast("long")).withColumn(
        "end", F.when(F.col("text").contains(END), F.octet_length(head) + len(END) + stated))
    # A part that is longer than what came before it said begins a record; others continue one.
    sums = order.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("offset", F.coalesce(F.sum(F.col("size") + len(END)).over(sums), F.lit(0)))
    ahead = F.max(F.when(F.col("end") >= F.col("size"), F.col("offset") + F.col("end"))).over(sums)
    parts = parts.withColumn("begins", F.coalesce(F.col("offset") >= ahead, F.lit(True)))
    parts = parts.withColumn("record_no", F.sum(F.col("begins").cast("int")).over(
        order.rowsBetween(Window.unboundedPreceding, 0)))
    records = parts.groupBy("archive", "file", "record_no").agg(
        F.min("offset").alias("offset"), F.array_join(F.transform(F.array_sort(F.collect_list(
            F.struct("n", "text"))), lambda x: x["text"]), END).alias("record"))
    return records.select("archive", "offset", (F.octet_length("record") + len(END)).cast("long")
                          .alias("length"), "record")


def leaves(records: DataFrame) -> DataFrame:
    """``archive, offset, length, digest`` of records: what the tree is built on."""
    return records.select("archive", F.col("offset").cast("long").alias("offset"),
                          F.col("length").cast("long").alias("length"),
                          F.sha2(F.coalesce(F.col("record"), F.lit("")), 256).alias("digest"))


def _height(*replicas: DataFrame) -> int:
    most = max((r.agg(F.max("offset")).first()[0] or 0 for r in replicas), default=0)
    height, width = 0, RANGE_BYTES
    while most >= width:
        height, width = height + 1, width * FANOUT
    return height


def merkle_levels(leaf: DataFrame, height: int, work: Workspace) -> list[DataFrame]:
    """``archive, node, digest`` for each level, from the leaf ranges to the roots.

    A node of the first level covers ``RANGE_BYTES`` bytes of offsets, so it holds few records however
    large an archive is; a node above covers ``FANOUT`` of the nodes below. Digests are over the
    children in order.
    """
    line = F.concat_ws(":", "offset", "length", "digest")
    level = (leaf.withColumn("node", F.floor(F.col("offset") / RANGE_BYTES))
             .groupBy("archive", "node").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(
                 F.struct("offset", line.alias("line")))), lambda x: x["line"]), "\n"), 256).alias("digest")))
    levels = [work.keep(level, "level")]
    for _ in range(height):
        below = levels[-1]
        levels.append(work.keep(
            below.withColumn("parent", F.floor(F.col("node") / FANOUT)).groupBy("archive", "parent").agg(
                F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
                    "node", F.concat_ws(":", "node", "digest").alias("line")))),
                    lambda x: x["line"]), "\n"), 256).alias("digest"))
            .withColumnRenamed("parent", "node"), "level"))
    return levels


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes that only one side has, or that have different digests."""
    joined = a.select("archive", "node", F.col("digest").alias("x")).join(
        b.select("archive", "node", F.col("digest").alias("y")), ["archive", "node"], "full")
    return joined.where(~F.col("x").eqNullSafe(F.col("y"))).select("archive", "node")


def audit(original: DataFrame, replica: DataFrame, work: Workspace | None = None) -> DataFrame:
    """``archive, offset, length, replica_length, status`` of all damaged records of a replica.

    Both sides have ``archive, offset, length, record``. Each side hashes its own records into
    trees; roots are compared, and only below differing nodes are the children compared, down to
    the records of differing ranges. ``status`` is ``changed`` (another record stands at the
    offset), ``missing`` or ``extra``; lengths are null on the side without a record.

    An archive that one side lacks is missing or extra as a whole. A null record counts as empty.
    Records that repeat an archive and offset are compared as a set. Empty tables are trees
    without nodes. Other columns are not read.
    """
    work = work or Workspace(original.sparkSession, "fixity")
    sides = [work.keep(leaves(x), "leaves") for x in (original, replica)]
    height = _height(*sides)
    a, b = (merkle_levels(x, height, work) for x in sides)
    suspects = work.keep(_differing(a[height], b[height]), "roots")
    for level in range(height - 1, -1, -1):
        parents = suspects.select("archive", F.col("node").alias("parent"))
        below = [x[level].withColumn("parent", F.floor(F.col("node") / FANOUT))
                 .join(parents, ["archive", "parent"], "left_semi") for x in (a, b)]
        suspects = work.keep(_differing(*below), "suspects")
    within = [x.withColumn("node", F.floor(F.col("offset") / RANGE_BYTES))
              .join(suspects, ["archive", "node"], "left_semi")
              .groupBy("archive", "offset").agg(
                  F.max("length").alias("length"),
                  F.array_join(F.array_sort(F.collect_list("digest")), " ").alias("digest"))
              for x in sides]
    found = within[0].withColumnRenamed("digest", "x").join(
        within[1].select("archive", "offset", F.col("length").alias("replica_length"),
                         F.col("digest").alias("y")), ["archive", "offset"], "full")
    return found.where(~F.col("x").eqNullSafe(F.col("y"))).select(
        "archive", "offset", "length", "replica_length",
        F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra")
        .otherwise("changed").alias("status"))


def damaged_copy(records: DataFrame) -> DataFrame:
    """A replica with known damage: about one page in 256 has its last letter exchanged, and about
    every eighth archive has lost the records of its last twentieth of pages."""
    number = F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    hurt = F.substring(number, 1, 2) == "3f"
    cut = F.substring(F.md5("archive"), 1, 1).isin("2", "b") & (F.pmod("page_id", F.lit(
        ARCHIVE_PAGES)) >= ARCHIVE_PAGES * 95 // 100)
    broken = F.concat(F.expr("left(record, char_length(record) - 1)"), F.lit("~"))
    return records.where(~F.coalesce(cut, F.lit(False))).withColumn(
        "record", F.when(hurt, broken).otherwise(F.col("record"))).withColumn(
            "length", (F.octet_length("record") + len(END)).cast("long"))


def op8_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records with the state of a damaged replica, as the audit finds it."""
    work = Workspace(spark, "fixity")
    records = warc_records(table(spark, sf_dir, "pages"))
    found = audit(records, damaged_copy(records), work)
    places = work.keep(records.select("page_id", "archive", "offset", "length"), "places")
    return places.join(found.select("archive", "offset", "replica_length", "status"),
                       ["archive", "offset"], "left").select(
        "page_id", "archive", "offset", "length", "replica_length",
        F.coalesce("status", F.lit("same")).alias("status"))
