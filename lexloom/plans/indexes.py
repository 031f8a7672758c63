"""Search indexes of a stored lexicon.

``grams`` holds the letter trigrams of every form, with marks for its beginning and end, sorted, so that a
filter on trigrams reads only their rows. ``by_form`` and ``by_lemmac`` are copies of the search table in Spark
buckets: a join on the form or the lemma moves the other side only. ``sums_*`` are a small lattice of
group-bys: frequency and number of rows by features, by lemma properties and by both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexloom.functions.grams import marked_trigrams
from lexloom.operators.lookup import fits_broadcast
from lexloom.sources.store import Lexicon, begin, complete, finished
from lexloom.storage import keep

#: Rows of a bucket, about, when their number is not given; and the fewest buckets.
BUCKET_ROWS, LEAST_BUCKETS = 500_000, 8
#: Small row groups, so that a filter on sorted trigrams skips most of them.
GROUP_BYTES = 4 << 20
BUCKETED = {"by_form": "form", "by_lemmac": "lemmac"}
LEMMA_KEYS = ["lemma", "lemmac", "posx", "lemmafreq", "lemmalen", "comparts", "amblemma"]


def lattice(features: Iterable[str]) -> dict[str, list[str]]:
    """The stored group-bys and their keys."""
    by_features = ["posx", *features]
    return {"sums_features": by_features, "sums_lemmas": LEMMA_KEYS,
            "sums_both": [*LEMMA_KEYS, *(f for f in by_features if f not in LEMMA_KEYS)]}


class Indexes:
    """The opened indexes of a lexicon."""

    def __init__(self, spark: SparkSession, path: str, features: Iterable[str]):
        self.grams = spark.read.parquet(f"{path}/indexes/grams")
        self.bucketed = {column: _bucketed(spark, path, name) for name, column in BUCKETED.items()}
        sizes = {row.name: row.groups for row in spark.read.parquet(f"{path}/indexes/sizes").collect()}
        #: Stored sums, smallest first.
        self.sums = [(set(keys), spark.read.parquet(f"{path}/indexes/{name}")) for name, keys in
                     sorted(lattice(features).items(), key=lambda entry: sizes[entry[0]])]

    def smallest(self, columns: Iterable[str]) -> DataFrame | None:
        """The smallest stored sums that have all these columns as keys."""
        return next((df for keys, df in self.sums if set(columns) <= keys), None)


def _table_name(path: str) -> str:
    return "lexloom_" + hashlib.sha256(path.encode()).hexdigest()[:20]


def _bucketed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A bucketed copy as a table of the session; the number of buckets is that of its folder."""
    folder, table = f"{path}/indexes/{name}", f"{_table_name(path)}_{name}"
    if not spark.catalog.tableExists(table):
        stored = spark.read.parquet(f"{path}/wide")
        buckets = spark.read.parquet(f"{path}/indexes/buckets").first().buckets
        columns = ", ".join(f"`{c}` {t}" for c, t in stored.dtypes)
        column = BUCKETED[name]
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({column}) "
                  f"SORTED BY ({column}) INTO {buckets} BUCKETS LOCATION '{folder}'")
    return spark.table(table)


def build_indexes(lexicon: Lexicon, buckets: int | None = None) -> Lexicon:
    """Write the indexes beside the tables of a stored lexicon, and open it with them.

    They are used by searches from then on. Building the lexicon again takes their mark away.
    """
    spark, path, wide = lexicon["wide"].sparkSession, lexicon.path, lexicon["wide"]
    folder = f"{path}/indexes"
    begin(spark, folder)
    if buckets is None:
        buckets = max(LEAST_BUCKETS, 1 << (wide.count() // BUCKET_ROWS).bit_length())
    grams = lexicon["forms"].select(F.explode(marked_trigrams(F.col("form"))).alias("gram"), "form")
    # Frequent trigrams are spread over partitions by the form.
    (grams.repartitionByRange("gram", "form").sortWithinPartitions("gram", "form")
     .write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).parquet(f"{folder}/grams"))
    # Feature columns follow from class and features: they are put back after the rows have moved.
    values = list(lexicon.features.values())
    known = lexicon["features"].select("feats", "pos", *values)
    few = fits_broadcast(known)
    for name, column in BUCKETED.items():
        table = f"{_table_name(path)}_{name}"
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        moved = (wide.drop(*values) if few else wide).repartition(buckets, column)
        if few:
            moved = moved.join(F.broadcast(known), ["feats", "pos"]).select(wide.columns)
        (moved.write.mode("overwrite").bucketBy(buckets, column).sortBy(column)
         .option("path", f"{folder}/{name}").format("parquet").saveAsTable(table))
    # Each node of the lattice comes from a finer one, and twins of a verb and its auxiliary count once.
    rows, sizes = wide.where("primary").withColumn("rows", F.lit(1).cast("long")), []
    for name, keys in sorted(lattice(lexicon.features.values()).items(), key=lambda entry: -len(entry[1])):
        sums = keep(rows.groupBy(keys).agg(F.sum("frequencyx").alias("frequencyx"), F.sum("rows").alias("rows")),
                    path=f"{folder}/{name}")
        if not sizes:
            rows = sums
        sizes.append(sums.agg(F.count("*").alias("groups")).select(F.lit(name).alias("name"), "groups"))
    keep(reduce(DataFrame.unionByName, sizes), path=f"{folder}/sizes")
    keep(spark.range(1).select(F.lit(buckets).alias("buckets")), path=f"{folder}/buckets")
    complete(spark, folder)
    return open_indexed(spark, path)


def open_indexed(spark: SparkSession, path: str) -> Lexicon:
    """Open a stored lexicon with its indexes, if they are finished."""
    lexicon = Lexicon.load(spark, path)
    if finished(spark, f"{path}/indexes"):
        lexicon.indexes = Indexes(spark, path, lexicon.features.values())
    return lexicon
