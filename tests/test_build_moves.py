"""What a build and its indexes write and move, and that the invented tokens stay the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixture
from lexloom.operators.words import sum_words
from lexloom.plans import build
from lexloom.plans.indexes import build_indexes
from lexloom.storage import keep, kept_outside, new_folder


def test_rows_move_once(spark, monkeypatch):
    """Stored word rows are not stored again, and the search table is not stored and ranged after its last join."""
    letters = "abcdefghij"
    data = [(f"{x}{y}talo", f"{x}{y}talo", "NOUN", "Case=Nom", 1 + (i * j) % 7)
            for i, x in enumerate(letters) for j, y in enumerate(letters)]
    rows = keep(sum_words(spark.createDataFrame(data, "lemma string, form string, pos string, feats string, frequency long")))
    names = []
    monkeypatch.setattr(build, "keep", lambda df, name="table", path=None: names.append(name) or keep(df, name, path))
    path = new_folder(spark, "once")
    built = build.build_lexicon(rows, path, auto=20, minimum=2)
    assert "words" not in names and "rows" not in names
    files = built["wide"].select(F.input_file_name().alias("file"), "frequencyx", "form").collect()
    assert len(files) == 100
    for file in {r.file for r in files}:
        found = [(-r.frequencyx, r.form) for r in files if r.file == file]
        assert found == sorted(found)
    # Rows inside the folder that is written to are stored apart first, and so are derived ones.
    assert not kept_outside(keep(rows, path=f"{path}/old"), rows.columns, path)
    assert not kept_outside(rows.where("len > 1"), rows.columns, path) and not kept_outside(rows, ["form"], path)

    moved = []
    kind = type(built["wide"])
    plain = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda df, *by: moved.append(df.columns) or plain(df, *by))
    indexed = build_indexes(built, buckets=2)
    assert len(moved) == 2 and not any(set(built.features.values()) & set(columns) for columns in moved)
    for copy in indexed.indexes.bucketed.values():
        assert copy.columns == built["wide"].columns
        assert copy.exceptAll(built["wide"]).isEmpty() and copy.count() == 100


def test_classes_at_line_ends(spark):
    """Word classes by comparing ends are those of the pattern, also where a line end is left on a form."""
    ends = ["", "\n", "\r", "\r\n", "\u0085", " ", " ", "\n\n", "\rx", "s", "\u000b"]
    forms = [(f"{word}{end}", doc) for word in ("walked", "walk", "ring", "er", "en", "red-", "") for end in ends
             for doc in (1, 2, 3, 5)]
    rows = spark.createDataFrame(forms, "form string, doc long")
    by_pattern = F.coalesce(F.col("form").rlike("(ed|ing|er|en)$"), F.lit(False))
    found = rows.select(fixture._upos(F.col("form"), F.col("doc")).isin("AUX", "VERB").alias("is"), by_pattern.alias("should"))
    assert found.where("`is` <> should").isEmpty()
