"""Plan shapes that matter at scale."""

from __future__ import annotations

from contextlib import redirect_stdout
from io import StringIO

from lexloom.operators import search as s
from lexloom.operators.words import sum_words
from lexloom.plans.build import build_lexicon
from lexloom.storage import new_folder


def plan(df) -> str:
    out = StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_search_is_one_pruned_scan(spark, lexicon):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    text = plan(s.search(lexicon, [("len", ">=", 6), ("start", "=", "th"), ("pos", "=", "noun"),
                                   ("frequency", ">", 10), ("relfreq", "<", 1e5)],
                         limit=100, lemmas=False, grams=False))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "TakeOrderedAndProject" in text
    assert "Exchange" not in text and "Join" not in text
    for pushed in ("GreaterThanOrEqual(len,6)", "GreaterThan(frequencyx,10)", "LessThanOrEqual(frequencyx,",
                   "StringStartsWith(form,th)", "EqualTo(posx,NOUN)"):
        assert pushed in text
    read = text[text.index("ReadSchema"):].split("\n")[0]
    assert "lemmafreq" not in read and "bigramfreq" not in read


def test_top_per_form_is_cut_before_the_shuffle(lexicon):
    result = s.matching(lexicon, [("frequency", ">", 0)]).select(s.result_columns(lexicon.features))
    text = plan(s.top_per_form(result, 2))
    assert text.split("\n\n")[0].count("WindowGroupLimit") == 2


def test_gram_columns_move_no_rows(spark, lexicon):
    from lexloom.operators.grams import gram_contributions

    assert "Exchange" not in plan(gram_contributions(lexicon["forms"], ["th", "en"]))


def test_accepted_forms_are_read_once(spark):
    """They may be a whole query over the corpus."""
    seen = spark.sparkContext.accumulator(0)

    def note(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    accepted = spark.createDataFrame([("talo",), ("valo",)], "form string").mapInArrow(note, "form string")
    rows = sum_words(spark.createDataFrame([("talo", "talo", "NOUN", "_", 5), ("valo", "valo", "NOUN", "_", 3)],
                                           "lemma string, form string, pos string, feats string, frequency long"))
    built = build_lexicon(rows, new_folder(spark, "once"), accepted_forms=accepted, auto=20, minimum=2)
    assert seen.value == 2
    assert {r.form: r.hood for r in built["forms"].collect()} == {"talo": 1, "valo": 1}
