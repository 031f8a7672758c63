"""The registered queries: each runs operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks import fixture as fx
from lexloom.functions import feats
from lexloom.languages import features_for
from lexloom.operators import ambiguity, features, grams, neighbours, search, words
from lexloom.plans import changes
from lexloom.plans.build import build_from_tokens, build_lexicon, corpus_totals, metadata_table
from lexloom.sources import conllu, export, vrt, wordlist
from lexloom.sources.store import EXPORTED, Lexicon
from lexloom.storage import keep, new_folder

# Parameters shared with the SQL in ``checks/oracles.py``.
LISTED_GRAMS = ["er", "en", "on", "an", "th", "ou", "re", "ti"]
LISTED_INITIALS = ["the", "ere", "and", "ing"]
FILE_CAP = 2
SENTENCE_CAP = 7

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# Sources

def _part(tokens: DataFrame) -> DataFrame:
    part = F.regexp_extract("file", r"part=(\d+)", 1).cast("int").alias("part")
    return tokens.select(part, "sent_id", F.col("token_id").cast("int").alias("token_id"),
                         "form", "lemma", "upos", "feats")


@query
def conllu_tokens(spark, sf_dir):
    return _part(conllu.read_conllu(spark, fx.conllu_text(spark, sf_dir), glob="*.txt.gz"))


@query
def conllu_dir(spark, sf_dir):
    folder = fx.write_conllu(spark, sf_dir, compression="gzip")
    tokens = conllu.read_conllu_tokens(spark, folder, file_cap=FILE_CAP, glob="*.txt.gz")
    return words.count_words(tokens, features_for("fi")).select("lemma", "form", "pos", "feats", "frequency")


@query
def conllu_lexicon(spark, sf_dir):
    tokens = conllu.read_conllu_tokens(spark, fx.conllu_text(spark, sf_dir), glob="*.txt.gz")
    return words.count_words(tokens, features_for("fi")).drop("primary")


@query
def conllu_tokens_capped(spark, sf_dir):
    folder = fx.conllu_text(spark, sf_dir)
    return _part(conllu.read_conllu(spark, folder, sentence_cap=SENTENCE_CAP, glob="*.txt.gz"))


@query
def vrt_tokens(spark, sf_dir):
    return _part(vrt.read_vrt(spark, fx.vrt_text(spark, sf_dir), glob="*.txt.gz"))


@query
def vrt_lexicon(spark, sf_dir):
    tokens = vrt.read_vrt_tokens(spark, fx.vrt_text(spark, sf_dir), glob="*.txt.gz")
    return words.count_words(tokens, features_for("fi")).drop("primary")


@query
def wordlist_scan(spark, sf_dir):
    folder = fx.write_wordlist(spark, fx.form_list(spark, sf_dir), "form")
    return wordlist.read_wordlist(spark, folder).select("type", "item", "position")


@query
def lexicon_roundtrip(spark, sf_dir):
    stored = Lexicon.load(spark, fx.lexicon(spark, sf_dir).path)
    return stored["lexicon"].select("lemma", "form", "pos", "posx", "feats", "len",
                                    "frequency", "frequencyx")


# Tokens

@query
def valid_words(spark, sf_dir):
    return (fx.tokens(spark, sf_dir).groupBy("form").agg(F.count("*").alias("tokens")))


@query
def rejected_tokens(spark, sf_dir):
    folder = new_folder(spark, "rejects")
    export.write_rejects(words.rejected_tokens(fx.all_tokens(spark, sf_dir)), folder)
    return export.read_rejects(spark, folder)


@query
def lexicon_origcase(spark, sf_dir):
    tokens = fx.all_tokens(spark, sf_dir, origcase=True)
    return words.count_words(tokens, features_for("fi"), origcase=True).select(
        "lemma", "form", "pos", "feats", "frequency")


@query
def core_feats(spark, sf_dir):
    core = feats.core_feats(F.col("feats"), features_for("fi"))
    return (fx.tokens(spark, sf_dir).groupBy("feats").agg(F.count("*").alias("tokens"))
            .select("feats", core.alias("core"), "tokens"))


# Lexicon

@query
def lexicon_build(spark, sf_dir):
    return fx.words(spark, sf_dir).select("lemma", "form", "pos", "posx", "feats", "len", "frequency")


@query
def lexicon_posx(spark, sf_dir):
    rows = fx.stored_words(spark, sf_dir).select("lemma", "form", "pos", "feats", "frequency")
    return words.sum_words(rows).select("lemma", "form", "pos", "posx", "feats", "frequency", "frequencyx")


@query
def feature_table(spark, sf_dir):
    return features.feature_table(fx.stored_words(spark, sf_dir), features_for("fi"))


@query
def feature_table_sv(spark, sf_dir):
    langcode = "sv"
    stored = keep(metadata_table(spark, langcode), "metadata")
    code = stored.where(F.col("key") == "langcode").first().value
    return features.feature_table(fx.words(spark, sf_dir, code), features_for(code))


@query
def feature_ids(spark, sf_dir):
    rows = fx.stored_words(spark, sf_dir)
    numbered = features.numbered_features(rows, features_for("fi"))
    return features.with_feature_ids(rows, numbered).select(
        "lemma", "form", "pos", "feats", "frequency", "featid")


@query
def feature_ids_stable(spark, sf_dir):
    """Ids of a first lexicon, and of one that adds the other documents to it."""
    first = words.count_words(fx.all_tokens(spark, sf_dir).where("doc_id % 2 = 0"), features_for("fi"))
    known = keep(features.numbered_features(keep(first, "words"), features_for("fi")), "features")
    grown = features.extend_features(known, fx.stored_words(spark, sf_dir), features_for("fi"))
    rounds = [rows.select(F.lit(number).alias("round"), "feats", "pos", "featid")
              for number, rows in enumerate((known, grown), 1)]
    return rounds[0].unionByName(rounds[1])


@query
def feature_values(spark, sf_dir):
    return features.feature_values(
        features.numbered_features(fx.stored_words(spark, sf_dir), features_for("fi")))


def _shares(spark, sf_dir) -> DataFrame:
    counts = ambiguity.form_lemma_counts(fx.stored_words(spark, sf_dir))
    return ambiguity.lemmaforms(counts, ambiguity.form_totals(counts))


@query
def lemmaforms(spark, sf_dir):
    return _shares(spark, sf_dir)


@query
def forms(spark, sf_dir):
    return ambiguity.form_totals(ambiguity.form_lemma_counts(fx.stored_words(spark, sf_dir)))


@query
def lemmas(spark, sf_dir):
    return ambiguity.lemmas(_shares(spark, sf_dir)).drop("amblemma")


@query
def lemma_ambiguity(spark, sf_dir):
    return ambiguity.lemmas(_shares(spark, sf_dir)).select("lemma", "pos", "lemmafreq", "amblemma")


@query
def form_ambiguity(spark, sf_dir):
    rows = ambiguity.form_ambiguity(fx.stored_words(spark, sf_dir), _shares(spark, sf_dir))
    return rows.select("lemma", "form", "pos", "feats", "ambform")


# Letter groups

@query
def init_trigram_freqs(spark, sf_dir):
    return grams.initial_gram_freqs(fx.stored_forms(spark, sf_dir))


@query
def final_trigram_freqs(spark, sf_dir):
    return grams.final_gram_freqs(fx.stored_forms(spark, sf_dir))


@query
def bigram_freqs(spark, sf_dir):
    return grams.bigram_freqs(fx.stored_forms(spark, sf_dir))


@query
def word_bigram_freqs(spark, sf_dir):
    rows = fx.stored_forms(spark, sf_dir)
    return grams.bigram_means(rows, grams.bigram_freqs(rows))


@query
def distinct_bigram_mean(spark, sf_dir):
    rows = fx.stored_forms(spark, sf_dir)
    return grams.bigram_means(rows, grams.bigram_freqs(rows, distinct=True), distinct=True)


@query
def gram_contributions(spark, sf_dir):
    return grams.gram_contributions(fx.stored_forms(spark, sf_dir), LISTED_GRAMS)


@query
def gram_contributions_initial(spark, sf_dir):
    return grams.gram_contributions(fx.stored_forms(spark, sf_dir), LISTED_INITIALS, "initial")


@query
def gram_contribution_sums(spark, sf_dir):
    rows = grams.gram_contribution_rows(fx.stored_forms(spark, sf_dir), "final")
    return rows.groupBy("gram").agg(F.sum("frequency").alias("frequency"), F.count("*").alias("words"))


@query
def nonword_bigrams(spark, sf_dir):
    freqs = grams.bigram_freqs(fx.stored_forms(spark, sf_dir))
    return grams.nonword_bigrams(fx.nonword_list(spark, sf_dir), freqs)


# Neighbours

def _flagged(spark, sf_dir, listed: bool) -> DataFrame:
    accepted = fx.even_forms(spark, sf_dir) if listed else None
    return keep(neighbours.flag_accepted(fx.stored_forms(spark, sf_dir), accepted,
                                         fx.AUTO, fx.MINIMUM), "flagged")


@query
def hamming_hood(spark, sf_dir):
    return neighbours.hamming_hood(_flagged(spark, sf_dir, listed=False))


@query
def hood_with_lexicon(spark, sf_dir):
    return neighbours.hamming_hood(_flagged(spark, sf_dir, listed=True))


@query
def hood_transpositions(spark, sf_dir):
    return neighbours.hamming_hood(_flagged(spark, sf_dir, listed=True), transpositions=True)


@query
def edit1_neighbours(spark, sf_dir):
    return neighbours.edit1_neighbours(_flagged(spark, sf_dir, listed=True), transpositions=True)


@query
def edit1_counts(spark, sf_dir):
    return neighbours.edit1_counts(_flagged(spark, sf_dir, listed=True))


# The stored lexicon

@query
def lexicon_full(spark, sf_dir):
    return fx.lexicon(spark, sf_dir)["lexicon"].drop("primary")


@query
def wide_lexicon(spark, sf_dir):
    return fx.lexicon(spark, sf_dir)["wide"].drop("primary")


@query
def totals(spark, sf_dir):
    lexicon = fx.lexicon(spark, sf_dir)
    return corpus_totals(*(lexicon[name] for name in
                           ("lexicon", "lemmas", "init_grams", "fin_grams", "bigrams")))


@query
def lexicon_stats(spark, sf_dir):
    return words.word_stats(fx.stored_words(spark, sf_dir))


# Searches

def _matches(spark, sf_dir, *conditions, indexed: bool = False) -> DataFrame:
    lexicon = (fx.indexed_lexicon if indexed else fx.lexicon)(spark, sf_dir)
    return search.matching(lexicon, conditions).select(search.result_columns(lexicon.features))


@query
def search_topk(spark, sf_dir):
    return search.search(fx.lexicon(spark, sf_dir), [
        ("pos", "=", "noun"), ("len", ">=", 6), ("start", "in", ["th", "an", "re"]),
        ("frequency", ">", 1)], limit=100)


@query
def search_order_by(spark, sf_dir):
    return search.search(fx.lexicon(spark, sf_dir), [("frequency", ">=", 2)],
                         order_by="hood", ascending=True, limit=500, lemmas=False)


@query
def search_dedup(spark, sf_dir):
    return search.search(fx.lexicon(spark, sf_dir), [("pos", "=", "verb"), ("hood", ">=", 0)],
                         limit=1000, lemmas=False, grams=False)


@query
def filter_numeric(spark, sf_dir):
    return _matches(spark, sf_dir, ("lemmafreq", ">", 5), ("lemmalen", "<=", 9), ("amblemma", "<", 0.9),
                    ("ambform", ">=", 0.1), ("hood", "!=", 0), ("len", ">", 4),
                    ("initgramfreq", ">", 50), ("fingramfreq", ">", 50), ("bigramfreq", ">", 100))


@query
def filter_relative(spark, sf_dir):
    return _matches(spark, sf_dir, ("relfreq", ">", 20), ("rellemmafreq", ">", 25),
                    ("relbigramfreq", ">", 1000), ("relinitgramfreq", "<", 9000))


@query
def filter_string(spark, sf_dir):
    return _matches(spark, sf_dir, ("pos", "!=", "noun"), ("number", "=", "sing"), ("case", "=", "GEN"),
                    ("form", "!=", "the"))


@query
def filter_in(spark, sf_dir):
    return _matches(spark, sf_dir, ("pos", "in", "noun,adj"), ("case", "in", ["ine", "par"]),
                    ("possnum", "not in", ["sing"]))


@query
def filter_like(spark, sf_dir):
    return _matches(spark, sf_dir, ("form", "like", "%TION%"), ("lemma", "like", "th%"), indexed=True)


@query
def filter_lemma(spark, sf_dir):
    top = [row["item"] for row in fx.lemma_list(spark, sf_dir).where("position <= 20").collect()]
    return _matches(spark, sf_dir, ("lemma", "in", top), ("lemma", "!=", "the"))


@query
def filter_start(spark, sf_dir):
    return _matches(spark, sf_dir, ("start", "in", ["th", "en"]), ("start", "not in", "tho,enr"),
                    ("start", "!=", "the"))


@query
def filter_end(spark, sf_dir):
    return _matches(spark, sf_dir, ("end", "in", ["ing", "tion", "è"]), ("end", "!=", "ating"))


@query
def filter_end_indexed(spark, sf_dir):
    """Affixes of three letters, marks included, go through the trigrams."""
    return _matches(spark, sf_dir, ("end", "in", ["ing", "tion", "en"]), ("start", "in", ["th", "re"]),
                    ("end", "!=", "ating"), indexed=True)


@query
def filter_long_list(spark, sf_dir):
    """Every form of seven letters as a beginning or an end: tens of thousands of affixes."""
    affixes = [row.form for row in fx.stored_forms(spark, sf_dir).where("length(form) = 7").select("form").collect()]
    return _matches(spark, sf_dir, ("start", "in", affixes), ("end", "not in", affixes))


@query
def filter_middle(spark, sf_dir):
    return _matches(spark, sf_dir, ("middle", "in", "tion,ouo"), ("middle", "!=", "the"),
                    ("middle", "not in", ["ent"]), indexed=True)


@query
def filter_compound(spark, sf_dir):
    return _matches(spark, sf_dir, "compound", ("pos", "=", "adj"))


@query
def filter_not_compound(spark, sf_dir):
    return _matches(spark, sf_dir, "not compound", ("pos", "=", "adj"), ("frequency", ">", 1))


@query
def filter_pos_aux(spark, sf_dir):
    return _matches(spark, sf_dir, ("pos", "in", "aux,pron"), ("frequency", ">", 1))


@query
def clitic_in(spark, sf_dir):
    return _matches(spark, sf_dir, ("clitic", "in", "kin,kaan"), ("derivation", "=", "vs"))


@query
def clitic_not_in(spark, sf_dir):
    return _matches(spark, sf_dir, ("clitic", "not in", "kin,kaan"), ("clitic", "!=", "_"))


@query
def wordlist_forms(spark, sf_dir):
    return search.search_wordlist(fx.indexed_lexicon(spark, sf_dir), fx.form_list(spark, sf_dir), "form",
                                  ordered=False)


@query
def wordlist_forms_joined(spark, sf_dir):
    """The same without indexes, in order."""
    return search.search_wordlist(fx.lexicon(spark, sf_dir), fx.form_list(spark, sf_dir), "form")


@query
def wordlist_lemmas(spark, sf_dir):
    return search.search_wordlist(fx.indexed_lexicon(spark, sf_dir), fx.lemma_list(spark, sf_dir), "lemma",
                                  ordered=False)


@query
def refilter(spark, sf_dir):
    lexicon = fx.lexicon(spark, sf_dir)
    result = search.search_wordlist(lexicon, fx.form_list(spark, sf_dir), "form")
    return search.refilter(lexicon, result, [("case", "in", "gen,nom"), ("ambform", "<", 0.9),
                                             ("frequency", ">", 2)])


@query
def top_n_per_form(spark, sf_dir):
    lexicon = fx.lexicon(spark, sf_dir)
    rows = _matches(spark, sf_dir, ("frequency", ">", 0))
    return search.refilter(lexicon, rows, [("top", "=", 2)])


@query
def relative_freqs(spark, sf_dir):
    lexicon = fx.lexicon(spark, sf_dir)
    return search.relative_frequencies(lexicon, _matches(spark, sf_dir, ("frequency", ">", 0)))


@query
def relative_freqs_only(spark, sf_dir):
    lexicon = fx.lexicon(spark, sf_dir)
    return search.relative_frequencies(lexicon, _matches(spark, sf_dir, ("len", ">", 0)), drop=True)


@query
def column_groups(spark, sf_dir):
    lexicon = fx.lexicon(spark, sf_dir)
    result = search.relative_frequencies(lexicon, _matches(spark, sf_dir, ("frequency", ">", 0)))
    return search.column_groups(result, form=True, lemma=True, grams=False, features=False,
                                frequencies="relative")


@query
def drop_empty_columns(spark, sf_dir):
    # All rows together leave no column empty, so one that is empty is added.
    rows = _matches(spark, sf_dir, ("frequency", ">", 0))
    return search.drop_empty_columns(rows.withColumn("unused", F.lit(feats.EMPTY)))


@query
def aggregate_sum(spark, sf_dir):
    return search.aggregate(fx.indexed_lexicon(spark, sf_dir), ["pos", "case"], "sum")


@query
def aggregate_count(spark, sf_dir):
    return search.aggregate(fx.indexed_lexicon(spark, sf_dir), ["lemma", "posx"], "count", limit=50)


@query
def aggregate_filtered(spark, sf_dir):
    return search.aggregate(fx.indexed_lexicon(spark, sf_dir), ["number", "clitic"], "sum",
                            [("pos", "in", "noun,adj"), ("lemmafreq", ">", 3), ("clitic", "in", "kin")])


@query
def aggregate_scanned(spark, sf_dir):
    """Conditions on the form are in no stored sums."""
    return search.aggregate(fx.lexicon(spark, sf_dir), ["pos", "number"], "sum", [("start", "=", "th")])


# Managing lexicons

def _words_and_forms(rows: DataFrame) -> DataFrame:
    """Word rows with the ambiguity recomputed from them alone."""
    counts = ambiguity.form_lemma_counts(rows)
    shares = ambiguity.lemmaforms(counts, ambiguity.form_totals(counts))
    return ambiguity.form_ambiguity(rows, shares).select(
        "lemma", "form", "pos", "feats", "frequency", "frequencyx", "ambform")


@query
def prune_frequency(spark, sf_dir):
    return _words_and_forms(words.prune_words(fx.stored_words(spark, sf_dir), min_frequency=2))


@query
def prune_pos(spark, sf_dir):
    return _words_and_forms(words.prune_words(fx.stored_words(spark, sf_dir), drop_pos=["AUX", "PRON"]))


@query
def prune_length(spark, sf_dir):
    return _words_and_forms(words.prune_words(fx.stored_words(spark, sf_dir), max_length=8))


@query
def prune_report(spark, sf_dir):
    return words.prune_report(fx.stored_words(spark, sf_dir), 2, ["AUX", "PRON"], 8)


@query
def merge_lexicons(spark, sf_dir):
    tokens = fx.all_tokens(spark, sf_dir)
    parts = [words.count_words(tokens.where(F.col("doc_id") % 2 == rest), features_for("fi"))
             for rest in (0, 1)]
    return words.merge_words(*parts).drop("primary")


def _rebuilt(spark, sf_dir, rows: DataFrame) -> DataFrame:
    """The search table of a lexicon built from word rows, opened from where it is stored."""
    built = build_lexicon(rows, new_folder(spark, "rebuilt"), accepted_forms=fx.even_forms(spark, sf_dir),
                          auto=fx.AUTO, minimum=fx.MINIMUM)
    return Lexicon.load(spark, built.path)["wide"].drop("primary")


@query
def prune_rebuilt(spark, sf_dir):
    stored = Lexicon.load(spark, fx.lexicon(spark, sf_dir).path)
    return _rebuilt(spark, sf_dir, words.prune_words(stored["lexicon"], min_frequency=2,
                                                     drop_pos=["PRON"], max_length=11))


@query
def merge_rebuilt(spark, sf_dir):
    tokens = fx.all_tokens(spark, sf_dir)
    stored = [build_from_tokens(tokens.where(F.col("doc_id") % 2 == rest), new_folder(spark, "half"))
              for rest in (0, 1)]
    halves = [Lexicon.load(spark, half.path)["lexicon"] for half in stored]
    return _rebuilt(spark, sf_dir, words.merge_words(*halves))


def _merged(spark, sf_dir) -> Lexicon:
    return changes.merge_into(fx.earlier_lexicon(spark, sf_dir), fx.later_words(spark, sf_dir),
                              **fx.options(spark, sf_dir))


@query
def merge_incremental(spark, sf_dir):
    return _merged(spark, sf_dir)["wide"].drop("primary")


@query
def merge_incremental_tables(spark, sf_dir):
    """Every table but those with feature ids, which depend on the order of additions."""
    merged = _merged(spark, sf_dir)
    out = None
    for name in EXPORTED:
        if not name.startswith("feature"):
            rows = _contents(merged[name], name, KEYS[name])
            out = rows if out is None else out.unionByName(rows)
    return out


@query
def prune_incremental(spark, sf_dir):
    pruned = changes.prune_from(fx.lexicon(spark, sf_dir), min_frequency=2, drop_pos=["PRON"], max_length=11,
                                **fx.options(spark, sf_dir))
    return pruned["wide"].drop("primary")


# Exports

@query
def export_roundtrip(spark, sf_dir):
    result = _matches(spark, sf_dir, ("frequency", ">", 0))
    folder = new_folder(spark, "export")
    export.write_text(result, folder, tsv=True)
    return export.read_text(spark, folder, result.schema, tsv=True)


@query
def export_all_tables(spark, sf_dir):
    lexicon = fx.lexicon(spark, sf_dir)
    folder = new_folder(spark, "export")
    export.export_tables(lexicon, folder)
    return _table_contents(spark, lexicon, folder)


@query
def combined_export(spark, sf_dir):
    lexicon = fx.lexicon(spark, sf_dir)
    folder = new_folder(spark, "combined")
    export.export_combined(lexicon, folder, min_frequency=1, limit=2000)
    return export.read_text(spark, folder, export.combined_rows(lexicon).schema)


@query
def release_export(spark, sf_dir):
    lexicon = fx.lexicon(spark, sf_dir)
    folder = new_folder(spark, "release")
    export.export_release(lexicon, folder, "documents")
    combined = export.read_text(spark, f"{folder}/tables/combined", export.combined_rows(lexicon).schema)
    stats = spark.read.json(f"{folder}/statistics")
    return (_table_contents(spark, lexicon, f"{folder}/tables")
            .unionByName(_rows(combined, "combined", KEYS["lexicon"]))
            .unionByName(_contents(stats, "statistics", ["source"])))


# Columns that name a row of each table.
KEYS = {"lexicon": ["lemma", "form", "pos", "feats"], "features": ["feats", "pos"],
        "feature_values": ["featid", "feature", "value"], "lemmaforms": ["lemma", "form", "pos"],
        "forms": ["form"], "lemmas": ["lemma", "pos"], "init_grams": ["gram"], "fin_grams": ["gram"],
        "bigrams": ["gram"], "word_bigrams": ["form"], "totals": ["name"], "metadata": ["key"]}


def _text(column: str, kind: str):
    """A cell as text, doubles in billionths."""
    value = F.round(F.col(column) * 1e9).cast("long") if kind == "double" else F.col(column)
    return value.cast("string")


def _rows(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """A table with a digest of all cells of each row."""
    cells = F.concat_ws("|", *[_text(c, kind) for c, kind in df.dtypes])
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in keys]).alias("key")
    return df.select(F.lit(name).alias("name"), key, F.lit("row").alias("column"), F.md5(cells).alias("value"))


def _contents(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """A table in long form: its name, the row's key, the column and its value as text."""
    def text(column: str, kind: str):
        return F.struct(F.lit(column).alias("column"), _text(column, kind).alias("value"))

    cells = F.array(*[text(c, kind) for c, kind in df.dtypes if c != "primary"])
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in keys]).alias("key")
    return df.select(F.lit(name).alias("name"), key, F.inline(cells))


def _table_contents(spark: SparkSession, lexicon: Lexicon, folder: str) -> DataFrame:
    """All exported tables, read back."""
    out = None
    for name in EXPORTED:
        table = export.read_text(spark, f"{folder}/{name}", lexicon[name].schema)
        rows = _contents(table, name, KEYS[name])
        out = rows if out is None else out.unionByName(rows)
    return out
