"""Annotated tokens made from ``documents`` by a fixed rule.

The tables hold plain prose, so lemma, word class and features are invented from the
word and the document number. The rule is for checking only; ``checks/oracles.py``
holds the same rule in SQL.
"""

from __future__ import annotations

from functools import reduce, wraps
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexloom.functions.words import valid_word
from lexloom.languages import features_for
from lexloom.operators.lookup import number_sorted
from lexloom.operators.words import count_words
from lexloom.plans.build import build_lexicon
from lexloom.plans.indexes import build_indexes
from lexloom.sources.store import Lexicon
from lexloom.storage import keep, new_folder

# Neighbour thresholds that suit the size of the test tables.
AUTO, MINIMUM = 20, 2


def spread(df: DataFrame) -> DataFrame:
    """Rebalance a scan that has fewer input splits than the session has cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))


def _pick(index: Column, *values: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def _upos(form: Column, doc: Column) -> Column:
    """Word class of a form in a document."""
    # ``$`` also matches before a line end that ends the form; without one, comparing ends is the same and cheaper.
    ends = reduce(or_, [F.endswith(form, F.lit(end)) for end in ("ed", "ing", "er", "en")])
    line_end = F.substring(form, -1, 1).isin("\n", "\r", "\u0085", "\u2028", "\u2029")
    return (F.when(F.when(line_end, form.rlike("(ed|ing|er|en)$")).otherwise(ends), F.when(doc % 2 == 0, "AUX").otherwise("VERB"))
            .when(F.length(form) <= 3, F.when(doc % 3 == 0, "PRON").otherwise("ADP"))
            .when(doc % 5 == 0, "ADJ").otherwise("NOUN"))


def annotation(form: Column, doc: Column, upos: Column | None = None) -> dict[str, Column]:
    """Lemma, word class (if it is not given) and features of a form in a document."""
    size = F.length(form)
    upos = _upos(form, doc) if upos is None else upos
    lemma = (F.when((doc % 4 == 0) & (size >= 6),
                    F.concat(F.substring(form, 1, 3), F.lit("#"), F.substring(form, F.lit(4), size)))
             .when((size > 4) & (doc % 3 == 0), F.substring(form, F.lit(1), size - 2))
             .when((size > 4) & (doc % 3 == 1), F.substring(form, F.lit(1), size - 1))
             .otherwise(form))
    number = F.when(size % 2 == 1, "Plur").otherwise("Sing")
    verb = F.concat(F.lit("Mood=Ind|Number="), number, F.lit("|Person="), 1 + doc % 3,
                    F.lit("|Polarity=Pos|Tense=Past|VerbForm=Fin|Voice=Act"))
    nominal = F.concat(
        F.lit("Case="), _pick(doc % 4, "Nom", "Gen", "Par", "Ine"),
        F.when(doc % 6 == 0, "|Clitic=Han,Kin").when(doc % 6 == 1, "|Clitic=Kin").otherwise(""),
        F.when(upos == "ADJ", "|Degree=Pos").otherwise(""),
        F.when(doc % 8 == 2, "|Derivation=Inen,Vs").otherwise(""),
        F.lit("|Number="), number,
        F.when(doc % 9 == 3, "|Number[psor]=Sing|Person[psor]=1").otherwise(""))
    feats = (F.when(upos.isin("VERB", "AUX"), verb)
             .when(upos.isin("NOUN", "ADJ"), nominal).otherwise("_"))
    return {"lemma": lemma, "upos": upos, "feats": feats}


def _word(piece: Column, origcase: bool = False) -> Column:
    stripped = F.rtrim(piece, F.lit(",.;:!?"))
    return stripped if origcase else F.lower(stripped)


def annotate(docs: DataFrame, origcase: bool = False) -> DataFrame:
    """Every token of every document: (file, doc_id, sent_id, form, lemma, upos, feats)."""
    # The words come out of the explode ready made, so later filters do not repeat the rule.
    forms = F.transform(F.split("text", "[ \n\t]+"), lambda piece: _word(piece, origcase))
    words = docs.select("doc_id", F.col("source").alias("file"), F.explode(forms).alias("form"))
    # A column of its own, so that it is not worked out again for each column that depends on it.
    words = words.withColumn("upos", _upos(F.col("form"), F.col("doc_id")))
    columns = annotation(F.col("form"), F.col("doc_id"), F.col("upos"))
    return words.select("file", "doc_id", F.col("doc_id").alias("sent_id"), "form",
                        *[column.alias(name) for name, column in columns.items()])


def once_per_session(make):
    """Keep what a function returns for a session and folder: it wrote the tables already."""
    made: dict[tuple[str, str], object] = {}

    @wraps(make)
    def get(spark: SparkSession, sf_dir: str):
        key = (spark.sparkContext.applicationId, str(sf_dir))
        if key not in made:
            made[key] = make(spark, sf_dir)
        return made[key]

    return get


# Documents per rendered text file.
PER_FILE = 100


def _in_parts(docs: DataFrame) -> DataFrame:
    """Documents with the file they go to (``part``), moved there in order.

    Texts are a tenth of what is rendered from them, so they move and are sorted before. A part
    that is not null needs no further sort when it is written.
    """
    part = F.coalesce(F.lpad(F.floor(F.col("doc_id") / PER_FILE).cast("string"), 6, "0"),
                      F.lit("__HIVE_DEFAULT_PARTITION__"))
    return docs.select(part.alias("part"), "doc_id", "text").repartition("part").sortWithinPartitions("part", "doc_id")


def _rendered(docs: DataFrame, line, before: str, after: str) -> DataFrame:
    """(part, doc_id, value): each document as one sentence of text."""
    doc = F.col("doc_id")
    forms = F.transform(F.split("text", "[ \n\t]+"), lambda piece: _word(piece))
    # One by one, so that no token's class is worked out again for each column that depends on it.
    classed = F.transform(forms, lambda form: F.struct(form.alias("form"), _upos(form, doc).alias("upos")))
    lines = F.transform(classed, lambda word, i: line(
        i + 1, word["form"], annotation(word["form"], doc, word["upos"])))
    return _in_parts(docs).select("part", "doc_id", F.concat(
        F.lit(before), doc.cast("string"), F.lit(after), F.array_join(lines, "\n")).alias("value"))


def write_conllu(spark: SparkSession, sf_dir: str, compression: str = "none") -> str:
    """The tokens as CoNLL-U text, one file per hundred documents; returns the folder."""
    def line(number, form, note):
        blank = F.lit("_")
        return F.concat_ws("\t", number, form, note["lemma"], note["upos"], blank, note["feats"],
                           F.lit("0"), blank, blank, blank)

    rows = _rendered(documents(spark, sf_dir), line, "# doc = ", "\n")
    # Some sentences have more blank lines before them, and one file in three has CRLF ends.
    blanks = F.when(F.col("doc_id") % 3 == 0, F.lit("\n\n")).when(F.col("doc_id") % 7 == 0, "\n").otherwise("")
    value = F.concat(blanks, "value")
    crlf = F.replace(value, F.lit("\n"), F.lit("\r\n"))
    rows = rows.withColumn("value", F.when(F.col("part").cast("int") % 3 == 1, crlf).otherwise(value))
    return _write_parts(spark, rows, "\n\n", "conllu", compression)


@once_per_session
def conllu_text(spark: SparkSession, sf_dir: str) -> str:
    """The CoNLL-U folder, rendered once per session and packed, as features repeat."""
    return write_conllu(spark, sf_dir, compression="gzip")


def write_vrt(spark: SparkSession, sf_dir: str) -> str:
    """The tokens as VRT text with underscore-style features; returns the folder."""
    def line(number, form, note):
        msd = F.replace(note["feats"], F.lit("="), F.lit("_"))
        return F.concat_ws("\t", number, form, note["lemma"], note["upos"], msd,
                           F.lit("0"), F.lit("_"), F.lit("_"))

    header = "<!-- #vrt positional-attributes: ref word lemma pos msd dephead deprel lex/ -->\n"
    rows = _rendered(documents(spark, sf_dir), line, header + '<text>\n<sentence id="', '">\n')
    rows = rows.withColumn("value", F.concat("value", F.lit("\n</sentence>\n</text>")))
    return _write_parts(spark, rows, "\n", "vrt", "gzip")


@once_per_session
def vrt_text(spark: SparkSession, sf_dir: str) -> str:
    """The VRT folder, rendered once per session."""
    return write_vrt(spark, sf_dir)


def _write_parts(spark: SparkSession, rows: DataFrame, line_sep: str, name: str,
                 compression: str) -> str:
    folder = new_folder(spark, name)
    (rows.drop("doc_id").write.partitionBy("part").option("lineSep", line_sep).option("compression", compression)
     .text(folder))
    return folder


# Items in each word list file.
PER_LIST = 7000


def write_wordlist(spark: SparkSession, items: DataFrame, kind: str) -> str:
    """A word list as files of ``PER_LIST`` items, in order; returns the folder.

    The second file is in Latin-1 and the third begins with a byte order mark.
    """
    part = F.floor((F.col("position") - 1) / PER_LIST).cast("int").alias("part")
    rows = items.select(part, "position", F.col("item").alias("value"))
    head = F.when(F.col("part") == 2, "\ufeff# type = " + kind).otherwise("# type = " + kind)
    heads = rows.select("part").distinct().select(
        "part", F.posexplode(F.array(head, F.lit("# items"))).alias("position", "value")).withColumn(
            "position", F.col("position") - 1)
    lines = (rows.unionByName(heads).repartition("part").sortWithinPartitions("part", "position"))
    folder = new_folder(spark, "wordlist")
    lines.where("part <> 1").select("part", "value").write.partitionBy("part").text(folder)
    (lines.where("part = 1").select("value").write.option("encoding", "ISO-8859-1").option("sep", "\t")
     .option("quote", "").option("comment", "\u0001").csv(f"{folder}/latin"))
    return folder


def all_tokens(spark: SparkSession, sf_dir: str, origcase: bool = False) -> DataFrame:
    return annotate(documents(spark, sf_dir), origcase)


def tokens(spark: SparkSession, sf_dir: str, origcase: bool = False) -> DataFrame:
    """The tokens whose form is a valid word."""
    return all_tokens(spark, sf_dir, origcase).where(valid_word(F.lower("form")))


def words(spark: SparkSession, sf_dir: str, langcode: str = "fi") -> DataFrame:
    """Word rows counted from the documents."""
    return count_words(all_tokens(spark, sf_dir), features_for(langcode))


@once_per_session
def stored_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word rows, counted once per session and written to the shared folder."""
    return keep(words(spark, sf_dir), "words")


@once_per_session
def stored_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(form, frequency), written likewise."""
    rows = stored_words(spark, sf_dir).groupBy("form").agg(F.sum("frequency").alias("frequency"))
    return keep(rows, "forms")


@once_per_session
def lexicon(spark: SparkSession, sf_dir: str) -> Lexicon:
    """A stored lexicon of the documents, built once per session."""
    return build_lexicon(stored_words(spark, sf_dir), new_folder(spark, "lexicon"),
                         accepted_forms=even_forms(spark, sf_dir), auto=AUTO, minimum=MINIMUM)


@once_per_session
def indexed_lexicon(spark: SparkSession, sf_dir: str) -> Lexicon:
    """The same lexicon, opened with indexes."""
    return build_indexes(lexicon(spark, sf_dir))


# One document in so many is added later to a lexicon of the others.
LATER = 50


@once_per_session
def earlier_lexicon(spark: SparkSession, sf_dir: str) -> Lexicon:
    """A stored lexicon of all documents but the later ones."""
    earlier = count_words(all_tokens(spark, sf_dir).where(F.col("doc_id") % LATER != 0), features_for("fi"))
    return build_lexicon(earlier, new_folder(spark, "earlier"), **options(spark, sf_dir))


def later_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word rows of the later documents."""
    return count_words(all_tokens(spark, sf_dir).where(F.col("doc_id") % LATER == 0), features_for("fi"))


def options(spark: SparkSession, sf_dir: str) -> dict:
    """How the lexicons of the checks are built."""
    return {"accepted_forms": stored_even_forms(spark, sf_dir), "auto": AUTO, "minimum": MINIMUM}


@once_per_session
def stored_even_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep(even_forms(spark, sf_dir), "even_forms")


def even_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms found in documents of even number: stands in for a morphological analyser."""
    # Tied to the count, the test runs once for each form and not for each token.
    forms = all_tokens(spark, sf_dir).where(F.col("doc_id") % 2 == 0).groupBy("form").agg(F.count("*").alias("n"))
    return forms.where(F.when(F.col("n") > 0, valid_word(F.lower("form"))).otherwise(False)).select("form")


def form_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, position): all forms as a word list, most frequent first."""
    return _ranked(stored_forms(spark, sf_dir))


def lemma_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, position): all lemmas, without separators, likewise."""
    rows = (stored_words(spark, sf_dir).groupBy(F.replace("lemma", F.lit("#"), F.lit("")).alias("form"))
            .agg(F.sum("frequency").alias("frequency")))
    return _ranked(rows)


def _ranked(rows: DataFrame) -> DataFrame:
    ordered = rows.select((-F.col("frequency")).alias("rarity"), "form")
    return number_sorted(ordered, ["rarity", "form"], "position").select(
        F.col("form").alias("item"), F.col("position").cast("int").alias("position"))


def nonword_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, position): the listed forms written backwards."""
    return form_list(spark, sf_dir).select(F.reverse("item").alias("item"), "position")
