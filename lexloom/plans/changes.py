"""Merging into and pruning a stored lexicon by what changes in it.

A change names groups of word rows (lemma, form, class with auxiliaries as verbs, features) and what
they become. From there it spreads: to the forms of those rows, to the lemmas of those forms, to letter
groups by the difference in frequency, to neighbours of forms that begin or cease to be accepted. Only
those parts are computed again. They are stored tables, measured and broadcast, so the tables of the
base are read and copied without a shuffle; a change too large for that is joined like any table.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from lexloom.functions.grams import (bigram_mean, final_trigram, has_trigrams, initial_trigram)
from lexloom.operators.ambiguity import form_lemma_counts, form_totals, lemmaforms, lemmas
from lexloom.operators.features import extend_features, feature_values
from lexloom.operators.grams import bigram_freqs, bigram_means, final_gram_freqs, initial_gram_freqs
from lexloom.operators.lookup import fits_broadcast, lookup_join
from lexloom.operators.neighbours import AUTO_FREQUENCY, MIN_FREQUENCY, flag_accepted, hamming_pairs
from lexloom.operators.words import BASE_COLUMNS, WORD_KEY, dropped, prune_words, sum_words
from lexloom.plans.build import DERIVED_COLUMNS, WIDE_COLUMNS
from lexloom.sources.store import Lexicon, begin, complete
from lexloom.storage import keep, new_folder

GROUP = ["lemma", "form", "posx", "feats"]
LEMMA_VALUES = ["lemmac", "lemmafreq", "lemmalen", "comparts", "amblemma"]
#: Letter pairs whose frequencies are kept as one array; beyond, forms are split and joined.
PAIR_ARRAY = 1 << 16


class _Stored:
    """A stored table to join others with: broadcast where it is measured to fit."""

    def __init__(self, df: DataFrame, name: str):
        self.rows = keep(df, name)
        self.fits = fits_broadcast(self.rows)
        self.side = F.broadcast(self.rows) if self.fits else self.rows

    def inside(self, df: DataFrame, on: list[str]) -> DataFrame:
        return df.join(self.side, on, "left_semi")

    def outside(self, df: DataFrame, on: list[str]) -> DataFrame:
        return df.join(self.side, on, "left_anti")


class Change:
    """What a change of word rows does to every table of ``base``.

    ``groups`` are the changed groups and ``rows`` all word rows these groups have afterwards.
    ``accepted_forms``, ``auto``, ``minimum`` and ``transpositions`` must be those of the build.
    """

    def __init__(self, base: Lexicon, groups: DataFrame, rows: DataFrame,
                 accepted_forms: DataFrame | None = None, auto: int = AUTO_FREQUENCY,
                 minimum: int = MIN_FREQUENCY, transpositions: bool = False):
        self.base, self.transpositions = base, transpositions
        self.groups = _Stored(groups.select(GROUP).distinct(), "groups")
        self.rows = keep(rows.select(BASE_COLUMNS), "rows")
        self.old = keep(self.groups.inside(base["lexicon"], GROUP).select(BASE_COLUMNS), "old")
        self.accepted = lambda forms: self._flagged(forms, accepted_forms, auto, minimum)
        self._forms()
        self._lemmas()
        self._grams()
        self._hood()

    def _flagged(self, forms: DataFrame, accepted_forms: DataFrame | None, auto: int, minimum: int) -> DataFrame:
        """``flag_accepted`` that asks a large list only about these forms."""
        if accepted_forms is not None:
            accepted_forms = keep(_Stored(forms.select("form"), "asked").inside(
                accepted_forms.select("form"), ["form"]), "accepted")
        return flag_accepted(forms, accepted_forms, auto, minimum)

    def _forms(self) -> None:
        words, shares = self.base["lexicon"], self.base["lemmaforms"]
        self.hit = _Stored(self.groups.rows.select("form").distinct(), "hit")
        others = self.groups.outside(self.hit.inside(words, ["form"]), GROUP).select(BASE_COLUMNS)
        counts = keep(form_lemma_counts(others.unionByName(self.rows)), "counts")
        self.totals = keep(form_totals(counts), "totals")
        self.shares = _Stored(lemmaforms(counts, self.totals), "shares")
        self.old_shares = keep(self.hit.inside(shares, ["form"]), "old_shares")
        self.all_shares = self.hit.outside(shares, ["form"]).unionByName(self.shares.rows)
        self.old_forms = keep(self.hit.inside(self.base["forms"], ["form"]), "old_forms")
        now = self.totals.select("form", F.col("frequency").alias("now"))
        before = self.old_forms.select("form", F.col("frequency").alias("before"))
        change = F.coalesce("now", F.lit(0)) - F.coalesce("before", F.lit(0))
        self.difference = keep(now.join(before, "form", "full").select("form", change.alias("frequency"))
                               .where("frequency <> 0"), "difference")

    def _lemmas(self) -> None:
        key = ["lemma", "pos"]
        self.hit_lemmas = _Stored(self.old_shares.select(key).unionByName(
            self.shares.rows.select(key)).distinct(), "hit_lemmas")
        self.lemmas = _Stored(lemmas(self.hit_lemmas.inside(self.all_shares, key)), "lemmas")
        self.old_lemmas = keep(self.hit_lemmas.inside(self.base["lemmas"], key), "old_lemmas")

    def _grams(self) -> None:
        def added(old: DataFrame, difference: DataFrame) -> DataFrame:
            sums = old.unionByName(difference).groupBy("gram").agg(F.sum("frequency").alias("frequency"))
            return keep(sums.where("frequency > 0"), "grams")

        self.gram_changes = {name: keep(make(self.difference), "gram_changes") for name, make in (
            ("init_grams", initial_gram_freqs), ("fin_grams", final_gram_freqs), ("bigrams", bigram_freqs))}
        self.grams = {name: added(self.base[name], change) for name, change in self.gram_changes.items()}
        self.mean = self._mean()

    def _mean(self) -> Column | None:
        """The letter-pair mean as an expression on the form; none if the alphabet is too large."""
        pairs = self.grams["bigrams"]
        found = {row.gram: row.frequency for row in pairs.limit(PAIR_ARRAY + 1).collect()}
        alphabet = "".join(sorted({letter for gram in found for letter in gram}))
        if len(found) > PAIR_ARRAY or len(alphabet) ** 2 > PAIR_ARRAY:
            return None
        return bigram_mean(F.col("form"), alphabet, [found.get(a + b, 0) for a in alphabet for b in alphabet])

    def _hood(self) -> None:
        old = self.accepted(self.old_forms).select("form", F.col("accepted").alias("was"))
        now = self.accepted(self.totals).select("form", F.col("accepted").alias("is"))
        step = (F.coalesce("is", F.lit(False)).cast("long") - F.coalesce("was", F.lit(False)).cast("long"))
        flags = keep(now.join(old, "form", "full").select(
            "form", step.alias("step"), F.col("was").isNull().alias("new"), F.col("is").isNull().alias("gone")), "flags")
        moving = _Stored(flags.where("step <> 0 or new").select("form", "step", "new"), "moving")
        self.gone = _Stored(flags.where("gone").select("form"), "gone")
        kept = self.gone.outside(self.base["forms"].select("form", "frequency"), ["form"])
        new_totals = self.totals.select("form", "frequency")
        rows = self.hit.outside(kept, ["form"]).unionByName(new_totals)
        # All forms ask, those that move answer; forms that are gone still answer with their step.
        asked = rows.unionByName(self.old_forms.select("form", "frequency").join(
            self.gone.side, "form", "left_semi"))
        flagged = asked.join(moving.side.withColumn("accepted", F.lit(True)), "form", "left").select(
            "form", F.col("accepted").isNotNull().alias("accepted"))
        pairs = keep(hamming_pairs(flagged, self.transpositions).join(
            moving.rows.withColumnRenamed("form", "neighbour"), "neighbour"), "pairs")
        steps = pairs.where("step <> 0").groupBy("form").agg(F.sum("step").alias("step"))
        # The neighbours of a new form, as they are afterwards.
        near = keep(pairs.where("new").select(F.col("form").alias("neighbour"), F.col("neighbour").alias("form")), "near")
        around = _Stored(near.select(F.col("neighbour").alias("form")).distinct(), "around")
        good = self.accepted(keep(around.inside(rows, ["form"]), "near_forms")).where("accepted")
        fresh = near.join(good.select(F.col("form").alias("neighbour")), "neighbour").groupBy("form").agg(
            F.count("*").alias("hood"))
        new = flags.where("new and not gone").select("form").join(fresh, "form", "left").select(
            "form", F.coalesce("hood", F.lit(0)).alias("hood"))
        known = _Stored(steps.join(flags.where("new").select("form"), "form", "left_anti"), "steps")
        moved = known.side.join(self.base["forms"].select("form", "hood"), "form") if not known.fits else (
            self.base["forms"].select("form", "hood").join(known.side, "form"))
        moved = keep(moved.select("form", (F.col("hood") + F.col("step")).alias("hood")).unionByName(new), "moved")
        # New word rows have no number yet, so forms that keep theirs are listed too.
        same = self.old_forms.select("form", "hood").join(moved.select("form"), "form", "left_anti")
        self.hood = _Stored(moved.unionByName(same), "hood")

    def forms(self) -> DataFrame:
        """The table of forms."""
        kept = self.hit.outside(self.base["forms"], ["form"])
        hit = self.totals.join(self.old_forms.select("form", "hood"), "form", "left")
        return _renewed(kept.unionByName(hit.select(kept.columns)), self.hood, ["form"], ["hood"]).select(kept.columns)

    def word_means(self, forms: DataFrame) -> DataFrame:
        """The letter-pair mean of every form."""
        if self.mean is None:
            return bigram_means(forms, self.grams["bigrams"])
        return forms.select("form", self.mean.alias("frequency")).where("frequency is not null")

    def wide(self, features: DataFrame, means: DataFrame | None = None) -> tuple[DataFrame, bool]:
        """The search table, and whether its rows are still in the order of the base.

        Rows of the base stay where they are; new rows follow in partitions of their own, in the same order, so
        files keep narrow ranges of frequencies.
        """
        names = list(self.base.features.values())
        kept = self.groups.outside(self.base["wide"], GROUP)
        order = [F.col("frequencyx").desc(), F.col("form")]
        kinds = dict(self.base["wide"].dtypes)
        new = lookup_join(self.rows, keep(features.select("feats", "pos", *names), "features"),
                          ["feats", "pos"], "inner")
        new = keep(new.repartitionByRange(*order).sortWithinPartitions(*order).select(
            *BASE_COLUMNS, *[F.lit(None).cast(kinds[c]).alias(c) for c in WIDE_COLUMNS], *names), "new")
        rows = kept.select(new.columns).unionByName(new)
        shares = self.shares.rows.select("lemma", "form", F.col("pos").alias("posx"),
                                         (F.lit(1) - F.col("formpct")).alias("ambform"))
        tables = [(self.hood, ["form"], ["hood"]), (_Stored(shares, "ambform"), ["lemma", "form", "posx"], ["ambform"]),
                  (_Stored(self.lemmas.rows.withColumnRenamed("pos", "posx"), "lemma_rows"), ["lemma", "posx"],
                   LEMMA_VALUES)]
        for table, on, values in tables:
            rows = _renewed(rows, table, on, values)
        form, in_order = F.col("form"), all(table.fits for table, *_ in tables) and self.groups.fits
        for name, table, gram in (("initgramfreq", "init_grams", initial_trigram), ("fingramfreq", "fin_grams", final_trigram)):
            held = self.grams[table].select("gram", F.col("frequency").alias(name))
            in_order &= fits_broadcast(held)
            rows = lookup_join(rows.drop(name).withColumn("gram", F.when(has_trigrams(form), gram(form))), held, ["gram"])
            rows = rows.withColumn(name, F.coalesce(name, F.lit(0))).drop("gram")
        if self.mean is not None:
            rows = rows.withColumn("bigramfreq", self.mean)
        else:
            in_order = False
            rows = rows.drop("bigramfreq").join(
                means.select("form", F.col("frequency").alias("bigramfreq")), "form", "left")
        return rows.select(new.columns), in_order

    def corpus_totals(self) -> DataFrame:
        """The totals of the base, changed by what the change adds and takes away."""
        def total(df: DataFrame, column: str = "frequency") -> int:
            return df.agg(F.sum(column)).first()[0] or 0

        change = {"frequency": total(self.rows) - total(self.old),
                  "lemmafreq": total(self.lemmas.rows, "lemmafreq") - total(self.old_lemmas, "lemmafreq"),
                  "initgramfreq": total(self.gram_changes["init_grams"]),
                  "fingramfreq": total(self.gram_changes["fin_grams"]),
                  "bigramfreq": total(self.gram_changes["bigrams"])}
        rows = [(name, self.base.totals[name] + step) for name, step in change.items()]
        return self.base["totals"].sparkSession.createDataFrame(rows, "name string, total long")

    def store(self, path: str) -> Lexicon:
        """Write all tables of the changed lexicon to a new folder."""
        base, spark = self.base, self.base["wide"].sparkSession
        put = lambda df, name: keep(df, path=f"{path}/{name}")
        if path.rstrip("/") == base.path.rstrip("/"):
            raise ValueError("the changed lexicon needs a folder of its own")
        begin(spark, path)
        for name, df in self.grams.items():
            put(df, name)
        forms = put(self.forms(), "forms")
        means = put(self.word_means(forms), "word_bigrams")
        put(self.all_shares, "lemmaforms")
        put(self.hit_lemmas.outside(base["lemmas"], ["lemma", "pos"]).unionByName(
            self.lemmas.rows.select(base["lemmas"].columns)), "lemmas")
        features = put(extend_features(base["features"], self.rows, base.features), "features")
        highest = base["features"].agg(F.max("featid")).first()[0] or 0
        put(base["feature_values"].unionByName(feature_values(features.where(F.col("featid") > highest))),
            "feature_values")
        wide, in_order = self.wide(features, means)
        if not in_order:
            order = [F.col("frequencyx").desc(), F.col("form")]
            wide = wide.sortWithinPartitions(*order)
        wide = put(wide, "wide")
        put(wide.select(*BASE_COLUMNS, *DERIVED_COLUMNS), "lexicon")
        put(self.corpus_totals(), "totals")
        put(base["metadata"], "metadata")
        complete(spark, path)
        return Lexicon.load(spark, path)


def _renewed(rows: DataFrame, table: _Stored, on: list[str], values: list[str]) -> DataFrame:
    """Rows with new ``values`` where the table has some."""
    new = table.rows.select(*on, *[F.col(v).alias(f"_{v}") for v in values])
    joined = rows.join(F.broadcast(new) if table.fits else new, on, "left")
    return joined.withColumns({v: F.coalesce(f"_{v}", v) for v in values}).drop(*[f"_{v}" for v in values])


def merge_into(base: Lexicon, added: DataFrame, path: str | None = None, **build_options) -> Lexicon:
    """``base`` with the word rows of ``added``, as if both had been counted and built together.

    Feature ids of the base stay (see ``extend_features``). ``build_options`` are those that ``base`` was built with:
    ``accepted_forms``, ``auto``, ``minimum``, ``transpositions``. ``added`` is a table of word rows, such as the
    ``lexicon`` of another one. The base is left as it is; the result goes to a folder of its own.
    """
    added = keep(added.select(*WORD_KEY, "frequency"), "added")
    new = keep(sum_words(added), "new_words")
    groups = _Stored(new.select(GROUP).distinct(), "groups")
    old = groups.inside(base["lexicon"], GROUP).select(*WORD_KEY, "frequency")
    rows = sum_words(old.unionByName(new.select(*WORD_KEY, "frequency")))
    spark = new.sparkSession
    return Change(base, groups.rows, rows, **build_options).store(path or new_folder(spark, "merged"))


def prune_from(base: Lexicon, path: str | None = None, min_frequency: int | None = None,
               drop_pos: Iterable[str] = (), max_length: int | None = None, **build_options) -> Lexicon:
    """``base`` without rare rows, word classes or long forms (see ``prune_words``).

    The feature table keeps entries that no row uses any more, so that ids stay.
    """
    criteria = {"min_frequency": min_frequency, "drop_pos": list(drop_pos), "max_length": max_length}
    words = base["lexicon"]
    groups = _Stored(words.where(dropped(**criteria)).select(GROUP).distinct(), "groups")
    rows = prune_words(groups.inside(words, GROUP), **criteria)
    return Change(base, groups.rows, rows, **build_options).store(
        path or new_folder(words.sparkSession, "pruned"))
