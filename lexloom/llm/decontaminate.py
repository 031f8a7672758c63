"""Benchmark decontamination by templates: questions are found with other numbers and names too."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lexloom.llm.store import Workspace, carried, table

#: Words of a template window.
WINDOW = 8
#: Words of a window that are no placeholders, at least; windows with fewer would match any list
#: of numbers, so they are looked for with their values.
LITERALS = 4
#: Items of fewer words than this stand in almost any text; they are looked for as whole sentences.
SHORTEST = 4
#: Share of an item's windows that a document must hold.
COVERAGE = 0.5
#: Windows or documents in a set that is broadcast, at most; more are shuffled.
BROADCAST_ROWS = 500_000
#: Units that become placeholders after a number, unless the caller gives others.
UNITS = ("mm", "cm", "m", "km", "inch", "inches", "feet", "miles", "mg", "g", "kg", "lb", "lbs",
         "ml", "l", "s", "sec", "seconds", "min", "minutes", "h", "hours", "days", "weeks", "years",
         "percent", "usd", "eur", "dollars", "euros", "cents", "w", "kw", "v", "hz", "mb", "gb", "mph")
NUM, UNIT, NAME = "<num>", "<unit>", "<name>"

#: Readings of a text. Capitalised words inside a sentence are names, or those that begin one
#: too, or none; last, windows with their values and short items as whole sentences.
INSIDE, ALL_NAMES, NO_NAMES, VALUES, SENTENCE = range(5)

# Numbers with their signs inside, other words, and what ends a sentence.
_WORD = r"\p{N}+(?:[.,]\p{N}+)*|[\p{L}\p{N}]+"
_TOKEN = _WORD + r"|[.!?\n]"
_END = "({0} < '0' or {0} = '?')"


def words_of(rows: DataFrame, key: str, units: Sequence[str] = UNITS) -> DataFrame:
    """``key, words, h``: each text's words as ``v`` (lower case), ``k`` (kind), ``first``; their hashes.

    Kinds are ``n`` number, ``u`` unit after a number, ``c`` capitalised and ``w`` any other word;
    ``first`` words begin the text or a sentence. A null text has no words.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    known = ", ".join("'" + u.lower().replace("\\", "\\\\").replace("'", "\\'") + "'" for u in units) or "''"
    # Plain comparisons decide about ASCII words, patterns about others.
    number = r"(({0} >= '0' and {0} < ':') or ({0} >= '{{' and {0} rlike '^\\p{{N}}'))"
    return rows.select(key, tokens.alias("tokens")).select(key, F.expr(rf"""
        filter(transform(tokens, (x, i) -> named_struct(
            'v', lower(x),
            'k', case when i > 0 and tokens[i - 1] < '{{' and tokens[i - 1] >= ':' and x >= 'a' and x < '{{' then 'w'
                when {number.format("x")} then 'n'
                when i > 0 and {number.format("tokens[i - 1]")} and lower(x) in ({known}) then 'u'
                when (x >= 'A' and x < '[') or (x >= '{{' and x rlike '^\\p{{Lu}}') then 'c'
                else 'w' end,
            'first', i = 0 or {_END.format("tokens[i - 1]")})), p -> not {_END.format("p.v")})""").alias("words")).withColumn(
        "h", F.transform("words", lambda p: F.xxhash64(p["v"])))


def _readings(rows: DataFrame) -> DataFrame:
    """Adds three readings ``r0``, ``r1``, ``r2`` of ``words`` as ``i`` (word), ``h`` (hash), ``s`` (placeholder).

    A run of capitalised words is one name. The arrays ``h`` and ``h0`` to ``h2`` hold the hashes alone,
    ``g`` each word's place if every run counts as one word, so that a longer name moves no place.
    """
    held = f"case when p.k = 'w' then h[i] when p.k = 'n' then xxhash64('{NUM}') when p.k = 'u' then xxhash64('{UNIT}')"
    for reading, name in ((INSIDE, "p.k = 'c' and not p.first"), (ALL_NAMES, "p.k = 'c'")):
        before = name.replace("p.", "words[i - 1].")
        rows = rows.withColumn(f"r{reading}", F.expr(f"""
            filter(transform(words, (p, i) -> if(p.k = 'c' and not p.first and {before}, null, named_struct('i', i,
                'h', {held} when {name} then xxhash64('{NAME}') else h[i] end,
                's', p.k in ('n', 'u') or ({name})))), p -> p is not null)"""))
    rows = rows.withColumn(f"r{NO_NAMES}", F.expr(f"""transform(words, (p, i) -> named_struct('i', i,
        'h', {held} else h[i] end, 's', p.k in ('n', 'u')))"""))
    rows = rows.withColumn("g", F.expr(f"""flatten(transform(r{ALL_NAMES}, (p, j) ->
        array_repeat(j, coalesce(get(r{ALL_NAMES}, j + 1).i, size(words)) - p.i)))"""))
    return rows.withColumns({f"h{r}": F.transform(f"r{r}", lambda p: p["h"]) for r in (INSIDE, ALL_NAMES, NO_NAMES)})


def _upto(last: str) -> str:
    """Numbers from 0 to ``last``, none if that is negative."""
    return f"if({last} >= 0, sequence(0, {last}), cast(array() as array<int>))"


def _few(width: int | str) -> str:
    """Plain words that a template window of this width needs."""
    return f"least({LITERALS}, {width} - 1)"


def _marks(words: str, first: str, width: str, plain: str) -> str:
    """What a text with a window must hold: hashes of each two plain words side by side, and of each plain word.

    ``words`` are the hashes, ``first`` the window's place in them, ``plain`` tells of a place ``m`` whether it
    holds no placeholder. Neighbours in a reading that are no placeholders are neighbours in the text.
    """
    places = lambda last: f"sequence({first}, {first} + {last})"
    pairs = (f"if({width} < 2, cast(array() as array<bigint>), transform(filter({places(f'greatest({width} - 2, 0)')},"
             f" m -> {plain} and {plain.replace('[m]', '[m + 1]')}), m -> xxhash64({words}[m], {words}[m + 1])))")
    single = f"transform(filter({places(f'{width} - 1')}, m -> {plain}), m -> xxhash64({words}[m]))"
    return f"named_struct('pairs', {pairs}, 'words', {single})"


def benchmark_windows(items: DataFrame, units: Sequence[str] = UNITS, work: Workspace | None = None) -> DataFrame:
    """``item_id, at, base, hash, width, reading, vat, marks, windows``: what is looked for of all items.

    ``at`` is the word at which a window begins, ``base`` its place with runs as one word and ``vat`` its
    place in its reading. A text shorter than a window is one window of its own width. ``windows`` counts
    the item's places. See ``_marks`` for ``marks``.
    """
    # Stored, as the optimizer would put the readings into the filters below, to be worked out anew for each word.
    work = work or Workspace(items.sparkSession, "templates")
    rows = work.keep(_readings(words_of(items, "item_id", units)), "readings")
    parts = []
    for r in (INSIDE, ALL_NAMES, NO_NAMES):
        wide = (rows.withColumn("width", F.least(F.size(f"r{r}"), F.lit(WINDOW)))
                .where(F.col("width") >= SHORTEST))
        places = F.explode(F.expr(f"""transform({_upto(f"size(r{r}) - width")}, j -> named_struct(
            'vat', j, 'at', r{r}[j].i, 'base', g[r{r}[j].i], 'template', xxhash64(slice(h{r}, j + 1, width)),
            'plain', size(filter(slice(r{r}, j + 1, width), p -> not p.s)),
            'valued', xxhash64('values', slice(h, j + 1, width)),
            'marks', {_marks(f"h{r}", "j", "width", f"not r{r}[m].s")},
            'valued_marks', {_marks("h", "j", "width", "h[m] is not null")}))""")).alias("w")
        wide = wide.select("item_id", "width", places).withColumn("enough", F.expr(f"w.plain >= {_few('width')}"))
        if r == NO_NAMES:
            parts.append(wide.select("item_id", "width", "w.at", "w.base", "w.vat", F.when(
                F.col("enough"), F.col("w.template")).otherwise(F.col("w.valued")).alias("hash"), F.when(
                F.col("enough"), F.lit(r)).otherwise(F.lit(VALUES)).alias("reading"), F.when(
                F.col("enough"), F.col("w.marks")).otherwise(F.col("w.valued_marks")).alias("marks")))
        else:
            parts.append(wide.where("enough").select(
                "item_id", "width", "w.at", "w.base", "w.vat", F.col("w.template").alias("hash"), F.lit(r).alias("reading"),
                "w.marks"))
    parts.append(rows.where(F.size("words").between(1, SHORTEST - 1)).select(
        "item_id", F.size("words").alias("width"), F.lit(0).alias("at"), F.lit(0).alias("base"), F.lit(0).alias("vat"),
        F.xxhash64(F.lit("sentence"), "h").alias("hash"), F.lit(SENTENCE).alias("reading"),
        F.expr(_marks("h", "0", "size(words)", "h[m] is not null")).alias("marks")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    # Readings agree where a window has no capitalised word.
    once = every.groupBy("item_id", "at", "hash", "width").agg(
        F.min(F.struct("reading", "vat", "base", "marks")).alias("r")).select("item_id", "at", "hash", "width", "r.*")
    counts = once.groupBy("item_id").agg(F.count_distinct("at").alias("windows"))
    return once.join(counts, "item_id")


def _holders(texts: DataFrame, bench: DataFrame, coverage: float, small: bool, work: Workspace) -> DataFrame:
    """``node``: the texts that may hold ``coverage`` of an item's places, and all that do.

    A window cannot match where one of its marks is missing, so of each window the mark that the fewest items
    have is looked for. That takes one cheap pass over the words, without kinds and readings; only texts
    that have the marks of enough places are read in full.
    """
    pairs = F.size("marks.pairs") > 0
    every = bench.select("item_id", "at", "hash", "width", "windows", pairs.alias("pairs"), F.explode(
        F.when(pairs, F.col("marks.pairs")).otherwise(F.col("marks.words"))).alias("mark"))
    spread = every.groupBy("mark").agg(F.count_distinct("item_id").alias("items"))
    marks = (every.join(spread, "mark").groupBy("item_id", "at", "hash", "width", "windows", "pairs")
             .agg(F.min(F.struct("items", "mark")).alias("rarest"))
             .select("item_id", "at", "windows", "pairs", "rarest.mark").distinct())
    marks = work.keep(marks, "marks")
    # Two values at most.
    kinds = {r.pairs for r in marks.select("pairs").distinct().collect()}
    sent = F.broadcast if small else (lambda df: df)
    words = F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(_WORD), F.lit(0))
    rows = texts.select("node", F.transform(words, lambda v: F.xxhash64(F.lower(v))).alias("h"))
    here = F.expr("transform(h, (x, i) -> xxhash64(x, get(h, i + 1)))")
    if False in kinds:
        here = F.concat(here, F.expr("transform(h, x -> xxhash64(x))"))
    # With explode() the optimizer would work the marks out twice, to leave out texts without any.
    there = rows.select("node", here.alias("marks")).select("node", F.explode_outer("marks").alias("mark"))
    there = work.keep(there.join(sent(marks.select("mark").distinct()), "mark").distinct(), "marked")
    return (there.join(sent(marks), "mark").groupBy("node", "item_id", "windows").agg(F.count_distinct("at").alias("at"))
            .where(F.col("at") >= coverage * F.col("windows")).select("node").distinct())


def _document_windows(rows: DataFrame, key: str, widths: Sequence[int], short: Sequence[int]) -> DataFrame:
    """``key, reading, vpos, pos, hash``: all windows of documents, those that read alike once.

    ``pos`` is the place of the first word with runs as one word.

    Windows in which every name stands inside a sentence come first. Only windows with a
    capitalised beginning of a sentence read differently with all names, only those with a name
    inside without any, and only those crowded with numbers need their values.
    """
    rows = _readings(rows).withColumns({
        "firsts": F.expr(f"filter({_upto(f'size(r{ALL_NAMES}) - 1')}, j -> words[r{ALL_NAMES}[j].i].first"
                         f" and words[r{ALL_NAMES}[j].i].k = 'c')"),
        "names": F.expr(f"filter({_upto('size(words) - 1')}, i -> words[i].k = 'c' and not words[i].first)"),
        "numbers": F.expr(f"filter({_upto('size(words) - 1')}, i -> words[i].k in ('n', 'u'))")})

    def around(places: str, size: str, width: int) -> str:
        """Starts of the windows that hold one of the places."""
        return (f"if({size} >= {width}, array_distinct(flatten(transform({places}, c -> "
                f"sequence(greatest(0, c - {width - 1}), least(c, {size} - {width}))))), cast(array() as array<int>))")

    def windows(reading: int, starts: str, hashed: str, word: str = "j") -> str:
        return (f"transform({starts}, j -> named_struct('reading', {reading}, 'vpos', j, 'pos', g[{word}],"
                f" 'hash', {hashed}))")

    found = []
    for w in widths:
        for r, starts in ((INSIDE, _upto(f"size(r{INSIDE}) - {w}")),
                          (ALL_NAMES, around("firsts", f"size(r{ALL_NAMES})", w)),
                          (NO_NAMES, around("names", "size(words)", w))):
            found.append(windows(r, starts, f"xxhash64(slice(h{r}, j + 1, {w}))", f"r{r}[j].i"))
        many = w - min(LITERALS, w - 1) + 1  # this many numbers leave too few plain words
        if many <= w:
            crowded = f"""filter({_upto(f"size(numbers) - {many}")}, m -> numbers[m + {many - 1}] - numbers[m] < {w})"""
            starts = (f"if(size(words) >= {w}, array_distinct(flatten(transform({crowded}, m -> sequence("
                      f"greatest(0, numbers[m + {many - 1}] - {w - 1}), least(numbers[m], size(words) - {w}))))),"
                      " cast(array() as array<int>))")
            found.append(windows(VALUES, starts, f"xxhash64('values', slice(h, j + 1, {w}))"))
    for w in short:
        whole = f"""filter({_upto(f"size(words) - {w}")}, i -> words[i].first
            and (i + {w} = size(words) or words[i + {w}].first))"""
        found.append(windows(SENTENCE, whole, f"xxhash64('sentence', slice(h, j + 1, {w}))"))
    # With explode() the optimizer would work all windows out twice, to leave out texts without any.
    return (rows.select(key, F.explode_outer(F.expr(f"concat({', '.join(found)})")).alias("w"))
            .where("w is not null").select(key, "w.*"))


def _among(texts: DataFrame, nodes: DataFrame, work: Workspace) -> DataFrame:
    """The rows of these texts; the set of nodes is broadcast only if it is small."""
    nodes = work.keep(nodes, "nodes")
    few = nodes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return texts.join(F.broadcast(nodes) if few else nodes, "node", "left_semi")


def contaminated(docs: DataFrame, items: DataFrame, work: Workspace | None = None,
                 coverage: float = COVERAGE, units: Sequence[str] = UNITS) -> DataFrame:
    """``doc_id, item_id, covered, windows, same_slots, slots, kind``: documents with an item in them.

    ``docs`` has ``doc_id, text``, ``items`` has ``item_id, text``. Both become templates: numbers,
    ``units`` after numbers and runs of capitalised words are placeholders. Each text is read in three
    ways, as a capitalised word may be a name or begin a sentence: with names inside sentences only,
    with all capitalised words as names, and without names (which finds other spellings in capitals).
    Only texts that have the rarest neighbouring words of enough windows of an item are read so (see ``_holders``).
    The windows of documents meet those of the benchmark in a hash join, and a document that holds at
    least ``coverage`` of the places of an item's windows is a candidate. Then the slots are checked:
    each value that the item has in its placeholders must have one value throughout one
    occurrence that itself holds ``coverage`` of the windows. If each window found holds with the item's
    own values, ``kind`` is ``verbatim``, else ``changed``;
    candidates that fill a slot in two ways in each occurrence are no copies of the question and are left out
    (unless at least ``coverage`` of the windows hold with the item's own values).

    A window with too few plain words beside its numbers (``LITERALS``) is looked for with its values, so items
    of numbers are found word for word only. An item of fewer than ``SHORTEST`` words is
    found where it is a whole sentence, line or text.

    Null and empty texts hold nothing, and null or empty items are not looked for.
    Rows with a null ``doc_id`` are reported with it; repeated rows and copies are reported one by
    one. Items that repeat an ``item_id`` count as one item. Empty tables give an empty result.
    Other columns are not read.
    """
    work = work or Workspace(docs.sparkSession, "templates")
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("node", F.unhex(F.sha2("text", 256)))
    bench = work.keep(benchmark_windows(items.select("item_id", "text"), units, work), "benchmark")
    # At most WINDOW numbers.
    sizes = bench.select("width", (F.col("reading") == SENTENCE).alias("short")).distinct().collect()
    widths = sorted(r.width for r in sizes if not r.short) or [WINDOW]
    small = bench.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    held = _among(texts, _holders(texts, bench, coverage, small, work), work).dropDuplicates(["node"])
    exploded = _document_windows(words_of(held, "node", units), "node", widths,
                                 sorted(r.width for r in sizes if r.short))
    wanted = bench.select("hash", "item_id", "at", "base", "windows", F.col("reading").alias("item_reading"), "vat", "width")
    hits = exploded.join(F.broadcast(wanted) if small else wanted, "hash")
    # Copies of a text give the same hits; they are counted once, before the shuffle as well.
    hits = work.keep(hits.distinct(), "hits")
    found = (hits.groupBy("node", "item_id", "windows").agg(F.count_distinct("at").alias("covered"))
             .where(F.col("covered") >= coverage * F.col("windows")))
    found = work.keep(found, "candidates")
    chosen = _among(texts, found.select("node").distinct(), work)

    # Slots: what stands at the same place of matched windows on both sides.
    doc_slots = _slots(words_of(chosen.dropDuplicates(["node"]), "node", units), "node").select(
        "node", "reading", F.col("place").alias("vpos"), "kind", F.col("value").alias("doc_value"))
    item_slots = _slots(words_of(items.select("item_id", "text"), "item_id", units), "item_id").select(
        "item_id", F.col("reading").alias("item_reading"), F.col("place").alias("vat"), "kind",
        F.col("value").alias("item_value")).distinct()
    hit = F.struct("reading", "vpos", "item_reading", "vat").alias("hit")
    places = (hits.join(found.select("node", "item_id"), ["node", "item_id"])
              .select("node", "item_id", "reading", "item_reading", "pos", "base", hit, "vpos", "vat",
                      F.explode(F.expr("sequence(0, width - 1)")).alias("step"))
              .withColumns({"vpos": F.col("vpos") + F.col("step"), "vat": F.col("vat") + F.col("step")}))
    filled = work.keep(places.join(doc_slots, ["node", "reading", "vpos"]).join(
        item_slots, ["item_id", "item_reading", "vat", "kind"]), "slots")
    # A document may hold an item more than once, each time filled in its own way. So slots are
    # judged per occurrence: one alignment of the two texts, a run of neighbouring alignments
    # (a copy with words put in or left out), or the whole document.
    mine = hits.join(found.select("node", "item_id"), ["node", "item_id"]).select(
        "node", "item_id", "at", hit, (F.col("pos") - F.col("base")).alias("shift"))
    in_order = Window.partitionBy("node", "item_id").orderBy("shift")
    shifts = (mine.select("node", "item_id", "shift").distinct()
              .withColumn("new", F.coalesce(F.col("shift") - F.lag("shift").over(in_order) > WINDOW, F.lit(True)))
              .withColumn("run", F.sum(F.col("new").cast("int")).over(in_order)))
    seen = shifts.select("node", "item_id", "shift", F.explode(F.array(
        F.struct(F.lit(0).alias("level"), F.lit(0).cast("long").alias("part")),
        F.struct(F.lit(1).alias("level"), F.col("run").cast("long").alias("part")),
        F.struct(F.lit(2).alias("level"), F.col("shift").cast("long").alias("part")))).alias("place"))
    seen = work.keep(seen, "occurrences")
    key = ["node", "item_id", "place"]
    placed = filled.withColumn("shift", F.col("pos") - F.col("base")).join(seen, ["node", "item_id", "shift"])
    per_value = placed.groupBy(*key, "kind", "item_value").agg(
        F.count_distinct("doc_value").alias("ways"),
        F.min((F.col("doc_value") == F.col("item_value")).cast("int")).alias("same"))
    slots = per_value.groupBy(*key).agg(
        F.count("*").alias("slots"), F.sum("same").alias("same_slots"), F.max("ways").alias("ways"))
    # Windows that hold with the item's own values, for texts that also hold other fillings.
    foreign = filled.where("doc_value != item_value").select("node", "item_id", "hit").distinct().withColumn(
        "foreign", F.lit(True))
    totals = (mine.join(foreign, ["node", "item_id", "hit"], "left").join(seen, ["node", "item_id", "shift"])
              .groupBy(*key).agg(
                  F.count_distinct("at").alias("here"),
                  F.count_distinct(F.when(F.col("foreign").isNull(), F.col("at"))).alias("own")))
    judged = (found.join(totals, ["node", "item_id"]).join(slots, key, "left")
              .na.fill(0, ["slots", "same_slots"]).na.fill(1, ["ways"])
              .where(F.col("here") >= coverage * F.col("windows")))
    # A place may match in two readings, one of which takes more words for a name.
    verbatim = F.col("own") == F.col("here")
    judged = judged.where(verbatim | (F.col("ways") == 1) | (F.col("own") >= coverage * F.col("windows"))).withColumn(
        "kind", F.when(verbatim, "verbatim").otherwise("changed"))
    # One row for a text and an item: verbatim before changed, the widest occurrence first.
    judged = judged.groupBy("node", "item_id").agg(F.max_by(
        F.struct("covered", "windows", "same_slots", "slots", "kind"),
        F.struct(F.col("kind") == "verbatim", -F.col("place.level"), "here", "place.part")).alias("best"))
    judged = work.keep(judged.select("node", "item_id", "best.*"), "judged")
    ids = work.keep(chosen.select("doc_id", "node"), "ids")
    return ids.join(judged, "node").select("doc_id", "item_id", "covered", "windows",
                                           "same_slots", "slots", "kind")


def _slots(rows: DataFrame, key: str) -> DataFrame:
    """``key, reading, place, kind, value`` of each placeholder in the three readings."""
    rows = _readings(rows).withColumn("v", F.transform("words", lambda p: p["v"]))
    for r in (INSIDE, ALL_NAMES, NO_NAMES):
        spans = F.expr(f"""transform(r{r}, (p, j) -> named_struct('s', p.s, 'kind', words[p.i].k, 'value',
            array_join(slice(v, p.i + 1, coalesce(get(r{r}, j + 1).i, size(words)) - p.i), ' ')))""")
        part = rows.select(key, F.lit(r).alias("reading"), F.posexplode(spans).alias("place", "p")).where(
            "p.s").select(key, "reading", "place", "p.kind", "p.value")
        every = part if r == INSIDE else every.unionByName(part)
    return every


def drop_contaminated(docs: DataFrame, items: DataFrame, work: Workspace | None = None,
                      units: Sequence[str] = UNITS) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item; same columns.

    Rows go by their text, so rows with a null or repeated id are judged by what they say.
    """
    work = work or Workspace(docs.sparkSession, "clean")
    there, back = carried(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    node = F.unhex(F.sha2(text, 256))  # rows are dropped by it, so 64 bits would be too few
    keyed = docs.select(*there, node.alias("__node"))
    found = contaminated(docs.select(node.alias("doc_id"), "text"), items, work, units=units)
    bad = work.keep(found.select(F.col("doc_id").alias("__node")).distinct(), "bad")
    few = bad.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return keyed.join(F.broadcast(bad) if few else bad, "__node", "left_anti").select(*back)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in all documents."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
