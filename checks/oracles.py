"""The same results in SQL, for DuckDB over the same tables."""

from __future__ import annotations

from checks import queries as q
from checks.fixture import AUTO, MINIMUM, PER_FILE, PER_LIST

# Fixed values, written out so that a mistake in the library's own cannot hide here.
LETTERS = "abcdefghijklmnopqrstuvwxyzåäöüáàãâéèêíìïóòôõúñç"
FEATURES_FI = {'Case': 'nouncase',
 'Number': 'nnumber',
 'Mood': 'mood',
 'Tense': 'tense',
 'Voice': 'voice',
 'Person': 'person',
 'VerbForm': 'verbform',
 'Clitic': 'clitic',
 'Derivation': 'derivation',
 'Person[psor]': 'posspers',
 'Number[psor]': 'possnum'}
FEATURES_SV = {'Case': 'nouncase',
 'Number': 'nnumber',
 'Gender': 'gender',
 'Definite': 'definite',
 'Mood': 'mood',
 'Tense': 'tense',
 'Voice': 'voice',
 'Person': 'person',
 'VerbForm': 'verbform'}


def features_for(langcode: str) -> dict[str, str]:
    return FEATURES_SV if langcode == "sv" else FEATURES_FI


VALID = (f"regexp_matches({{0}}, '^[{LETTERS}0-9][''.:\\-_#{LETTERS}0-9]*[{LETTERS}0-9\\-.'']$') "
         f"AND regexp_matches({{0}}, '[{LETTERS}]')")

PIECES = """pieces AS (
  SELECT doc_id, source AS file, unnest(regexp_split_to_array(text, '[ \\n\\t]+')) AS piece,
         generate_subscripts(regexp_split_to_array(text, '[ \\n\\t]+'), 1) AS token_id
  FROM documents),
stripped AS (
  SELECT doc_id, file, token_id, regexp_replace(piece, '[,.;:!?]+$', '') AS word FROM pieces)"""


def annotated(form: str = "lower(word)") -> str:
    """All tokens with lemma, upos and feats."""
    return f"""{PIECES},
classed AS (
  SELECT doc_id, file, token_id, form,
    CASE WHEN regexp_matches(form, '(ed|ing|er|en)$')
           THEN CASE WHEN doc_id % 2 = 0 THEN 'AUX' ELSE 'VERB' END
         WHEN length(form) <= 3 THEN CASE WHEN doc_id % 3 = 0 THEN 'PRON' ELSE 'ADP' END
         WHEN doc_id % 5 = 0 THEN 'ADJ' ELSE 'NOUN' END AS upos,
    CASE WHEN length(form) % 2 = 1 THEN 'Plur' ELSE 'Sing' END AS num
  FROM (SELECT doc_id, file, token_id, {form} AS form FROM stripped)),
annotated AS MATERIALIZED (
  SELECT doc_id, file, token_id, form, upos,
    CASE WHEN doc_id % 4 = 0 AND length(form) >= 6 THEN substr(form, 1, 3) || '#' || substr(form, 4)
         WHEN length(form) > 4 AND doc_id % 3 = 0 THEN substr(form, 1, length(form) - 2)
         WHEN length(form) > 4 AND doc_id % 3 = 1 THEN substr(form, 1, length(form) - 1)
         ELSE form END AS lemma,
    CASE WHEN upos IN ('VERB', 'AUX')
           THEN 'Mood=Ind|Number=' || num || '|Person=' || (1 + doc_id % 3)
                || '|Polarity=Pos|Tense=Past|VerbForm=Fin|Voice=Act'
         WHEN upos IN ('NOUN', 'ADJ')
           THEN 'Case=' || CASE doc_id % 4 WHEN 0 THEN 'Nom' WHEN 1 THEN 'Gen' WHEN 2 THEN 'Par' ELSE 'Ine' END
                || CASE doc_id % 6 WHEN 0 THEN '|Clitic=Han,Kin' WHEN 1 THEN '|Clitic=Kin' ELSE '' END
                || CASE WHEN upos = 'ADJ' THEN '|Degree=Pos' ELSE '' END
                || CASE WHEN doc_id % 8 = 2 THEN '|Derivation=Inen,Vs' ELSE '' END
                || '|Number=' || num
                || CASE WHEN doc_id % 9 = 3 THEN '|Number[psor]=Sing|Person[psor]=1' ELSE '' END
         ELSE '_' END AS feats
  FROM classed)"""


def tokens(form: str = "lower(word)") -> str:
    return annotated(form) + f""",
tokens AS (SELECT * FROM annotated WHERE {VALID.format('lower(form)')})"""


def core(feats: str = "feats", langcode: str = "fi") -> str:
    """Core features of a FEATS string, sorted by name."""
    names = ", ".join(f"'{name}'" for name in features_for(langcode))
    return (f"coalesce(nullif(array_to_string(list_sort(list_filter(string_split({feats}, '|'), "
            f"lambda p: split_part(p, '=', 1) IN ({names}))), '|'), ''), '_')")


def feature(name: str, feats: str = "feats") -> str:
    pattern = name.replace("[", "\\[").replace("]", "\\]")
    return f"coalesce(nullif(regexp_extract({feats}, '(?:^|\\|){pattern}=([^|]*)', 1), ''), '_')"


def words(form: str = "lower(word)", langcode: str = "fi", where: str = "true") -> str:
    """Word rows with lemma, form, pos, posx, feats, len, frequency, frequencyx."""
    return tokens(form) + f""",
counted AS (
  SELECT lemma, form, upos AS pos, {core('feats', langcode)} AS feats, count(*) AS frequency
  FROM tokens WHERE {VALID.format('lower(lemma)')} GROUP BY ALL),
words AS MATERIALIZED (
  SELECT lemma, form, pos, CASE WHEN pos = 'AUX' THEN 'VERB' ELSE pos END AS posx, feats,
    CAST(length(form) AS INTEGER) AS len, frequency,
    CAST(sum(frequency) OVER (PARTITION BY lemma, form, CASE WHEN pos = 'AUX' THEN 'VERB' ELSE pos END, feats)
         AS BIGINT) AS frequencyx
  FROM counted WHERE {where})"""


AGGREGATES = """,
lf AS (SELECT lemma, form, posx AS pos, CAST(sum(frequency) AS BIGINT) AS frequency
       FROM words GROUP BY lemma, form, posx),
lemmaforms AS MATERIALIZED (
  SELECT lemma, form, pos, frequency, formsum, frequency / formsum AS formpct
  FROM (SELECT *, CAST(sum(frequency) OVER (PARTITION BY form) AS BIGINT) AS formsum FROM lf)),
forms AS MATERIALIZED (
  SELECT form, CAST(sum(frequency) AS BIGINT) AS frequency, count(*) AS numforms FROM lf GROUP BY form),
clear AS (
  SELECT x.lemma, x.pos, sum(x.frequency) AS clear
  FROM lemmaforms x JOIN forms f ON x.form = f.form
  WHERE f.numforms = 1 OR x.formpct > CAST(0.99 AS DOUBLE) GROUP BY x.lemma, x.pos),
lemmasums AS (SELECT lemma, pos, CAST(sum(frequency) AS BIGINT) AS lemmafreq FROM lf GROUP BY lemma, pos),
lemmas AS MATERIALIZED (
  SELECT lemma, replace(lemma, '#', '') AS lemmac, pos, lemmafreq,
    CAST(length(replace(lemma, '#', '')) AS INTEGER) AS lemmalen,
    CAST(length(lemma) - length(replace(lemma, '#', '')) AS INTEGER) AS comparts,
    coalesce(CAST(lemmafreq - clear AS DOUBLE) / CAST(lemmafreq AS DOUBLE), CAST(1 AS DOUBLE)) AS amblemma
  FROM lemmasums LEFT JOIN clear USING (lemma, pos))"""

GRAMS = """,
init AS (SELECT substr(form, 1, 3) AS gram, CAST(sum(frequency) AS BIGINT) AS frequency
         FROM forms WHERE length(form) >= 4 GROUP BY 1),
fin AS (SELECT right(form, 3) AS gram, CAST(sum(frequency) AS BIGINT) AS frequency
        FROM forms WHERE length(form) >= 4 GROUP BY 1),
pairs AS (SELECT form, frequency, substr(form, CAST(i AS BIGINT), 2) AS gram
          FROM (SELECT form, frequency, unnest(range(1, length(form))) AS i FROM forms)),
bi AS (SELECT gram, CAST(sum(frequency) AS BIGINT) AS frequency FROM pairs GROUP BY gram),
wordbi AS (SELECT p.form, CAST(floor(sum(bi.frequency) / count(*)) AS BIGINT) AS frequency
           FROM pairs p JOIN bi ON p.gram = bi.gram GROUP BY p.form)"""


def hood(listed: bool = True, swaps: bool = False) -> str:
    """``flagged`` forms and their ``hood``."""
    known = (", known AS MATERIALIZED (SELECT DISTINCT form FROM tokens WHERE doc_id % 2 = 0)" if listed
             else ", known AS (SELECT NULL AS form WHERE false)")
    swapped = f"""
  UNION ALL
  SELECT DISTINCT a.form, a.key AS other FROM (
    SELECT form, substr(form, 1, CAST(i AS BIGINT) - 1) || substr(form, CAST(i AS BIGINT) + 1, 1)
           || substr(form, CAST(i AS BIGINT), 1) || substr(form, CAST(i AS BIGINT) + 2) AS key
    FROM (SELECT form, unnest(range(1, length(form))) AS i FROM flagged)) a
  JOIN flagged b ON a.key = b.form AND b.accepted WHERE a.key <> a.form""" if swaps else ""
    return known + f""",
flagged AS MATERIALIZED (
  SELECT f.form, f.frequency,
    f.frequency >= {AUTO} OR (f.frequency >= {MINIMUM} AND k.form IS NOT NULL) AS accepted
  FROM forms f LEFT JOIN known k ON f.form = k.form),
patterns AS MATERIALIZED (
  SELECT form, accepted, substr(form, 1, CAST(i AS BIGINT) - 1) || '*' || substr(form, CAST(i AS BIGINT) + 1) AS key
  FROM (SELECT form, accepted, unnest(range(1, length(form) + 1)) AS i FROM flagged)),
samelength AS MATERIALIZED (
  SELECT a.form, b.form AS other FROM patterns a JOIN patterns b ON a.key = b.key AND b.accepted
  WHERE a.form <> b.form{swapped}),
hood AS (SELECT f.form, count(s.other) AS hood FROM flagged f LEFT JOIN samelength s ON f.form = s.form
         GROUP BY f.form)"""


OTHER_LENGTH = """,
dropped AS MATERIALIZED (
  SELECT DISTINCT form, accepted, substr(form, 1, CAST(i AS BIGINT) - 1) || substr(form, CAST(i AS BIGINT) + 1) AS key
  FROM (SELECT form, accepted, unnest(range(1, length(form) + 1)) AS i FROM flagged)),
edit1 AS MATERIALIZED (
  SELECT form, other FROM samelength
  UNION ALL SELECT d.form, b.form AS other FROM dropped d JOIN flagged b ON d.key = b.form AND b.accepted
  UNION ALL SELECT b.form, d.form AS other FROM dropped d JOIN flagged b ON d.key = b.form WHERE d.accepted)"""

FI = features_for("fi")
FEATURES = ", ".join(f"{feature(name)} AS {column}" for name, column in FI.items())


def wide(where: str = "true") -> str:
    return words(where=where) + AGGREGATES + GRAMS + hood() + f""",
wide AS MATERIALIZED (
  SELECT w.lemma, w.form, w.pos, w.posx, w.feats, w.len, w.frequency, w.frequencyx,
    h.hood, 1 - lf.formpct AS ambform,
    l.lemmac, l.lemmafreq, l.lemmalen, l.comparts, l.amblemma, b.frequency AS bigramfreq,
    CASE WHEN length(w.form) > 3 THEN i.frequency ELSE 0 END AS initgramfreq,
    CASE WHEN length(w.form) > 3 THEN e.frequency ELSE 0 END AS fingramfreq,
    {FEATURES.replace('(feats', '(w.feats')}
  FROM words w
  JOIN lemmaforms lf ON w.lemma = lf.lemma AND w.form = lf.form AND w.posx = lf.pos
  JOIN lemmas l ON w.lemma = l.lemma AND w.posx = l.pos
  JOIN hood h ON w.form = h.form
  LEFT JOIN init i ON i.gram = substr(w.form, 1, 3)
  LEFT JOIN fin e ON e.gram = right(w.form, 3)
  LEFT JOIN wordbi b ON b.form = w.form),
totals AS (
  SELECT (SELECT sum(frequency) FROM words)::BIGINT AS frequency,
    (SELECT sum(lemmafreq) FROM lemmas)::BIGINT AS lemmafreq,
    (SELECT sum(frequency) FROM init)::BIGINT AS initgramfreq,
    (SELECT sum(frequency) FROM fin)::BIGINT AS fingramfreq,
    (SELECT sum(frequency) FROM bi)::BIGINT AS bigramfreq)"""


SHOWN = {"nouncase": '"case"', "nnumber": '"number"'}
FEATURE_LIST = ", ".join(f"{c} AS {SHOWN.get(c, c)}" for c in FI.values())


def result(raw: bool = False, lemmas: bool = True, grams: bool = True) -> str:
    pos, freq = ("pos", "frequency") if raw else ("posx", "frequencyx")
    return ("lemma, " + ("lemmalen, lemmafreq, amblemma, " if lemmas else "")
            + f"form, {pos} AS pos, len, hood, ambform, {freq} AS frequency, "
            + ("bigramfreq, initgramfreq, fingramfreq, " if grams else "")
            + f"feats, {FEATURE_LIST}")


def matches(where: str, raw: bool = False, **shown: bool) -> str:
    distinct = "" if raw else "DISTINCT "
    return f"SELECT {distinct}{result(raw, **shown)} FROM wide, totals t WHERE {where}".replace(
        "FROM wide, totals t", "FROM wide w CROSS JOIN (SELECT frequency AS tf, lemmafreq AS tl, "
        "initgramfreq AS ti, fingramfreq AS te, bigramfreq AS tb FROM totals) t")


KEY = "lemma, form, pos, feats"
LISTED = """,
formlist AS (SELECT form AS item, CAST(row_number() OVER (ORDER BY frequency DESC, form) AS INTEGER) AS position
             FROM forms),
lemmalist AS (
  SELECT lemmac AS item, CAST(row_number() OVER (ORDER BY frequency DESC, lemmac) AS INTEGER) AS position
  FROM (SELECT replace(lemma, '#', '') AS lemmac, sum(frequency) AS frequency FROM words GROUP BY 1))"""

BY_FREQUENCY = f"ORDER BY frequency DESC, {KEY}"


def _per_million(value: str, total: str) -> str:
    return f"{value} / {total} * CAST(1000000 AS DOUBLE)"


def _listed_grams(grams: list[str], test: str) -> str:
    return ", ".join(f"CASE WHEN {test.format(g)} THEN frequency ELSE 0 END AS \"{g}\"" for g in grams)


def _pruned(where: str) -> str:
    return "WITH " + words(where=where) + AGGREGATES + """
SELECT w.lemma, w.form, w.pos, w.feats, w.frequency, w.frequencyx, 1 - lf.formpct AS ambform
FROM words w JOIN lemmaforms lf ON w.lemma = lf.lemma AND w.form = lf.form AND w.posx = lf.pos"""


def _cells(name: str, key: str, columns: str, source: str, doubles: str = "") -> str:
    """A table in long form; doubles in billionths."""
    parts = []
    for column in columns.split():
        value = f"CAST(round({column} * 1e9) AS BIGINT)" if column in doubles.split() else f'"{column}"'
        parts.append(f"SELECT '{name}' AS name, concat_ws('|', {key}) AS \"key\", '{column}' AS \"column\", "
                     f"CAST({value} AS VARCHAR) AS value FROM {source}")
    return " UNION ALL ".join(parts)


IDS = f""",
ids AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY feats, pos) AS featid
  FROM (SELECT DISTINCT feats, pos, {FEATURES} FROM words)),
single AS MATERIALIZED (
  SELECT featid, feature, unnest(string_split(joined, ',')) AS value FROM (
    SELECT featid, 'derivation' AS feature, derivation AS joined FROM ids
    UNION ALL SELECT featid, 'clitic', clitic FROM ids
    UNION ALL SELECT featid, 'nouncase', nouncase FROM ids) WHERE joined <> '_'),
named AS MATERIALIZED (SELECT name, total FROM (UNPIVOT totals ON COLUMNS(*) INTO NAME name VALUE total)),
meta AS (SELECT * FROM (VALUES ('language', 'Finnish'), ('langcode', 'fi')) t("key", value))"""

CELLS = [
    _cells("lexicon", "lemma, form, pos, feats",
           "lemma form pos posx feats len frequency frequencyx hood ambform", "wide", "ambform"),
    _cells("features", "feats, pos", "featid feats pos " + " ".join(FI.values()), "ids"),
    _cells("feature_values", "featid, feature, value", "featid feature value", "single"),
    _cells("lemmaforms", "lemma, form, pos", "lemma form pos frequency formsum formpct", "lemmaforms", "formpct"),
    _cells("forms", "form", "form frequency numforms hood", "(SELECT f.*, h.hood FROM forms f JOIN hood h USING (form))"),
    _cells("lemmas", "lemma, pos", "lemma lemmac pos lemmafreq lemmalen comparts amblemma", "lemmas", "amblemma"),
    _cells("init_grams", "gram", "gram frequency", "init"),
    _cells("fin_grams", "gram", "gram frequency", "fin"),
    _cells("bigrams", "gram", "gram frequency", "bi"),
    _cells("word_bigrams", "form", "form frequency", "wordbi"),
    _cells("totals", "name", "name total", "(SELECT name, total FROM named)"),
    _cells("metadata", '"key"', "key value", "meta"),
]
TABLE_CELLS = " UNION ALL ".join(CELLS)
# Without the tables that name feature ids.
UNNUMBERED_CELLS = " UNION ALL ".join(c for c in CELLS if "'feature" not in c)



def combined(where: str) -> str:
    """The combined table: per million and ambiguity with three decimals."""
    return f"""SELECT DISTINCT lemma, m.lemmafreq,
  round(m.lemmafreq * CAST(1e9 AS DOUBLE) / t.lemmafreq) / CAST(1000 AS DOUBLE) AS rellemmafreq, lemmalen,
  round(1000 * amblemma) / CAST(1000 AS DOUBLE) AS amblemma, form, pos, len, hood,
  round(1000 * ambform) / CAST(1000 AS DOUBLE) AS ambform, m.frequency,
  round(m.frequency * CAST(1e9 AS DOUBLE) / t.frequency) / CAST(1000 AS DOUBLE) AS relfrequency, feats,
  m.* EXCLUDE (lemma, lemmafreq, lemmalen, amblemma, form, pos, len, hood, ambform, frequency, feats)
FROM ({matches(where)}) m, totals t"""


COMBINED_COLUMNS = ["lemma", "lemmafreq", "rellemmafreq", "lemmalen", "amblemma", "form", "pos", "len", "hood", "ambform",
                    "frequency", "relfrequency", "feats", *(SHOWN.get(c, c) for c in FI.values()),
                    "initgramfreq", "fingramfreq", "bigramfreq"]
COMBINED_CELLS = ", ".join(
    f"CAST(CAST(round({c} * 1e9) AS BIGINT) AS VARCHAR)" if c in ("rellemmafreq", "amblemma", "ambform", "relfrequency")
    else f"CAST({c} AS VARCHAR)" for c in COMBINED_COLUMNS)

CORE_WORDS = ["lemma", "form", "pos", "feats", "frequency"]
TOKEN_ROWS = (f"SELECT CAST(doc_id // {PER_FILE} AS INTEGER) AS part, doc_id % {PER_FILE} + 1 AS sent_id, "
              "CAST(token_id AS INTEGER) AS token_id, form, lemma, upos, feats FROM annotated")


def oracle_sql() -> dict[str, str]:
    word_rows = "WITH " + words()
    derived = "WITH " + words() + AGGREGATES
    gram_rows = derived + GRAMS
    everything = "WITH " + wide()
    return {
        "conllu_tokens": f"WITH {annotated()} {TOKEN_ROWS}",
        "conllu_tokens_capped":
            f"WITH {annotated()} SELECT * FROM ({TOKEN_ROWS}) WHERE sent_id <= {q.SENTENCE_CAP}",
        "conllu_dir": "WITH " + words().replace(
            "FROM documents", f"FROM documents WHERE doc_id < {q.FILE_CAP * PER_FILE}")
            + " SELECT lemma, form, pos, feats, frequency FROM words",
        "conllu_lexicon": f"{word_rows} SELECT * FROM words",
        "vrt_tokens": f"WITH {annotated()} {TOKEN_ROWS}",
        "vrt_lexicon": f"{word_rows} SELECT * FROM words",
        "wordlist_scan": derived + LISTED + f"""
SELECT 'form' AS type, item, CAST((position - 1) % {PER_LIST} + 1 AS INTEGER) AS position FROM formlist""",
        "lexicon_roundtrip": f"{word_rows} SELECT * FROM words",
        "valid_words": f"WITH {tokens()} SELECT form, count(*) AS tokens FROM tokens GROUP BY form",
        "rejected_tokens": f"""WITH {annotated()}
SELECT file, doc_id AS sent_id, form, lemma FROM annotated
WHERE NOT ({VALID.format('form')} AND {VALID.format('lemma')}) AND length(form) > 1 AND length(lemma) > 1""",
        "lexicon_origcase": "WITH " + words(form="word")
            + " SELECT lemma, form, pos, feats, frequency FROM words",
        "core_feats": f"""WITH {tokens()}
SELECT feats, {core()} AS core, tokens
FROM (SELECT feats, count(*) AS tokens FROM tokens GROUP BY feats)""",
        "lexicon_build": f"{word_rows} SELECT lemma, form, pos, posx, feats, len, frequency FROM words",
        "lexicon_posx":
            f"{word_rows} SELECT lemma, form, pos, posx, feats, frequency, frequencyx FROM words",
        "feature_table": f"{word_rows} SELECT DISTINCT feats, pos, {FEATURES} FROM words",
        "feature_table_sv": "WITH " + words(langcode="sv") + " SELECT DISTINCT feats, pos, "
            + ", ".join(f"{feature(n)} AS {c}" for n, c in features_for("sv").items()) + " FROM words",
        "feature_ids": f"""{word_rows}
SELECT lemma, form, pos, feats, frequency, dense_rank() OVER (ORDER BY feats, pos) AS featid FROM words""",
        "feature_ids_stable": f"""WITH first AS (
  SELECT feats, pos, row_number() OVER (ORDER BY feats, pos) AS featid FROM (WITH {words().replace(
      "FROM documents", "FROM documents WHERE doc_id % 2 = 0")} SELECT DISTINCT feats, pos FROM words)),
every AS (WITH {words()} SELECT DISTINCT feats, pos FROM words),
more AS (SELECT feats, pos, (SELECT coalesce(max(featid), 0) FROM first) + row_number() OVER (ORDER BY feats, pos)
         AS featid FROM every ANTI JOIN first USING (feats, pos))
SELECT 1 AS round, * FROM first UNION ALL SELECT 2, * FROM (SELECT * FROM first UNION ALL SELECT * FROM more)""",
        "feature_values": f"""{word_rows},
ids AS (SELECT feats, pos, row_number() OVER (ORDER BY feats, pos) AS featid
        FROM (SELECT DISTINCT feats, pos FROM words))
SELECT featid, feature, unnest(string_split(value, ',')) AS value FROM (
  SELECT featid, 'derivation' AS feature, {feature('Derivation')} AS value FROM ids
  UNION ALL SELECT featid, 'clitic', {feature('Clitic')} FROM ids
  UNION ALL SELECT featid, 'nouncase', {feature('Case')} FROM ids) WHERE value <> '_'""",
        "lemmaforms": f"{derived} SELECT * FROM lemmaforms",
        "forms": f"{derived} SELECT * FROM forms",
        "lemmas": f"{derived} SELECT lemma, lemmac, pos, lemmafreq, lemmalen, comparts FROM lemmas",
        "lemma_ambiguity": f"{derived} SELECT lemma, pos, lemmafreq, amblemma FROM lemmas",
        "form_ambiguity": f"""{derived}
SELECT w.lemma, w.form, w.pos, w.feats, 1 - lf.formpct AS ambform
FROM words w JOIN lemmaforms lf ON w.lemma = lf.lemma AND w.form = lf.form AND w.posx = lf.pos""",
        "init_trigram_freqs": f"{gram_rows} SELECT * FROM init",
        "final_trigram_freqs": f"{gram_rows} SELECT * FROM fin",
        "bigram_freqs": f"{gram_rows} SELECT * FROM bi",
        "word_bigram_freqs": f"{gram_rows} SELECT * FROM wordbi",
        "distinct_bigram_mean": f"""{gram_rows},
once AS (SELECT DISTINCT form, frequency, gram FROM pairs),
sums AS (SELECT gram, sum(frequency) AS total FROM once GROUP BY gram)
SELECT form, CAST(floor(sum(total) / count(*)) AS BIGINT) AS frequency
FROM once JOIN sums USING (gram) GROUP BY form""",
        "gram_contributions":
            f"{derived} SELECT form, {_listed_grams(q.LISTED_GRAMS, chr(39).join(['instr(form, ', '{0}', ') > 0']))}"
            " FROM forms",
        "gram_contributions_initial":
            f"""{derived} SELECT form, {_listed_grams(
                q.LISTED_INITIALS, "length(form) > 3 AND substr(form, 1, 3) = '{0}'")} FROM forms""",
        "gram_contribution_sums": f"""{derived}
SELECT right(form, 3) AS gram, CAST(sum(frequency) AS BIGINT) AS frequency, count(*) AS words
FROM forms WHERE length(form) > 3 GROUP BY 1""",
        "nonword_bigrams": f"""{gram_rows}{LISTED},
nonwords AS (SELECT reverse(item) AS form, max(position) AS "order" FROM formlist GROUP BY 1),
parts AS (SELECT form, "order", substr(form, CAST(i AS BIGINT), 2) AS gram
          FROM (SELECT form, "order", unnest(range(1, length(form))) AS i FROM nonwords))
SELECT "order", p.form, CAST(floor(sum(coalesce(bi.frequency, 0)) / length(p.form)) AS BIGINT) AS bigramfreq
FROM parts p LEFT JOIN bi ON p.gram = bi.gram GROUP BY "order", p.form""",
        "hamming_hood": derived + hood(listed=False) + " SELECT * FROM hood",
        "hood_with_lexicon": derived + hood() + " SELECT * FROM hood",
        "hood_transpositions": derived + hood(swaps=True) + " SELECT * FROM hood",
        "edit1_neighbours": derived + hood(swaps=True) + OTHER_LENGTH + """
SELECT e.form, e.other AS neighbour, f.frequency FROM edit1 e JOIN flagged f ON e.other = f.form""",
        "edit1_counts": derived + hood() + OTHER_LENGTH + """
SELECT f.form, count(e.other) AS neighbours FROM flagged f LEFT JOIN edit1 e ON f.form = e.form
GROUP BY f.form""",
        "lexicon_full": f"""{everything}
SELECT lemma, form, pos, posx, feats, len, frequency, frequencyx, hood, ambform FROM wide""",
        "wide_lexicon": f"{everything} SELECT * FROM wide",
        "totals": f"""{everything}
SELECT name, total FROM (UNPIVOT totals ON COLUMNS(*) INTO NAME name VALUE total)""",
        "lexicon_stats":
            f"{word_rows} SELECT count(*) AS rows, CAST(sum(frequency) AS BIGINT) AS frequency FROM words",
        "search_topk": f"""{everything} {matches(
            "posx = 'NOUN' AND len >= 6 AND frequencyx > 1 AND (form GLOB 'th*' OR form GLOB 'an*' OR form GLOB 're*')")}
{BY_FREQUENCY} LIMIT 100""",
        "search_order_by": f"""{everything} SELECT * FROM ({matches('frequencyx >= 2', lemmas=False)})
ORDER BY hood, {KEY} LIMIT 500""",
        "search_dedup": f"""{everything} SELECT * FROM ({matches(
            "posx = 'VERB' AND hood >= 0", lemmas=False, grams=False)}) {BY_FREQUENCY} LIMIT 1000""",
        "filter_numeric": f"""{everything} {matches(
            "lemmafreq > 5 AND lemmalen <= 9 AND amblemma < CAST(0.9 AS DOUBLE) "
            "AND ambform >= CAST(0.1 AS DOUBLE) AND hood <> 0 AND len > 4 AND initgramfreq > 50 "
            "AND fingramfreq > 50 AND bigramfreq > 100")}""",
        "filter_relative": f"""{everything} {matches(
            "frequencyx / tf * 1e6 > 20 AND lemmafreq / tl * 1e6 > 25 AND bigramfreq / tb * 1e6 > 1000 "
            "AND initgramfreq / ti * 1e6 < 9000")}""",
        "filter_string": f"""{everything} {matches(
            "posx <> 'NOUN' AND nnumber = 'Sing' AND nouncase = 'Gen' AND form <> 'the'")}""",
        "filter_in": f"""{everything} {matches(
            "posx IN ('NOUN', 'ADJ') AND nouncase IN ('Ine', 'Par') AND possnum NOT IN ('Sing')")}""",
        "filter_like": f"{everything} {matches(chr(39).join(['form ILIKE ', '%tion%', ' AND lemma ILIKE ', 'th%', '']))}",
        "filter_lemma": f"""{everything} {LISTED} {matches(
            "lemmac IN (SELECT item FROM lemmalist WHERE position <= 20) AND lemmac <> 'the'")}""",
        "filter_start": f"""{everything} {matches(
            "(starts_with(form, 'th') OR starts_with(form, 'en')) AND NOT starts_with(form, 'tho') "
            "AND NOT starts_with(form, 'enr') AND NOT starts_with(form, 'the')")}""",
        "filter_end": f"""{everything} {matches(
            "(ends_with(form, 'ing') OR ends_with(form, 'tion') OR ends_with(form, 'è')) "
            "AND NOT ends_with(form, 'ating')")}""",
        "filter_end_indexed": f"""{everything} {matches(
            "(ends_with(form, 'ing') OR ends_with(form, 'tion') OR ends_with(form, 'en')) "
            "AND (starts_with(form, 'th') OR starts_with(form, 're')) AND NOT ends_with(form, 'ating')")}""",
        "filter_long_list": f"""{everything}, seven AS (SELECT form AS f FROM forms WHERE length(form) = 7) {matches(
            "left(form, 7) IN (SELECT f FROM seven) AND right(form, 7) NOT IN (SELECT f FROM seven)")}""",
        "filter_middle": f"""{everything} {matches(
            "(form LIKE '_%tion%_' OR form LIKE '_%ouo%_') AND form NOT LIKE '_%the%_' "
            "AND form NOT LIKE '_%ent%_'")}""",
        "filter_compound": f"""{everything} {matches("lemma LIKE '%#%' AND posx = 'ADJ'")}""",
        "filter_not_compound":
            f"""{everything} {matches("lemma NOT LIKE '%#%' AND posx = 'ADJ' AND frequencyx > 1")}""",
        "filter_pos_aux":
            f"""{everything} {matches("w.pos IN ('AUX', 'PRON') AND w.frequency > 1", raw=True)}""",
        "clitic_in": f"""{everything} {matches(
            "list_has_any(string_split(clitic, ','), ['Kin', 'Kaan']) "
            "AND list_contains(string_split(derivation, ','), 'Vs')")}""",
        "clitic_not_in": f"""{everything} {matches("clitic NOT IN ('Kin', 'Kaan') AND clitic <> '_'")}""",
        "wordlist_forms": f"""{everything} {LISTED}
SELECT f.position AS "order", m.* FROM ({matches('true')}) m JOIN formlist f ON m.form = f.item
""",
        "wordlist_forms_joined": f"""{everything} {LISTED}
SELECT f.position AS "order", m.* FROM ({matches('true')}) m JOIN formlist f ON m.form = f.item
""",
        "wordlist_lemmas": f"""{everything} {LISTED}
SELECT f.position AS "order", m.* FROM ({matches('true')}) m
JOIN lemmalist f ON replace(m.lemma, '#', '') = f.item""",
        "refilter": f"""{everything} {LISTED}
SELECT * FROM (
  SELECT f.position AS "order", m.* FROM ({matches('true')}) m JOIN formlist f ON m.form = f.item)
WHERE "case" IN ('Gen', 'Nom') AND ambform < CAST(0.9 AS DOUBLE) AND frequency > 2""",
        "top_n_per_form": f"""{everything} SELECT * FROM ({matches('true')})
QUALIFY row_number() OVER (PARTITION BY form ORDER BY frequency DESC, lemma, pos, feats) <= 2""",
        "relative_freqs": f"""{everything}
SELECT m.*, {_per_million('m.lemmafreq', 't.lemmafreq')} AS rellemmafreq,
  {_per_million('m.frequency', 't.frequency')} AS relfrequency,
  {_per_million('m.bigramfreq', 't.bigramfreq')} AS relbigramfreq,
  {_per_million('m.initgramfreq', 't.initgramfreq')} AS relinitgramfreq,
  {_per_million('m.fingramfreq', 't.fingramfreq')} AS relfingramfreq
FROM ({matches('true')}) m, totals t""",
        "relative_freqs_only": f"""{everything}
SELECT m.* EXCLUDE (lemmafreq, frequency, bigramfreq, initgramfreq, fingramfreq),
  {_per_million('m.lemmafreq', 't.lemmafreq')} AS rellemmafreq,
  {_per_million('m.frequency', 't.frequency')} AS relfrequency,
  {_per_million('m.bigramfreq', 't.bigramfreq')} AS relbigramfreq,
  {_per_million('m.initgramfreq', 't.initgramfreq')} AS relinitgramfreq,
  {_per_million('m.fingramfreq', 't.fingramfreq')} AS relfingramfreq
FROM ({matches('true')}) m, totals t""",
        "column_groups": f"""{everything}
SELECT lemma, lemmalen, {_per_million('m.lemmafreq', 't.lemmafreq')} AS rellemmafreq, amblemma,
  form, pos, len, hood, ambform, {_per_million('m.frequency', 't.frequency')} AS relfrequency
FROM ({matches('true')}) m, totals t""",
        "drop_empty_columns": f"""{everything}
SELECT * FROM ({matches('true')})""",
        "aggregate_sum": f"""{everything}
SELECT pos, "case", CAST(sum(frequency) AS BIGINT) AS agg FROM ({matches('true')})
GROUP BY ALL""",
        "aggregate_count": f"""{everything}
SELECT lemma, pos AS posx, count(frequency) AS agg FROM ({matches('true')})
GROUP BY lemma, pos ORDER BY agg DESC, lemma, posx LIMIT 50""",
        "aggregate_filtered": f"""{everything}
SELECT "number", clitic, CAST(sum(frequency) AS BIGINT) AS agg FROM ({matches(
            "posx IN ('NOUN', 'ADJ') AND lemmafreq > 3 AND list_contains(string_split(clitic, ','), 'Kin')")})
GROUP BY ALL""",
        "aggregate_scanned": f"""{everything}
SELECT pos, "number", CAST(sum(frequency) AS BIGINT) AS agg FROM ({matches("starts_with(form, 'th')")})
GROUP BY ALL""",
        "prune_frequency": _pruned("frequency >= 2"),
        "prune_pos": _pruned("pos NOT IN ('AUX', 'PRON')"),
        "prune_length": _pruned("length(form) <= 8"),
        "prune_report": f"""{word_rows},
hits AS (SELECT count(*) AS total, count_if(pos IN ('AUX', 'PRON')) AS a, count_if(frequency < 2) AS b,
                count_if(len > 8) AS c FROM words)
SELECT 'pos' AS criterion, total, CAST(a AS BIGINT) AS deleted, CAST(total - a AS BIGINT) AS remaining FROM hits
UNION ALL SELECT 'frequency', total, CAST(b AS BIGINT), CAST(total - b AS BIGINT) FROM hits
UNION ALL SELECT 'length', total, CAST(c AS BIGINT), CAST(total - c AS BIGINT) FROM hits""",
        "merge_lexicons": f"{word_rows} SELECT * FROM words",
        "prune_rebuilt": "WITH " + wide("frequency >= 2 AND pos <> 'PRON' AND length(form) <= 11") + " SELECT * FROM wide",
        "merge_rebuilt": f"{everything} SELECT * FROM wide",
        "merge_incremental": f"{everything} SELECT * FROM wide",
        "merge_incremental_tables": f"{everything}{IDS} {UNNUMBERED_CELLS}",
        "prune_incremental":
            "WITH " + wide("frequency >= 2 AND pos <> 'PRON' AND length(form) <= 11") + " SELECT * FROM wide",
        "export_roundtrip": f"{everything} {matches('true')}",
        "export_all_tables": f"{everything}{IDS} {TABLE_CELLS}",
        "combined_export": f"""{everything}
{combined('frequencyx > 1')} ORDER BY m.frequency DESC, lemma, form, pos, feats LIMIT 2000""",
        "release_export": f"""{everything}{IDS}, merged AS MATERIALIZED ({combined('true')}) {TABLE_CELLS}
UNION ALL SELECT 'combined', concat_ws('|', lemma, form, pos, feats), 'row', md5(concat_ws('|', {COMBINED_CELLS}))
FROM merged
UNION ALL SELECT 'statistics', 'documents', c, v FROM (
  SELECT unnest(['source', 'language', 'langcode', 'rows', 'frequency']) AS c,
         unnest(['documents', 'Finnish', 'fi', CAST(count(*) AS VARCHAR),
                 CAST(sum(frequency) AS VARCHAR)]) AS v FROM words)""",
    }
