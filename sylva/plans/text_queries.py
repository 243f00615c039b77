"""Text queries: tokens, sentences, dictionary and phrase matching, relevance, co-occurrence, paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.functions import text as X
from sylva.operators import cooccur, gazetteer, graph, matching, ranking
from sylva.tables import spread, table

#: Phrases that overlap, for leftmost-longest matching.
OVERLAPPING = ("at", "at the", "the base", "at the base", "the apex", "obtuse at the apex", "obtuse at", "cordate at the base", "white to cream", "to cream", "recurved with age", "with age", "known from two gatherings", "from two")
#: Environments by identifier.
ENVIRONMENTS = (("ENVO:1", "gallery forest"), ("ENVO:2", "montane grassland"), ("ENVO:3", "coastal dunes"), ("ENVO:4", "open woodland"), ("ENVO:5", "limestone cliffs"), ("ENVO:6", "old fallows"))
#: A small bilingual word list.
LEXICON = (("leaf", "feuille"), ("leaf blade", "limbe"), ("petal", "pétale"), ("dry weight", "poids sec"), ("colour", "couleur"), ("stalk", "pédoncule"), ("texture", "texture"), ("apex form", "forme du sommet"))


def described(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "sentences")).filter(F.col("description").isNotNull()).select("sent_id", "taxon", "description")


def term_gazetteer(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "term_list").select("name", F.col("term_id").alias("id"), "kind", F.lit("terms").alias("source"))


def phrases(spark: SparkSession, folder: str) -> DataFrame:
    return gazetteer.dictionary(term_gazetteer(spark, folder))


def _listed(spark: SparkSession, pairs: tuple[tuple[str, str], ...], kind: str) -> DataFrame:
    return gazetteer.dictionary(spark.createDataFrame([(n, i, kind) for i, n in pairs], "name string, id string, kind string"))


def eq_part_cooccurrence(spark: SparkSession, folder: str) -> DataFrame:
    """Entities and qualities that name the same part, with counts."""
    gaz = spark.createDataFrame(
        [(n, n, "quality") for n in "small large old new hot cold red blue".split()] + [(n, n, "entity") for n in "ring bolt anvil widget gear gizmo plate rod".split()],
        "name string, id string, kind string",
    )
    hits = matching.phrase_hits(table(spark, folder, "part"), ["p_partkey"], "p_name", gazetteer.dictionary(gaz))
    return cooccur.pairs(hits, "p_partkey").groupBy(F.col("e_name").alias("entity"), F.col("q_name").alias("quality")).agg(F.count("*").alias("n"))


def _eq(spark: SparkSession, folder: str, k: int) -> DataFrame:
    s = described(spark, folder)
    scored = cooccur.scored_pairs(s, "sent_id", "description", phrases(spark, folder), k)
    return scored.join(s, "sent_id").select("sent_id", "taxon", "e_name", "e_id", "q_name", "q_id", "score", F.col("description").alias("text"))


def eq_cooccurrence(spark: SparkSession, folder: str) -> DataFrame:
    """Entity-quality facts with the best 1,000 sentences of each pair."""
    return _eq(spark, folder, 1000)


def eq_top3(spark: SparkSession, folder: str) -> DataFrame:
    """The best three sentences of each entity-quality pair."""
    return _eq(spark, folder, 3)


def environment_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Environments named in habitat sentences, scored."""
    s = table(spark, folder, "sentences").filter(F.col("habitat").isNotNull()).select("sent_id", "taxon", "habitat")
    hits = cooccur.single_phrase_hits(s, "sent_id", "habitat", _listed(spark, ENVIRONMENTS, "environment"))
    return hits.join(s, "sent_id").select("sent_id", "taxon", "name", "id", "score", F.col("habitat").alias("text"))


def token_stats(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select("doc_id", X.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"))


def sentence_clauses(spark: SparkSession, folder: str) -> DataFrame:
    """Every clause of every sentence piece of the documents."""
    s = table(spark, folder, "documents").select("doc_id", F.posexplode(X.sentence_pieces(F.col("text"))).alias("sent_no", "s"))
    return s.select("doc_id", "sent_no", F.posexplode(X.clauses(F.col("s"), "[;,]")).alias("clause_no", "clause"))


def first_clauses(spark: SparkSession, folder: str) -> DataFrame:
    return described(spark, folder).select("sent_id", X.first_clause(F.col("description"), ",").alias("clause"))


def content_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return described(spark, folder).select("sent_id", F.inline(X.content_tokens(F.col("description"), X.STOP_EN)))


def french_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Elided, stopped and stemmed tokens of the French documents."""
    d = table(spark, folder, "documents").filter(F.lower("lang").isin("fr", "fra", "fr-fr"))
    return d.select("doc_id", F.array_join(X.french_tokens(F.col("text")), " ").alias("terms"))


def measurements(spark: SparkSession, folder: str) -> DataFrame:
    """Number ranges with a metric unit in the documents, as written."""
    d = table(spark, folder, "documents").select("doc_id", F.posexplode(X.measurement_spans(F.col("text"))).alias("no", "span"))
    return d.select("doc_id", F.col("no").alias("span_no"), "span")


def dict_longest_match(spark: SparkSession, folder: str) -> DataFrame:
    """Leftmost-longest matches of overlapping phrases in the documents."""
    d = spread(table(spark, folder, "documents").select("doc_id", "text"))
    gaz = spark.createDataFrame([(n, n, "phrase") for n in OVERLAPPING], "name string, id string, kind string")
    m = matching.dictionary_match(d, ["doc_id"], "text", gazetteer.dictionary(gaz, 2))
    return m.select("doc_id", "pos", "n", "name")


def phrase_hits(spark: SparkSession, folder: str) -> DataFrame:
    return matching.phrase_hits(described(spark, folder), ["sent_id"], "description", phrases(spark, folder)).select("sent_id", "pos", "n", "name", "id", "kind")


def boolean_and(spark: SparkSession, folder: str) -> DataFrame:
    return matching.texts_with_all(described(spark, folder), ["sent_id"], "description", ["and", "ovate"])


def tfidf_scores(spark: SparkSession, folder: str) -> DataFrame:
    s, p = described(spark, folder), phrases(spark, folder)
    hits = matching.phrase_hits(s, ["sent_id"], "description", p)
    parts = ranking.phrase_scores(hits, "sent_id", ranking.phrase_idf(s, "description", p), ranking.text_lengths(s, "sent_id", "description"))
    return parts.select("sent_id", "name", F.col("tf").cast("bigint").alias("tf"), F.round("part", 4).alias("score"))


def tfidf_topk(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.top_k(tfidf_scores(spark, folder), ["name"], "score", ["sent_id"], 5)


def lexicon_top1(spark: SparkSession, folder: str) -> DataFrame:
    """The best term for each word of a bilingual list, searched among the term names."""
    t = table(spark, folder, "trait_terms").select(F.col("term_id"), "name")
    p = _listed(spark, tuple((f, e) for e, f in LEXICON), "word")
    hits = cooccur.single_phrase_hits(t, "term_id", "name", p)
    best = ranking.top_k(hits, ["name"], "score", ["term_id"], 1)
    return best.select(F.col("name").alias("english"), F.col("id").alias("french"), "term_id", "score")


def eq_fragments(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences with an entity and a quality tagged."""
    s = described(spark, folder)
    spans = cooccur.name_spans(s, "sent_id", "description", phrases(spark, folder))
    return cooccur.tagged_fragments(s, "sent_id", "description", spans)


def mismatch_report(spark: SparkSession, folder: str) -> DataFrame:
    """Entities matched for a taxon that no quality of any of its sentences goes with."""
    s = described(spark, folder)
    m = matching.phrase_hits(s, ["sent_id"], "description", phrases(spark, folder)).join(s.select("sent_id", "taxon"), "sent_id")
    every = m.filter("kind = 'entity'").select("taxon", "name").distinct()
    paired = cooccur.pairs(m, "sent_id").join(s.select("sent_id", "taxon"), "sent_id").select("taxon", F.col("e_name").alias("name")).distinct()
    return every.exceptAll(paired).select(F.coalesce("taxon", F.lit("null")).alias("taxon"), "name")


def dep_token_window(spark: SparkSession, folder: str) -> DataFrame:
    """Entity and quality vertices less than three steps apart along the token chain."""
    s = described(spark, folder)
    rows = matching.token_rows(s, ["sent_id"], "description")
    hits = matching.phrase_hits(s, ["sent_id"], "description", phrases(spark, folder))
    v = graph.vertices_of(rows, "sent_id", hits)
    e = v.filter("kind = 'entity'").select("sent_id", F.col("pos").alias("src"), F.col("name").alias("e_name"))
    q = v.filter("kind = 'quality'").select("sent_id", F.col("pos").alias("dst"), F.col("name").alias("q_name"))
    reach = graph.within_hops(graph.token_chain(rows, "sent_id"), "sent_id", e.select("sent_id", "src"), 2)
    near = reach.join(e, ["sent_id", "src"]).join(q, ["sent_id", "dst"])
    return near.groupBy("sent_id", "e_name", "q_name").agg(F.min("dist").alias("dist"), F.count("*").alias("n_paths"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        eq_part_cooccurrence, eq_cooccurrence, eq_top3, environment_hits, token_stats, sentence_clauses, first_clauses, content_tokens, french_tokens,
        measurements, dict_longest_match, phrase_hits, boolean_and, tfidf_scores, tfidf_topk, lexicon_top1, eq_fragments, mismatch_report, dep_token_window,
    )
}


def _quoted(words: list[str] | tuple[str, ...]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _hits(source: str, key: str, text: str, phrases: str) -> str:
    return rf"""
toks AS (SELECT {key}, regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+') AS w FROM {source}),
ph AS (SELECT DISTINCT name, id, kind, regexp_extract_all(name, '[\p{{L}}\p{{N}}]+') AS phrase FROM ({phrases})),
place AS (SELECT {key}, w, unnest(range(1, len(w) + 1)) AS i FROM toks),
hits AS (
  SELECT {key}, CAST(i - 1 AS INTEGER) AS pos, CAST(len(phrase) AS INTEGER) AS n, name, id, kind
  FROM place JOIN ph ON w[i] = phrase[1] AND w[i:i + len(phrase) - 1] = phrase)
"""


def _scores(key: str) -> str:
    return f"""
dfs AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT {key}, unnest(w) AS term FROM toks) GROUP BY 1),
idf AS (
  SELECT name, sum(1 + ln((SELECT count(*) FROM toks)::DOUBLE / (coalesce(df, 0) + 1))) AS idf
  FROM (SELECT name, unnest(phrase) AS term FROM (SELECT DISTINCT name, phrase FROM ph)) LEFT JOIN dfs USING (term) GROUP BY name),
lens AS (SELECT {key}, len(list_filter(w, lambda x: x NOT IN ({_quoted(X.STOP_EN)}))) AS length FROM toks),
parts AS (
  SELECT {key}, name, count(DISTINCT pos) AS tf, sqrt(count(DISTINCT pos)) * any_value(idf) * any_value(idf) / sqrt(any_value(length)) AS part
  FROM hits JOIN idf USING (name) JOIN lens USING ({key}) GROUP BY {key}, name)
"""


_TERMS = "SELECT lower(trim(name)) AS name, term_id AS id, kind FROM term_list WHERE length(trim(name)) >= 3"
_SENT = _hits("(SELECT * FROM sentences WHERE description IS NOT NULL)", "sent_id", "description", _TERMS)
_VALUES = lambda pairs, kind: "SELECT * FROM (VALUES " + ", ".join(f"({_quoted([n])}, {_quoted([i])}, '{kind}')" for i, n in pairs) + ") v(name, id, kind)"


def _eq_sql(k: int) -> str:
    return f"""
WITH {_SENT}, {_scores("sent_id")},
named AS (SELECT DISTINCT sent_id, name, id, kind FROM hits),
e AS (SELECT sent_id, name AS e_name, id AS e_id, part AS ep FROM named JOIN parts USING (sent_id, name) WHERE kind = 'entity'),
q AS (SELECT sent_id, name AS q_name, id AS q_id, part AS qp FROM named JOIN parts USING (sent_id, name) WHERE kind = 'quality'),
scored AS (SELECT sent_id, e_name, e_id, q_name, q_id, round(ep + qp, 6) AS score FROM e JOIN q USING (sent_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY e_id, q_id ORDER BY score DESC, sent_id) AS r FROM scored)
SELECT sent_id, taxon, e_name, e_id, q_name, q_id, score, description AS text FROM ranked JOIN sentences USING (sent_id) WHERE r <= {k}
"""


_FR = rf"regexp_extract_all(regexp_replace(lower(text), '{X.ELISION.replace(chr(39), chr(39) * 2)}', '\1', 'g'), '[\p{{L}}\p{{N}}]+')"
_STEM = r"""CASE WHEN length(t) < 6 THEN t WHEN t LIKE '%aux' THEN regexp_replace(t, 'aux$', 'al') WHEN t LIKE '%x' THEN regexp_replace(t, 'x$', '')
  ELSE (SELECT CASE WHEN length(u) > 1 AND right(u, 1) = left(right(u, 2), 1) THEN left(u, length(u) - 1) ELSE u END
        FROM (SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, 's$', ''), 'r$', ''), 'e$', ''), 'é$', '') AS u)) END"""

SQL: dict[str, str] = {
    "eq_part_cooccurrence": """
SELECT split_part(p_name, ' ', 2) AS entity, split_part(p_name, ' ', 1) AS quality, count(*) AS n FROM part
WHERE split_part(p_name, ' ', 1) IN ('small','large','old','new','hot','cold','red','blue')
  AND split_part(p_name, ' ', 2) IN ('ring','bolt','anvil','widget','gear','gizmo','plate','rod') GROUP BY 1, 2""",
    "eq_cooccurrence": _eq_sql(1000),
    "eq_top3": _eq_sql(3),
    "environment_hits": f"""
WITH {_hits("(SELECT * FROM sentences WHERE habitat IS NOT NULL)", "sent_id", "habitat", _VALUES(ENVIRONMENTS, "environment"))}, {_scores("sent_id")},
ranked AS (SELECT sent_id, name, id, round(part, 6) AS score, row_number() OVER (PARTITION BY id ORDER BY round(part, 6) DESC, sent_id) AS r
  FROM (SELECT DISTINCT sent_id, name, id FROM hits) JOIN parts USING (sent_id, name))
SELECT sent_id, taxon, name, id, score, habitat AS text FROM ranked JOIN sentences USING (sent_id) WHERE r <= 1000""",
    "token_stats": r"""
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents)""",
    "sentence_clauses": r"""
WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]\s+|\n+'), lambda x: trim(x, '  ')), lambda x: x <> '') AS p FROM documents),
t AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS sent_no, list_filter(list_transform(regexp_split_to_array(p[i], '[;,]'), lambda x: trim(x, '  ')), lambda x: x <> '') AS c
  FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM s))
SELECT doc_id, sent_no, CAST(k - 1 AS INTEGER) AS clause_no, c[k] AS clause FROM (SELECT doc_id, sent_no, c, unnest(range(1, len(c) + 1)) AS k FROM t)""",
    "first_clauses": "SELECT sent_id, trim(split_part(description, ',', 1), '  ') AS clause FROM sentences WHERE description IS NOT NULL",
    "content_tokens": rf"""
SELECT sent_id, CAST(i - 1 AS INTEGER) AS pos, w[i] AS term
FROM (SELECT sent_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT sent_id, regexp_extract_all(lower(description), '[\p{{L}}\p{{N}}]+') AS w FROM sentences WHERE description IS NOT NULL))
WHERE w[i] NOT IN ({_quoted(X.STOP_EN)})""",
    "french_tokens": f"""
WITH d AS (SELECT doc_id, list_filter({_FR}, lambda x: x NOT IN ({_quoted(X.STOP_FR)})) AS w FROM documents WHERE lower(lang) IN ('fr', 'fra', 'fr-fr')),
u AS (SELECT doc_id, i, w[i] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
v AS (SELECT doc_id, string_agg({_STEM}, ' ' ORDER BY i) AS terms FROM u GROUP BY doc_id)
SELECT doc_id, coalesce(terms, '') AS terms FROM d LEFT JOIN v USING (doc_id)""",
    "measurements": r"""
SELECT doc_id, CAST(i - 1 AS INTEGER) AS span_no, m[i] AS span FROM (SELECT doc_id, m, unnest(range(1, len(m) + 1)) AS i FROM (
  SELECT doc_id, regexp_extract_all(text, '([0-9]+(?:[.,][0-9]+)?(?:\s?[-–]\s?[0-9]+(?:[.,][0-9]+)?)?\s?(?:mm|cm|dm|m))\b', 1) AS m FROM documents))""",
    "dict_longest_match": f"""
WITH RECURSIVE {_hits("documents", "doc_id", "text", _VALUES(tuple((n, n) for n in OVERLAPPING), "phrase"))},
longest AS (SELECT doc_id, pos, max(n) AS n FROM hits GROUP BY 1, 2),
walk AS (
  SELECT doc_id, min(pos) AS pos FROM longest GROUP BY 1
  UNION ALL
  SELECT w.doc_id, (SELECT min(l.pos) FROM longest l WHERE l.doc_id = w.doc_id AND l.pos >= w.pos + (SELECT n FROM longest k WHERE k.doc_id = w.doc_id AND k.pos = w.pos))
  FROM walk w WHERE w.pos IS NOT NULL)
SELECT h.doc_id, h.pos, h.n, h.name FROM walk JOIN longest l USING (doc_id, pos) JOIN hits h ON h.doc_id = l.doc_id AND h.pos = l.pos AND h.n = l.n""",
    "phrase_hits": f"WITH {_SENT} SELECT sent_id, pos, n, name, id, kind FROM hits",
    "boolean_and": r"""
SELECT sent_id FROM (SELECT sent_id, regexp_extract_all(lower(description), '[\p{L}\p{N}]+') AS w FROM sentences WHERE description IS NOT NULL)
WHERE list_contains(w, 'and') AND list_contains(w, 'ovate')""",
    "tfidf_scores": f"WITH {_SENT}, {_scores('sent_id')} SELECT sent_id, name, tf, round(part, 4) AS score FROM parts",
    "tfidf_topk": f"""
WITH {_SENT}, {_scores("sent_id")}, s AS (SELECT sent_id, name, tf, round(part, 4) AS score FROM parts)
SELECT sent_id, name, tf, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, sent_id) AS r FROM s) WHERE r <= 5""",
    "lexicon_top1": f"""
WITH {_hits("trait_terms", "term_id", "name", _VALUES(tuple((f, e) for e, f in LEXICON), "word"))}, {_scores("term_id")},
s AS (SELECT DISTINCT term_id, name, id, round(part, 6) AS score FROM hits JOIN parts USING (term_id, name))
SELECT name AS english, id AS french, term_id, score FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, term_id) AS r FROM s) WHERE r = 1""",
    "eq_fragments": f"""
WITH {_SENT},
m AS (SELECT DISTINCT sent_id, name, kind FROM hits),
sp AS (SELECT sent_id, name, kind, description AS t, instr(lower(description), name) AS s, length(name) AS l FROM m JOIN sentences USING (sent_id) WHERE instr(lower(description), name) > 0),
p AS (
  SELECT e.sent_id, e.t, e.name AS e_name, q.name AS q_name, e.s AS es, e.l AS el, q.s AS qs, q.l AS ql,
    row_number() OVER (PARTITION BY e.sent_id ORDER BY abs(e.s - q.s), e.s, q.s, e.name, q.name) AS r
  FROM sp e JOIN sp q ON e.sent_id = q.sent_id AND e.kind = 'entity' AND q.kind = 'quality' AND (e.s + e.l <= q.s OR q.s + q.l <= e.s))
SELECT sent_id, e_name, q_name, CASE WHEN es < qs
  THEN t[1:es - 1] || '<E>' || t[es:es + el - 1] || '</E>' || t[es + el:qs - 1] || '<Q>' || t[qs:qs + ql - 1] || '</Q>' || t[qs + ql:]
  ELSE t[1:qs - 1] || '<Q>' || t[qs:qs + ql - 1] || '</Q>' || t[qs + ql:es - 1] || '<E>' || t[es:es + el - 1] || '</E>' || t[es + el:] END AS fragment
FROM p WHERE r <= 50""",
    "mismatch_report": f"""
WITH {_SENT}, m AS (SELECT DISTINCT sent_id, name, kind, taxon FROM hits JOIN sentences USING (sent_id)),
paired AS (SELECT DISTINCT e.taxon, e.name FROM m e JOIN m q ON e.sent_id = q.sent_id AND q.kind = 'quality' WHERE e.kind = 'entity')
SELECT coalesce(taxon, 'null') AS taxon, name FROM (SELECT DISTINCT taxon, name FROM m WHERE kind = 'entity' EXCEPT SELECT taxon, name FROM paired)""",
    "dep_token_window": f"""
WITH {_SENT}, m AS (SELECT DISTINCT sent_id, name, id, kind FROM hits),
v AS (
  SELECT sent_id, i AS pos, name, kind FROM (SELECT sent_id, i, w[i] AS term FROM place) JOIN m USING (sent_id)
  WHERE length(term) >= 3 AND (contains(term, name) OR contains(name, term)))
SELECT e.sent_id, e.name AS e_name, q.name AS q_name, CAST(min(q.pos - e.pos) AS INTEGER) AS dist, count(*) AS n_paths
FROM v e JOIN v q ON e.sent_id = q.sent_id AND q.pos - e.pos BETWEEN 0 AND 2 WHERE e.kind = 'entity' AND q.kind = 'quality' GROUP BY 1, 2, 3""",
}
