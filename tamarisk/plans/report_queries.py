"""Queries of logs, time sheets, test summaries and language operators over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.operators import counting, language, lines, reports, tfidf
from tamarisk.plans.registry import Registry
from tamarisk.plans.scale import lookup, spread, table
from tamarisk.plans.table_queries import _LINES
from tamarisk.plans.text_queries import _grams_sql

R = Registry()


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.numbered(spread(table(spark, d, "documents"), "doc_id"))


_COLLAPSED = rf"""{_LINES}, sh AS (SELECT doc_id, line_no, translate(string_split(rtrim(regexp_replace(line, '{reports.COMMANDS}', '', 'g'), chr(13)), chr(13))[-1], chr(7) || chr(27), '') AS line FROM l WHERE NOT regexp_full_match(line, '[ \t\r\n]*')),
c AS (SELECT doc_id, line_no, CASE WHEN contains(line, chr(8)) THEN list_reduce(list_prepend('', string_split(line, '')), lambda a, x: CASE WHEN x = chr(8) THEN left(a, greatest(length(a) - 1, 0)) ELSE a || x END) ELSE line END AS line FROM sh)"""


@R.add("log_collapsed", f"WITH {_COLLAPSED} SELECT * FROM c WHERE NOT regexp_full_match(line, '[ \\t\\r\\n]*')")
def log_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return reports.collapse(_lines(spark, d))


@R.add("log_abbreviated")
def log_abbreviated(spark: SparkSession, d: str) -> DataFrame:
    c = reports.collapse(_lines(spark, d))
    return reports.abbreviate(c, reports.frequent_paths(c, min_length=25))


@R.add("log_long_tokens", rf"WITH {_LINES}, t AS (SELECT unnest(regexp_extract_all(line, '[^ \t]{{30,}}')) AS token FROM l) SELECT token, count(*) AS n, count(*) * length(token) AS score FROM t GROUP BY token HAVING count(*) >= 2")
def log_long_tokens(spark: SparkSession, d: str) -> DataFrame:
    return reports.long_tokens(_lines(spark, d))


_TIMES = rf"""{_LINES}, s AS (SELECT doc_id, line_no, lower(line) AS l FROM l),
x AS (SELECT *, nullif(regexp_extract(l, '^(mon|tue|wed|thu|fri|sat|sun)[a-z]*:[ \t\r]*$', 1), '') AS day_here,
  CASE WHEN regexp_matches(l, '^[ \t]*[0-9]+:?[0-9]*(?:am|pm)?-[0-9]+:?[0-9]*(?:am|pm)?:?[ \t]') THEN regexp_extract(l, '^\s*(\d+):?(\d*)(?:am|pm)?(?:-|\s+)(\d+):?(\d*)(?:am|pm)?', ['a', 'b', 'c', 'd']) END AS r,
  coalesce(nullif(regexp_extract(l, '\[([a-z0-9_/\-]+)\]', 1), ''), 'n/a') AS tag, try_cast(regexp_extract(l, '^hours:[ \t]*([0-9.]+)', 1) AS DOUBLE) AS stated, starts_with(l, 'hours:') AS is_end,
  try_cast(regexp_extract(l, '^total hours:[ \t]*([0-9.]+)', 1) AS DOUBLE) AS stated_total FROM s),
y AS (SELECT *, r.a::DOUBLE + coalesce(try_cast(r.b AS DOUBLE), 0) / 60 AS f, r.c::DOUBLE + coalesce(try_cast(r.d AS DOUBLE), 0) / 60 AS t FROM x),
z AS (SELECT doc_id, line_no, last_value(day_here IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS day, 1 + coalesce(sum(CASE WHEN is_end THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block,
  CASE WHEN t < f THEN t + 12 - f ELSE t - f END AS hours, tag, stated, is_end, stated_total FROM y),
times AS (SELECT * FROM z WHERE hours IS NOT NULL OR is_end OR stated_total IS NOT NULL)"""


def _times(spark: SparkSession, d: str) -> DataFrame:
    return reports.time_lines(_lines(spark, d))


@R.add("time_blocks", f"WITH {_TIMES} SELECT doc_id, block::BIGINT AS block, arg_max(day, line_no) AS day, round(coalesce(sum(hours), 0), 6) AS calculated, max(stated) AS stated, coalesce(abs(coalesce(sum(hours), 0) - max(stated)) < 1e-6, false) AS agrees FROM times WHERE hours IS NOT NULL OR is_end GROUP BY doc_id, block")
def time_blocks(spark: SparkSession, d: str) -> DataFrame:
    return reports.time_blocks(_times(spark, d)).withColumn("calculated", F.round("calculated", 6))


@R.add("time_by_tag", f"WITH {_TIMES} SELECT doc_id, tag, round(sum(hours), 6) AS hours, (grouping(doc_id) + grouping(tag))::INT AS level FROM times WHERE hours IS NOT NULL GROUP BY CUBE (doc_id, tag) HAVING sum(hours) <> 0")
def time_by_tag(spark: SparkSession, d: str) -> DataFrame:
    return reports.time_by_tag(_times(spark, d)).withColumn("hours", F.round("hours", 6))


@R.add("time_totals", f"WITH {_TIMES} SELECT doc_id, round(coalesce(sum(hours), 0), 6) AS calculated, max(stated_total) AS stated, abs(coalesce(sum(hours), 0) - max(stated_total)) < 1e-6 AS agrees FROM times GROUP BY doc_id")
def time_totals(spark: SparkSession, d: str) -> DataFrame:
    return reports.time_totals(_times(spark, d)).withColumn("calculated", F.round("calculated", 6))


def _num(p: str) -> str:
    return f"coalesce(try_cast(nullif(regexp_extract(line, '{p}', 1), '') AS DOUBLE), 0)"


_TESTS = f"""{_LINES}, p AS (SELECT doc_id, line_no, {", ".join(f"{_num(f'([0-9]+) {c}')}::BIGINT AS {c}" for c in reports.COUNTS)}, {_num("in ([0-9.]+) ?s")} AS duration FROM l WHERE regexp_matches(line, '= .*(passed|failed|skipped).* ='))"""
_OK = "passed + failed AS total, CASE WHEN passed + failed > 0 THEN round(least(passed * 100.0::DOUBLE / (passed + failed), 100), 6) ELSE 0 END AS ok_pct"


@R.add("test_summaries_last", f"WITH {_TESTS}, g AS (SELECT * EXCLUDE (line_no) FROM p QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no DESC) = 1) SELECT *, {_OK} FROM g")
def test_summaries_last(spark: SparkSession, d: str) -> DataFrame:
    return reports.test_summaries(_lines(spark, d)).withColumn("ok_pct", F.round("ok_pct", 6))


@R.add("test_summaries_combined", f"WITH {_TESTS}, g AS (SELECT doc_id, {', '.join(f'sum({c})::BIGINT AS {c}' for c in reports.COUNTS)}, round(sum(duration), 6) AS duration FROM p GROUP BY doc_id) SELECT *, {_OK} FROM g")
def test_summaries_combined(spark: SparkSession, d: str) -> DataFrame:
    return reports.test_summaries(_lines(spark, d), combine=True).withColumn("ok_pct", F.round("ok_pct", 6)).withColumn("duration", F.round("duration", 6))


# Language

_SENT = r"sent AS (SELECT doc_id, k AS sentence_no, s[k] AS sentence FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t\r\n]+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')), lambda s: s <> '') AS s FROM documents WHERE text IS NOT NULL), unnest(range(1, len(s) + 1)) AS u(k))"


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return language.sentences(spread(table(spark, d, "documents"), "doc_id"))


@R.add("sentences", f"WITH {_SENT} SELECT * FROM sent")
def sentences(spark: SparkSession, d: str) -> DataFrame:
    return _sentences(spark, d)


_WT = r"wt AS (SELECT id, k AS token_no, t[k] AS token FROM (SELECT id, regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]+') AS t FROM (SELECT DISTINCT id, text FROM snippets)), unnest(range(1, len(t) + 1)) AS u(k))"


def _word_tokens(spark: SparkSession, d: str) -> DataFrame:
    return language.word_tokens(table(spark, d, "snippets").select("id", "text").distinct(), "id")


@R.add("word_tokens", f"WITH {_WT} SELECT * FROM wt")
def word_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _word_tokens(spark, d)


# A small dictionary of parts of speech.
POS = {"the": "DT", "a": "DT", "an": "DT", "of": "IN", "in": "IN", "on": "IN", "to": "TO", "and": "CC", "or": "CC", "is": "VBZ", "was": "VBD", "are": "VBP", "be": "VB", "can": "MD", "would": "MD", "visit": "VB", "built": "VBN", "painted": "VBN", "early": "RB", "quiet": "JJ"}
_POS = ", ".join(f"('{w}', '{p}')" for w, p in POS.items())
_TAG = f"{_WT}, d(word, pos) AS (VALUES {_POS}), tg AS (SELECT id, token_no, token, coalesce(pos, CASE WHEN regexp_full_match(token, '[\\p{{P}}\\p{{S}}]+') THEN '.' END, 'NN') AS pos FROM wt LEFT JOIN d ON word = lower(token))"


@R.add(
    "tagged_tokens",
    f"""WITH {_TAG}, pv AS (SELECT *, coalesce(lag(pos) OVER (PARTITION BY id ORDER BY token_no), '') AS pv FROM tg)
SELECT id, token_no, token, pos, CASE WHEN pos IN ('VBG', 'VBN') AND NOT regexp_matches(pv, '^(VB|MD)') THEN 'other' WHEN starts_with(pos, 'NN') THEN 'noun' WHEN starts_with(pos, 'VB') OR starts_with(pos, 'MD') THEN 'verb' WHEN starts_with(pos, 'RB') THEN 'adverb' WHEN starts_with(pos, 'JJ') THEN 'adjective' ELSE 'other' END AS "class" FROM pv""",
)
def tagged_tokens(spark: SparkSession, d: str) -> DataFrame:
    pos = spark.createDataFrame(list(POS.items()), "word string, pos string")
    return language.pos_class(language.tag(_word_tokens(spark, d), pos), "id").select("id", "token_no", "token", "pos", "class")


@R.add("stemmed_words")
def stemmed_words(spark: SparkSession, d: str) -> DataFrame:
    return language.stems(table(spark, d, "documents").select(F.explode(counting.matches(F.lower("text"), "[a-z]+")).alias("word")))


@R.add("tfidf_stemmed")
def tfidf_stemmed(spark: SparkSession, d: str) -> DataFrame:
    """Top unigrams by stem: every distinct word is stemmed once and looked up."""
    docs = spread(table(spark, d, "documents"), "doc_id")
    tf = tfidf.frequencies(docs, (1,), tfidf.STOP_WORDS)
    st = language.stems(tf.select("ngram"), "ngram").select(F.col("word").alias("ngram"), "stem")
    both = lookup(tf, st, ["ngram"], "inner").groupBy("doc_id", "doc_len", F.col("stem").alias("ngram")).agg(F.sum("tf").alias("tf"))
    return tfidf.top_terms(both.select("doc_id", "ngram", "tf", "doc_len"), docs.count(), 5)


_LM = rf"""{_SENT}, tk AS (SELECT list_concat(['<s>'], regexp_extract_all(lower(sentence), '[a-z0-9_]+'), ['</s>']) AS t FROM sent),
cnt AS (SELECT n::INT AS n, array_to_string(t[i : i + n - 1], ' ') AS ngram, count(*) AS c FROM tk, unnest(range(1, len(t) + 1)) AS a(i), unnest([1, 2, 3]) AS b(n) WHERE i + n - 1 <= len(t) GROUP BY ALL)"""


@R.add("ngram_counts", f'WITH {_LM} SELECT n, ngram, c AS "count" FROM cnt')
def ngram_counts(spark: SparkSession, d: str) -> DataFrame:
    return language.ngram_counts(_sentences(spark, d))


@R.add(
    "language_model",
    f"""WITH {_LM}, h AS (SELECT *, CASE WHEN n > 1 THEN regexp_replace(ngram, ' [^ ]+$', '') ELSE '' END AS history FROM cnt),
t AS (SELECT n, history, sum(c) AS total, count(*) AS types FROM h WHERE ngram <> '<s>' OR n > 1 GROUP BY n, history),
b AS (SELECT n - 1 AS n, history AS ngram, log10(0.5 * types / total) AS backoff FROM t WHERE n > 1)
SELECT h.n, h.ngram, round(CASE WHEN h.n = 1 THEN log10(c / total) ELSE log10((c - 0.5) / total) END, 6) AS logprob, round(coalesce(backoff, 0), 6) AS backoff FROM h JOIN t USING (n, history) LEFT JOIN b ON b.n = h.n AND b.ngram = h.ngram""",
)
def language_model(spark: SparkSession, d: str) -> DataFrame:
    m = language.language_model(language.ngram_counts(_sentences(spark, d)))
    return m.select("n", "ngram", F.round("logprob", 6).alias("logprob"), F.round("backoff", 6).alias("backoff"))


@R.add(
    "sentence_scores",
    f"""WITH {_LM}, h AS (SELECT *, CASE WHEN n > 1 THEN regexp_replace(ngram, ' [^ ]+$', '') ELSE '' END AS history FROM cnt),
t AS (SELECT n, history, sum(c) AS total, count(*) AS types FROM h WHERE ngram <> '<s>' OR n > 1 GROUP BY n, history),
b AS (SELECT n - 1 AS n, history AS ngram, log10(0.5 * types / total) AS backoff FROM t WHERE n > 1),
m AS (SELECT h.n, h.ngram, CASE WHEN h.n = 1 THEN log10(c / total) ELSE log10((c - 0.5) / total) END AS lp, coalesce(backoff, 0) AS bo FROM h JOIN t USING (n, history) LEFT JOIN b ON b.n = h.n AND b.ngram = h.ngram),
s AS (SELECT id, list_concat(['<s>'], regexp_extract_all(lower(text), '[a-z0-9_]+'), ['</s>']) AS t FROM (SELECT DISTINCT id, text FROM snippets WHERE text IS NOT NULL)),
w AS (SELECT id, t, i FROM s, unnest(range(2, len(t) + 1)) AS u(i)),
x AS (SELECT id, i, t[i] AS g1, array_to_string(t[i - 1 : i], ' ') AS g2, CASE WHEN i >= 3 THEN array_to_string(t[i - 2 : i], ' ') END AS g3, t[i - 1] AS h1, CASE WHEN i > 2 THEN array_to_string(t[i - 2 : i - 1], ' ') END AS h2 FROM w),
y AS (SELECT id, p1.lp AS p1, coalesce(p3.lp, p2.lp + coalesce(b2.bo, 0), p1.lp + coalesce(b1.bo, 0) + coalesce(b2.bo, 0), -7.0) AS lp FROM x LEFT JOIN m p1 ON p1.n = 1 AND p1.ngram = g1 LEFT JOIN m p2 ON p2.n = 2 AND p2.ngram = g2 LEFT JOIN m p3 ON p3.n = 3 AND p3.ngram = g3
  LEFT JOIN m b1 ON b1.n = 1 AND b1.ngram = h1 LEFT JOIN m b2 ON b2.n = 2 AND b2.ngram = h2)
SELECT id, round(sum(lp), 6) AS logprob, count(*) AS tokens, count(*) FILTER (p1 IS NULL) AS unknown, round(sum(lp) / count(*), 6) AS per_token FROM y GROUP BY id""",
)
def sentence_scores(spark: SparkSession, d: str) -> DataFrame:
    model = language.language_model(language.ngram_counts(_sentences(spark, d)))
    s = table(spark, d, "snippets").select("id", F.col("text").alias("sentence")).where("sentence IS NOT NULL").distinct()
    return language.score_sentences(s, model, ["id"]).withColumns({"logprob": F.round("logprob", 6), "per_token": F.round("per_token", 6)})


_TOP3 = _grams_sql("2", False) + ", k AS (SELECT doc_id, count(*) AS k, avg(score) AS m, array_to_string(list_sort(list(ngram)), ', ') AS keyword_set FROM top WHERE rank <= 3 GROUP BY doc_id)"


@R.add("keyword_sets", _TOP3 + " SELECT keyword_set, count(*) AS documents FROM k GROUP BY keyword_set")
def keyword_sets(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents"), "doc_id")
    top = tfidf.top_terms(tfidf.frequencies(docs, (2,)), docs.count(), 3)
    return counting.keyword_stats(top)[1]


@R.add("keyword_summary", _TOP3 + " SELECT count(*) AS documents, sum(k)::BIGINT AS keywords, round(avg(m), 6) AS mean_score, (SELECT count(DISTINCT ngram) FROM top WHERE rank <= 3) AS distinct_keywords FROM k")
def keyword_summary(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents"), "doc_id")
    return counting.keyword_stats(tfidf.top_terms(tfidf.frequencies(docs, (2,)), docs.count(), 3))[0].withColumn("mean_score", F.round("mean_score", 6))


@R.add(
    "arpa_lines",
    f"""WITH {_LM}, h AS (SELECT *, CASE WHEN n > 1 THEN regexp_replace(ngram, ' [^ ]+$', '') ELSE '' END AS history FROM cnt),
t AS (SELECT n, history, sum(c) AS total, count(*) AS types FROM h WHERE ngram <> '<s>' OR n > 1 GROUP BY n, history)
SELECT h.n, ngram, round(CASE WHEN h.n = 1 THEN log10(c / total) ELSE log10((c - 0.5) / total) END, 6) AS logprob FROM h JOIN t USING (n, history)""",
)
def arpa_lines(spark: SparkSession, d: str) -> DataFrame:
    """The n-grams and probabilities that a round trip through ARPA text keeps."""
    model = language.language_model(language.ngram_counts(_sentences(spark, d)))
    return language.from_arpa(language.to_arpa(model)).select("n", "ngram", F.round("logprob", 6).alias("logprob"))
