"""Queries of term extraction and TF-IDF over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.functions import text
from tamarisk.operators import tfidf
from tamarisk.plans.registry import Registry
from tamarisk.plans.scale import spread, table

R = Registry()

_STOP = ", ".join(f"'{w}'" for w in tfidf.STOP_WORDS)


def _grams_sql(sizes: str, stop: bool) -> str:
    keep = f"list_filter(w, lambda x: regexp_replace(x, '(n''t|''s|''re|''ll)$', '') NOT IN ({_STOP}))" if stop else "w"
    return rf"""
WITH cl AS (SELECT doc_id, row_number() OVER () AS c, clause FROM (SELECT doc_id, unnest(regexp_extract_all({text.CLEAN_SQL.format("text")}, '[^:;!^,?.\[|\]()"`]+')) AS clause FROM documents)),
ws AS (SELECT doc_id, {keep} AS w FROM (SELECT doc_id, regexp_extract_all(clause, '[^ \t\r\n]+') AS w FROM cl)),
g AS (SELECT doc_id, array_to_string(w[i : i + k - 1], ' ') AS ngram FROM ws, unnest(range(1, len(w) + 1)) AS a(i), unnest([{sizes}]) AS b(k) WHERE i + k - 1 <= len(w)),
ok AS (SELECT * FROM g WHERE regexp_full_match(ngram, '[a-zA-Z0-9_''$ \-]+')),
tf AS (SELECT doc_id, ngram, count(*) AS tf, sum(count(*)) OVER (PARTITION BY doc_id) AS doc_len FROM ok GROUP BY doc_id, ngram),
df AS (SELECT ngram, count(*) AS df FROM tf GROUP BY ngram),
n AS (SELECT count(*) AS n FROM documents),
s AS (SELECT doc_id, ngram, tf, df, tf / doc_len * ln(n::DOUBLE / df) AS score FROM tf JOIN df USING (ngram), n),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, ngram) AS rank FROM s)
"""


def _docs(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    docs = table(spark, d, "documents")
    return spread(docs, "doc_id"), docs.count()


@R.add("tfidf_top_bigrams", _grams_sql("2", False) + "SELECT doc_id, ngram, tf, df, round(score, 6) AS score, rank FROM top WHERE rank <= 10")
def tfidf_top_bigrams(spark: SparkSession, d: str) -> DataFrame:
    docs, n = _docs(spark, d)
    return tfidf.top_terms(tfidf.frequencies(docs, (2,)), n, 10).withColumn("score", F.round("score", 6))


@R.add("tfidf_top_terms_no_stop", _grams_sql("1, 2", True) + "SELECT doc_id, ngram, tf, df, round(score, 6) AS score, rank FROM top WHERE rank <= 5")
def tfidf_top_terms_no_stop(spark: SparkSession, d: str) -> DataFrame:
    docs, n = _docs(spark, d)
    return tfidf.top_terms(tfidf.frequencies(docs, (1, 2), tfidf.STOP_WORDS), n, 5).withColumn("score", F.round("score", 6))


_W = """, m AS (SELECT doc_id, max(tf) AS mx FROM tf GROUP BY doc_id), g2 AS (SELECT max(tf) AS most FROM tf),
w AS (SELECT doc_id, ngram, tf, df, round(tf / doc_len, 6) AS tf_basic, round(1 + ln(tf / doc_len), 6) AS tf_log, 1.0::DOUBLE AS tf_binary, round(0.5 + 0.5 * (tf / doc_len / mx), 6) AS tf_norm_50, tf::DOUBLE AS tf_freq,
  round(ln(n::DOUBLE / df), 6) AS idf_basic, round(1.0::DOUBLE / df, 6) AS idf_freq, round(ln(1 + n::DOUBLE / df), 6) AS idf_smooth, round(ln(1 + most::DOUBLE / df), 6) AS idf_max,
  round(CASE WHEN (n - df)::DOUBLE / df + 1e-6 > 0 THEN ln((n - df)::DOUBLE / df + 1e-6) ELSE 0 END, 6) AS idf_prob
  FROM tf JOIN df USING (ngram) JOIN m USING (doc_id), n, g2)
"""


@R.add("tfidf_weightings", _grams_sql("1", False) + _W + "SELECT * FROM w")
def tfidf_weightings(spark: SparkSession, d: str) -> DataFrame:
    docs, n = _docs(spark, d)
    w = tfidf.weights(tfidf.frequencies(docs, (1,)), n)
    return w.select("doc_id", "ngram", "tf", "df", *[F.round(c, 6).alias(c) for c in w.columns[4:]])


@R.add("tfidf_df_norm", _grams_sql("1", False) + "SELECT ngram, df, freq, round(df / (SELECT max(df) FROM df), 6) AS df_norm, round(df / n, 6) AS df_share FROM df JOIN (SELECT ngram, sum(tf)::BIGINT AS freq FROM tf GROUP BY ngram) USING (ngram), n")
def tfidf_df_norm(spark: SparkSession, d: str) -> DataFrame:
    docs, n = _docs(spark, d)
    t = tfidf.df_table(tfidf.frequencies(docs, (1,)), n)
    return t.select("ngram", "df", "freq", F.round("df_norm", 6).alias("df_norm"), F.round("df_share", 6).alias("df_share"))


@R.add("tfidf_filter_extremes", _grams_sql("1", False) + "SELECT ngram, df FROM df, n WHERE df >= 5 AND df <= 0.1 * n ORDER BY df DESC, ngram LIMIT 200")
def tfidf_filter_extremes(spark: SparkSession, d: str) -> DataFrame:
    docs, n = _docs(spark, d)
    return tfidf.filter_extremes(tfidf.df_table(tfidf.frequencies(docs, (1,)), n), n, 5, 0.1, 200).select("ngram", "df")


@R.add("tfidf_df_bounds", _grams_sql("1", False) + ", b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, ngram) AS r2 FROM s, n WHERE df >= 3 AND df <= 0.2 * n) SELECT doc_id, ngram, tf, df, round(score, 6) AS score, r2 AS rank FROM b WHERE r2 <= 3")
def tfidf_df_bounds(spark: SparkSession, d: str) -> DataFrame:
    docs, n = _docs(spark, d)
    return tfidf.top_terms(tfidf.frequencies(docs, (1,)), n, 3, min_df=3, max_df=0.2).withColumn("score", F.round("score", 6))


_CLASH = """contains(' ' || a.ngram || ' ', ' ' || b.ngram || ' ') OR contains(' ' || b.ngram || ' ', ' ' || a.ngram || ' ')"""
_OVERLAP = """ OR len(list_filter(range(1, least(len(a.w), len(b.w)) + 1), lambda k: a.w[len(a.w) - k + 1 :] = b.w[: k] OR b.w[len(b.w) - k + 1 :] = a.w[: k])) > 0"""


@R.add(
    "tfidf_pruned_terms",
    _grams_sql("1, 2, 3", True)
    + f""", t AS (SELECT doc_id, ngram, score, rank, string_split(ngram, ' ') AS w FROM top WHERE rank <= 100),
k AS (SELECT * FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.doc_id = a.doc_id AND b.rank < a.rank AND ({_CLASH}{_OVERLAP})))
SELECT doc_id, ngram, round(score, 6) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY rank) AS rank FROM k""",
)
def tfidf_pruned_terms(spark: SparkSession, d: str) -> DataFrame:
    docs, n = _docs(spark, d)
    return tfidf.prune(tfidf.top_terms(tfidf.frequencies(docs, (1, 2, 3), tfidf.STOP_WORDS), n)).withColumn("score", F.round("score", 6))


@R.add(
    "tfidf_boosted_terms",
    _grams_sql("2", False)
    + f""", t AS (SELECT doc_id, ngram, string_split(ngram, ' ') AS w, score FROM top WHERE rank <= 100),
b AS (SELECT doc_id, ngram, score
  * CASE WHEN list_has_any(w, ['museum', 'bridge']) THEN 2.0 ELSE 1.0 END * CASE WHEN list_has_any(w, ['once']) THEN 0.5 ELSE 1.0 END
  * CASE WHEN len(list_filter(w, lambda x: try_cast(x AS DOUBLE) IS NOT NULL)) > 0 THEN 0.25 ELSE 1.0 END
  * pow(0.5, len(list_filter(w, lambda x: x IN ({_STOP})))) AS score FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, ngram) AS rank FROM b)
SELECT doc_id, ngram, round(score, 6) AS score, rank FROM r WHERE rank <= 5""",
)
def tfidf_boosted_terms(spark: SparkSession, d: str) -> DataFrame:
    docs, n = _docs(spark, d)
    top = tfidf.top_terms(tfidf.frequencies(docs, (2,)), n)
    out = tfidf.boost(top, good=["museum", "bridge"], bad=["once"], good_by=2.0, bad_by=0.5, numeric_by=0.25, stop_by=0.5)
    return out.where("rank <= 5").select("doc_id", "ngram", F.round("score", 6).alias("score"), "rank")


@R.add("tfidf_report", _grams_sql("2", True) + "SELECT doc_id, array_to_string(list(ngram || ':' || format('{:.2f}', score) ORDER BY rank), ', ') AS terms FROM top WHERE rank <= 3 GROUP BY doc_id")
def tfidf_report(spark: SparkSession, d: str) -> DataFrame:
    docs, n = _docs(spark, d)
    return tfidf.report(tfidf.top_terms(tfidf.frequencies(docs, (2,), tfidf.STOP_WORDS), n, 3), limit=3, places=2)


@R.add(
    "term_positions",
    """WITH p AS (SELECT doc_id, string_split(lower(text), 'museum') AS p FROM documents WHERE text IS NOT NULL),
o AS (SELECT doc_id, i, list_sum(list_transform(p[:i], lambda x: length(x))) + (i - 1) * 6 AS start FROM p, unnest(range(1, len(p))) AS u(i))
SELECT o.doc_id, start::INT AS start, (start + 6)::INT AS "end", substr(text, start::INT + 1, 6) AS original FROM o JOIN documents USING (doc_id)""",
)
def term_positions(spark: SparkSession, d: str) -> DataFrame:
    return tfidf.positions(table(spark, d, "documents"), "museum")


@R.add("clean_text", f"SELECT doc_id, {text.CLEAN_SQL.format('text')} AS cleaned FROM documents")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"), "doc_id").select("doc_id", text.clean("text").alias("cleaned"))


@R.add("term_matrix", _grams_sql("1", False) + "SELECT doc_id, coalesce(sum(tf) FILTER (ngram = 'museum'), 0)::BIGINT AS museum, coalesce(sum(tf) FILTER (ngram = 'bridge'), 0)::BIGINT AS bridge FROM tf GROUP BY doc_id")
def term_matrix(spark: SparkSession, d: str) -> DataFrame:
    return tfidf.term_matrix(tfidf.frequencies(_docs(spark, d)[0]), ["museum", "bridge"])


@R.add("score_of_term", _grams_sql("1", False) + "SELECT doc_id, round(score, 6) AS score FROM s WHERE ngram = 'museum'")
def score_of_term(spark: SparkSession, d: str) -> DataFrame:
    docs, n = _docs(spark, d)
    return tfidf.score_of(tfidf.frequencies(docs), n, "museum").withColumn("score", F.round("score", 6))


@R.add("documents_of_files", "SELECT file_name AS doc_id, string_agg(text, ' ' ORDER BY line_no, line_id) AS text FROM raw_lines GROUP BY file_name")
def documents_of_files(spark: SparkSession, d: str) -> DataFrame:
    return tfidf.documents_of(table(spark, d, "raw_lines"), "file_name", "text", ["line_no", "line_id"])


@R.add("random_terms")
def random_terms(spark: SparkSession, d: str) -> DataFrame:
    docs, n = _docs(spark, d)
    return tfidf.random_term(tfidf.top_terms(tfidf.frequencies(docs), n, 100))


_STOPS = ", ".join(f"'{w}'" for w in tfidf.STOP_WORDS)


@R.add("without_stop_words", f"SELECT id, array_to_string(list_filter(string_split(lower(text), ' '), lambda w: w NOT IN ({_STOPS})), ' ') AS text FROM snippets WHERE text IS NOT NULL")
def without_stop_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "snippets").where("text IS NOT NULL").select("id", text.without_stop_words("text", list(tfidf.STOP_WORDS)).alias("text"))
