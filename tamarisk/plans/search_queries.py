"""Queries of lookups, search, similarity, evaluation and matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.operators import columns, counting, evaluation, lookups, matrix, search
from tamarisk.plans.registry import Registry
from tamarisk.plans.scale import lookup, new_folder, spread, table

R = Registry()

# Lookups


@R.add("lookup_with_default", "SELECT o_orderkey, coalesce(n.n_name, 'NONE') AS nation FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON c_nationkey = n_nationkey")
def lookup_with_default(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("value"))
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    return lookups.with_default(o, names, F.col("c_nationkey").cast("string"), "NONE", "nation").select("o_orderkey", "nation")


_TOK = "SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents"


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"), "doc_id").select("doc_id", F.explode(counting.matches(F.lower("text"), "[a-z]+")).alias("token")).distinct()


@R.add("spelling_not_listed", f"SELECT DISTINCT doc_id, token FROM ({_TOK}) WHERE token NOT IN (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) FROM snippets WHERE text IS NOT NULL)")
def spelling_not_listed(spark: SparkSession, d: str) -> DataFrame:
    dictionary = table(spark, d, "snippets").select(F.explode(counting.matches(F.lower("text"), "[a-z]+")).alias("token"))
    return lookups.not_listed(_tokens(spark, d), dictionary)


@R.add("labels_in_documents", f"SELECT DISTINCT doc_id, token FROM ({_TOK}) WHERE token IN (SELECT label FROM snippet_labels)")
def labels_in_documents(spark: SparkSession, d: str) -> DataFrame:
    return lookups.listed(_tokens(spark, d), table(spark, d, "snippet_labels").select(F.col("label").alias("token")))


@R.add("lookup_table", "SELECT trim(split_part(t, '|', 1)) AS key, arg_max(substr(t, strpos(t, '|') + 1), line_id) AS value FROM (SELECT line_id, lower(text) AS t FROM raw_lines) WHERE contains(t, '|') GROUP BY 1")
def lookup_table(spark: SparkSession, d: str) -> DataFrame:
    return lookups.lookup_table(table(spark, d, "raw_lines"), "text", "line_id", "|")


@R.add("boolean_table", "SELECT DISTINCT lower(trim(split_part(text, ',', 1))) AS key FROM raw_lines WHERE trim(split_part(text, ',', 1)) <> ''")
def boolean_table(spark: SparkSession, d: str) -> DataFrame:
    return lookups.boolean_table(table(spark, d, "raw_lines"), "text", ",")


@R.add("frequency_table", "SELECT lower(trim(split_part(text, chr(9), 1))) AS word, arg_min(split_part(text, chr(9), 2), line_id) AS freq FROM raw_lines WHERE NOT starts_with(text, '#') AND len(string_split(text, chr(9))) = 2 GROUP BY 1")
def frequency_table(spark: SparkSession, d: str) -> DataFrame:
    return lookups.frequency_table(table(spark, d, "raw_lines"), "text", "line_id")


@R.add(
    "transitive_closure",
    "WITH RECURSIVE e AS (SELECT DISTINCT p_size % 40 AS src, (p_size * 7 + 3) % 41 AS dst FROM part), c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src) SELECT src, dst FROM c",
)
def transitive_closure(spark: SparkSession, d: str) -> DataFrame:
    return lookups.closure(table(spark, d, "part").selectExpr("p_size % 40 AS src", "(p_size * 7 + 3) % 41 AS dst"))


# Names and codes of the sixteen basic web colours.
COLOURS = {"aqua": "00ffff", "black": "000000", "blue": "0000ff", "fuchsia": "ff00ff", "gray": "808080", "green": "008000", "lime": "00ff00", "maroon": "800000", "navy": "000080", "olive": "808000", "purple": "800080", "red": "ff0000", "silver": "c0c0c0", "teal": "008080", "white": "ffffff", "yellow": "ffff00"}
_PAL = ", ".join(f"('{n}', ('0x' || '{h[:2]}')::INT, ('0x' || '{h[2:4]}')::INT, ('0x' || '{h[4:]}')::INT)" for n, h in COLOURS.items())


@R.add(
    "nearest_colour",
    rf"""WITH h AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\b[0-9a-f]{{6}}\b')) AS hex FROM documents), p(name, r, g, b) AS (VALUES {_PAL}),
x AS (SELECT hex, name, pow(('0x' || hex[1:2])::INT - r, 2) + pow(('0x' || hex[3:4])::INT - g, 2) + pow(('0x' || hex[5:6])::INT - b, 2) AS d FROM h, p)
SELECT hex, arg_min(name, (d, name)) AS colour, min(d)::INT AS distance FROM x GROUP BY hex""",
)
def nearest_colour(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "documents").select(F.explode(counting.matches("text", r"\b[0-9a-f]{6}\b")).alias("hex")).distinct()
    return lookups.nearest_colour(h, spark.createDataFrame(list(COLOURS.items()), "name string, hex string"), "hex")


@R.add("latest_before", "WITH e AS (SELECT user_id, ts, event_id, event_type, value FROM events WHERE ts IS NOT NULL) SELECT a.event_id, (SELECT arg_max(value, ts) FROM e b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND b.ts <= a.ts) AS latest_value FROM e a WHERE event_type = 'click'")
def latest_before(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("ts IS NOT NULL")
    return lookups.latest_before(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), e.where("event_type = 'purchase'").select("user_id", "ts", "value"), "user_id", "ts", "value").select("event_id", "latest_value")


# Search

_IDX = "idx AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY ALL)"


def _index(spark: SparkSession, d: str) -> DataFrame:
    return search.inverted_index(spread(table(spark, d, "documents"), "doc_id"))


@R.add("inverted_index", f"WITH {_IDX} SELECT * FROM idx")
def inverted_index(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d)


@R.add("search_any", f"WITH {_IDX} SELECT doc_id, count(*) AS matched FROM idx WHERE term IN ('museum', 'bridge', 'insulin') GROUP BY doc_id")
def search_any(spark: SparkSession, d: str) -> DataFrame:
    return search.boolean_search(_index(spark, d), ["museum", "bridge", "insulin"])


@R.add("search_all", f"WITH {_IDX} SELECT doc_id, count(*) AS matched FROM idx WHERE term IN ('museum', 'bridge') GROUP BY doc_id HAVING count(*) = 2")
def search_all(spark: SparkSession, d: str) -> DataFrame:
    return search.boolean_search(_index(spark, d), ["Museum", "bridge"], conjunctive=True)


@R.add(
    "search_phrase",
    """WITH j AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), '  ') || ' ' AS j FROM documents WHERE text IS NOT NULL)
SELECT doc_id, ((length(j) - length(replace(j, ' wild  flowers ', ''))) // 15)::INT AS occurrences FROM j WHERE contains(j, ' wild  flowers ')""",
)
def search_phrase(spark: SparkSession, d: str) -> DataFrame:
    return search.phrase_search(table(spark, d, "documents"), "wild flowers")


@R.add("query_hits", f"WITH {_IDX}, q AS (SELECT car_name, name_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(car_name), '[a-z0-9]+'))) AS term FROM car_names) SELECT query_id, count(DISTINCT doc_id) AS documents, sum(tf)::BIGINT AS occurrences FROM idx JOIN q USING (term) GROUP BY query_id")
def query_hits(spark: SparkSession, d: str) -> DataFrame:
    return search.query_hits(_index(spark, d), table(spark, d, "car_names").select(F.col("name_id").alias("query_id"), F.col("car_name").alias("query")))


@R.add(
    "document_neighbours",
    f"""WITH {_IDX}, n AS (SELECT count(*) AS n FROM documents), df AS (SELECT term, count(*) AS df FROM idx GROUP BY term),
w AS (SELECT doc_id, term, tf * ln(n::DOUBLE / df) AS w FROM idx JOIN df USING (term), n WHERE df < n),
u AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM w),
s AS (SELECT a.doc_id AS query, b.doc_id, sum(a.w * b.w) AS s FROM u a JOIN u b ON a.term = b.term AND a.doc_id <> b.doc_id AND a.doc_id % 50 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(s, 9) DESC, doc_id) AS rank FROM s)
SELECT query, doc_id, round(s, 6) AS similarity, rank FROM r WHERE rank <= 5""",
)
def document_neighbours(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    v = search.tfidf_vectors(_index(spark, d), docs.count())
    return search.cosine_neighbours(v, F.col("doc_id") % 50 == 0, 5).withColumn("similarity", F.round("similarity", 6))


_EMB = "SELECT a.vec_id AS query, b.vec_id, {0} AS s FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id"


@R.add("embedding_l2_neighbours", "WITH s AS (" + _EMB.format("sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: pow(p[1]::DOUBLE - p[2]::DOUBLE, 2))))") + "), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(s, 9), vec_id) AS rank FROM s) SELECT query, vec_id, round(s, 6) AS distance, rank FROM r WHERE rank <= 5")
def embedding_l2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return search.vector_neighbours(e, F.col("vec_id") % 50 == 0, 5).withColumn("distance", F.round("distance", 6))


@R.add("embedding_cosine_neighbours", "WITH s AS (" + _EMB.format("list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])") + "), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(s, 9) DESC, vec_id) AS rank FROM s) SELECT query, vec_id, round(s, 6) AS similarity, rank FROM r WHERE rank <= 5")
def embedding_cosine_neighbours(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return search.vector_neighbours(e, F.col("vec_id") % 50 == 0, 5, metric="cosine").withColumn("similarity", F.round("similarity", 6))


@R.add("embedding_lsh_neighbours")
def embedding_lsh_neighbours(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return search.lsh_neighbours(e, e.where("vec_id % 50 = 0"), 5)


@R.add("document_chunks", "SELECT doc_id, s::INT AS start_index, substr(text, s::INT + 1, 500) AS content FROM documents, unnest(range(0, greatest(length(text) - 51, 0) + 1, 450)) AS u(s) WHERE length(text) > 0")
def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    return search.chunks(table(spark, d, "documents"))


# Questions to the store of chunks.
QUESTIONS = ("a quiet museum near the bridge", "insulin and glucose of the patient", "failed tests of the build")
_VECTOR = "list_transform(range(0, 64), lambda d: len(list_filter(list_transform(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: ('0x' || left(md5(w), 4))::INT % 64), lambda x: x = d))::DOUBLE)"


@R.add(
    "chunk_search",
    f"""WITH c AS (SELECT doc_id * 1000000 + s AS vec_id, substr(text, s::INT + 1, 500) AS content FROM documents, unnest(range(0, greatest(length(text) - 51, 0) + 1, 450)) AS u(s) WHERE length(text) > 0),
v AS (SELECT vec_id, {_VECTOR.format('content')} AS v FROM c), q AS (SELECT i - 1 AS query, {_VECTOR.format('t')} AS q FROM (SELECT unnest(range(1, 4)) AS i, unnest([{', '.join(f"'{x}'" for x in QUESTIONS)}]) AS t)),
s AS (SELECT query, vec_id, list_cosine_similarity(v, q) AS s FROM v, q WHERE list_sum(v) > 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(s, 9) DESC, vec_id) AS rank FROM s)
SELECT query, vec_id, round(s, 6) AS similarity, rank FROM r WHERE rank <= 10""",
)
def chunk_search(spark: SparkSession, d: str) -> DataFrame:
    """A store of chunks that is filled in two goes, and searched."""
    at = new_folder(spark)
    docs = table(spark, d, "documents")
    search.add_chunks(docs.where("doc_id % 2 = 0"), at)
    search.add_chunks(docs.where("doc_id % 2 <> 0 OR doc_id IS NULL"), at)
    asked = spark.createDataFrame(list(enumerate(QUESTIONS)), "query bigint, text string")
    return search.search_chunks(spark.read.parquet(at), asked).withColumn("similarity", F.round("similarity", 6))


# Evaluation: the class of diabetes records, guessed from glucose

_CLS = """c AS (SELECT DISTINCT record_id, trim("class") AS a, CASE WHEN glucose >= 125 THEN '1' ELSE '0' END AS p, glucose FROM diabetes WHERE trim("class") IN ('0', '1'))"""


def _guessed(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "diabetes").select("record_id", F.trim("class").alias("a"), F.when(F.col("glucose") >= 125, "1").otherwise("0").alias("p"), "glucose")
    return t.where("a IN ('0', '1')").distinct()


@R.add("confusion_matrix", f"WITH {_CLS} SELECT a, count(*) FILTER (p = '0') AS pred_0, count(*) FILTER (p = '1') AS pred_1 FROM c GROUP BY a")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.confusion(_guessed(spark, d), "a", "p", ["0", "1"])


_BIN = f"WITH {_CLS}, x AS (SELECT count(*) FILTER (a = '1' AND p = '1') AS tp, count(*) FILTER (a = '0' AND p = '1') AS fp, count(*) FILTER (a = '1' AND p = '0') AS fn, count(*) FILTER (a = '0' AND p = '0') AS tn FROM c), y AS (SELECT *, (tp + tn) / (tp + fp + fn + tn) AS acc, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / pow(tp + fp + fn + tn, 2) AS e FROM x)"


@R.add("binary_scores", _BIN + " SELECT tp, fp, fn, tn, round(acc, 9) AS accuracy, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1, round((acc - e) / (1 - e), 9) AS kappa FROM y")
def binary_scores(spark: SparkSession, d: str) -> DataFrame:
    s = evaluation.binary_scores(_guessed(spark, d), F.col("a"), F.col("p"))
    return s.select("tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in s.columns[4:]])


@R.add("class_report", f"WITH {_CLS}, l AS (SELECT unnest(['0', '1']) AS label), s AS (SELECT label, count(*) FILTER (a = label) AS support, count(*) FILTER (p = label) AS guessed, count(*) FILTER (a = label AND p = label) AS tp FROM c, l GROUP BY label) SELECT label, round(tp / guessed, 9) AS precision, round(tp / support, 9) AS recall, round(2 * tp / (guessed + support), 9) AS f1, support FROM s")
def class_report(spark: SparkSession, d: str) -> DataFrame:
    t = evaluation.class_report(_guessed(spark, d), "a", "p")
    return t.select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@R.add("precision_recall_curve", f"WITH {_CLS}, g AS (SELECT glucose AS threshold, count(*) FILTER (a = '1') AS p, count(*) AS n FROM c WHERE glucose IS NOT NULL GROUP BY 1), r AS (SELECT threshold, sum(p) OVER (ORDER BY threshold DESC) AS tp, sum(n) OVER (ORDER BY threshold DESC) AS s, sum(p) OVER () AS t FROM g) SELECT threshold, tp::BIGINT AS tp, (s - tp)::BIGINT AS fp, round(tp / s, 9) AS precision, round(tp / t, 9) AS recall FROM r")
def precision_recall_curve(spark: SparkSession, d: str) -> DataFrame:
    c = evaluation.curve(_guessed(spark, d), F.col("a"), F.col("glucose"))
    return c.select("threshold", "tp", "fp", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@R.add("roc_auc", f"WITH {_CLS}, g AS (SELECT glucose AS s, count(*) FILTER (a = '1') AS p, count(*) FILTER (a = '0') AS q FROM c WHERE glucose IS NOT NULL GROUP BY 1), b AS (SELECT p, q, sum(q) OVER (ORDER BY s) - q AS below FROM g) SELECT round(sum(p * (below + q / 2)) / (sum(p) * sum(q)), 9) AS auc FROM b")
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.roc_auc(_guessed(spark, d), F.col("a"), F.col("glucose")).withColumn("auc", F.round("auc", 9))


@R.add("regression_lines", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, regr_count(l_extendedprice, l_quantity)::BIGINT AS n FROM lineitem GROUP BY l_returnflag")
def regression_lines(spark: SparkSession, d: str) -> DataFrame:
    t = evaluation.regression_line(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"])
    return t.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r2", 6).alias("r2"), "n")


@R.add("trailing_split", "SELECT event_id, CASE WHEN row_number() OVER (ORDER BY event_id) <= count(*) OVER () - ceil(count(*) OVER () * 0.2) THEN 'train' ELSE 'test' END AS part FROM events")
def trailing_split(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.trailing_split(table(spark, d, "events").select("event_id"), "event_id", 20)


# Matrices


@R.add("matrix_product", "SELECT o_orderpriority AS i, c_mktsegment AS j, round(sum(o_totalprice), 2) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def matrix_product(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").select(F.col("o_orderpriority").alias("i"), F.col("o_custkey").alias("j"), F.col("o_totalprice").alias("v"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("i"), F.col("c_mktsegment").alias("j"), F.lit(1.0).alias("v"))
    return matrix.multiply(a, b).withColumn("v", F.round("v", 2))


@R.add("gram_matrix", "WITH x AS (SELECT vec_id, i - 1 AS i, embedding[i]::DOUBLE AS v FROM embeddings, unnest(range(1, 65)) AS u(i)) SELECT a.i::INT AS i, b.i::INT AS j, round(sum(a.v * b.v), 4) AS v FROM x a JOIN x b USING (vec_id) GROUP BY ALL")
def gram_matrix(spark: SparkSession, d: str) -> DataFrame:
    return matrix.gram(table(spark, d, "embeddings"), "embedding", 64).withColumn("v", F.round("v", 4))


@R.add("resolved_terms", f"WITH {_IDX}, v AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS id FROM (SELECT DISTINCT term FROM idx)) SELECT doc_id, id, term, tf FROM idx JOIN v USING (term)")
def resolved_terms(spark: SparkSession, d: str) -> DataFrame:
    idx = _index(spark, d)
    return lookup(idx, columns.ids_by_name(idx, "term"), ["term"], "inner").select("doc_id", "id", "term", "tf")


@R.add("relabelled", "SELECT o_orderkey, coalesce(CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' END, o_orderstatus) AS o_orderstatus FROM orders")
def relabelled(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame([("O", "open"), ("F", "filled")], "key string, value string")
    return lookups.relabel(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), t, "o_orderstatus")


@R.add("pairs_table", "SELECT lower(split_part(text, chr(9), 1)) AS key, arg_max(split_part(text, chr(9), 2), line_id) AS value FROM raw_lines WHERE len(string_split(text, chr(9))) = 2 GROUP BY 1")
def pairs_table(spark: SparkSession, d: str) -> DataFrame:
    return lookups.pairs_table(table(spark, d, "raw_lines"), "text", "line_id")


@R.add("orders_without_items", "SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def orders_without_items(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return lookups.missing_rows(table(spark, d, "orders").select("o_orderkey"), items)
