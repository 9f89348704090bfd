"""Queries of sources, sampling, learning and streaming."""

from __future__ import annotations

import time

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.operators import learning, sampling
from tamarisk.plans.registry import Registry
from tamarisk.plans.scale import new_folder, table, written
from tamarisk.sources import tabular
from tamarisk.streaming import events as streams

R = Registry()


_place = new_folder

# Sources


@R.add("csv_round_trip", "SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey, c_mktsegment FROM customer")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    at = _place(spark)
    tabular.write_delimited(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), at)
    return tabular.read_delimited(spark, at, comments=False)


@R.add("tsv_round_trip", "SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_brand, p_type FROM part")
def tsv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    at = _place(spark) + ".tsv"
    tabular.write_delimited(table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type"), at, "tab")
    return tabular.read_delimited(spark, at, "tab")


@R.add("json_round_trip", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    lines, array = _place(spark), _place(spark)
    table(spark, d, "nation").write.json(lines)
    tabular.lines_to_json(spark, lines).select("json").write.text(array)
    return tabular.records(spark, array, ["n_nationkey", "n_name", "n_regionkey"])


@R.add("labelled_round_trip", "SELECT lower(label) AS label, regexp_replace(text, '[\t\n]', ' ', 'g') AS text FROM snippets WHERE label IS NOT NULL AND text IS NOT NULL")
def labelled_round_trip(spark: SparkSession, d: str) -> DataFrame:
    at = _place(spark)
    tabular.write_labelled(table(spark, d, "snippets").where("label IS NOT NULL AND text IS NOT NULL"), at, "label", "text")
    return tabular.read_labelled(spark, at)


@R.add("csv_line_breaks", "SELECT doc_id::VARCHAR AS doc_id, coalesce(text, '') AS text, coalesce(source, '') AS source FROM documents")
def csv_line_breaks(spark: SparkSession, d: str) -> DataFrame:
    """Texts with quotes, separators and line breaks through a CSV file and back."""
    at = _place(spark)
    tabular.write_delimited(table(spark, d, "documents").select("doc_id", "text", "source"), at)
    return tabular.read_delimited(spark, at, comments=False, multiline=True)


@R.add("dialect_round_trip", "SELECT DISTINCT id::VARCHAR AS id, regexp_replace(text, '[\r\n]', ' ', 'g') AS text, coalesce(site, '') AS site FROM snippets WHERE text IS NOT NULL")
def dialect_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Texts with quotes and separators through the dialect whose quotes are escaped by a backslash."""
    at = _place(spark)
    s = table(spark, d, "snippets").where("text IS NOT NULL").select("id", F.regexp_replace("text", r"[\r\n]", " ").alias("text"), "site").distinct()
    tabular.write_delimited(s, at, "pyspark")
    return tabular.read_delimited(spark, at, "pyspark")


@R.add("headers_by_file", "SELECT n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation UNION ALL SELECT 'n_name', 'n_regionkey'")
def headers_by_file(spark: SparkSession, d: str) -> DataFrame:
    """Several files with a header each, and one data row that reads like the header."""
    at = _place(spark)
    rows = table(spark, d, "nation").selectExpr("n_name", "CAST(n_regionkey AS string) AS n_regionkey")
    rows = rows.unionByName(spark.createDataFrame([("n_name", "n_regionkey")], rows.schema))
    tabular.write_delimited(rows.repartition(3), at)
    return tabular.read_delimited(spark, at)


@R.add("sniffed_dialect", "SELECT '|' AS sep, '\"' AS quote")
def sniffed_dialect(spark: SparkSession, d: str) -> DataFrame:
    at = _place(spark)
    tabular.write_delimited(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), at, sep="|")
    o = tabular.sniff(spark, at)
    return spark.createDataFrame([(o["sep"], o["quote"])], "sep string, quote string")


def _named_lines(spark: SparkSession, d: str) -> DataFrame:
    """The nations in one file, a line each, in order."""
    at = _place(spark)
    lines = table(spark, d, "nation").select(F.concat("n_name", F.lit(" ; nation # "), F.col("n_nationkey").cast("string")).alias("line"), "n_nationkey")
    tabular.write_lines(lines.coalesce(1).sortWithinPartitions("n_nationkey"), "line", at)
    return spark.createDataFrame([(at,)], "at string")


@R.add("file_lines", "SELECT row_number() OVER (ORDER BY n_nationkey)::INT AS line_no, n_name || ' ' AS line FROM nation")
def file_lines(spark: SparkSession, d: str) -> DataFrame:
    at = _named_lines(spark, d).first().at
    return tabular.read_lines(spark, at, comments=True).select("line_no", "line")


@R.add("numbered_table", "SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::VARCHAR AS key, n_name || ' ; nation # ' || n_nationkey AS value FROM nation")
def numbered_table(spark: SparkSession, d: str) -> DataFrame:
    return tabular.numbered_table(tabular.read_lines(spark, _named_lines(spark, d).first().at))


@R.add("whole_files", "SELECT string_agg(n_name || ' ; nation # ' || n_nationkey || chr(10), '' ORDER BY n_nationkey) AS text, sum(length(n_name || ' ; nation # ' || n_nationkey) + 1)::BIGINT AS length, true AS same FROM nation")
def whole_files(spark: SparkSession, d: str) -> DataFrame:
    """A file as text and as bytes."""
    at = _named_lines(spark, d).first().at
    text, data = tabular.read_text(spark, at).where("text <> ''"), tabular.read_bytes(spark, at).where("length > 0 AND path LIKE '%.txt'")
    return text.select("text", F.lit(1).alias("k")).join(data.select("length", "content", F.lit(1).alias("k")), "k").select("text", "length", (F.encode("text", "UTF-8") == F.col("content")).alias("same"))


@R.add("listed_folders", "SELECT DISTINCT 'n_regionkey=' || n_regionkey AS name, true AS directory FROM nation UNION ALL SELECT '_SUCCESS', false")
def listed_folders(spark: SparkSession, d: str) -> DataFrame:
    at = _place(spark)
    table(spark, d, "nation").write.partitionBy("n_regionkey").parquet(at)
    return tabular.directory_listing(spark, at).select("name", "directory")


@R.add("newer_files", "SELECT 'txt' AS extension, 3::BIGINT AS files")
def newer_files(spark: SparkSession, d: str) -> DataFrame:
    """Text files written after the newest file of an index; a file before it and files of another kind are not among them."""
    at, index = _place(spark), _place(spark)
    n = table(spark, d, "nation").select(F.col("n_name").alias("line"))
    tabular.write_lines(n.limit(1).coalesce(1), "line", at)
    tabular.write_lines(n.limit(1).coalesce(1), "line", index)
    time.sleep(1.1)
    tabular.write_lines(n.repartition(3), "line", at, mode="append")
    n.write.mode("append").parquet(at)
    return tabular.newer_files(spark, at, index).groupBy(F.regexp_extract("path", r"\.([^./]*)$", 1).alias("extension")).agg(F.count(F.lit(1)).alias("files"))


@R.add("yaml_records", "SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_brand || ': \"#' || p_size || '\"' AS note, NULL::VARCHAR AS absent FROM part")
def yaml_records(spark: SparkSession, d: str) -> DataFrame:
    at = _place(spark)
    note = F.concat("p_brand", F.lit(': "#'), F.col("p_size").cast("string"), F.lit('"'))
    tabular.write_yaml(table(spark, d, "part").select("p_partkey", "p_name", note.alias("note")), at)
    return tabular.records(spark, at, ["p_partkey", "p_name", "note", "absent"], "yaml")


@R.add("orc_round_trip", "SELECT event_id, event_type, value FROM events")
def orc_round_trip(spark: SparkSession, d: str) -> DataFrame:
    at = _place(spark)
    table(spark, d, "events").select("event_id", "event_type", "value").write.orc(at)
    return spark.read.orc(at)


@R.add("event_properties", "SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events")
def event_properties(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@R.add("table_files")
def table_files(spark: SparkSession, d: str) -> DataFrame:
    return tabular.list_files(spark, d, "*.parquet", recursive=True)


# Sampling


@R.add("sample_by_digest", "SELECT o_orderkey, o_custkey FROM orders WHERE ('0x' || right(md5(o_orderkey::VARCHAR), 6))::BIGINT < 1677721")
def sample_by_digest(spark: SparkSession, d: str) -> DataFrame:
    return sampling.by_digest(table(spark, d, "orders"), "o_orderkey", 0.1).select("o_orderkey", "o_custkey")


@R.add("sample_bernoulli")
def sample_bernoulli(spark: SparkSession, d: str) -> DataFrame:
    return sampling.bernoulli(table(spark, d, "orders"), 0.1, header="o_orderkey = 1")


@R.add("shuffle_percent")
def shuffle_percent(spark: SparkSession, d: str) -> DataFrame:
    return sampling.shuffled(table(spark, d, "orders"), percent=25)


# Learning


@R.add("text_categories")
def text_categories(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy on held-out snippets of labels learned from the others."""
    s = table(spark, d, "snippets").select("id", "label", "text").distinct()
    test = F.pmod(F.xxhash64("id"), F.lit(5)) == 0
    return learning.TextCategorizer("nb", ngrams=2).train(s.where(~test)).test(s.where(test))


_NUM = ["sepal_length", "sepal_width", "petal_length", "petal_width"]


@R.add("iris_classifiers")
def iris_classifiers(spark: SparkSession, d: str) -> DataFrame:
    """Held-out accuracy of each classifier on the spelt-out iris classes."""
    t = table(spark, d, "iris").withColumn("class", F.nullif(F.lower(F.trim("class")), F.lit(""))).select("obs_id", *_NUM, "class").distinct()
    data = written(learning.features(t, _NUM, "class"))
    return spark.createDataFrame([(c, float(learning.hold_out(data, c))) for c in ("nb", "lr", "tree", "forest")], "classifier string, accuracy double")


@R.add("column_importance")
def column_importance(spark: SparkSession, d: str) -> DataFrame:
    cols = ["glucose", "BMI", "pedigree", "age", "pregnant"]
    t = table(spark, d, "diabetes").withColumn("class", F.trim("class")).where("class IN ('0', '1')").select("record_id", *cols, "class").distinct()
    return spark.createDataFrame([(c, float(v)) for c, v in learning.importances(learning.features(t, cols, "class"), cols)], "field string, importance double")


@R.add("iris_ablation")
def iris_ablation(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "iris").withColumn("class", F.nullif(F.lower(F.trim("class")), F.lit(""))).select("obs_id", *_NUM, "class").distinct()
    return learning.ablation(t, _NUM, "class")


@R.add("related_words")
def related_words(spark: SparkSession, d: str) -> DataFrame:
    return learning.word_vectors(table(spark, d, "documents"), size=32).findSynonyms("museum", 10)


@R.add("linear_fit")
def linear_fit(spark: SparkSession, d: str) -> DataFrame:
    return learning.linear_fit(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])


@R.add("scaled_features", "WITH f AS (SELECT event_id, event_type, coalesce(user_id, avg(user_id) OVER ()) AS u, coalesce(value, avg(value) OVER ()) AS v FROM events WHERE event_type IS NOT NULL) SELECT (dense_rank() OVER (ORDER BY event_type) - 1)::DOUBLE AS y, round(u / stddev_samp(u) OVER (), 6) AS user_id, round(v / stddev_samp(v) OVER (), 6) AS value FROM f")
def scaled_features(spark: SparkSession, d: str) -> DataFrame:
    """y and the scaled columns of every event with a type; gaps hold the mean."""
    out = learning.features(table(spark, d, "events"), ["user_id", "value"], "event_type").select("y", vector_to_array("features").alias("f"))
    return out.select("y", F.round(F.col("f")[0], 6).alias("user_id"), F.round(F.col("f")[1], 6).alias("value"))


def _iris(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "iris").withColumn("class", F.nullif(F.lower(F.trim("class")), F.lit(""))).select("obs_id", *_NUM, "class").distinct()
    return written(learning.features(t, _NUM, "class"))


def _plain(df: DataFrame, label: str) -> float:
    """The share of the most frequent label, which a guess must beat."""
    return df.groupBy(label).count().agg(F.max("count") / F.sum("count")).first()[0]


@R.add("iris_methods", "SELECT unnest(['elastic', 'forest', 'knn', 'lda', 'lr', 'tree']) AS classifier, true AS able")
def iris_methods(spark: SparkSession, d: str) -> DataFrame:
    """Whether each method names held-out classes better, by 20 points and more, than the most frequent class does."""
    data = _iris(spark, d)
    least = _plain(data, "y") + 0.2
    return spark.createDataFrame([(c, bool(learning.hold_out(data, c) > least)) for c in ("elastic", "forest", "knn", "lda", "lr", "tree")], "classifier string, able boolean")


@R.add("iris_cross_validated", "SELECT 'tree' AS classifier, true AS able, true AS deep UNION ALL SELECT 'drawn forest', true, true")
def iris_cross_validated(spark: SparkSession, d: str) -> DataFrame:
    """Settings chosen by cross-validation from a grid, and from drawn ones; a tree of one question is not the best."""
    data = _iris(spark, d)
    least = _plain(data, "y") + 0.2
    mean, _, best = learning.cross_validated(data, "tree", 3, {"maxDepth": [1, 4]})
    drawn, settings, n = learning.random_search(data, "forest", {"maxDepth": (2, 6), "subsamplingRate": (0.5, 1.0)}, 3, 2)
    return spark.createDataFrame([("tree", bool(mean > least), best["maxDepth"] == 4), ("drawn forest", bool(drawn > least), n == 3 and 2 <= settings["maxDepth"] <= 6)], "classifier string, able boolean, deep boolean")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "snippets").where("label IS NOT NULL AND text IS NOT NULL").select("id", "label", "text").distinct()


@R.add("class_probabilities", "SELECT count(DISTINCT id) AS n, true AS whole, true AS same FROM snippets WHERE label IS NOT NULL AND text IS NOT NULL")
def class_probabilities(spark: SparkSession, d: str) -> DataFrame:
    """Probabilities of all labels for every snippet: they add up to 1, and a categorizer that was saved and read again gives the same ones."""
    s, at = _labelled(spark, d), _place(spark)
    c = learning.TextCategorizer("nb", ngrams=2, max_features=5000, min_df=2, max_df=0.5).train(s)
    c.save(at)
    p = c.class_probabilities(s).select("id", F.col("probabilities").alias("p"))
    again = learning.TextCategorizer("nb").load(at).class_probabilities(s).select("id", F.col("probabilities").alias("q"))
    total = F.aggregate(F.map_values("p"), F.lit(0.0), lambda a, x: a + x)
    far = F.array_max(F.zip_with(F.map_values("p"), F.map_values("q"), lambda x, y: F.abs(x - y)))
    return p.join(again, "id").agg(F.count(F.lit(1)).alias("n"), F.min(F.abs(total - 1) < 1e-9).alias("whole"), F.min(far < 1e-9).alias("same"))


@R.add("document_kinds", "SELECT true AS words, true AS characters, (SELECT count(DISTINCT regexp_extract(source, '^[a-z]+')) * 3 FROM documents WHERE text IS NOT NULL AND source IS NOT NULL) AS terms")
def document_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Whether words, and n-grams of characters, name the kind of a held-out document (what its source begins with) better, by 20 points and more, than the most frequent kind
    does, and how many terms speak for the kinds of a model of words."""
    docs = table(spark, d, "documents").where("text IS NOT NULL AND source IS NOT NULL").select("doc_id", F.regexp_extract("source", "^[a-z]+", 0).alias("label"), "text")
    test = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    least = _plain(docs, "label") + 0.2
    words = learning.TextCategorizer("nb", max_features=2000, min_df=2).train(docs.where(~test))
    marks = learning.TextCategorizer("nb", ngrams=2, characters=True, max_features=1000).train(docs.where(~test))
    able = [bool(c.test(docs.where(test)).first().accuracy > least) for c in (words, marks)]
    return words.weights(3).agg(F.count(F.lit(1)).alias("terms")).select(F.lit(able[0]).alias("words"), F.lit(able[1]).alias("characters"), "terms")


@R.add("logistic_fit", "SELECT unnest(['glucose', 'BMI', 'age', '(intercept)']) AS term, true AS balanced, true AS wider")
def logistic_fit(spark: SparkSession, d: str) -> DataFrame:
    """Whether the fit solves its equations (residuals that add up to nothing, alone and times each column), and its quasi form scales all errors alike."""
    xs = ["glucose", "BMI", "age"]
    t = table(spark, d, "diabetes").withColumn("y", F.trim("class")).where("y IN ('0', '1')").select("record_id", F.col("y").cast("double").alias("y"), *xs).dropna().distinct()
    fit, predict = learning.logistic_fit(t, "y", xs)
    quasi = learning.logistic_fit(t, "y", xs, quasi=True)[0].select("term", F.col("std_error").alias("q"))
    left = F.col("y") - F.col("probability")
    sums = predict(t).agg(*[(F.abs(F.sum(left * F.col(x))) / F.sum(F.abs(x)) < 1e-6).alias(x) for x in xs], (F.abs(F.avg(left)) < 1e-6).alias("(intercept)"))
    balanced = sums.select(F.explode(F.create_map(*[v for c in [*xs, "(intercept)"] for v in (F.lit(c), F.col(f"`{c}`"))])).alias("term", "balanced"))
    ratio = fit.join(quasi, "term").select("term", (F.col("q") / F.col("std_error")).alias("r"))
    first = ratio.agg(F.avg("r")).scalar()
    return balanced.join(ratio, "term").select("term", "balanced", (F.abs(F.col("r") / first - 1) < 1e-9).alias("wider"))


@R.add("fit_columns", "SELECT 'l_quantity' AS term, round(regr_slope(l_extendedprice, l_quantity), 4) AS estimate FROM lineitem UNION ALL SELECT '(intercept)', round(regr_intercept(l_extendedprice, l_quantity), 3) FROM lineitem")
def fit_columns(spark: SparkSession, d: str) -> DataFrame:
    """The last column by the one before it, given by number."""
    f = learning.fit_columns(table(spark, d, "lineitem").select("l_tax", "l_quantity", "l_extendedprice"), -1, [2])
    return f.select("term", F.when(F.col("term") == "(intercept)", F.round("estimate", 3)).otherwise(F.round("estimate", 4)).alias("estimate"))


# Streaming


def _stream(spark: SparkSession, d: str) -> DataFrame:
    return streams.stream(spark, f"{d}/events.parquet", table(spark, d, "events").schema)


@R.add("stream_windowed_counts", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def stream_windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    out = streams.run_available(streams.windowed_counts(_stream(spark, d)), _place(spark), _place(spark), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@R.add(
    "stream_sessions",
    """WITH b AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM b)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM g GROUP BY user_id, k""",
)
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = streams.run_available(streams.sessions(_stream(spark, d), "6 hours"), _place(spark), _place(spark), "complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@R.add("stream_deltas", "SELECT user_id, event_id, coalesce(date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts), 0) AS delta_us FROM events WHERE ts IS NOT NULL")
def stream_deltas(spark: SparkSession, d: str) -> DataFrame:
    return streams.run_available(streams.deltas(_stream(spark, d)), _place(spark), _place(spark))
