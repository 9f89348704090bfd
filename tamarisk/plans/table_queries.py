"""Queries of column, line, counting, lookup and set operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.functions import arrays, dates, numbers, text
from tamarisk.operators import columns, counting, lines
from tamarisk.plans.registry import Registry
from tamarisk.plans.scale import spread, table

R = Registry()

# Columns


@R.add("cut_fields", "SELECT coalesce(p_partkey::VARCHAR, '') AS p_partkey, coalesce(p_brand, '') AS p_brand, coalesce(p_type, '') AS p_type, coalesce(p_size::VARCHAR, '') AS p_size, coalesce(p_name, '') AS p_name FROM part")
def cut_fields(spark: SparkSession, d: str) -> DataFrame:
    return columns.cut(table(spark, d, "part"), "1,3-5,p_name")


@R.add("cut_exclude", "SELECT * EXCLUDE (o_totalprice, o_orderdate) FROM orders")
def cut_exclude(spark: SparkSession, d: str) -> DataFrame:
    return columns.exclude(table(spark, d, "orders"), "o_totalprice,5")


@R.add("cut_elided", "SELECT doc_id::VARCHAR AS doc_id, CASE WHEN length(coalesce(text, '')) > 20 THEN substr(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]', ' ', 'g'), 1, 20) || '...' ELSE regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]', ' ', 'g') END AS text, CASE WHEN length(coalesce(source, '')) > 20 THEN substr(source, 1, 20) || '...' ELSE coalesce(source, '') END AS source FROM documents")
def cut_elided(spark: SparkSession, d: str) -> DataFrame:
    return columns.cut(table(spark, d, "documents"), "doc_id,text,source", most=20, one_line=True)


@R.add("to_delimited", "SELECT r_regionkey::VARCHAR || '|' || r_name AS line FROM region")
def to_delimited(spark: SparkSession, d: str) -> DataFrame:
    return columns.delimited(table(spark, d, "region"), "|")


@R.add("unpivot_fields", "SELECT c_custkey, 1 AS field_no, 'c_name' AS field, c_name AS value FROM customer UNION ALL SELECT c_custkey, 2, 'c_nationkey', c_nationkey::VARCHAR FROM customer UNION ALL SELECT c_custkey, 3, 'c_mktsegment', c_mktsegment FROM customer")
def unpivot_fields(spark: SparkSession, d: str) -> DataFrame:
    return columns.unpivot_fields(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "c_custkey")


@R.add(
    "transpose_elided",
    """WITH c AS (SELECT n_nationkey, 1 AS field_no, 'n_name' AS field, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 2, 'n_regionkey', n_regionkey::VARCHAR FROM nation)
SELECT n_nationkey, field_no, field, CASE WHEN row_number() OVER w > 1 AND lag(value) OVER w IS NOT DISTINCT FROM value THEN '.' ELSE value END AS value FROM c WINDOW w AS (PARTITION BY field ORDER BY n_nationkey)""",
)
def transpose_elided(spark: SparkSession, d: str) -> DataFrame:
    return columns.unpivot_fields(table(spark, d, "nation"), "n_nationkey", elide=True)


@R.add("transposed", "SELECT 1 AS field_no, 'r_name' AS field, list(coalesce(r_name, 'n/a') ORDER BY r_regionkey) AS \"values\" FROM region")
def transposed(spark: SparkSession, d: str) -> DataFrame:
    return columns.transpose(table(spark, d, "region"), "r_regionkey")


@R.add("elide_repeats", "SELECT o_orderkey, o_custkey, CASE WHEN row_number() OVER w > 1 AND lag(o_orderstatus) OVER w IS NOT DISTINCT FROM o_orderstatus THEN '.' ELSE o_orderstatus END AS o_orderstatus FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def elide_repeats(spark: SparkSession, d: str) -> DataFrame:
    return columns.elide_repeats(table(spark, d, "orders"), "o_orderstatus", "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey", "o_orderstatus")


@R.add("class_last", 'SELECT * EXCLUDE ("class", pedigree, received_at), "class" FROM diabetes')
def class_last(spark: SparkSession, d: str) -> DataFrame:
    return columns.class_last(table(spark, d, "diabetes"), "class", ["pedigree", "received_at"])


#: DuckDB's cast takes what Spark's does but for digits with underscores.
_DOUBLE = "CASE WHEN NOT contains({0}, '_') THEN try_cast({0} AS DOUBLE) END AS {0}"


@R.add("as_doubles", f"SELECT record_id, {_DOUBLE.format('insulin')}, {_DOUBLE.format('triceps')} FROM diabetes")
def as_doubles(spark: SparkSession, d: str) -> DataFrame:
    return columns.as_doubles(table(spark, d, "diabetes").select("record_id", "insulin", "triceps"), ["record_id"])


@R.add("lookup_first_value", "SELECT p_brand, arg_min(p_name, p_partkey) AS value FROM part GROUP BY p_brand")
def lookup_first_value(spark: SparkSession, d: str) -> DataFrame:
    return columns.first_value(table(spark, d, "part"), "p_name", "p_brand", "p_partkey")


@R.add("feature_ids", "SELECT event_type, row_number() OVER (ORDER BY f, event_type) - 1 AS id FROM (SELECT event_type, min(event_id) AS f FROM events WHERE event_type IS NOT NULL GROUP BY 1)")
def feature_ids(spark: SparkSession, d: str) -> DataFrame:
    return columns.ids_by_appearance(table(spark, d, "events"), "event_type", "event_id")


@R.add("label_ids", "SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS id FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)")
def label_ids(spark: SparkSession, d: str) -> DataFrame:
    return columns.ids_by_name(table(spark, d, "documents"), "lang")


@R.add("one_hot", "SELECT event_id, [CASE WHEN event_type = 'click' THEN 1 ELSE 0 END, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END] AS event_type_vector FROM events")
def one_hot(spark: SparkSession, d: str) -> DataFrame:
    return columns.one_hot(table(spark, d, "events"), "event_type", ["click", "view"]).select("event_id", "event_type_vector")


@R.add("describe_table", "SELECT 'BMI' AS field, count(*) AS n, count(*) FILTER (BMI IS NULL) AS nulls, round(avg(BMI), 6) AS mean, round(stddev(BMI), 6) AS sd, min(BMI) AS low, max(BMI) AS high FROM diabetes UNION ALL SELECT 'glucose', count(*), count(*) FILTER (glucose IS NULL), round(avg(glucose), 6), round(stddev(glucose), 6), min(glucose), max(glucose) FROM diabetes")
def describe_table(spark: SparkSession, d: str) -> DataFrame:
    t = columns.describe_column(table(spark, d, "diabetes"), ["BMI", "glucose"])
    return t.withColumns({c: F.round(c, 6) for c in ("mean", "sd")})


# Lines of documents

_LINES = "l AS (SELECT doc_id, i AS line_no, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), unnest(range(1, len(l) + 1)) AS u(i))"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.numbered(spread(table(spark, d, "documents"), "doc_id"))


@R.add("numbered_lines", f"WITH {_LINES} SELECT * FROM l")
def numbered_lines(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d)


@R.add(
    "paragraphs",
    f"""WITH {_LINES}, b AS (SELECT *, regexp_full_match(line, '[ \\t\\r]*') AS b FROM l),
s AS (SELECT *, CASE WHEN NOT b AND coalesce(lag(b) OVER w, true) THEN 1 ELSE 0 END AS s FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
p AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY line_no) AS para_no FROM s)
SELECT doc_id, para_no::BIGINT AS para_no, min(line_no) AS first_line, count(*) AS lines, array_to_string(list(line ORDER BY line_no), chr(10)) AS text FROM p WHERE NOT b GROUP BY doc_id, para_no""",
)
def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return lines.paragraphs(_lines(spark, d))


@R.add(
    "page_lines",
    f"""WITH {_LINES}, s AS (SELECT doc_id, line_no, k - 1 AS part, p[k] AS segment FROM (SELECT *, string_split(line, chr(12)) AS p FROM l), unnest(range(1, len(p) + 1)) AS u(k)),
f AS (SELECT *, 1 + sum(CASE WHEN part > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no, part) AS page_no FROM s)
SELECT doc_id, page_no::BIGINT AS page_no, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line_no, part) AS page_line, line_no, segment FROM f""",
)
def page_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.pages(_lines(spark, d))


_MONTHS = "CASE lower(p[2]) " + " ".join(f"WHEN '{m}' THEN '{k:02d}'" for k, m in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"), 1)) + " END"
_NOTES = rf"""{_LINES}, t AS (SELECT *, regexp_replace(line, '[ \t\r]+$', '') AS t FROM l),
m AS (SELECT *, regexp_full_match(t, '((Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]* )?[0-9]{{1,2}} [A-Z][a-z]{{2}} ([0-9]{{4}}|[0-9]{{2}})') AS is_date FROM t),
c AS (SELECT *, coalesce(last_value(CASE WHEN is_date THEN t END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no), '1 Jan 1900') AS date_text FROM m),
dp AS (SELECT *, string_split(regexp_replace(date_text, '^(Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]* ', ''), ' ') AS p FROM c WHERE NOT is_date),
notes AS (SELECT doc_id, line_no, line, date_text, coalesce(try_cast((CASE WHEN length(p[3]) = 4 THEN p[3] WHEN p[3]::INT >= 69 THEN '19' || p[3] ELSE '20' || p[3] END) || '-' || {_MONTHS} || '-' || lpad(p[1], 2, '0') AS DATE), DATE '1900-01-01') AS note_date FROM dp)"""


@R.add("dated_notes", f"WITH {_NOTES} SELECT * FROM notes")
def dated_notes(spark: SparkSession, d: str) -> DataFrame:
    return lines.dated_notes(_lines(spark, d))


@R.add("merge_notes", f"WITH {_NOTES} SELECT note_date, count(*) AS notes, count(DISTINCT doc_id) AS sources, min(date_text) AS date_text FROM notes WHERE regexp_matches(line, '[^ \\t\\r]') GROUP BY note_date")
def merge_notes(spark: SparkSession, d: str) -> DataFrame:
    return lines.merge_notes(lines.dated_notes(_lines(spark, d)))


@R.add(
    "head_middle_tail",
    f"""WITH {_LINES}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM l),
h AS (SELECT *, line_no > 4 AND line_no <= n - 6 AND n > 10 AND regexp_matches(line, '(?i)error|fail|warning|critical|exception') AS hit FROM n),
k AS (SELECT *, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM h),
p AS (SELECT *, CASE WHEN n <= 10 OR line_no <= 4 THEN 'head' WHEN line_no > n - 6 THEN 'tail' WHEN hit AND k <= 3 THEN 'middle' END AS part FROM k)
SELECT doc_id, line_no, part, line FROM p WHERE part IS NOT NULL""",
)
def head_middle_tail(spark: SparkSession, d: str) -> DataFrame:
    return lines.head_middle_tail(_lines(spark, d), 4, 3, 6, "error|fail|warning|critical|exception")


@R.add("timestamp_deltas", "SELECT event_id, user_id, ts, CASE WHEN ts IS NOT NULL THEN coalesce(date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id, ts IS NULL ORDER BY ts, event_id), ts), 0) END AS delta_us FROM events")
def timestamp_deltas(spark: SparkSession, d: str) -> DataFrame:
    return lines.time_deltas(table(spark, d, "events"), "user_id", "ts", "event_id").select("event_id", "user_id", "ts", "delta_us")


@R.add(
    "log_line_deltas",
    rf"""WITH {_LINES}, s AS (SELECT doc_id, line_no, regexp_extract(line, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9]{{1,2}}:[0-9]{{2}}:[0-9]{{2}}([.,][0-9]+)?Z?') AS s FROM l),
t AS (SELECT doc_id, line_no, try_cast(regexp_replace(regexp_replace(replace(replace(s, ',', '.'), 'T', ' '), ' ([0-9]):', ' 0\1:'), 'Z$', '') AS TIMESTAMP) AS ts FROM s WHERE s <> '')
SELECT doc_id, line_no, ts, coalesce(date_diff('microsecond', lag(ts) OVER (PARTITION BY doc_id ORDER BY line_no), ts), 0) AS delta_us FROM t WHERE ts IS NOT NULL""",
)
def log_line_deltas(spark: SparkSession, d: str) -> DataFrame:
    return lines.line_deltas(_lines(spark, d))


# Counting and extraction


@R.add("count_it", "SELECT value, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS value FROM documents) GROUP BY value")
def count_it(spark: SparkSession, d: str) -> DataFrame:
    return counting.count_it(table(spark, d, "documents").select(F.lower("text").alias("t")), "t", "[a-z]+")


@R.add("extract_first_match", "SELECT doc_id, regexp_extract(text, '([0-9]+) ([a-z]+)', 2) AS unit FROM documents WHERE regexp_matches(text, '([0-9]+) ([a-z]+)')")
def extract_first_match(spark: SparkSession, d: str) -> DataFrame:
    pattern = "([0-9]+) ([a-z]+)"
    m = table(spark, d, "documents").where(F.col("text").rlike(pattern))
    return m.select("doc_id", F.element_at(counting.matches("text", pattern, 2, first_only=True), 1).alias("unit"))


@R.add("extract_groups", "SELECT doc_id, unnest(list_zip(regexp_extract_all(text, '([0-9]+) ([a-z]+)', 1), regexp_extract_all(text, '([0-9]+) ([a-z]+)', 2))) AS m FROM documents".replace("unnest(list_zip", "unnest(list_transform(list_zip").replace("2))) AS m", "2)), lambda x: x[1] || ' of ' || x[2])) AS m"))
def extract_groups(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "documents").select("doc_id", F.inline(counting.match_groups("text", "([0-9]+) ([a-z]+)", 2)))
    return g.select("doc_id", F.concat("g1", F.lit(" of "), "g2").alias("m"))


@R.add("frequency_shares", "SELECT event_type, count(*) AS freq, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM events GROUP BY event_type")
def frequency_shares(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("freq"))
    return counting.normalized(f).withColumn("share", F.round("share", 9))


@R.add("top_weighted", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def top_weighted(spark: SparkSession, d: str) -> DataFrame:
    return counting.top(table(spark, d, "part"), "p_retailprice", 25, "p_partkey").select("p_partkey", "p_retailprice")


@R.add("min_max_scaled", "SELECT l_orderkey, l_linenumber, round(CASE WHEN hi = lo THEN 1.0 ELSE (l_extendedprice - lo) / (hi - lo) END, 9) AS scaled FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)")
def min_max_scaled(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    low, high = t.select(F.min("l_extendedprice")).scalar(), t.select(F.max("l_extendedprice")).scalar()
    return t.select("l_orderkey", "l_linenumber", F.round(numbers.min_max("l_extendedprice", low, high), 9).alias("scaled"))


_WORDS = "regexp_extract_all(lower(text), '[a-z]+')"


@R.add("document_frequency", f"SELECT term, count(*) AS df, sum(c)::BIGINT AS freq FROM (SELECT doc_id, term, count(*) AS c FROM (SELECT doc_id, unnest({_WORDS}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return counting.document_frequency(table(spark, d, "documents"), "doc_id", counting.matches(F.lower("text"), "[a-z]+"))


@R.add("bag_of_words", "SELECT id, token, count(*) AS n FROM (SELECT id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9_]+')) AS token FROM (SELECT DISTINCT id, text FROM snippets) WHERE text IS NOT NULL) GROUP BY ALL")
def bag_of_words(spark: SparkSession, d: str) -> DataFrame:
    return counting.bag_of_words(table(spark, d, "snippets").select("id", "text").distinct(), "id")


@R.add(
    "keyword_filter",
    f"""WITH f AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS freq FROM (SELECT doc_id, unnest({_WORDS}) AS term FROM documents) GROUP BY term), n AS (SELECT count(*) AS n FROM documents)
SELECT term, df, freq FROM f, n WHERE term IN (SELECT unnest({_WORDS}) FROM snippets) AND term NOT IN (SELECT lower(label) FROM snippet_labels) AND df >= 4 AND df <= 0.3 * n""",
)
def keyword_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    words = counting.matches(F.lower("text"), "[a-z]+")
    f = counting.document_frequency(docs, "doc_id", words)
    include = table(spark, d, "snippets").select(F.explode(words).alias("term")).distinct()
    exclude = table(spark, d, "snippet_labels").select(F.lower("label").alias("term"))
    return counting.keyword_filter(f, docs.count(), include, exclude, 4, 0.3)


@R.add("value_rollup", "SELECT event_type, user_id, round(sum(value), 6) AS total, count(*) AS n, (CASE WHEN grouping(user_id) = 1 THEN 1 ELSE 0 END + CASE WHEN grouping(event_type) = 1 THEN 1 ELSE 0 END) AS level FROM events GROUP BY ROLLUP (event_type, user_id)")
def value_rollup(spark: SparkSession, d: str) -> DataFrame:
    return counting.rolled_up(table(spark, d, "events"), ["event_type", "user_id"], "value").withColumn("total", F.round("total", 6))


@R.add(
    "path_prefixes",
    r"""WITH p AS (SELECT string_split(unnest(regexp_extract_all(text, '(?:/[A-Za-z0-9_.\-]+){5,}')), '/') AS p FROM documents),
x AS (SELECT array_to_string(p[:k], '/') AS prefix FROM p, unnest(range(2, len(p) + 1)) AS u(k))
SELECT prefix, count(*) AS n, length(prefix) * count(*) AS score FROM x WHERE length(prefix) >= 25 GROUP BY prefix HAVING count(*) > 1""",
)
def path_prefixes(spark: SparkSession, d: str) -> DataFrame:
    return counting.prefix_stats(table(spark, d, "documents"), "text", 5, 25)


# Lists and sets

_ARR = "SELECT o_custkey, list(o_orderpriority ORDER BY o_orderkey) AS a, list(o_orderstatus ORDER BY o_orderkey) AS b, list(o_orderpriority ORDER BY o_orderkey)[1:2] AS c FROM orders GROUP BY o_custkey"


def _arrays(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority", "o_orderstatus"))).alias("s"))
    a = F.transform("s", lambda x: x["o_orderpriority"])
    return o.select("o_custkey", a.alias("a"), F.transform("s", lambda x: x["o_orderstatus"]).alias("b"), F.slice(a, 1, 2).alias("c"))


@R.add(
    "list_set_operations",
    f"""SELECT o_custkey, list_sort(list_distinct(list_concat(a, c))) AS "union", list_sort(list_intersect(a, c)) AS inter, list_filter(a, lambda x: NOT list_contains(c, x)) AS diff,
 list_concat(c, list_filter(a, lambda x: NOT list_contains(c, x))) AS union_keeping, round(len(list_intersect(a, c)) / greatest(len(a), len(c)), 9) AS rel, len(list_filter(c, lambda x: NOT list_contains(a, x))) = 0 AS subset FROM ({_ARR})""",
)
def list_set_operations(spark: SparkSession, d: str) -> DataFrame:
    t = _arrays(spark, d)
    return t.select(
        "o_custkey", F.array_sort(arrays.union("a", "c")).alias("union"), F.array_sort(arrays.intersection("a", "c")).alias("inter"), arrays.difference_keeping("a", "c").alias("diff"),
        arrays.union_keeping("c", "a").alias("union_keeping"), F.round(arrays.relative_intersection("a", "c"), 9).alias("rel"), arrays.is_subset("c", "a").alias("subset"),
    )


@R.add("unique_items", f"SELECT o_custkey, list_filter(a, lambda x, i: list_position(a, x) = i) AS u, CASE WHEN list_contains(b, 'X') THEN b ELSE list_append(b, 'X') END AS appended FROM ({_ARR})")
def unique_items(spark: SparkSession, d: str) -> DataFrame:
    return _arrays(spark, d).select("o_custkey", arrays.unique("a").alias("u"), arrays.append_new("b", F.lit("X")).alias("appended"))


# Scalars


@R.add("string_functions", "SELECT p_partkey, rpad(p_name, 12, ' ') AS fixed, CASE WHEN ends_with(p_type, 'M') THEN left(p_type, length(p_type) - 1) ELSE p_type END AS chomped, CASE WHEN length(p_name) > 5 THEN left(p_name, 5) || '...' ELSE p_name END AS elided, '  ' || p_brand AS indented, regexp_replace(p_name, ' +', chr(9), 'g') AS tabbed FROM part")
def string_functions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.fixed_length("p_name", 12).alias("fixed"), text.chomp("p_type", "M").alias("chomped"), text.elide("p_name", 5).alias("elided"), text.indent_lines("p_brand", "  ").alias("indented"), text.blanks_to_tab("p_name").alias("tabbed"))


@R.add(
    "path_functions",
    r"""WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '/[A-Za-z0-9_./\-]+[A-Za-z0-9]')) AS path FROM documents)
SELECT doc_id, path, string_split(path, '/')[-1] AS base, coalesce(nullif(regexp_replace(path, '/[^/]*$', ''), ''), '/') AS dir, regexp_extract(string_split(path, '/')[-1], '^.+\.([^.]*)$', 1) AS ext FROM p""",
)
def path_functions(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "documents").select("doc_id", F.explode(counting.matches("text", r"/[A-Za-z0-9_./\-]+[A-Za-z0-9]")).alias("path"))
    return p.select("doc_id", "path", text.base_name("path").alias("base"), text.dir_name("path").alias("dir"), text.extension("path").alias("ext"))


@R.add(
    "version_numbers",
    r"""WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[0-9]+\.[0-9]+\.[0-9]+')) AS v FROM documents), s AS (SELECT v, string_split(v, '.') AS p FROM v)
SELECT v, (p[1] || '.' || array_to_string(list_transform(p[2:], lambda x: CASE WHEN length(regexp_replace(x, '^0+(.)', '\1')) > 4 THEN '9999' ELSE lpad(regexp_replace(x, '^0+(.)', '\1'), 4, '0') END), ''))::DOUBLE AS number FROM s""",
)
def version_numbers(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "documents").select(F.explode(counting.matches("text", r"[0-9]+\.[0-9]+\.[0-9]+")).alias("v")).distinct()
    return v.select("v", text.version_number("v").alias("number"))


@R.add("symbols_stripped", "SELECT doc_id, regexp_replace(text, '[\\p{So}]', '', 'g') AS t FROM documents WHERE regexp_matches(text, '[\\p{So}]')")
def symbols_stripped(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("text").rlike(r"\p{So}")).select("doc_id", text.strip_symbols("text").alias("t"))


@R.add("html_escapes", "SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM documents")
def html_escapes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.escape_html("text").alias("escaped"))


@R.add("html_round_trip", "SELECT doc_id, text FROM documents")
def html_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.unescape_html(text.escape_html("text")).alias("text"))


@R.add("number_functions", "SELECT o_orderkey, printf('%.6f', o_totalprice) AS shown, o_totalprice > 0 AND lower(o_orderstatus) NOT IN ('false', 'none', 'off', '0', '') AS truth, abs(o_totalprice - round(o_totalprice, 1)) <= greatest(1e-9 * greatest(abs(o_totalprice), abs(round(o_totalprice, 1))), 0.01) AS near, coalesce(try_cast(o_orderpriority AS DOUBLE), -1) AS number FROM orders")
def number_functions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select("o_orderkey", numbers.round_as_text("o_totalprice").alias("shown"), ((F.col("o_totalprice") > 0) & numbers.to_bool("o_orderstatus")).alias("truth"), numbers.is_close(F.col("o_totalprice"), F.round("o_totalprice", 1), 0.01).alias("near"), numbers.to_float("o_orderpriority", -1.0).alias("number"))


@R.add("primes", "SELECT DISTINCT p_partkey AS n, n > 1 AND (n < 4 OR len(list_filter(range(2, greatest(floor(sqrt(n))::BIGINT, 2) + 1), lambda x: n % x = 0)) = 0) AS prime FROM part")
def primes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("n")).distinct().select("n", numbers.is_prime("n").alias("prime"))


@R.add("prime_factor_product", "SELECT DISTINCT p_partkey AS n, p_partkey AS product, true AS all_prime FROM part WHERE p_partkey > 1")
def prime_factor_product(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "part").where("p_partkey > 1").select(F.col("p_partkey").alias("n")).distinct().withColumn("f", numbers.prime_factors("n"))
    return f.select("n", F.aggregate("f", F.lit(1).cast("bigint"), lambda a, x: a * x).alias("product"), F.forall("f", lambda x: numbers.is_prime(x)).alias("all_prime"))


@R.add("date_functions", "SELECT o_orderkey, lower(strftime(o_orderdate, '%d %b %y')) AS shown FROM orders")
def date_functions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", dates.ddmmmyy("o_orderdate").alias("shown"))


@R.add("rgb_values", "SELECT hex, ('0x' || hex[1:2])::INT AS r, ('0x' || hex[3:4])::INT AS g, ('0x' || hex[5:6])::INT AS b FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '\\b[0-9a-f]{6}\\b')) AS hex FROM documents)")
def rgb_values(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "documents").select(F.explode(counting.matches("text", r"\b[0-9a-f]{6}\b")).alias("hex")).distinct()
    return h.select("hex", numbers.rgb("hex").alias("c")).select("hex", "c.*")


@R.add("hex_dumps", "SELECT n_name, trim(regexp_replace(hex(encode(n_name)), '(..)', '\\1 ', 'g')) AS dump, CASE WHEN starts_with(n_name, 'NATION') THEN substr(n_name, 7) ELSE n_name END AS rest FROM nation")
def hex_dumps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_name", text.hex_dump("n_name").alias("dump"), text.without_prefix("n_name", "NATION").alias("rest"))
