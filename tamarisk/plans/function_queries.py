"""Queries of string, list, number, date, URL and page functions, and of the small operators around them.

Where a function takes texts that the tables lack (pages, settings, device lists), its input is put together from table columns, so that SQL can say
what must come out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.functions import aggregates, arrays, dates, numbers, text, urls
from tamarisk.operators import columns, counting, evaluation, language, lines, reports, search, tfidf
from tamarisk.plans import steps
from tamarisk.plans.registry import Registry
from tamarisk.plans.scale import spread, table
from tamarisk.plans.search_queries import _CLS, _IDX, _PAL, COLOURS, _guessed, _index
from tamarisk.plans.table_queries import _ARR, _LINES, _arrays

R = Registry()


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"), "doc_id")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.numbered(_docs(spark, d))


# Strings


@R.add("escaped_fields", r"SELECT doc_id, replace(replace(replace(replace(text, '\', '\\'), chr(10), '\n'), chr(9), '\t'), chr(13), '\r') AS text FROM documents")
def escaped_fields(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", text.escape_controls("text").alias("text"))


@R.add("comments_stripped", rf"WITH {_LINES} SELECT doc_id, line_no, regexp_replace(line, '[;#][^\r\x{{85}}\x{{2028}}\x{{2029}}]*', '', 'g') AS line FROM l")
def comments_stripped(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).withColumn("line", text.strip_comment("line"))


_NUMERIC = "coalesce(NOT contains({0}, '_') AND try_cast({0} AS DOUBLE) IS NOT NULL, false) AS {0}"


@R.add("numeric_texts", f"SELECT record_id, {_NUMERIC.format('insulin')}, {_NUMERIC.format('triceps')}, {_NUMERIC.format('diastolic')} FROM diabetes")
def numeric_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "diabetes").select("record_id", *[text.is_numeric(c).alias(c) for c in ("insulin", "triceps", "diastolic")])


@R.add("token_kinds", r"SELECT token, regexp_full_match(token, '[\p{P}\p{S}]*') AS punct, regexp_matches(token, '^[^\p{L}\p{N}]') AS starts FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[^ \t\r\n]+')) AS token FROM snippets)")
def token_kinds(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "snippets").select(F.explode(counting.matches("text", r"[^ \t\r\n]+")).alias("token")).distinct()
    return t.select("token", text.all_punct("token").alias("punct"), text.starts_with_punct("token").alias("starts"))


@R.add("list_texts", "SELECT p_partkey, list_concat(string_split(p_name, ' '), [p_size::VARCHAR, (p_size + 1)::VARCHAR, (p_size + 2)::VARCHAR]) AS plain, [p_name, p_brand, p_size::VARCHAR] AS quoted, [p_size::INT, p_partkey::INT] AS ints FROM part")
def list_texts(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    plain = F.concat("p_name", F.lit(", "), size, F.lit("-"), (F.col("p_size") + 2).cast("string"))
    quoted = F.concat(F.lit("['"), "p_name", F.lit("', \""), "p_brand", F.lit('", '), size, F.lit("]"))
    ints = F.concat(size, F.lit(", "), F.col("p_partkey").cast("string"))
    return table(spark, d, "part").select("p_partkey", text.split_list(plain, strip=True, ranges=True).alias("plain"), text.quoted_list(quoted).alias("quoted"), text.int_list(ints).alias("ints"))


@R.add("text_diff", "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: '  ' || w), chr(10)) || chr(10) || '> zzz' AS diff, array_to_string(list_transform(string_split(p_name, ' '), lambda w: '  ' || w), chr(10)) AS same FROM part")
def text_diff(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.string_diff("p_name", F.concat("p_name", F.lit(" zzz"))).alias("diff"), text.string_diff("p_name", "p_name").alias("same"))


_SUFFIX = r"CASE WHEN {0} = 0 THEN '0K' ELSE regexp_replace(regexp_replace(printf('%.6f', {0} / pow(1024, {1})), '\.0+$', ''), '(\.[0-9]*[1-9])0+$', '\1') || ['', 'K', 'M', 'G', 'T', 'P', 'E'][{1} + 1] END"
_POWER = "least(floor(ln(greatest({0}, 1)) / ln(1024)), 6)::INT"


def _suffix(x: str) -> str:
    return _SUFFIX.format(x, _POWER.format(x))


@R.add("number_suffixes", f"WITH n AS (SELECT o_orderkey, floor(o_totalprice * o_orderkey)::BIGINT AS n, (o_orderkey % 3 * 3000)::BIGINT AS m FROM orders) SELECT o_orderkey, {_suffix('m')} AS one, 'used ' || CASE WHEN n >= 1000 THEN {_suffix('n')} ELSE n::VARCHAR END || ' of 1M, v2024.5 a12345' AS every FROM n")
def number_suffixes(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") * F.col("o_orderkey")).cast("bigint").alias("n"), (F.col("o_orderkey") % 3 * 3000).cast("bigint").alias("m"))
    return o.select("o_orderkey", text.numeric_suffix("m").alias("one"), text.suffix_numbers(F.concat(F.lit("used "), F.col("n").cast("string"), F.lit(" of 1048576, v2024.5 a12345"))).alias("every"))


@R.add("symbols_named", r"SELECT doc_id, false AS left_over, length(text) - length(regexp_replace(text, '\p{So}', '', 'g')) AS named FROM documents WHERE text IS NOT NULL AND NOT contains(text, '[')")
def symbols_named(spark: SparkSession, d: str) -> DataFrame:
    """Documents without brackets of their own: no symbol is left, and each became one name in brackets."""
    t = _docs(spark, d).where("text IS NOT NULL AND NOT contains(text, '[')").select("doc_id", text.name_symbols("text").alias("t"))
    return t.select("doc_id", F.col("t").rlike(r"\p{So}").alias("left_over"), F.regexp_count("t", F.lit(r"\[")).cast("bigint").alias("named"))


@R.add("header_names", "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), '') AS plugin, ['Containments', p_partkey::VARCHAR, p_brand] AS parts FROM part")
def header_names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    header = F.concat(F.lit("[Containments]["), F.col("p_partkey").cast("string"), F.lit("]["), "p_brand", F.lit("]"))
    return p.select("p_partkey", text.plugin_name(F.concat(F.lit("org.kde.plasma."), F.replace("p_name", F.lit(" "), F.lit("-")))).alias("plugin"), text.section_parts(header).alias("parts"))


@R.add("text_bytes", "SELECT doc_id, text, octet_length(encode(text))::INT AS bytes FROM documents")
def text_bytes(spark: SparkSession, d: str) -> DataFrame:
    t = _docs(spark, d).select("doc_id", F.encode(F.col("text").cast("string"), "UTF-8").alias("b"))
    return t.select("doc_id", F.decode("b", "UTF-8").alias("text"), F.octet_length("b").alias("bytes"))


@R.add("edit_distances", r"SELECT p_partkey, levenshtein(p_name, p_type)::INT AS edits, len(regexp_extract_all(p_name, '[aeiou]'))::INT AS vowels, regexp_replace(p_name, '([a-z]+) ([a-z]+)', '\2 \1') AS turned FROM part")
def edit_distances(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.levenshtein("p_name", "p_type").alias("edits"), F.regexp_count("p_name", F.lit("[aeiou]")).alias("vowels"), F.expr("regexp_replace(p_name, '([a-z]+) ([a-z]+)', '$2 $1', 1)").alias("turned"))


# Lists


@R.add("flattened_lists", f"SELECT o_custkey, list_concat(a, c) AS flat FROM ({_ARR})")
def flattened_lists(spark: SparkSession, d: str) -> DataFrame:
    return _arrays(spark, d).select("o_custkey", F.flatten(F.array("a", "c")).alias("flat"))


_LEFT = "list_filter(a, lambda x, i: len(list_filter(a[1:i], lambda y: {0}(y) = {0}(x))) > len(list_filter(c, lambda y: {0}(y) = {0}(x))))"


@R.add("removed_items", f"SELECT o_custkey, {_LEFT.format('')} AS rest, {_LEFT.format('lower')} AS any_case FROM ({_ARR})")
def removed_items(spark: SparkSession, d: str) -> DataFrame:
    return _arrays(spark, d).select("o_custkey", arrays.remove_first("a", "c").alias("rest"), arrays.remove_first("a", F.transform("c", F.lower), ignore_case=True).alias("any_case"))


@R.add("unzipped_lists", f"SELECT o_custkey, a, b FROM ({_ARR})")
def unzipped_lists(spark: SparkSession, d: str) -> DataFrame:
    pairs = _arrays(spark, d).select("o_custkey", F.zip_with("a", "b", lambda x, y: F.array(x, y)).alias("p"))
    a, b = arrays.unzip("p", 2)
    return pairs.select("o_custkey", a.alias("a"), b.alias("b"))


@R.add("elided_lists", f"SELECT o_custkey, list_transform(a, lambda x: CASE WHEN length(x) > 5 THEN left(x, 5) || '...' ELSE x END) AS short FROM ({_ARR})")
def elided_lists(spark: SparkSession, d: str) -> DataFrame:
    return _arrays(spark, d).select("o_custkey", text.elide_all("a", 5).alias("short"))


@R.add("unique_by_key", f"SELECT o_custkey, list_filter(a, lambda x, i: list_position(list_transform(a, lambda y: right(y, 3)), right(x, 3)) = i) AS u FROM ({_ARR})")
def unique_by_key(spark: SparkSession, d: str) -> DataFrame:
    return _arrays(spark, d).select("o_custkey", arrays.unique("a", key=lambda x: F.right(x, F.lit(3))).alias("u"))


_FLAGS = "[o_totalprice > 100000, o_orderstatus = 'F', starts_with(o_orderpriority, '1')]"
_TRUE = f"len(list_filter({_FLAGS}, lambda x: x))"


@R.add("boolean_lists", f"SELECT o_orderkey, {_TRUE} = 1 AS one, {_TRUE} <= 1 AS at_most_one, {_TRUE} = 1 AS odd_one, o_orderstatus IN ('F', 'O') AS subset, o_orderstatus = 'F' AS same FROM orders")
def boolean_lists(spark: SparkSession, d: str) -> DataFrame:
    flags = [F.col("o_totalprice") > 100000, F.col("o_orderstatus") == "F", F.startswith("o_orderpriority", F.lit("1"))]
    status = F.array("o_orderstatus")
    return table(spark, d, "orders").select(
        "o_orderkey", arrays.exactly_one(F.array(*flags)).alias("one"), arrays.exactly_one(F.array(*flags), zero_ok=True).alias("at_most_one"), arrays.xor(*flags).alias("odd_one"),
        arrays.is_subset(status, F.array(F.lit("F"), F.lit("O"))).alias("subset"), arrays.equivalent(status, F.array(F.lit("F"))).alias("same"),
    )


_TITLE = r"regexp_full_match({0}, '\p{{Lu}}[^\p{{Lu}}]*')"


@R.add("title_case_phrases", f"WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+')[1:4] AS w FROM documents) SELECT doc_id, {_TITLE.format('w[1]')} AND {_TITLE.format('w[-1]')} AND len(list_filter(w[2:-2], lambda x: NOT ({_TITLE.format('x')} OR lower(x) IN ('of', 'the', 'and')))) = 0 AS title FROM w WHERE len(w) > 0")
def title_case_phrases(spark: SparkSession, d: str) -> DataFrame:
    w = _docs(spark, d).select("doc_id", F.slice(counting.matches("text", "[A-Za-z]+"), 1, 4).alias("w")).where("size(w) > 0")
    return w.select("doc_id", arrays.title_case_ngram("w", ["of", "the", "and"]).alias("title"))


@R.add("zipped_features", "WITH t AS (SELECT label, term, count(DISTINCT id) AS df FROM (SELECT id, label, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM snippets WHERE label IS NOT NULL) GROUP BY ALL), n AS (SELECT count(DISTINCT id) AS n FROM snippets) SELECT label, term, df, round(ln(n::DOUBLE / df), 9) AS idf FROM t, n")
def zipped_features(spark: SparkSession, d: str) -> DataFrame:
    """The terms, document counts and weights of each label as three lists, zipped by position."""
    s = table(spark, d, "snippets")
    n = s.select("id").distinct().count()
    t = s.where("label IS NOT NULL").select("id", "label", F.explode(counting.matches(F.lower("text"), "[a-z]+")).alias("term")).distinct().groupBy("label", "term").agg(F.count(F.lit(1)).alias("df"))
    g = t.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("term", "df"))).alias("r"))
    lists = g.select("label", F.col("r.term").alias("term"), F.col("r.df").alias("df"), F.transform("r.df", lambda x: F.round(F.log(F.lit(float(n)) / x), 9)).alias("idf"))
    return lists.select("label", F.inline(F.arrays_zip("term", "df", "idf")))


# Numbers and dates


@R.add("parsed_numbers", "SELECT p_partkey, p_partkey::BIGINT AS from_hex, CASE WHEN p_size % 2 = 0 THEN (p_size // 2)::VARCHAR ELSE (p_size // 2)::VARCHAR || '.5' END AS half, -1::BIGINT AS no_number, p_size::BIGINT AS cut FROM part")
def parsed_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", numbers.to_int(F.lower(F.hex("p_partkey")), base=16).alias("from_hex"), numbers.whole_as_int(F.col("p_size") / 2.0).alias("half"), numbers.to_int("p_name", -1).alias("no_number"), numbers.to_int(F.concat(F.col("p_size").cast("string"), F.lit(".75"))).alias("cut"))


@R.add("fibonacci_below", "SELECT p_partkey, list_filter([0, 1, 1, 2, 3, 5, 8, 13, 21, 34, 55]::BIGINT[], lambda x: x < p_size) AS f FROM part")
def fibonacci_below(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", numbers.fibonacci("p_size").alias("f"))


@R.add("random_numbers", "SELECT count(*) AS n, true AS whole, true AS share, 6::BIGINT AS faces FROM orders")
def random_numbers(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "orders").select(numbers.random_int(1, 6).alias("i"), numbers.random_float(-1, 1).alias("f"))
    return r.agg(F.count(F.lit(1)).alias("n"), F.min(F.col("i").between(1, 6)).alias("whole"), F.min((F.col("f") >= -1) & (F.col("f") < 1)).alias("share"), F.count_distinct("i").alias("faces"))


@R.add("weekday_lines", rf"WITH {_LINES} SELECT doc_id, line_no, regexp_replace(lower(line), '^(sun|mon|tue|wed|thu|fri|sat)(?:s|nes|rs|ur)?(?:day)?:', '\1:') AS line FROM l WHERE regexp_matches(line, '^[A-Za-z]+:')")
def weekday_lines(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).where(F.col("line").rlike("^[A-Za-z]+:")).withColumn("line", dates.short_weekday("line"))


@R.add("shown_times", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown, floor(epoch(ts))::BIGINT AS seconds, true AS now FROM events WHERE ts IS NOT NULL")
def shown_times(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("ts IS NOT NULL")
    return e.select("event_id", dates.shown("ts").alias("shown"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("seconds"), (dates.seconds() > 1_700_000_000).alias("now"))


@R.add("transcript_times", "SELECT event_id, regexp_replace(regexp_replace(printf('%02d:%02d:%02d', event_id // 3600 % 24, event_id // 60 % 60, event_id % 60), '^00:', ''), '^0', '') AS shown FROM events")
def transcript_times(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    clock = F.format_string("%02d:%02d:%02d", F.floor(i / 3600) % 24, F.floor(i / 60) % 60, i % 60)
    return table(spark, d, "events").select("event_id", dates.transcript_time(clock).alias("shown"))


# URLs and pages


@R.add("url_quoting", "SELECT doc_id, replace(replace(url_encode(text), '%20', '+'), '~', '%7E') AS quoted, replace(replace(url_encode(text), '%20', '+'), '~', '%7E') AS again, text AS back FROM documents")
def url_quoting(spark: SparkSession, d: str) -> DataFrame:
    q = _docs(spark, d).select("doc_id", urls.quote("text").alias("quoted"))
    return q.select("doc_id", "quoted", urls.quote("quoted", idempotent=True).alias("again"), urls.unquote("quoted").alias("back"))


@R.add("url_parameters", "SELECT p_partkey, p_name AS name, p_size::VARCHAR AS last, 'none' AS absent, true AS flag, p_size::INT AS number, p_brand AS misc FROM part")
def url_parameters(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat(F.lit("http://x.test/p?a-b=0&name="), urls.quote("p_name"), F.lit("&on=Yes&a-b="), F.col("p_size").cast("string"), F.lit("#end"))
    misc = F.concat(F.lit("k = v, brand="), "p_brand")
    return table(spark, d, "part").select("p_partkey", urls.param(url, "name").alias("name"), urls.param(url, "a_b").alias("last"), urls.param(url, "other", "none").alias("absent"), urls.param_bool(url, "on").alias("flag"), urls.param_number(url, "a-b").alias("number"), F.element_at(urls.misc_params(misc), "brand").alias("misc"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """A page for each part: headings, entities, a script, links, images."""
    page = F.concat(
        F.lit('<html><head><meta charset="ISO-8859-1"><base href="http://h.test/d/"><style>p {color: red}</style></head><body><h1>'), "p_brand", F.lit("</h1>\n<p>"), "p_name", F.lit(" &amp; <b>more</b></p><script type='x'>var n = "), F.col("p_size").cast("string"),
        F.lit(';</script><a href="a'), F.col("p_partkey").cast("string"), F.lit('.html">one</a> <a class="c" href="/b">two</a><img src="//c.test/i.png"><img hidden src="h.png"><img src="//c.test/i.png"><!-- gone --></body></html>'),
    )
    return table(spark, d, "part").select("p_partkey", page.alias("page"))


@R.add("page_texts", "SELECT p_partkey, p_brand || ' ' || p_name || ' & more one two' AS text, p_brand || chr(10) || p_name || ' & more' || chr(10) || 'one two' AS blocks, ['var n = ' || p_size || ';'] AS scripts, 'iso-8859-1' AS charset FROM part")
def page_texts(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("p_partkey", text.html_to_text("page").alias("text"), text.html_blocks_to_text("page").alias("blocks"), text.scripts("page").alias("scripts"), text.charset("page").alias("charset"))


@R.add("page_links", "SELECT p_partkey, ['http://h.test/d/a' || p_partkey || '.html', 'http://h.test/b'] AS links, ['http://c.test/i.png'] AS images FROM part")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    url = F.lit("http://other.test/x/y.html")
    return _pages(spark, d).select("p_partkey", text.links("page", url).alias("links"), text.images("page", url).alias("images"))


@R.add("document_texts", r"SELECT doc_id, regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(text, '(?is)<(?:script)\b.*?</script\s*>|<(?:style)\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&#39;', ''''), '&nbsp;', ' '), '&#x27;', ''''), '&quot;', '\"'), '&gt;', '>'), '&lt;', '<'), '&amp;', '&'), '[ \t\n\x0b\f\r]+', ' ', 'g'), '^ +| +$', '', 'g') AS text FROM documents".replace('\\"', '"'))
def document_texts(spark: SparkSession, d: str) -> DataFrame:
    """The documents as pages: their text without markup."""
    return _docs(spark, d).select("doc_id", text.html_to_text("text").alias("text"))


@R.add("xml_fields", "SELECT p_partkey, [p_name] AS name, [p_brand, p_type] AS tags, []::VARCHAR[] AS absent FROM part")
def xml_fields(spark: SparkSession, d: str) -> DataFrame:
    from tamarisk.sources import tabular

    xml = F.concat(F.lit("<part><name>"), text.escape_html("p_name"), F.lit("</name><tags><tag>"), text.escape_html("p_brand"), F.lit("</tag><tag>"), text.escape_html("p_type"), F.lit("</tag></tags></part>"))
    return tabular.xml_values(table(spark, d, "part").select("p_partkey", xml.alias("x")), "x", {"name": "/part/name/text()", "tags": "//tag/text()", "absent": "/part/other/text()"}).drop("x")


# Small reports


@R.add("dependency_rows", "SELECT p_name AS name, unnest([p_brand, p_type]) AS requires FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_name, NULL FROM part WHERE p_size % 2 = 1")
def dependency_rows(spark: SparkSession, d: str) -> DataFrame:
    meta = F.struct(F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, F.array("p_brand", "p_type")).alias("requires_dist"))
    return reports.dependencies(table(spark, d, "part").select(F.to_json(F.struct(F.array(F.struct(meta.alias("metadata"))).alias("install"))).alias("json")))


@R.add("device_list", "SELECT p_name AS title, p_size::INT AS width, (p_size * 2)::INT AS height, 1.5 AS ratio FROM part UNION ALL SELECT 'plain', p_partkey::INT, NULL, NULL FROM part")
def device_list(spark: SparkSession, d: str) -> DataFrame:
    s = lambda c: c.cast("string")
    block = F.concat(F.lit('{"type": "phone", "title": "'), "p_name", F.lit('", "screen": {"device-pixel-ratio": 1.5, "vertical": {"width": '), s(F.col("p_size")), F.lit(', "height": '), s(F.col("p_size") * 2), F.lit('}}}, {"title":"plain","width":'), s(F.col("p_partkey")), F.lit("}"))
    return reports.device_rows(table(spark, d, "part").select(block.alias("text")))


@R.add("colour_notes", f"WITH x AS (SELECT p_partkey, lpad(to_hex(p_partkey * 7919 % 16777216)[-6:], 6, '0') AS h FROM part), y AS (SELECT p_partkey, lower(h) AS h FROM x), p(name, r, g, b) AS (VALUES {_PAL}), n AS (SELECT y.p_partkey, h, arg_min(name, (pow(('0x' || h[1:2])::INT - r, 2) + pow(('0x' || h[3:4])::INT - g, 2) + pow(('0x' || h[5:6])::INT - b, 2), name)) AS name FROM y, p GROUP BY ALL) SELECT p_partkey, 'on #' || h || ' [' || name || '] and #' || h || ' [' || name || '], #12' AS text FROM n")
def colour_notes(spark: SparkSession, d: str) -> DataFrame:
    code = F.lower(F.lpad(F.hex(F.col("p_partkey") * 7919 % 16777216), 6, "0"))
    t = table(spark, d, "part").select("p_partkey", F.concat(F.lit("on #"), code, F.lit(" and #"), code, F.lit(", #12")).alias("text"))
    return reports.colour_names(t, "text", spark.createDataFrame(list(COLOURS.items()), "name string, hex string"))


@R.add("example_rows", "SELECT p_partkey AS line_no, 'size(' || p_brand || ')' AS expression, p_size::VARCHAR AS expected FROM part")
def example_rows(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("  x = 1  # EX: size("), "p_brand", F.lit(") => "), F.col("p_size").cast("string"), F.lit("  "))
    code = table(spark, d, "part").select(F.col("p_partkey").alias("line_no"), line.alias("line"))
    return reports.example_tests(code.unionByName(code.withColumn("line", F.lit("# no example => here"))))


# Settings of a desktop


def _settings(spark: SparkSession, d: str) -> DataFrame:
    """Settings for each supplier: two containments, an applet in the first, and one that refers to the second."""
    i, name = F.col("s_suppkey").cast("string"), F.col("s_name")
    ini = F.concat_ws(
        "\n", F.concat(F.lit("[Containments]["), i, F.lit("]")), F.lit("plugin=org.kde.panel"), F.lit("lastScreen=0"), F.lit(""), F.concat(F.lit("[Containments]["), i, F.lit("][Applets][7][Configuration][General]")), F.concat(F.lit("title = "), name), F.lit("SystrayContainmentId=9999999"),
        F.concat(F.lit("[Containments]["), i, F.lit("][Applets][7]")), F.lit("plugin=org.kde.clock"), F.lit("[Containments][9999999]"), F.lit("plugin=org.kde.tray"), F.lit("[Other]"), F.lit("a=b=c"), F.lit("no setting"),
    )
    return lines.sections(lines.numbered(table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), ini.alias("text"))))


@R.add("ini_settings", "SELECT s_suppkey AS doc_id, unnest(['[Containments][' || s_suppkey || ']', '[Containments][' || s_suppkey || '][Applets][7][Configuration][General]', '[Containments][' || s_suppkey || '][Applets][7][Configuration][General]', '[Containments][' || s_suppkey || '][Applets][7]', '[Containments][9999999]', '[Other]']) AS section, unnest(['plugin', 'title', 'SystrayContainmentId', 'plugin', 'plugin', 'a']) AS name, unnest(['org.kde.panel', s_name, '9999999', 'org.kde.clock', 'org.kde.tray', 'b=c']) AS value FROM supplier")
def ini_settings(spark: SparkSession, d: str) -> DataFrame:
    return lines.without_keys(_settings(spark, d), ["lastscreen"]).drop("line_no")


@R.add("applet_rows", "SELECT s_suppkey AS doc_id, s_suppkey::BIGINT AS containment, 7::BIGINT AS applet, 'org.kde.clock' AS plugin, 'org.kde.panel' AS within FROM supplier")
def applet_rows(spark: SparkSession, d: str) -> DataFrame:
    return lines.applets(lines.properties(_settings(spark, d)))


@R.add("tray_references", "SELECT s_suppkey AS doc_id, s_suppkey::BIGINT AS containment, 7::BIGINT AS applet, 9999999::BIGINT AS target, 'org.kde.tray' AS target_plugin FROM supplier")
def tray_references(spark: SparkSession, d: str) -> DataFrame:
    return lines.references(lines.properties(_settings(spark, d)))


@R.add("lost_settings", "SELECT 0 AS doc_id, '' AS section, '' AS name, '' AS value WHERE false")
def lost_settings(spark: SparkSession, d: str) -> DataFrame:
    """Settings that the conversion to tables loses: none."""
    from tamarisk.operators import lookups

    s = _settings(spark, d)
    return lookups.missing_rows(s.select("doc_id", "section", "name", "value"), lines.as_settings(lines.properties(s)))


# Terms


@R.add("split_terms", "SELECT id, k AS token_no, t[k] AS token FROM (SELECT id, regexp_extract_all(text, '[A-Za-z0-9_]+') AS t FROM (SELECT DISTINCT id, text FROM snippets)), unnest(range(1, len(t) + 1)) AS u(k)")
def split_terms(spark: SparkSession, d: str) -> DataFrame:
    return language.word_tokens(table(spark, d, "snippets").select("id", "text").distinct(), "id", punctuation=False)


@R.add("indexed_tfidf", f"WITH {_IDX}, n AS (SELECT count(*) AS n FROM documents), df AS (SELECT term, count(*) AS df FROM idx GROUP BY term), s AS (SELECT doc_id, term AS ngram, tf, df, tf / sum(tf) OVER (PARTITION BY doc_id) * ln(n::DOUBLE / df) AS score FROM idx JOIN df USING (term), n), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, ngram) AS rank FROM s) SELECT doc_id, ngram, tf, df, round(score, 6) AS score, rank FROM r WHERE rank <= 5")
def indexed_tfidf(spark: SparkSession, d: str) -> DataFrame:
    """TF-IDF over the counts of an inverted index."""
    return tfidf.top_terms(search.index_counts(_index(spark, d)), table(spark, d, "documents").count(), 5).withColumn("score", F.round("score", 6))


@R.add("vectorizer_counts", "WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[A-Za-z0-9_]{2,}') AS w FROM documents WHERE text IS NOT NULL), g AS (SELECT doc_id, array_to_string(w[i : i + k - 1], ' ') AS term FROM w, unnest(range(1, len(w) + 1)) AS a(i), unnest([1, 2]) AS b(k) WHERE i + k - 1 <= len(w)) SELECT doc_id, term, count(*) AS n FROM g GROUP BY ALL")
def vectorizer_counts(spark: SparkSession, d: str) -> DataFrame:
    return tfidf.counted_terms(_docs(spark, d))


@R.add("capitals_first", f"WITH t AS (SELECT doc_id, term, count(*) AS score FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS term FROM documents) GROUP BY ALL) SELECT doc_id, term, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, {_TITLE.format('term')} DESC, term) AS rank FROM t QUALIFY rank <= 10")
def capitals_first(spark: SparkSession, d: str) -> DataFrame:
    t = _docs(spark, d).select("doc_id", F.explode(counting.matches("text", "[A-Za-z]+")).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("score"))
    return tfidf.capitals_first(t, "doc_id").where("rank <= 10")


# Tables, windows, maps


@R.add("table_sets", "SELECT 'both' AS kind, count(*) AS n FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_nationkey < 10) UNION ALL SELECT 'either', count(*) FROM (SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer) UNION ALL SELECT 'first alone', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)")
def table_sets(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey")
    kinds = {"both": o.intersect(c.where("c_nationkey < 10").select("k")), "either": o.union(c.select("k")).distinct(), "first alone": c.select("k").subtract(o)}
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k, t in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_WINDOWS = "rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)::INT AS quarter, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last_three"


@R.add("order_windows", f"SELECT o_orderkey, {_WINDOWS} FROM orders")
def order_windows(spark: SparkSession, d: str) -> DataFrame:
    over = lambda order, frame="": f"OVER (PARTITION BY o_custkey ORDER BY {order}{frame})"
    return table(spark, d, "orders").selectExpr(
        "o_orderkey", f"rank() {over('o_totalprice DESC, o_orderkey')} AS rank", f"ntile(4) {over('o_totalprice, o_orderkey')} AS quarter", f"lead(o_orderkey) {over('o_orderdate, o_orderkey')} AS next",
        f"round(sum(o_totalprice) {over('o_orderdate, o_orderkey', ' ROWS BETWEEN 2 PRECEDING AND CURRENT ROW')}, 2) AS last_three",
    )


@R.add("property_maps", "SELECT event_id, props::JSON->>'k' AS k, ['event', 'k'] AS names, event_type AS event, 2::INT AS size FROM events WHERE props IS NOT NULL AND event_type IS NOT NULL")
def property_maps(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("props IS NOT NULL AND event_type IS NOT NULL")
    m = e.select("event_id", F.map_concat(F.create_map(F.lit("k"), F.get_json_object("props", "$.k")), F.create_map(F.lit("event"), "event_type")).alias("m"))
    return m.select("event_id", F.element_at("m", "k").alias("k"), F.array_sort(F.map_keys("m")).alias("names"), F.element_at("m", "event").alias("event"), F.size("m").alias("size"))


@R.add("shown_rows", "WITH h AS (SELECT *, 'head' AS part FROM part ORDER BY p_partkey LIMIT 5), t AS (SELECT *, 'tail' AS part FROM part ORDER BY p_partkey DESC LIMIT 5), s AS (SELECT *, 'sample' AS part FROM part ORDER BY md5(p_partkey::VARCHAR), p_partkey LIMIT 5) SELECT p_partkey, p_name, part FROM h UNION ALL SELECT p_partkey, p_name, part FROM t UNION ALL SELECT p_partkey, p_name, part FROM s")
def shown_rows(spark: SparkSession, d: str) -> DataFrame:
    return columns.shown_rows(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey")


# Evaluation


@R.add("threshold_sweep", f"WITH {_CLS}, t AS (SELECT unnest([80.0, 100, 125, 150, 1000]) AS threshold), s AS (SELECT threshold::DOUBLE AS threshold, count(*) FILTER (glucose >= threshold AND a = '1') AS tp, count(*) FILTER (glucose >= threshold AND a = '0') AS fp, count(*) FILTER (glucose < threshold AND a = '1') AS fn FROM c, t WHERE glucose IS NOT NULL GROUP BY 1) SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM s")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    s = evaluation.threshold_sweep(_guessed(spark, d), F.col("a"), F.col("glucose"), [80, 100, 125, 150, 1000])
    return s.select("threshold", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@R.add("mean_scores", f"WITH {_CLS}, l AS (SELECT unnest(['0', '1']) AS label), s AS (SELECT label, count(*) FILTER (a = label) AS support, count(*) FILTER (p = label) AS guessed, count(*) FILTER (a = label AND p = label) AS tp FROM c, l GROUP BY label), r AS (SELECT support, tp / guessed AS p, tp / support AS r, 2 * tp / (guessed + support) AS f FROM s) SELECT count(*) AS classes, round(avg(p), 9) AS macro_precision, round(avg(r), 9) AS macro_recall, round(avg(f), 9) AS macro_f1, round(sum(p * support) / sum(support), 9) AS weighted_precision, round(sum(r * support) / sum(support), 9) AS weighted_recall, round(sum(f * support) / sum(support), 9) AS weighted_f1 FROM r")
def mean_scores(spark: SparkSession, d: str) -> DataFrame:
    m = evaluation.mean_scores(evaluation.class_report(_guessed(spark, d), "a", "p"))
    return m.select("classes", *[F.round(c, 9).alias(c) for c in m.columns[1:]])


@R.add("price_anova", "WITH g AS (SELECT c_mktsegment, count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), t AS (SELECT count(*) AS groups, sum(n)::BIGINT AS n, sum(n * v) AS within, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) AS between FROM g) SELECT groups, n, (groups - 1)::BIGINT AS df_between, (n - groups)::BIGINT AS df_within, round((between / (groups - 1)) / (within / (n - groups)), 5) AS f FROM t")
def price_anova(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return evaluation.anova(o, "o_totalprice", "c_mktsegment").select("groups", "n", "df_between", "df_within", F.round("f", 5).alias("f"))


# User functions and hooks


@R.add("hooked_lines", rf"WITH {_LINES} SELECT count(*) AS lines, sum(length(line))::BIGINT AS characters, sum(CASE WHEN contains(line, ':') THEN 1 ELSE 0 END)::BIGINT AS marked FROM l")
def hooked_lines(spark: SparkSession, d: str) -> DataFrame:
    """A script of hooks: lines are prepared, each is worked on, and the end sums up."""

    class Counted(steps.Script):
        def setup(self, df: DataFrame) -> DataFrame:
            return df.where("line IS NOT NULL")

        def process_line(self, df: DataFrame) -> DataFrame:
            return df.withColumns({"length": F.length("line"), "mark": F.contains("line", F.lit(":")).cast("int")})

        def wrap_up(self, df: DataFrame) -> DataFrame:
            return df.agg(F.count(F.lit(1)).alias("lines"), F.sum("length").alias("characters"), F.sum("mark").alias("marked"))

    return Counted().run(_lines(spark, d))


@R.add("expressions", "SELECT p_partkey, p_size * 2 + 1 AS twice, upper(p_brand) AS loud, p_size > 20 AND p_name LIKE '%a%' AS chosen FROM part")
def expressions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", *steps.evaluated({"twice": "p_size * 2 + 1", "loud": "upper(p_brand)", "chosen": "p_size > 20 AND p_name LIKE '%a%'"}))


@R.add("text_processors", "SELECT id, k AS token_no, lower(t[k]) AS token FROM (SELECT id, regexp_extract_all(text, '[A-Za-z0-9_]+') AS t FROM (SELECT DISTINCT id, text FROM snippets)), unnest(range(1, len(t) + 1)) AS u(k)")
def text_processors(spark: SparkSession, d: str) -> DataFrame:
    return steps.text_processor("lower_words")(table(spark, d, "snippets").select("id", "text").distinct(), "id")


@R.add("grouped_means", "SELECT p_brand, round(exp(avg(ln(p_retailprice))), 6) AS geometric, round(count(*) / sum(1 / p_retailprice), 6) AS harmonic FROM part GROUP BY p_brand")
def grouped_means(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("p_retailprice").cast("double")
    return table(spark, d, "part").groupBy("p_brand").agg(F.round(aggregates.geometric_mean(price), 6).alias("geometric"), F.round(aggregates.harmonic_mean(price), 6).alias("harmonic"))


@R.add("word_spans", "WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part) SELECT p_partkey, w[k] AS word, (length(array_to_string(w[1 : k - 1], ' ')) + CASE WHEN k > 1 THEN 1 ELSE 0 END)::INT AS start FROM w, unnest(range(1, len(w) + 1)) AS u(k)")
def word_spans(spark: SparkSession, d: str) -> DataFrame:
    """A table function applied to every row."""
    p = table(spark, d, "part").select("p_partkey", "p_name")
    return p.lateralJoin(aggregates.word_spans(F.col("p_name").outer())).select("p_partkey", "word", "start")
