"""Named queries of the llm problems, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.llm import mapping, ngrams, packing, sampling, surrogates, tokens
from tamarisk.plans.registry import Registry
from tamarisk.plans.scale import checkpoint, lookup, spread, table

R = Registry()

# Problem 1


def _classed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    iris = sampling.records(table(spark, d, "iris"), "iris", "obs_id", "class", "plot_id")
    diabetes = sampling.records(table(spark, d, "diabetes"), "diabetes", "record_id", "class", "clinic_id")
    return iris.unionByName(diabetes), table(spark, d, "sample_targets")


@R.add("p1_sample")
def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.draw(*_classed(spark, d))


@R.add("p1_margins", "SELECT DISTINCT plan_id, true AS classes, true AS strata FROM sample_targets")
def p1_margins(spark: SparkSession, d: str) -> DataFrame:
    """Whether the sample keeps both margins: the rows of every class, and of every stratum its share rounded down or up."""
    recs, targets = _classed(spark, d)
    return sampling.margins(recs, targets, sampling.draw(recs, targets))


_P1 = r"""
WITH rec AS (
  SELECT DISTINCT 'iris' AS table_name, obs_id AS k, lower(regexp_replace("class", '^\s+|\s+$', '', 'g')) AS ck FROM iris
  UNION ALL SELECT DISTINCT 'diabetes', record_id, lower(regexp_replace("class", '^\s+|\s+$', '', 'g')) FROM diabetes),
p AS (SELECT *, lower(trim("class")) AS ck FROM sample_targets),
n AS (SELECT table_name, ck, count(*) AS n FROM rec WHERE (table_name, ck) IN (SELECT (table_name, ck) FROM p) GROUP BY ALL),
t AS (SELECT table_name, sum(n) AS t FROM n GROUP BY ALL),
r AS (SELECT plan_id, p.table_name, "class", target_pct, min_rows, greatest(min_rows, coalesce(t, 0) * sample_pct * target_pct // 10000)::BIGINT AS requested, coalesce(n, 0)::BIGINT AS available
      FROM p LEFT JOIN n ON n.table_name = p.table_name AND n.ck = p.ck LEFT JOIN t ON t.table_name = p.table_name)
"""


@R.add("p1_report", _P1 + 'SELECT *, least(requested, available) AS drawn, available >= requested AS met FROM r')
def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return sampling.report(*_classed(spark, d))


@R.add("p1_found", _P1 + 'SELECT plan_id, "class" FROM r WHERE available < requested')
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return sampling.report(*_classed(spark, d)).where("NOT met").select("plan_id", "class")


# Problem 2

_P2 = r"""
WITH rec AS (SELECT id, min(text) AS text FROM snippets GROUP BY id),
tok AS (SELECT id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+')) AS term FROM rec WHERE text IS NOT NULL),
c AS (SELECT term, count(*) AS occurrences, count(DISTINCT id) AS records FROM tok GROUP BY term),
m AS (SELECT *, CASE WHEN records < 3 THEN 'rare' WHEN records * 100 > 24 * (SELECT count(*) FROM rec WHERE text IS NOT NULL) THEN 'common' END AS mark FROM c)
"""


#: Terms of a suffix where single terms are wanted: the first routes it, the second sorts it and spreads a frequent first one over tasks. A third
#: would change no count.
SUFFIX_TERMS = 2


def _ngrams(spark: SparkSession, d: str, max_n: int, sizes: tuple[int, ...] | None = None) -> DataFrame:
    return ngrams.count_ngrams(ngrams.one_record(table(spark, d, "snippets"), "id", "text", "ingested_at"), max_n=max_n, sizes=sizes)


def _marked(spark: SparkSession, d: str) -> DataFrame:
    return ngrams.mark_terms(_ngrams(spark, d, SUFFIX_TERMS, (1,)), ngrams.record_count(table(spark, d, "snippets"), "id", "text", "ingested_at"))


@R.add("p2_terms", _P2 + "SELECT term, occurrences, records, mark FROM m")
def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).select(F.col("ngram").alias("term"), "occurrences", "records", "mark")


@R.add("p2_found", _P2 + "SELECT term, mark FROM m WHERE mark IS NOT NULL")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).where("mark IS NOT NULL").select(F.col("ngram").alias("term"), "mark")


@R.add(
    "p2_trigrams",
    r"""
WITH rec AS (SELECT id, min(text) AS text FROM snippets GROUP BY id),
w AS (SELECT id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w FROM rec WHERE text IS NOT NULL),
g AS (SELECT id, k AS n, array_to_string(w[i : i + k - 1], ' ') AS ngram FROM w, unnest(range(1, len(w) + 1)) AS a(i), unnest([1, 2, 3]) AS b(k) WHERE i + k - 1 <= len(w))
SELECT ngram, n, count(*) AS occurrences, count(DISTINCT id) AS records FROM g GROUP BY ALL
""",
)
def p2_trigrams(spark: SparkSession, d: str) -> DataFrame:
    return _ngrams(spark, d, 3)


# Problem 3


def _cars(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(car_ID, CarName) once for each car, and the mapping of the distinct names."""
    names = table(spark, d, "car_names").select(F.col("name_id").alias("id"), F.col("car_name").alias("name"), "maker", F.col("maker_abbr").alias("abbr"))
    cars = ngrams.one_record(table(spark, d, "cars"), "car_ID", "CarName", "updated_at")
    return cars, mapping.map_values(cars.select("CarName"), names)


@R.add("p3_mapped")
def p3_mapped(spark: SparkSession, d: str) -> DataFrame:
    cars, mapped = _cars(spark, d)
    m = checkpoint(mapped.select(F.col("value").alias("CarName"), F.col("id").cast("int").alias("name_id"), "score"))
    return lookup(cars, m, ["CarName"])


@R.add("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    listed = table(spark, d, "car_names").select(F.col("car_name").alias("CarName")).where("CarName IS NOT NULL").distinct()
    cars, mapped = _cars(spark, d)
    m = mapped.select(F.col("value").alias("CarName"), F.col("id").cast("int").alias("name_id"))
    m = checkpoint(lookup(m, listed, ["CarName"], "left_anti"))
    return lookup(cars, m, ["CarName"], "inner").select(F.col("car_ID").cast("long").alias("car_ID"), "name_id")


# Problem 6


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"), "doc_id")


@R.add("p6_ids")
def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(_documents(spark, d))


@R.add("p6_spans")
def p6_spans(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_spans(tokens.encode_corpus(_documents(spark, d)))


@R.add("p6_decoded", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    return tokens.decode_corpus(tokens.encode_corpus(_documents(spark, d)))


# Problem 7


def _sizes(spark: SparkSession, d: str) -> tuple[DataFrame, list[str], DataFrame]:
    plans = table(spark, d, "pack_plans").select("plan_id", F.col("tokenizer").alias("kind"), F.col("capacity_tokens").alias("capacity"))
    names = packing.kinds(plans)
    return plans, names, tokens.token_counts(_documents(spark, d), names).select("doc_id", F.col("tokenizer").alias("kind"), F.col("tokens").alias("units"))


def _packed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    plans, _, sizes = _sizes(spark, d)
    return packing.pack(sizes, plans), plans


@R.add("p7_packed")
def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)[0].withColumnsRenamed({"start": "start_token", "units": "tokens"})


@R.add("p7_checked", "SELECT plan_id, true AS whole, true AS within, true AS filled FROM pack_plans")
def p7_checked(spark: SparkSession, d: str) -> DataFrame:
    """Whether every token of every document is packed once, in order, no container holds more than its capacity, and 97 % of the room is used."""
    plans, names, sizes = _sizes(spark, d)
    return packing.checked(packing.pack(sizes, plans), sizes, plans, 0.97)


@R.add("p7_fill")
def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(*_packed(spark, d))


# Problem 8


SECRET = "a key of the user's own"


def _personal(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, str]:
    return _documents(spark, d), table(spark, d, "person_names"), SECRET


@R.add("p8_found")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return surrogates.find_entities(*_personal(spark, d)).select("doc_id", "kind", "start_char")


@R.add("p8_redacted")
def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    return surrogates.replace_entities(*_personal(spark, d), by="placeholder")


@R.add("p8_surrogates")
def p8_surrogates(spark: SparkSession, d: str) -> DataFrame:
    return surrogates.replace_entities(*_personal(spark, d))


@R.add("p8_checked", "SELECT doc_id, true AS untouched, true AS changed FROM documents")
def p8_checked(spark: SparkSession, d: str) -> DataFrame:
    return surrogates.check_replaced(*_personal(spark, d))


@R.add("p8_distinct", "SELECT unnest(['email', 'id_number', 'phone', 'address', 'name']) AS kind, true AS apart, true AS together")
def p8_distinct(spark: SparkSession, d: str) -> DataFrame:
    return surrogates.check_distinct(surrogates.find_entities(*_personal(spark, d)))


QUERIES, SQL = R.queries, R.sql
