"""Queries of the general data-quality problems: p4_* (filling missing values) and p5_* (rows that fail to parse)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.operators import impute
from tamarisk.plans.registry import Registry
from tamarisk.plans.scale import table
from tamarisk.sources import records

R = Registry()


def diabetes_spec(spark: SparkSession, d: str) -> impute.FillSpec:
    """The bounds come from the rows of field_ranges for the three fields."""
    fields = ("diastolic", "triceps", "insulin")
    bounds = {r.field: (r.low, r.high) for r in table(spark, d, "field_ranges").where(F.col("field").isin(*fields)).groupBy("field").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()}
    numeric = {f: bounds[f] for f in fields}
    return impute.FillSpec("record_id", numeric, "class", ("0", "1"), ("glucose", "BMI", "age", "pregnant", "pedigree"), "clinic_id", "patient_id", "measured_at", "received_at")


def _filled(spark: SparkSession, d: str) -> tuple[DataFrame, impute.FillSpec]:
    spec = diabetes_spec(spark, d)
    return impute.fill_missing(table(spark, d, "diabetes"), spec), spec


@R.add("p4_filled")
def p4_filled(spark: SparkSession, d: str) -> DataFrame:
    return _filled(spark, d)[0]


@R.add(
    "p4_quality",
    r"""
WITH rec AS (SELECT record_id, min_by(struct_pack(diastolic, triceps, insulin, "class" := "class"), received_at) AS r FROM diabetes GROUP BY record_id),
m AS (SELECT record_id, f AS field, regexp_replace(CASE f WHEN 'diastolic' THEN r.diastolic WHEN 'triceps' THEN r.triceps WHEN 'insulin' THEN r.insulin ELSE r."class" END, '^\s+|\s+$', '', 'g') AS v
      FROM rec, (SELECT unnest(['diastolic', 'triceps', 'insulin', 'class']) AS f)),
t AS (SELECT m.field, ('0x' || left(md5(m.field || '|' || record_id::VARCHAR), 6))::BIGINT % 20 = 0 AS chosen,
      CASE WHEN m.field = 'class' THEN v IN ('0', '1') ELSE regexp_full_match(v, '[+-]?[0-9]+(\.[0-9]+)?') AND try_cast(v AS DOUBLE) BETWEEN low AND high END AS usable FROM m LEFT JOIN field_ranges r ON r.field = m.field)
SELECT field, count(*) FILTER (chosen AND usable) AS hidden, true AS better FROM t GROUP BY field
""",
)
def p4_quality(spark: SparkSession, d: str) -> DataFrame:
    """Hidden values of each field, and whether the fill is nearer to them than the clinic's mean (or most frequent class) is, give or take two standard
    errors of such an error (few values are hidden in a small table)."""
    plain = F.col("plain_error") * (1 + 2 / F.sqrt(2 * F.col("hidden")))
    return impute.hidden(table(spark, d, "diabetes"), diabetes_spec(spark, d)).select("field", "hidden", (F.col("error") < plain).alias("better"))


@R.add(
    "p4_found",
    r"""
WITH rec AS (SELECT DISTINCT record_id, diastolic, triceps, insulin, "class" AS cls FROM diabetes),
m AS (
  SELECT record_id, 'diastolic' AS field, diastolic AS v FROM rec UNION ALL
  SELECT record_id, 'triceps', triceps FROM rec UNION ALL
  SELECT record_id, 'insulin', insulin FROM rec),
t AS (SELECT m.record_id, m.field, regexp_replace(m.v, '^\s+|\s+$', '', 'g') AS v, r.low, r.high FROM m JOIN field_ranges r ON r.field = m.field)
SELECT record_id, field FROM t
WHERE v IS NULL OR NOT regexp_full_match(v, '[+-]?[0-9]+(\.[0-9]+)?') OR NOT (try_cast(v AS DOUBLE) BETWEEN low AND high)
UNION ALL
SELECT record_id, 'class' FROM rec WHERE cls IS NULL OR regexp_replace(cls, '^\s+|\s+$', '', 'g') NOT IN ('0', '1')
""",
)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return impute.found(*_filled(spark, d))


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return records.parse_rows(table(spark, d, "raw_lines"), table(spark, d, "snippet_labels"))


_P5 = r"""
r AS (SELECT * FROM raw_lines WHERE line_no <> 1 AND NOT starts_with(text, '#')),
c AS (SELECT line_id, regexp_full_match(text, '(?s)("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*') AS quoted_well,
             regexp_extract_all(',' || text, '(?s),("(?:[^"]|"")*"|[^",]*)', 1) AS f
      FROM r WHERE layout = 'snip_csv'),
u AS (SELECT line_id, quoted_well, list_transform(f, lambda x: CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) AS f FROM c),
snip AS (SELECT line_id, f, CASE WHEN NOT quoted_well THEN 'quoting' WHEN len(f) <> 5 THEN 'columns'
    WHEN NOT regexp_full_match(f[1], '[0-9]{1,18}') OR regexp_full_match(f[1], '0+') OR f[2] NOT IN (SELECT label FROM snippet_labels)
      OR NOT regexp_full_match(f[3], '[0-9]{4}-[0-9]{2}-[0-9]{2}') OR try_cast(f[3] AS DATE) IS NULL
      OR NOT (f[4] = '' OR (regexp_full_match(f[4], '[0-9]+(\.[0-9]+)?') AND try_cast(f[4] AS DOUBLE) <= 5)) OR regexp_full_match(f[5], '\s*') THEN 'value' END AS reason FROM u),
tsv AS (SELECT line_id, f, CASE WHEN len(f) <> 2 THEN 'columns' WHEN lower(f[1]) NOT IN (SELECT label FROM snippet_labels) OR regexp_full_match(f[2], '\s*') THEN 'value' END AS reason
      FROM (SELECT line_id, string_split(text, chr(9)) AS f FROM r WHERE layout = 'cat_tsv')),
pip AS (SELECT line_id, f, CASE WHEN len(f) <> 4 THEN 'columns'
    WHEN NOT regexp_full_match(f[1], '[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}') OR try_cast(f[1] AS TIMESTAMP) IS NULL OR substr(f[1], 12, 2) > '23'
      OR NOT regexp_full_match(f[2], '[0-9]{1,3}(\.[0-9]{1,3}){3}') OR list_max(list_transform(string_split(f[2], '.'), lambda x: try_cast(x AS INT))) > 255
      OR NOT regexp_full_match(f[3], '[0-9]{1,18}') OR regexp_full_match(f[3], '0+') OR regexp_full_match(f[4], '\s*') THEN 'value' END AS reason
      FROM (SELECT line_id, string_split(text, ' | ') AS f FROM r WHERE layout = 'sess_pipe')),
parsed AS (SELECT * FROM snip UNION ALL SELECT * FROM tsv UNION ALL SELECT * FROM pip)
"""


@R.add(
    "p5_records",
    f"""WITH {_P5} SELECT line_id, file_name, line_no, layout, CASE WHEN layout = 'snip_csv' THEN try_cast(f[1] AS BIGINT) END AS id,
  CASE layout WHEN 'snip_csv' THEN f[2] WHEN 'cat_tsv' THEN lower(f[1]) END AS label, CASE WHEN layout = 'snip_csv' THEN try_cast(f[3] AS DATE) END AS seen_on,
  CASE WHEN layout = 'snip_csv' THEN try_cast(f[4] AS DOUBLE) END AS rating, CASE WHEN layout = 'sess_pipe' THEN try_cast(f[1] AS TIMESTAMP) END AS ts,
  CASE WHEN layout = 'sess_pipe' THEN f[2] END AS ip, CASE WHEN layout = 'sess_pipe' THEN try_cast(f[3] AS BIGINT) END AS session_id, CASE WHEN layout = 'sess_pipe' THEN f[4] END AS keyword,
  CASE layout WHEN 'snip_csv' THEN f[5] WHEN 'cat_tsv' THEN f[2] END AS text FROM parsed JOIN (SELECT line_id, file_name, line_no, layout FROM r) USING (line_id) WHERE reason IS NULL""",
)
def p5_records(spark: SparkSession, d: str) -> DataFrame:
    return records.valid(_parsed(spark, d))


@R.add("p5_errors")
def p5_errors(spark: SparkSession, d: str) -> DataFrame:
    return records.failed(_parsed(spark, d))


@R.add("p5_found", f"WITH {_P5} SELECT line_id, reason FROM parsed WHERE reason IS NOT NULL")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return records.failed(_parsed(spark, d)).select("line_id", "reason")


#: Lines of a file that are joined to one text; a block starts at a record, as every row holds one.
BLOCK_LINES = 1000


@R.add(
    "p5_recovered",
    f"""WITH {_P5}, b AS (SELECT file_name || '#' || (line_no // {BLOCK_LINES})::VARCHAR AS path, line_no, line_id, reason, length(text) AS n, row_number() OVER w AS record_no, sum(length(text) + 1) OVER w AS upto
      FROM snip JOIN r USING (line_id) WINDOW w AS (PARTITION BY file_name, line_no // {BLOCK_LINES} ORDER BY line_no, line_id))
SELECT path, record_no::INT AS record_no, (upto - n)::INT AS start_char, reason FROM b""",
)
def p5_recovered(spark: SparkSession, d: str) -> DataFrame:
    """The csv files as running texts in blocks of BLOCK_LINES records, without what is known of where records start, parsed with
    recovery at record starts: path, record_no, start_char and reason. Where two bad records stand in a row, or one without text, a running text may not tell where the
    second starts, and then they come out as one (at sf0.1 this is so for 11 of 6877 records, at sf0.01 for none)."""
    rows = table(spark, d, "raw_lines").where("layout = 'snip_csv' AND line_no <> 1 AND text IS NOT NULL AND NOT startswith(text, '#')")
    block = F.concat_ws("#", "file_name", F.floor(F.col("line_no") / BLOCK_LINES).cast("string"))
    texts = rows.groupBy(block.alias("path")).agg(F.array_sort(F.collect_list(F.struct("line_no", "line_id", "text"))).alias("l"))
    labels = records.allowed_labels(table(spark, d, "snippet_labels"))
    parsed = records.parse_texts(texts.select("path", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text")), "snip_csv", labels)
    return parsed.select("path", "record_no", "start_char", "reason")
