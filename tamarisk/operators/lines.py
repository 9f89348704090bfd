"""Operators on ordered lines of documents. Windows run within one document (file) or one range of rows, never over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.functions import dates
from tamarisk.plans.scale import PREV, with_previous


def numbered(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, line_no (from 1) and line; a null text has no lines, an empty one has one empty line."""
    rows = docs.select(key, F.posexplode_outer(F.split(F.col(text), "\n")).alias("i", "line")).where("line IS NOT NULL")
    return rows.select(key, (F.col("i") + 1).alias("line_no"), "line")


def _over(key: str, frame: str = "") -> str:
    return f"OVER (PARTITION BY `{key}` ORDER BY line_no{' ' + frame if frame else ''})"


def paragraphs(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, para_no, first_line, lines and text of each run of non-blank lines."""
    blank = "line RLIKE '^[ \\t\\r]*$'"
    marked = lines.withColumn("b", F.expr(blank)).withColumn("starts", F.expr(f"CASE WHEN NOT b AND coalesce(lag(b) {_over(key)}, true) THEN 1 ELSE 0 END"))
    grouped = marked.withColumn("para_no", F.expr(f"sum(starts) {_over(key)}")).where("NOT b")
    out = grouped.groupBy(key, "para_no").agg(F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("lines"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return out.select(key, "para_no", "first_line", "lines", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def pages(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Segments of lines at form feeds with page_no, page_line (both from 1): counters start again on each page."""
    seg = lines.select(key, "line_no", F.posexplode(F.split("line", "\f")).alias("part", "segment"))
    feeds = seg.withColumn("page_no", F.expr(f"1 + sum(CASE WHEN part > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY `{key}` ORDER BY line_no, part)"))
    return feeds.withColumn("page_line", F.expr(f"row_number() OVER (PARTITION BY `{key}`, page_no ORDER BY line_no, part)")).select(key, "page_no", "page_line", "line_no", "segment")


def carry_forward(lines: DataFrame, value: Column, name: str, default: str, key: str = "doc_id") -> DataFrame:
    """Adds the last non-null ``value`` at or above each line of its document, else ``default``."""
    return lines.withColumn(name, value).withColumn(name, F.coalesce(F.expr(f"last_value(`{name}`) IGNORE NULLS {_over(key)}"), F.lit(default)))


#: A line that starts a dated note.
DATE_LINE = r"^((?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]* )?[0-9]{1,2} [A-Z][a-z]{2} ([0-9]{4}|[0-9]{2})$"


def dated_notes(lines: DataFrame, key: str = "doc_id", default: str = "1 Jan 1900") -> DataFrame:
    """Lines that are no date line with the date text above them and its resolved date."""
    trimmed = F.regexp_replace("line", r"[ \t\r]+$", "")
    marked = carry_forward(lines.withColumn("is_date", trimmed.rlike(DATE_LINE)), F.when(F.col("is_date"), trimmed), "date_text", default, key)
    return marked.where("NOT is_date").select(key, "line_no", "line", "date_text", dates.resolve_date("date_text").alias("note_date"))


def merge_notes(notes: DataFrame, key: str = "doc_id") -> DataFrame:
    """All notes of the documents by date: note_date, notes (lines) and sources (documents), without blank lines."""
    kept = notes.where("line RLIKE '[^ \\t\\r]'")
    return kept.groupBy("note_date").agg(F.count(F.lit(1)).alias("notes"), F.countDistinct(key).alias("sources"), F.min("date_text").alias("date_text"))


def head_middle_tail(lines: DataFrame, head: int, middle: int, tail: int, interest: str, key: str = "doc_id") -> DataFrame:
    """Adds part (``head``, ``middle``, ``tail``) and drops the rest of documents longer than head and tail together.

    Of the lines between only the first ``middle`` that match ``interest`` (in any case) stay; shorter documents stay whole.
    """
    n = lines.withColumn("n", F.expr(f"count(*) OVER (PARTITION BY `{key}`)"))
    between = f"line_no > {head} AND line_no <= n - {tail} AND n > {head + tail}"
    hit = F.expr(between) & F.col("line").rlike(f"(?i){interest}")
    ranked = n.withColumn("hit", hit).withColumn("k", F.expr(f"sum(CASE WHEN hit THEN 1 ELSE 0 END) {_over(key, 'ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')}"))
    part = F.expr(f"CASE WHEN n <= {head + tail} OR line_no <= {head} THEN 'head' WHEN line_no > n - {tail} THEN 'tail' WHEN hit AND k <= {middle} THEN 'middle' END")
    return ranked.withColumn("part", part).where("part IS NOT NULL").select(key, "line_no", "part", "line")


def snipped(lines: DataFrame, kept: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key`` and the number of lines that sampling removed, for documents that lost any."""
    return lines.groupBy(key).agg(F.count(F.lit(1)).alias("all")).join(kept.groupBy(key).agg(F.count(F.lit(1)).alias("left")), key).where("all > left").select(key, (F.col("all") - F.col("left")).alias("removed"))


def time_deltas(df: DataFrame, group: str, ts: str, tie: str) -> DataFrame:
    """Adds delta_us, the microseconds since the row before it in its group; 0 for the first, null without a time."""
    rows = with_previous(df.where(F.col(ts).isNotNull()), group, [ts, tie], [ts])
    timed = rows.withColumn("delta_us", F.expr(f"coalesce(timestampdiff(MICROSECOND, {PREV}.`{ts}`, `{ts}`), 0L)")).drop(PREV)
    return timed.unionByName(df.where(F.col(ts).isNull()).withColumn("delta_us", F.lit(None).cast("bigint")))


#: A time in a log line.
STAMP = r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{1,2}:[0-9]{2}:[0-9]{2}([.,][0-9]+)?Z?"


def line_deltas(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines with a time stamp, its timestamp and the microseconds since the stamped line before it in the document."""
    stamp = F.regexp_extract("line", STAMP, 0)
    fixed = F.regexp_replace(F.replace(F.replace(stamp, F.lit(","), F.lit(".")), F.lit("T"), F.lit(" ")), r" ([0-9]):", " 0$1:")
    timed = lines.select(key, "line_no", dates.parse_timestamp(fixed).alias("ts")).where("ts IS NOT NULL")
    return timed.withColumn("delta_us", F.expr(f"coalesce(timestampdiff(MICROSECOND, lag(ts) {_over(key)}, ts), 0)"))


def sections(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, section, name, value of INI lines: each setting belongs to the header above it."""
    line = F.trim("line")
    header = F.when(line.rlike(r"^\[.*\]$"), line)
    marked = carry_forward(lines, header, "section", "", key)
    return marked.where(~line.rlike(r"^\[.*\]$") & line.contains("=")).select(key, "line_no", "section", F.trim(F.substring_index(line, "=", 1)).alias("name"), F.trim(F.regexp_replace(line, "^[^=]*=", "")).alias("value"))


def without_keys(settings: DataFrame, skip: list[str]) -> DataFrame:
    """Settings whose name is in no list of names to skip, in any case."""
    return settings.where(~F.lower("name").isin(*[x.lower() for x in skip]))


# Containments: a desktop's settings as tables


def properties(settings: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, containment, applet, path, name, value of INI settings under headers such as ``[Containments][8][Applets][21][General]``.

    containment and applet are the numbers in the header, null where it has none; path is the rest of the header.
    """
    header = r"^\[Containments\]\[(\d+)\](?:\[Applets\]\[(\d+)\])?"
    part = lambda k: F.nullif(F.regexp_extract("section", header, k), F.lit("")).cast("bigint")
    return settings.select(key, part(1).alias("containment"), part(2).alias("applet"), F.regexp_replace("section", header, "").alias("path"), "name", "value")


def applets(props: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, containment, applet, plugin of every applet, and the plugin of the containment it is in (one join on the number)."""
    top = props.where("path = '' AND name = 'plugin'")
    inner = top.where("applet IS NOT NULL").select(key, "containment", "applet", F.col("value").alias("plugin"))
    outer = top.where("applet IS NULL AND containment IS NOT NULL").select(key, "containment", F.col("value").alias("within"))
    return inner.join(outer, [key, "containment"], "left")


def references(props: DataFrame, name: str = "SystrayContainmentId", key: str = "doc_id") -> DataFrame:
    """``key``, containment, applet, target and target_plugin of settings that name a containment by its number, such as that of a system tray."""
    given = props.where(F.col("name") == name).select(key, "containment", "applet", F.col("value").try_cast("bigint").alias("target"))
    known = props.where("path = '' AND name = 'plugin' AND applet IS NULL AND containment IS NOT NULL").select(key, F.col("containment").alias("target"), F.col("value").alias("target_plugin"))
    return given.join(known, [key, "target"], "left")


def as_settings(props: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, section, name, value: the settings that ``properties`` came from, to check that none is lost."""
    c = F.when(F.col("containment").isNotNull(), F.concat(F.lit("[Containments]["), F.col("containment").cast("string"), F.lit("]"))).otherwise("")
    a = F.when(F.col("applet").isNotNull(), F.concat(F.lit("[Applets]["), F.col("applet").cast("string"), F.lit("]"))).otherwise("")
    return props.select(key, F.concat(c, a, "path").alias("section"), "name", "value")
