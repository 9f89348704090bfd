"""Log refinement, time sheets, and test-log summaries over numbered lines (see ``lines``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.functions import dates
from tamarisk.operators import counting
from tamarisk.plans.scale import checkpoint

# Log refinement


#: What a terminal takes as a command and does not show, by the grammar of its standard (ECMA-48): control sequences, control strings, and
#: the other sequences that begin with the escape character.
COMMANDS = r"\x1b(?:\[[0-?]*[ -/]*[@-~]|[\]PX^_][^\x07\x1b]*(?:\x07|\x1b\\)|[ -/]+[0-~]|[0-OQ-WYZ\\`-~])"
_SILENT = "\x07\x1b"


def collapsed(line: Column | str) -> Column:
    """A terminal line as it ends up: commands taken out, what follows the last carriage return that has text after it, and each backspace
    taking the character before it.

    The pieces between backspaces are joined one by one, each to what is left of those before it, so the work grows with the line.
    """
    shown = F.regexp_replace(F.col(line) if isinstance(line, str) else line, COMMANDS, "")
    returned = F.element_at(F.split(F.rtrim(shown, F.lit("\r")), "\r", -1), -1)
    pieces = F.split(F.translate(returned, _SILENT, ""), "\b", -1)
    first, others = F.element_at(pieces, 1), F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.aggregate(others, first, lambda kept, piece: F.concat(F.left(kept, F.greatest(F.length(kept) - 1, F.lit(0))), piece))


def collapse(lines: DataFrame) -> DataFrame:
    """``collapsed`` lines that are not blank."""
    blank = r"^[ \t\r\n]*$"
    return lines.where(~F.col("line").rlike(blank)).withColumn("line", collapsed("line")).where(~F.col("line").rlike(blank))


def frequent_paths(lines: DataFrame, most: int = 10, min_parts: int = 5, min_length: int = 40) -> list[str]:
    """Directory prefixes worth abbreviating, longest first: the best score (length times count) is taken, then the best that is
    not part of one taken, until there are ``most``. Candidates are counted in full; one row a round comes to the driver."""
    stats = checkpoint(counting.prefix_stats(lines.select(F.col("line").alias("t")), "t", min_parts, min_length))
    taken: list[str] = []
    while len(taken) < most:
        left = stats
        for t in taken:
            left = left.where(~F.contains(F.lit(t), F.col("prefix")))
        best = left.orderBy(F.desc("score"), F.desc(F.length("prefix")), "prefix").limit(1).collect()
        if not best:
            break
        taken.append(best[0].prefix)
    return sorted(taken, key=len, reverse=True)


def abbreviate(lines: DataFrame, parts: list[str], name: str = "path") -> DataFrame:
    """Every listed part as ``{name1}``, ``{name2}``, in the order of the list."""
    c = F.col("line")
    for k, p in enumerate(parts, 1):
        c = F.replace(c, F.lit(p), F.lit(f"{{{name}{k}}}"))
    return lines.withColumn("line", c)


def long_tokens(lines: DataFrame, min_length: int = 30, min_count: int = 2) -> DataFrame:
    """(token, n, score) of tokens of at least ``min_length`` characters that recur."""
    t = lines.select(F.explode(F.regexp_extract_all("line", F.lit(r"[^ \t]{" + str(min_length) + ",}"), F.lit(0))).alias("token"))
    return t.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count).withColumn("score", F.col("n") * F.length("token"))


# Time sheets

DAY = r"^(mon|tue|wed|thu|fri|sat|sun)[a-z]*:[ \t\r]*$"


def time_lines(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines of time sheets with day, block, hours, tag and stated hours; other lines are left out.

    A block ends at its ``Hours:`` line; the day is that of the last weekday line. Hours come from ``h[:mm]-h[:mm]``, an end
    before the start being 12 hours later; the tag stands in brackets, ``n/a`` without one. Runs within each document.
    """
    low = F.lower("line")
    own = r"^[ \t]*[0-9]+:?[0-9]*(?:am|pm)?-[0-9]+:?[0-9]*(?:am|pm)?:?[ \t]"
    m = lines.select(key, "line_no", low.alias("l")).withColumns(
        {
            "day_here": F.nullif(F.regexp_extract("l", DAY, 1), F.lit("")), "hours": F.when(F.col("l").rlike(own), dates.range_hours("l")),
            "tag": F.coalesce(F.nullif(F.regexp_extract("l", r"\[([a-z0-9_/\-]+)\]", 1), F.lit("")), F.lit("n/a")),
            "stated": F.regexp_extract("l", r"^hours:[ \t]*([0-9.]+)", 1).try_cast("double"), "is_end": F.col("l").rlike("^hours:"),
            "stated_total": F.regexp_extract("l", r"^total hours:[ \t]*([0-9.]+)", 1).try_cast("double"),
        }
    )
    over = f"OVER (PARTITION BY `{key}` ORDER BY line_no"
    b = m.withColumn("day", F.expr(f"last_value(day_here) IGNORE NULLS {over})")).withColumn("block", F.expr(f"1 + coalesce(sum(CASE WHEN is_end THEN 1 ELSE 0 END) {over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"))
    return b.where("hours IS NOT NULL OR is_end OR stated_total IS NOT NULL").select(key, "line_no", "day", "block", "hours", "tag", "stated", "is_end", "stated_total")


def time_blocks(times: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, block, day, calculated and stated hours, and whether they agree; blocks without hours and end are left out."""
    b = times.where("hours IS NOT NULL OR is_end").groupBy(key, "block").agg(F.max_by("day", "line_no").alias("day"), F.coalesce(F.sum("hours"), F.lit(0.0)).alias("calculated"), F.max("stated").alias("stated"))
    return b.withColumn("agrees", F.coalesce(F.abs(F.col("calculated") - F.col("stated")) < 1e-6, F.lit(False)))


def time_by_tag(times: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hours of each document and tag with the totals of documents, tags (``level`` counts what is summed over) and of all."""
    return times.where("hours IS NOT NULL").cube(key, "tag").agg(F.sum("hours").alias("hours"), F.bit_count(F.grouping_id()).cast("int").alias("level")).where("hours <> 0")


def time_totals(times: DataFrame, key: str = "doc_id") -> DataFrame:
    t = times.groupBy(key).agg(F.coalesce(F.sum("hours"), F.lit(0.0)).alias("calculated"), F.max("stated_total").alias("stated"))
    return t.withColumn("agrees", F.abs(F.col("calculated") - F.col("stated")) < 1e-6)


# Test logs

# Fixed value: the form of a summary line, a row of counts between equals signs.
SUMMARY = "= .*(passed|failed|skipped).* ="
COUNTS = ("passed", "failed", "skipped", "xfailed", "xpassed")


def test_summaries(lines: DataFrame, key: str = "doc_id", combine: bool = False, treat_x: bool = False) -> DataFrame:
    """Counts and duration of the summary lines of each document: of the last line, or ``combine``: of all together.

    total is passed and failed (``treat_x``: and xfailed and xpassed); ok_pct their passed share, at most 100, 0 without tests.
    """
    rows = lines.where(F.col("line").rlike(SUMMARY))
    number = lambda p: F.coalesce(F.nullif(F.regexp_extract("line", p, 1), F.lit("")).try_cast("double"), F.lit(0.0))
    parsed = rows.select(key, "line_no", *[number(rf"([0-9]+) {c}").cast("long").alias(c) for c in COUNTS], number(r"in ([0-9.]+) ?s").alias("duration"))
    fields = [*COUNTS, "duration"]
    if combine:
        g = parsed.groupBy(key).agg(*[F.sum(c).alias(c) for c in fields])
    else:
        g = parsed.groupBy(key).agg(F.max_by(F.struct(*fields), "line_no").alias("r")).select(key, "r.*")
    total, ok = F.col("passed") + F.col("failed"), F.col("passed")
    if treat_x:
        total, ok = total + F.col("xfailed") + F.col("xpassed"), ok + F.col("xpassed")
    return g.withColumn("total", total).withColumn("ok_pct", F.when(total > 0, F.least(ok * 100.0 / total, F.lit(100.0))).otherwise(0.0))


# Small reports


def colour_names(df: DataFrame, column: str, palette: DataFrame) -> DataFrame:
    """``column`` with the name of the nearest palette colour (name, hex) after each ``#rrggbb``: ``#ff0000 [red]``.

    The codes are looked up in the palette, of checked size, which the expression holds.
    """
    from tamarisk.functions import numbers
    from tamarisk.operators.lookups import MAX_PALETTE
    from tamarisk.plans.scale import fits

    if not fits(palette, MAX_PALETTE):
        raise ValueError(f"more than {MAX_PALETTE} colours")
    rows = palette.select("name", numbers.rgb("hex").alias("c")).where("c IS NOT NULL").collect()
    colours = F.array(*[F.struct(F.lit(r["name"]).alias("name"), F.lit(r["c"]["r"]).alias("r"), F.lit(r["c"]["g"]).alias("g"), F.lit(r["c"]["b"]).alias("b")) for r in rows])
    square = lambda a, b: (a - b) * (a - b)

    def named(code: Column) -> Column:
        c = numbers.rgb(code)
        return F.array_min(F.transform(colours, lambda p: F.struct((square(p["r"], c["r"]) + square(p["g"], c["g"]) + square(p["b"], c["b"])).alias("d"), p["name"].alias("name"))))["name"]

    codes = F.array_distinct(F.regexp_extract_all(column, F.lit("#[0-9a-fA-F]{6}"), F.lit(0)))
    return df.withColumn(column, F.aggregate(codes, F.col(column), lambda a, code: F.replace(a, code, F.concat(code, F.lit(" ["), named(code), F.lit("]")))))


def example_tests(lines: DataFrame) -> DataFrame:
    """Lines ``# EX: expression => value`` as (line_no, expression, expected)."""
    p = r"#\s*EX:\s*(.*?)\s*=>\s*(.*?)\s*$"
    return lines.where(F.col("line").rlike(p)).select("line_no", F.regexp_extract("line", p, 1).alias("expression"), F.regexp_extract("line", p, 2).alias("expected"))


def dependencies(reports_: DataFrame, column: str = "json") -> DataFrame:
    """(name, requires) of an installation report in JSON: one row for each required package, null for none."""
    schema = "install array<struct<metadata: struct<name: string, requires_dist: array<string>>>>"
    items = reports_.select(F.explode(F.from_json(column, schema)["install"]["metadata"]).alias("m"))
    return items.select("m.name", F.explode_outer("m.requires_dist").alias("requires"))


def device_rows(df: DataFrame, column: str = "text") -> DataFrame:
    """(title, width, height, ratio) of the device descriptions in a text of JSON-like blocks, in any order of the fields; absent numbers are null."""
    blocks = F.filter(F.split(F.col(column), r"(?=\"title\"\s*:)"), lambda b: b.contains('"title"'))
    b = df.select(F.explode(blocks).alias("b"))
    number = lambda name, kind: F.regexp_extract("b", rf'"{name}"\s*:\s*([0-9.]+)', 1).try_cast(kind)
    return b.select(F.regexp_extract("b", r'"title"\s*:\s*"([^"]*)"', 1).alias("title"), number("width", "int").alias("width"), number("height", "int").alias("height"), number("device-pixel-ratio", "double").alias("ratio"))
