"""Delimited, JSON, YAML and XML sources and sinks; every column is text unless a schema says otherwise."""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Reader and writer options of the known dialects.
DIALECTS = {
    "excel": {"sep": ",", "quote": '"', "escape": '"'},
    "unix": {"sep": ",", "quote": '"', "escape": '"', "quoteAll": "true"},
    "pyspark": {"sep": ",", "quote": '"', "escape": "\\"},
    "hive": {"sep": ",", "quote": '"', "escape": "\\"},
    "tab": {"sep": "\t", "quote": "", "escape": "\\"},
}
#: Characters that are looked at to guess a dialect.
SNIFF_CHARS = 65_536
_END = "\u0002"


def dialect_of(path: str, dialect: str | None = None, sep: str | None = None) -> dict[str, str]:
    """Options of the named dialect, or of the file's extension; ``sep`` overrides its separator."""
    options = dict(DIALECTS[dialect] if dialect else DIALECTS["tab"] if path.rstrip("/").lower().endswith((".tsv", ".tab")) else DIALECTS["excel"])
    if sep:
        options["sep"] = sep
        if sep == "\t":
            options["quote"] = ""
    return options


def sniff(spark: SparkSession, path: str, lines: int = 200) -> dict[str, str]:
    """Guesses separator and quote from the first ``lines`` lines; those of ``excel`` if they give no clue."""
    head = "\n".join(r.value for r in spark.read.text(path).limit(lines).collect())[:SNIFF_CHARS]
    try:
        d = csv.Sniffer().sniff(head, delimiters=",\t;|")
    except csv.Error:
        return dict(DIALECTS["excel"])
    return {"sep": d.delimiter, "quote": d.quotechar or '"', "escape": '"' if d.doublequote else d.escapechar or "\\"}


def _first_file(spark: SparkSession, path: str) -> str | None:
    """The file of the smallest name below a path that holds anything; only names and lengths are read."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where("length > 0").agg(F.min("path")).first()
    return names[0]


def read_delimited(spark: SparkSession, path: str, dialect: str | None = None, sep: str | None = None, header: bool = True, comments: bool = True, options: dict[str, str] | None = None, multiline: bool = False) -> DataFrame:
    """All columns as text. ``NA`` is text and an empty field an empty text; short rows end in nulls, rows with too many fields are
    skipped, blank lines too; ``comments``: the text from a ``#`` on is dropped, also within a line (not for a named dialect).

    ``header``: the first line of every file is its header, other lines equal to it are data; the columns are named by the header of the first file.
    Without a header the columns are ``c1``, ``c2`` and so on, as many as its first line has. A byte order mark is dropped. A folder
    without a line gives a table without columns. ``multiline``: quoted fields may hold line breaks; a file is
    then one task's work, else files are split.
    """
    o = options or dialect_of(path, dialect, sep)
    cut = comments and dialect is None
    settings = {k: v for k, v in o.items() if k != "quoteAll"} | {"lineSep": "\n", "maxCharsPerColumn": "-1"}
    if cut:
        settings["comment"] = "#"
    first = _first_file(spark, path)
    line = F.regexp_replace(F.regexp_replace("value", "^\ufeff", ""), "#.*$" if cut else "\r$", "")
    head = spark.read.text(first, lineSep="\n").select(line.alias("line")).where("trim(line) <> ''").limit(1).collect() if first else []
    if not head:
        return spark.createDataFrame([], T.StructType([]))
    quote = {"quotechar": o["quote"]} if o["quote"] else {"quoting": csv.QUOTE_NONE}
    names = next(csv.reader([head[0].line.rstrip("\r")], delimiter=o["sep"], **quote))
    columns = names if header else [f"c{i + 1}" for i in range(len(names))]
    raw = [f"f{i}" for i in range(len(columns))]
    schema = ", ".join(f"{c} string" for c in [*raw, "__bad"])
    rows = spark.read.schema(schema).options(**settings).option("header", header).option("enforceSchema", True).option("multiLine", multiline).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__bad").csv(path)
    # Records with another number of fields are parsed again with one column more and an end mark that tells short ones from long ones.
    text = F.regexp_replace("__bad", "[\r\n]+$", "")
    text = F.regexp_replace(text, "#.*$", "") if cut else text
    again = F.from_csv(F.concat(text, F.lit(o["sep"] + _END)), ", ".join(f"{c} string" for c in [*raw, "__more"]), {k: v for k, v in settings.items() if k != "comment"} | {"mode": "PERMISSIVE"})
    rows = rows.withColumn("__r", F.when(F.col("__bad").isNotNull(), again))
    at = F.array_position(F.array(*[F.coalesce(F.col("__r")[c], F.lit("")) for c in [*raw, "__more"]]), _END)
    rows = rows.withColumn("__n", F.when(F.col("__bad").isNull(), len(raw) + 1).otherwise(at)).where("__n > 0")
    value = [F.when(F.col("__n") > i + 1, F.coalesce(F.when(F.col("__bad").isNull(), F.col(c)).otherwise(F.col("__r")[c]), F.lit(""))) for i, c in enumerate(raw)]
    value[0] = F.regexp_replace(value[0], "^\ufeff", "")
    if cut:
        # A record of the right number of fields may have a comment in its last ones.
        marked = [F.coalesce(F.contains(v, F.lit("#")), F.lit(False)) for v in value]
        before = [F.lit(False)]
        for m in marked[:-1]:
            before.append(before[-1] | m)
        value = [F.when(~b, F.regexp_replace(v, "#(?s:.*)$", "")) for v, b in zip(value, before)]
    out = rows.select(*[v.alias(c) for v, c in zip(value, columns)])
    return out.where(~F.forall(F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in columns]), lambda v: v == "")) if cut and len(columns) == 1 else out


def write_delimited(df: DataFrame, path: str, dialect: str | None = None, sep: str | None = None, header: bool = True, mode: str = "errorifexists") -> None:
    """One file for each partition, without an index; nulls are written as empty fields, blanks at the ends of texts stay."""
    rows = df.select(*[F.col(f"`{c}`").cast("string") for c in df.columns]).write.mode(mode).options(**dialect_of(path, dialect, sep))
    rows.option("header", header).option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("lineSep", "\n").csv(path)


def write_labelled(df: DataFrame, path: str, label: str, text: str, mode: str = "errorifexists") -> None:
    """Lines of label, tab and text, tabs and newlines in the text as blanks."""
    df.select(F.concat_ws("\t", label, F.regexp_replace(text, "[\t\n]", " ")).alias("value")).write.mode(mode).text(path)


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """(label, text) of lines with exactly one tab, the label in lower case; other lines are skipped."""
    p = spark.read.text(path, lineSep="\n").select(F.split("value", "\t").alias("p")).where("size(p) = 2")
    return p.select(F.lower(F.col("p")[0]).alias("label"), F.col("p")[1].alias("text"))


def read_lines(spark: SparkSession, path: str, comments: bool = False) -> DataFrame:
    """(path, line_no, line): the lines of each file in order, numbered from 1; ``comments``: text from ``;`` or ``#`` on is dropped.

    A file is read whole by one task so that its lines can be numbered without a sort; split large files first.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\n$", "").alias("t")).where("t <> ''")
    out = whole.select("path", F.posexplode(F.split("t", "\n")).alias("i", "line")).select("path", (F.col("i") + 1).alias("line_no"), "line")
    return out.withColumn("line", F.regexp_replace("line", "[;#].*$", "")) if comments else out


def write_lines(df: DataFrame, column: str, path: str, mode: str = "errorifexists") -> None:
    """A text column as lines; ``mode="append"`` adds files to those that are there."""
    df.select(F.col(column).cast("string").alias("value")).write.mode(mode).text(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of whole files as bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "content")


def numbered_table(lines: DataFrame) -> DataFrame:
    """(key, value): the number of each line of ``read_lines``, from 0 and as text, and the trimmed line."""
    return lines.select((F.col("line_no") - 1).cast("string").alias("key"), F.trim("line").alias("value"))


def list_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = False, newer_than: str | None = None) -> DataFrame:
    """path, length and modified of the files below a directory that are not empty; ``newer_than``: an ISO timestamp."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    for k, v in (("pathGlobFilter", glob), ("modifiedAfter", newer_than)):
        r = r.option(k, v) if v else r
    return r.load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def newer_files(spark: SparkSession, path: str, index: str, extensions: Sequence[str] = ("pdf", "docx", "html", "txt")) -> DataFrame:
    """The files below ``path`` with one of the extensions that changed after the newest file below ``index``; all of them without an index."""
    newest = list_files(spark, index, recursive=True).agg(F.max("modified")).scalar()
    named = list_files(spark, path, recursive=True).where(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(*[e.lower() for e in extensions]))
    return named.where(newest.isNull() | (F.col("modified") > newest))


def directory_listing(spark: SparkSession, path: str) -> DataFrame:
    """name, directory, permissions, length and modified of what is in a directory, by name; read through the file system of the path, not the driver's disk."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    rows = sorted((s.getPath().getName(), s.isDirectory(), s.getPermission().toString(), s.getLen(), s.getModificationTime() / 1000) for s in found)
    return spark.createDataFrame(rows, "name string, directory boolean, permissions string, length bigint, modified double")


def json_to_lines(spark: SparkSession, source: str, target: str, mode: str = "errorifexists") -> None:
    """Files with a JSON array each as one object per line."""
    spark.read.json(source, multiLine=True).write.mode(mode).json(target)


def lines_to_json(spark: SparkSession, source: str) -> DataFrame:
    """(path, json): the objects of each file of JSON lines as one array, in order."""
    rows = spark.read.text(source, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "").alias("l"))
    return rows.select("path", F.concat(F.lit("["), F.array_join("l", ","), F.lit("]")).alias("json"))


def records(spark: SparkSession, source: str, fields: Sequence[str], kind: str = "json") -> DataFrame:
    """The named fields of JSON, YAML or CSV records, absent ones null. Each YAML file (a list of records) is read by one task."""
    if kind == "yaml":
        return yaml_records(read_text(spark, source).select("text"), fields)
    df = spark.read.json(source, multiLine=True) if kind == "json" else read_delimited(spark, source)
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in fields])


def yaml_records(texts: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The named fields, as text, of the records of YAML lists in the first column; absent ones and nulls are null, a text that is no list gives none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for f in frames:
            rows = []
            for t in f.iloc[:, 0].dropna():
                data = yaml.load(t, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
                rows += [[None if r.get(c) is None else str(r[c]) for c in fields] for r in (data if isinstance(data, list) else []) if isinstance(r, dict)]
            yield pd.DataFrame(rows, columns=list(fields))

    return texts.mapInPandas(run, ", ".join(f"`{c}` string" for c in fields))


def write_yaml(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows as YAML lists of records, one file for each partition: a record in YAML's flow style, which JSON is a part of."""
    write_lines(df.select(F.concat(F.lit("- "), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})).alias("line")), "line", path, mode)


def xml_values(df: DataFrame, column: str, paths: dict[str, str]) -> DataFrame:
    """Adds for each name the texts that its XPath finds in an XML text, as an array."""
    return df.withColumns({name: F.xpath(F.col(column), F.lit(p)) for name, p in paths.items()})
