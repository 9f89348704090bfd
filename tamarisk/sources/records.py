"""Problem 5: separating rows that fail to parse from the typed records of dropped files."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarisk.sources import grammar

#: Labels are a closed list that is sent to every task; more than this is refused.
MAX_LABELS = 10_000

_OUT = T.StructType(
    [
        T.StructField("line_id", T.LongType()), T.StructField("file_name", T.StringType()), T.StructField("line_no", T.IntegerType()), T.StructField("layout", T.StringType()),
        T.StructField("id", T.LongType()), T.StructField("label", T.StringType()), T.StructField("seen_on", T.DateType()), T.StructField("rating", T.DoubleType()), T.StructField("ts", T.TimestampNTZType()),
        T.StructField("ip", T.StringType()), T.StructField("session_id", T.LongType()), T.StructField("keyword", T.StringType()), T.StructField("text", T.StringType()),
        T.StructField("reason", T.StringType()), T.StructField("error_field", T.IntegerType()), T.StructField("error_char", T.IntegerType()), T.StructField("detail", T.StringType()), T.StructField("raw", T.StringType()),
    ]
)
_ARROW = pa.schema(
    [
        ("line_id", pa.int64()), ("file_name", pa.string()), ("line_no", pa.int32()), ("layout", pa.string()), ("id", pa.int64()), ("label", pa.string()), ("seen_on", pa.date32()), ("rating", pa.float64()),
        ("ts", pa.timestamp("us")), ("ip", pa.string()), ("session_id", pa.int64()), ("keyword", pa.string()), ("text", pa.string()), ("reason", pa.string()), ("error_field", pa.int32()), ("error_char", pa.int32()), ("detail", pa.string()), ("raw", pa.string()),
    ]
)


def parse_rows(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """Typed records and located errors of ``lines`` (line_id, file_name, line_no, layout, text), one row for each record.

    ``reason`` is null for a valid record, else ``quoting``, ``columns`` or ``value``, with the number of the field, the
    offset in the text (``error_char``, from 1) and the text itself in ``raw``. Rows with ``line_no`` 1 (headers) and
    texts that begin with ``#`` are neither. A null text or an unknown layout is an error of ``columns``; an empty text
    has one empty field. Repeated rows are parsed one by one; other columns are dropped. No rows give no rows.

    A narrow map over Arrow batches: the rows of a layout in a batch are read as one running text by the recovering grammar, whose
    anchors are the starts of the rows. No shuffle, the texts never leave their partition.
    """
    names = allowed_labels(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = grammar.layouts(names)
        for batch in batches:
            given = batch.to_pydict()
            texts, kinds = given["text"], given["layout"]
            outcome: list[tuple[grammar.Record, int]] = [(grammar.single(known["snip_csv"], None), 0)] * len(texts)
            for layout in set(kinds):
                rows = [i for i, k in enumerate(kinds) if k == layout and texts[i] is not None]
                if layout not in known:
                    for i in rows:
                        outcome[i] = (grammar.Record(0, 0, None, grammar.SyntaxFault("columns", 0, 0, "unknown layout")), 0)
                    continue
                starts = list(accumulate((len(texts[i]) + 1 for i in rows[:-1]), initial=0)) if rows else []
                for i, rec in zip(rows, grammar.document(known[layout], "\n".join(texts[i] for i in rows), starts)):
                    outcome[i] = (rec, rec.start)
            cols: dict[str, list] = {f.name: [] for f in _ARROW}
            for i, (rec, start) in enumerate(outcome):
                row = rec.values or {}
                if rec.fault:
                    row = {"reason": rec.fault.reason, "error_field": rec.fault.field, "error_char": rec.fault.at - start + 1, "detail": rec.fault.detail, "raw": texts[i]}
                for c in ("line_id", "file_name", "line_no", "layout"):
                    cols[c].append(given[c][i])
                for f in _ARROW.names[4:]:
                    cols[f].append(row.get(f))
            yield pa.RecordBatch.from_pydict(cols, schema=_ARROW)

    rows = lines.select(F.col("line_id").cast("long"), "file_name", F.col("line_no").cast("int"), "layout", "text")
    data = rows.where("(line_no IS NULL OR line_no <> 1) AND (text IS NULL OR NOT startswith(text, '#'))")
    return data.mapInArrow(run, _OUT)


def allowed_labels(labels: DataFrame) -> frozenset[str]:
    """The labels of a closed list (column ``label``); more than MAX_LABELS raise ``ValueError``."""
    got = labels.where("label IS NOT NULL").select("label").distinct().limit(MAX_LABELS + 1).collect()
    if len(got) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    return frozenset(r.label for r in got)


def valid(parsed: DataFrame) -> DataFrame:
    """The typed records."""
    return parsed.where("reason IS NULL").drop("reason", "error_field", "error_char", "detail", "raw")


def failed(parsed: DataFrame) -> DataFrame:
    """The rows that broke their layout, with the located reason."""
    return parsed.where("reason IS NOT NULL").select("line_id", "file_name", "line_no", "layout", "reason", "error_field", "error_char", "detail", "raw")


_DOC_OUT = "path string, record_no int, start_char int, end_char int, fields map<string,string>, reason string, error_field int, error_char int, detail string"


def parse_texts(texts: DataFrame, layout: str, labels: Iterable[str]) -> DataFrame:
    """Records of whole files: ``texts`` (path, text) with many records each, recovered at anchors after a fault.

    Valid rows have ``fields`` (values as text), failed ones ``reason`` and the place of the error. Null and empty texts
    give no rows. One file is one task's work; split larger files by line ranges first.
    """
    names = frozenset(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lay = grammar.layouts(names)[layout]
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("path", "record_no", "start_char", "end_char", "fields", "reason", "error_field", "error_char", "detail")}
            for path, text in zip(*(batch.column(c).to_pylist() for c in ("path", "text"))):
                for k, r in enumerate(grammar.document(lay, text or "")):
                    f = r.fault
                    fields = None if r.values is None else [(n, None if v is None else str(v)) for n, v in r.values.items()]
                    for c, v in zip(out, (path, k + 1, r.start + 1, r.end, fields, f and f.reason, f and f.field, f and f.at + 1, f and f.detail)):
                        out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("path", pa.string()), ("record_no", pa.int32()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("fields", pa.map_(pa.string(), pa.string())), ("reason", pa.string()), ("error_field", pa.int32()), ("error_char", pa.int32()), ("detail", pa.string())]))

    return texts.select("path", "text").mapInArrow(run, _DOC_OUT)
