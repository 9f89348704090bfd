"""Recursive-descent grammars for delimited records, with error recovery at record anchors.

``document`` reads a whole text of many records. After a broken quote it resumes at the next *anchor*, a record start that is
validated: one that the caller knows (``starts``, where records came as rows), or else a line start at which the leading fields of
a record are valid (see ``Layout.leading``). An anchor also ends a quoted field that is still open, so that a quote that is never
closed costs its own record and swallows none of those after it. ``single`` reads a text that is one record.

Grammar of a quoted layout:   record := field (sep field)* end ;  field := '"' (char | '""')* '"' | char-but-quote*
Grammar of a plain layout:    record := field (sep field)* end ;  field := char*
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple


class SyntaxFault(Exception):
    """A located error: reason (``quoting``, ``columns`` or ``value``), offset in the text, field number, detail."""

    def __init__(self, reason: str, at: int, field: int, detail: str):
        super().__init__(detail)
        self.reason, self.at, self.field, self.detail = reason, at, field, detail


class Record(NamedTuple):
    """Outcome for one record: the typed values, or the fault."""

    start: int
    end: int
    values: dict | None
    fault: SyntaxFault | None


Check = Callable[[str], object]


@dataclass(frozen=True)
class Layout:
    """Named, typed fields with a separator; ``quoted``: double quotes enclose fields; ``anchors``: leading fields that prove a record start."""

    name: str
    sep: str
    fields: tuple[tuple[str, Check], ...]
    quoted: bool
    anchors: int = 1

    def leading(self, text: str, at: int) -> tuple[int, int]:
        """(read, valid): of the ``anchors`` leading fields at an offset, those that end in a separator on their line, and those of
        them that are valid."""
        pos, read, good = at, 0, 0
        line = text.find("\n", at)
        end = len(text) if line < 0 else line
        try:
            for k in range(self.anchors):
                raw, pos = _field(self, text, pos, k + 1, end, False)
                if not text.startswith(self.sep, pos) or pos >= end:
                    break
                read += 1
                good += _passes(self.fields[k][1], raw)
                pos += len(self.sep)
        except SyntaxFault:
            pass
        return read, good

    def anchor(self, text: str, at: int) -> bool:
        """True iff all the ``anchors`` leading fields at offset ``at`` are valid, so that a record surely starts there."""
        return self.leading(text, at)[1] == self.anchors


def _passes(check: Check, raw: str) -> bool:
    try:
        check(raw)
    except ValueError:
        return False
    return True


def _field(layout: Layout, text: str, at: int, number: int, end: int, lines: bool) -> tuple[str, int]:
    """field: the value and the offset after it, at most ``end``.

    ``lines``: records end at line ends, and an anchor ends a field whose quote is open; else the record reaches to ``end``.
    """
    if layout.quoted and text.startswith('"', at, end):
        pos = at + 1
        while True:
            q = text.find('"', pos, end)
            if lines:
                line = text.find("\n", pos, end if q < 0 else q)
                while line >= 0:
                    if layout.anchor(text, line + 1):
                        raise SyntaxFault("quoting", at, number, "quote not closed")
                    line = text.find("\n", line + 1, end if q < 0 else q)
            if q < 0:
                raise SyntaxFault("quoting", at, number, "quote not closed")
            if text.startswith('"', q + 1, end):
                pos = q + 2
                continue
            after = q + 1
            if after < end and not text.startswith(layout.sep, after, end) and not (lines and text[after] in "\r\n"):
                raise SyntaxFault("quoting", after, number, "text after a closing quote")
            return text[at + 1 : q].replace('""', '"'), after
    stop = text.find(layout.sep, at, end)
    stop = end if stop < 0 else stop
    if lines and (line := text.find("\n", at, stop)) >= 0:
        stop = line - (line > at and text[line - 1] == "\r")
    if layout.quoted and (q := text.find('"', at, stop)) >= 0:
        raise SyntaxFault("quoting", q, number, "quote inside an unquoted field")
    return text[at:stop], stop


def _record(layout: Layout, text: str, at: int, end: int, lines: bool) -> tuple[list[tuple[str, int]], int]:
    """record: the raw fields with their offsets, and the offset after the last."""
    raw, pos = [], at
    while True:
        value, pos_after = _field(layout, text, pos, len(raw) + 1, end, lines)
        raw.append((value, pos))
        if not text.startswith(layout.sep, pos_after, end):
            return raw, pos_after
        pos = pos_after + len(layout.sep)


def _typed(layout: Layout, raw: list[tuple[str, int]], at: int) -> dict:
    if len(raw) != len(layout.fields):
        raise SyntaxFault("columns", at, min(len(raw), len(layout.fields)), f"{len(raw)} fields instead of {len(layout.fields)}")
    values = {}
    for k, ((name, check), (value, pos)) in enumerate(zip(layout.fields, raw)):
        try:
            values[name] = check(value)
        except ValueError as e:
            raise SyntaxFault("value", pos, k + 1, f"{name}: {e}") from None
    return values


def single(layout: Layout, text: str | None) -> Record:
    """The text as one record, line breaks outside quotes being ordinary characters; a null text has no fields."""
    if text is None:
        return Record(0, 0, None, SyntaxFault("columns", 0, 0, "null text"))
    return _bounded(layout, text, 0, len(text))


def _bounded(layout: Layout, text: str, at: int, end: int) -> Record:
    """The record between two known places."""
    try:
        raw, _ = _record(layout, text, at, end, False)
        return Record(at, end, _typed(layout, raw, at), None)
    except SyntaxFault as e:
        return Record(at, end, None, e)


def document(layout: Layout, text: str, starts: Sequence[int] | None = None) -> Iterator[Record]:
    """The records of a text with line ends between them.

    ``starts``: the offsets at which records are known to start, each after a line end; one record comes out for each of them, line
    breaks within it being ordinary characters, and a broken quote ends at the next start. Without them records end at line ends
    outside quotes, blank lines are no records, and a record with a fault of quoting or columns ends before the next anchor: a line
    start at which all but one of the leading fields are valid. A fault of columns also ends at a line with as many fields as
    that. A line that is all valid at its start is never part of the record before it, whatever quotes are open.
    """
    if starts is not None:
        for at, after in zip(starts, [*starts[1:], len(text) + 1]):
            yield _bounded(layout, text, at, after - 1)
        return
    at, n = 0, len(text)
    while at < n:
        if text[at] in "\r\n":
            at += 1
            continue
        fault = values = None
        try:
            raw, end = _record(layout, text, at, n, True)
            values = _typed(layout, raw, at)
        except SyntaxFault as e:
            fault = e
            if layout.quoted and e.reason != "value":
                end = _resume(layout, text, at, e.reason)
        yield Record(at, end, values, fault)
        at = max(end, at + 1)


def _resume(layout: Layout, text: str, at: int, reason: str) -> int:
    """Offset of the line end before the next anchor after ``at``, or of the end of the text."""
    line = text.find("\n", at)
    while line >= 0:
        read, good = layout.leading(text, line + 1)
        if good >= max(layout.anchors - 1, 1) or (reason == "columns" and read == layout.anchors):
            return line
        line = text.find("\n", line + 1)
    return len(text)


# Value checks: each returns the typed value or raises ValueError with the reason.

_ID, _DAY, _RATE = re.compile(r"[0-9]{1,18}"), re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}"), re.compile(r"[0-9]+(\.[0-9]+)?")
_TIME, _IP = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}"), re.compile(r"[0-9]{1,3}(\.[0-9]{1,3}){3}")


def identifier(v: str) -> int:
    if not _ID.fullmatch(v) or int(v) == 0:
        raise ValueError("not 1 to 18 digits above zero")
    return int(v)


def day(v: str) -> dt.date:
    if not _DAY.fullmatch(v):
        raise ValueError("not YYYY-MM-DD")
    return dt.date.fromisoformat(v)


def moment(v: str) -> dt.datetime:
    if not _TIME.fullmatch(v):
        raise ValueError("not YYYY-MM-DD HH:MM:SS")
    return dt.datetime.strptime(v, "%Y-%m-%d %H:%M:%S") if v[17:19] < "60" else _no("no such second")


def _no(why: str):
    raise ValueError(why)


def rating(v: str) -> float | None:
    if v == "":
        return None
    if not _RATE.fullmatch(v) or float(v) > 5:
        raise ValueError("not a number up to 5")
    return float(v)


def address(v: str) -> str:
    if not _IP.fullmatch(v) or any(int(x) > 255 for x in v.split(".")):
        raise ValueError("not four numbers up to 255")
    return v


def filled(v: str) -> str:
    if not v.strip():
        raise ValueError("blank")
    return v


def one_of(allowed: frozenset[str], fold: bool = False) -> Check:
    def check(v: str) -> str:
        w = v.lower() if fold else v
        return w if w in allowed else _no("not an allowed label")

    return check


def layouts(labels: frozenset[str]) -> dict[str, Layout]:
    """The three layouts of dropped files."""
    return {
        "snip_csv": Layout("snip_csv", ",", (("id", identifier), ("label", one_of(labels)), ("seen_on", day), ("rating", rating), ("text", filled)), True, 3),
        "cat_tsv": Layout("cat_tsv", "\t", (("label", one_of(labels, True)), ("text", filled)), False, 1),
        "sess_pipe": Layout("sess_pipe", " | ", (("ts", moment), ("ip", address), ("session_id", identifier), ("keyword", filled)), False, 2),
    }
