"""String functions, Column to Column. Null in gives null out unless a function says otherwise."""

from __future__ import annotations

import difflib
import html
import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Str = Column | str


def _c(x: Str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def elide(x: Str, most: int = 128, mark: str = "...") -> Column:
    """The first ``most`` characters and ``mark`` of a longer text; null gives an empty text."""
    c = F.coalesce(_c(x), F.lit(""))
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(mark))).otherwise(c)


def elide_all(x: Str, most: int = 32) -> Column:
    """``elide`` of every element of an array of strings."""
    return F.transform(_c(x), lambda v: elide(v, most))


def fixed_length(x: Str, n: int = 16) -> Column:
    """Padded with blanks on the right or cut to ``n`` characters."""
    return F.rpad(_c(x), n, " ")


def chomp(x: Str, sep: str = "\n") -> Column:
    """Without one trailing ``sep``."""
    return F.when(F.endswith(_c(x), F.lit(sep)), F.substring(_c(x), F.lit(1), F.length(_c(x)) - len(sep))).otherwise(_c(x))


def indent_lines(x: Str, by: str = "    ") -> Column:
    """Every line with ``by`` before it."""
    return F.regexp_replace(_c(x), r"(?m)^", by)


def single_line(x: Str) -> Column:
    """Every white-space character as one blank."""
    return F.regexp_replace(_c(x), r"\s", " ")


def escape_controls(x: Str) -> Column:
    """Backslash, newline, tab and carriage return as two-character escapes."""
    c = F.replace(_c(x), F.lit("\\"), F.lit("\\\\"))
    for ch, name in (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        c = F.replace(c, F.lit(ch), F.lit(name))
    return c


def blanks_to_tab(x: Str, strip: bool = False) -> Column:
    """Runs of blanks as one tab; ``strip``: leading blanks are dropped first."""
    return F.regexp_replace(F.ltrim(_c(x)) if strip else _c(x), " +", "\t")


def strip_comment(x: Str) -> Column:
    """Without the text from the first ``;`` or ``#`` on, line by line."""
    return F.regexp_replace(_c(x), r"(?m)[;#].*$", "")


def is_numeric(x: Str) -> Column:
    """True iff the text reads as a floating-point number, blanks around it allowed; false for null.

    ``nan`` and ``inf`` are numbers; digits with underscores, Java's suffixes (``1d``) and hexadecimals are not.
    """
    c = _c(x)
    return F.coalesce(~c.rlike(r"(?i)x|[0-9.][df]\s*$") & c.try_cast("double").isNotNull(), F.lit(False))


def all_punct(x: Str) -> Column:
    """True iff every character is punctuation or a symbol (so for an empty text)."""
    return _c(x).rlike(r"^[\p{P}\p{S}]*$")


def starts_with_punct(x: Str) -> Column:
    return _c(x).rlike(r"^[^\p{L}\p{N}]")


def split_list(x: Str, strip: bool = False, ranges: bool = False) -> Column:
    """Items of a list separated by white space or commas; ``ranges``: ``a-b`` becomes all whole numbers from a to b.

    Empty items stay unless ``strip``.
    """
    c = F.regexp_replace(_c(x), r"\s+", " ")
    items = F.split(F.trim(F.regexp_replace(c, r", *| ", ",")) if strip else F.regexp_replace(c, r", | ", ","), ",")
    if strip:
        items = F.filter(items, lambda v: v != "")
    if ranges:

        def expand(v: Column) -> Column:
            low, high = F.regexp_extract(v, r"^(\d+)-(\d+)$", 1).try_cast("int"), F.regexp_extract(v, r"^(\d+)-(\d+)$", 2).try_cast("int")
            return F.when(low.isNotNull() & (low <= high), F.transform(F.sequence(low, F.greatest(low, high)), lambda n: n.cast("string"))).otherwise(F.array(v))

        items = F.flatten(F.transform(items, expand))
    return items


def quoted_list(x: Str) -> Column:
    """Items of a list in which quotes protect separators; brackets around the list and quotes around items are dropped."""
    body = F.regexp_replace(_c(x), r"^\s*\[|\]\s*$", "")
    return F.transform(F.regexp_extract_all(body, F.lit(r"""'[^']*'|"[^"]*"|[^\s,'"]+"""), F.lit(0)), lambda v: F.regexp_replace(v, r"""^['"]|['"]$""", ""))


def int_list(x: Str) -> Column:
    """The whole numbers of a list; other items become null."""
    return F.transform(split_list(x, strip=True), lambda v: v.try_cast("int"))


def version_number(x: Str, padding: int = 3) -> Column:
    """``1.11.2`` as 1.00110002: later components padded to ``padding + 1`` digits, longer ones all nines; 0 if there is none."""
    width = padding + 1
    text = F.regexp_extract(_c(x), r"^([0-9]+(?:\.[0-9]+)*)", 1)
    parts = F.split(text, r"\.")
    rest = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: _component(p, width))
    return F.coalesce(F.concat(parts[0], F.lit("."), F.array_join(rest, "")).try_cast("double"), F.lit(0.0))


def _component(p: Column, width: int) -> Column:
    n = F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.when(F.length(n) > width, F.lit("9" * width)).otherwise(F.lpad(n, width, "0"))


def numeric_suffix(x: Str) -> Column:
    """A whole number with a base-1024 suffix (K, M, G, T, P, E), up to six decimals without trailing zeros; 0 is ``0K``."""
    n = _c(x).cast("double")
    power = F.least(F.floor(F.log(F.greatest(n, F.lit(1.0))) / math.log(1024)), F.lit(6)).cast("int")
    scaled = F.format_string("%.6f", n / F.pow(F.lit(1024.0), power))
    trimmed = F.regexp_replace(F.regexp_replace(scaled, r"\.0+$", ""), r"(\.[0-9]*[1-9])0+$", "$1")
    return F.when(n == 0, F.lit("0K")).otherwise(F.concat(trimmed, F.element_at(F.array(*[F.lit(s) for s in ("", "K", "M", "G", "T", "P", "E")]), power + 1)))


#: Numbers that are shortened: of 4 to 19 digits, no part of a word or of a number with a point after it.
LONG_NUMBER = r"\b\d{4,19}\b(?!\.)"


def suffix_numbers(x: Str, once: bool = False) -> Column:
    """Every number of 4 to 19 digits in a text as ``numeric_suffix`` writes it; ``once``: only the first of each line."""

    def line_of(line: Column) -> Column:
        between = F.split(line, LONG_NUMBER, 2 if once else -1)
        found = F.regexp_extract_all(line, F.lit(LONG_NUMBER), F.lit(0))
        # The k-th number stands before the k-th of the texts that follow the first.
        tail = F.transform(F.slice(between, F.lit(2), F.greatest(F.size(between) - 1, F.lit(0))), lambda t, k: F.concat(numeric_suffix(F.get(found, k)), t))
        return F.concat(F.element_at(between, 1), F.array_join(tail, ""))

    return F.array_join(F.transform(F.split(_c(x), "\n", -1), line_of), "\n")


def strip_symbols(x: Str, by: str = "") -> Column:
    """Emoticons and other symbols of category So replaced by ``by``."""
    return F.regexp_replace(_c(x), r"\p{So}", by)


def name_symbols(x: Str, augment: bool = False) -> Column:
    """Symbols of category So as ``[name]``; ``augment``: the symbol stays before it."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None or t.isascii():
                return t
            return "".join(c if unicodedata.category(c) != "So" else f"{c + ' ' if augment else ''}[{unicodedata.name(c, '???').lower()}]" for c in t)

        return s.map(one)

    return run(_c(x))


def string_diff(a: Str, b: Str) -> Column:
    """The tokens of two texts with ``<`` before those of the first alone and ``>`` before those of the second alone."""

    @F.pandas_udf("string")
    def run(p: pd.Series, q: pd.Series) -> pd.Series:
        sign = {"- ": "< ", "+ ": "> ", "  ": "  "}
        return pd.Series([None if s is None or t is None else "\n".join(sign[d[:2]] + d[2:] for d in difflib.ndiff(s.split(), t.split()) if d[:2] in sign) for s, t in zip(p, q)], dtype=object)

    return run(_c(a), _c(b))


# Paths, as plain text


def base_name(path: Str) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def dir_name(path: Str) -> Column:
    """What is before the last slash: ``/`` for a file in the root, ``.`` without a slash."""
    p = _c(path)
    return F.when(~p.contains("/"), F.lit(".")).otherwise(F.coalesce(F.nullif(F.regexp_replace(p, r"/[^/]*$", ""), F.lit("")), F.lit("/")))


def extension(path: Str) -> Column:
    """The last extension without its point; empty if there is none; a leading point starts no extension."""
    return F.regexp_extract(base_name(path), r"^.+\.([^.]*)$", 1)


def without_extension(path: Str, ext: str | None = None) -> Column:
    """Without the last extension, or only without the given one."""
    return F.regexp_replace(_c(path), rf"\.?{re.escape(ext)}$" if ext else r"(?<=[^/])\.[^./]*$", "")


def join_path(*parts: Str) -> Column:
    return F.regexp_replace(F.concat_ws("/", *[_c(p) for p in parts]), "/+", "/")


def plugin_name(x: Str, prefix: str = r"^org\.kde\.(plasma\.)?") -> Column:
    """The last words of a dotted plugin id in capitals: ``org.kde.plasma.digital-clock`` is ``DigitalClock``."""
    words = F.split(F.regexp_replace(_c(x), prefix, ""), r"[^A-Za-z0-9]+")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), "")


def section_parts(x: Str) -> Column:
    """The parts of a header such as ``[A][B]``."""
    return F.regexp_extract_all(_c(x), F.lit(r"\[([^\]]+)\]"), F.lit(1))


# HTML

# The five entities of markup.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))


def escape_html(x: Str) -> Column:
    c = _c(x)
    for ch, name in ENTITIES:
        c = F.replace(c, F.lit(ch), F.lit(name))
    return c


def unescape_basic(x: Str) -> Column:
    """The five entities, blanks and ``&#39;`` as characters, JVM-side."""
    c = F.replace(F.replace(_c(x), F.lit("&#39;"), F.lit("'")), F.lit("&nbsp;"), F.lit(" "))
    for ch, name in reversed(ENTITIES):
        c = F.replace(c, F.lit(name), F.lit(ch))
    return c


def unescape_html(x: Str) -> Column:
    """All entities as characters; only texts with an ampersand are changed."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: html.unescape(t) if t is not None and "&" in t else t)

    return run(_c(x))


def html_to_text(x: Str) -> Column:
    """Text nodes of a page joined by a blank, without scripts and styles."""
    c = F.regexp_replace(_c(x), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(unescape_basic(F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")), r"\s+", " "))


def html_blocks_to_text(x: Str) -> Column:
    """Like ``html_to_text`` with a newline at block elements and ``<br>``."""
    c = F.regexp_replace(_c(x), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    c = F.regexp_replace(c, r"\s+", " ")
    c = F.regexp_replace(c, r"(?i)</?(p|div|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|blockquote|br)\b[^>]*>", "\n")
    c = unescape_basic(F.regexp_replace(c, r"<[^>]*>", ""))
    return F.regexp_replace(F.regexp_replace(c, r" *\n[ \n]*", "\n"), r"^[ \n]+|[ \n]+$", "")


def scripts(x: Str) -> Column:
    """The bodies of inline scripts."""
    return F.regexp_extract_all(_c(x), F.lit(r"(?is)<script\b[^>]*>(.*?)</script\s*>"), F.lit(1))


def base_url(page: Str, url: Str) -> Column:
    """The page's ``<base>`` address, or the directory of its URL."""
    given = F.regexp_extract(_c(page), r"""(?is)<base\b[^>]*\bhref\s*=\s*["']([^"']+)""", 1)
    return F.regexp_replace(F.when(given != "", given).otherwise(F.regexp_replace(_c(url), r"(?<=[^:/])/[^/]*$", "")), "/$", "")


def _absolute(href: Column, base: Column) -> Column:
    site = F.regexp_extract(base, r"^([a-zA-Z]+://[^/]+)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z]+:)", 1)
    return F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), href).when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(site, href)).otherwise(F.concat(base, F.lit("/"), href))


def links(page: Str, url: Str) -> Column:
    """Absolute addresses of all ``<a href>`` in order, repeated ones kept."""
    return F.transform(F.regexp_extract_all(_c(page), F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1)), lambda h: _absolute(h, base_url(page, url)))


def images(page: Str, url: Str) -> Column:
    """Absolute addresses of all ``<img src>`` that are not hidden, in order, once each."""
    tags = F.filter(F.regexp_extract_all(_c(page), F.lit(r"(?is)<img\b[^>]*>"), F.lit(0)), lambda t: ~t.rlike(r"(?i)\shidden\b|display:\s*none"))
    src = F.filter(F.transform(tags, lambda t: F.regexp_extract(t, r"""(?is)\bsrc\s*=\s*["']([^"']*)["']""", 1)), lambda s: s != "")
    return F.array_distinct(F.transform(src, lambda s: _absolute(s, base_url(page, url))))


def charset(page: Str) -> Column:
    """The encoding a page declares, in lower case; empty if it declares none."""
    return F.lower(F.regexp_extract(_c(page), r"""(?is)<meta\b[^>]*charset\s*=\s*["']?\s*([\w\-]+)""", 1))


# Cleaning before term extraction


def clean(x: Str) -> Column:
    """Markup, escapes, typographic quotes and dashes removed; lower case; white space and ``&`` as blanks.

    Only the five entities and the blank are decoded here; ``unescape_html`` before it decodes all.
    """
    # Fixed value: what counts as a tag.
    c = F.regexp_replace(_c(x), r"<[^<]+?>", " ")
    c = F.replace(F.replace(c, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t"))
    c = F.translate(unescape_basic(c), "“”‘’", "\"\"''")
    c = F.lower(F.regexp_replace(c, r"[ \t\r\n]+-[ \t\r\n]*|[ \t\r\n]*-[ \t\r\n]+", "; "))
    return F.replace(F.regexp_replace(c, r"[ \t\r\n]+", " "), F.lit("&"), F.lit(" "))


CLEAN_SQL = r"""replace(regexp_replace(lower(regexp_replace(translate(
  replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace({0}, '<[^<]+?>', ' ', 'g'), '\n', chr(10)), '\t', chr(9)),
    '&#39;', ''''), '&nbsp;', ' '), '&#x27;', ''''), '&quot;', '"'), '&gt;', '>'), '&lt;', '<'), '&amp;', '&'), '“”‘’', '""'''''),
  '[ \t\r\n]+-[ \t\r\n]*|[ \t\r\n]*-[ \t\r\n]+', '; ', 'g')), '[ \t\r\n]+', ' ', 'g'), '&', ' ')"""


def without_stop_words(x: Str, stop: list[str], lower: bool = True) -> Column:
    """The words between single blanks that are no stop words."""
    c = F.lower(_c(x)) if lower else _c(x)
    return F.array_join(F.filter(F.split(c, " "), lambda w: ~w.isin(*stop)), " ")


def hex_dump(x: Str) -> Column:
    """The bytes of the text in UTF-8 as pairs of hexadecimal digits with blanks between."""
    return F.trim(F.regexp_replace(F.hex(F.encode(_c(x), "UTF-8")), "(..)", "$1 "))


def without_prefix(x: Str, prefix: str) -> Column:
    """The text without a prefix, such as that of a temporary folder in a path."""
    return F.when(F.startswith(_c(x), F.lit(prefix)), F.substring(_c(x), F.lit(len(prefix) + 1), F.length(_c(x)))).otherwise(_c(x))
