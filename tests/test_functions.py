"""Functions by exact values."""

import pytest
from pyspark.sql import functions as F

from tamarisk.functions import arrays, dates, numbers, text, urls


def val(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lit(x):
    return F.lit(x)


def arr(*xs):
    return F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")


CASES = [
    (lambda: text.elide(lit("abcdef"), 3), "abc..."), (lambda: text.elide(lit("abc"), 3), "abc"), (lambda: text.elide(lit(None).cast("string"), 3), ""),
    (lambda: text.fixed_length(lit("abc"), 5), "abc  "), (lambda: text.fixed_length(lit("abcdef"), 3), "abc"), (lambda: text.chomp(lit("a\n\n")), "a\n"), (lambda: text.indent_lines(lit("a\nb"), "> "), "> a\n> b"),
    (lambda: text.single_line(lit("a\tb\nc")), "a b c"), (lambda: text.escape_controls(lit("a\tb\\n\n")), "a\\tb\\\\n\\n"), (lambda: text.blanks_to_tab(lit("a   b c")), "a\tb\tc"), (lambda: text.strip_comment(lit("9 # x")), "9 "),
    (lambda: text.is_numeric(lit("1e3")), True), (lambda: text.is_numeric(lit("nan")), True), (lambda: text.is_numeric(lit("1_0")), False), (lambda: text.is_numeric(lit(None).cast("string")), False),
    (lambda: text.all_punct(lit("$-!")), True), (lambda: text.all_punct(lit("a!")), False), (lambda: text.split_list(lit("1, 2-4 7"), strip=True, ranges=True), ["1", "2", "3", "4", "7"]),
    (lambda: text.quoted_list(lit("['a b', \"c, d\" e]")), ["a b", "c, d", "e"]), (lambda: text.int_list(lit("1 x 3")), [1, None, 3]),
    (lambda: text.version_number(lit("1.11.1")), 1.00110001), (lambda: text.version_number(lit("1")), 1.0), (lambda: text.version_number(lit("")), 0.0), (lambda: text.version_number(lit("3.7.12345 (x")), 3.00079999),
    (lambda: text.numeric_suffix(lit(1024)), "1K"), (lambda: text.numeric_suffix(lit(1572864)), "1.5M"), (lambda: text.numeric_suffix(lit(0)), "0K"), (lambda: text.suffix_numbers(lit("1024 1572864 1073741824")), "1K 1.5M 1G"), (lambda: text.suffix_numbers(lit("1024 1024\n2048"), once=True), "1K 1024\n2K"),
    (lambda: text.strip_symbols(lit("a☺b")), "ab"), (lambda: text.name_symbols(lit("☺"), augment=True), "☺ [white smiling face]"), (lambda: text.string_diff(lit("a b c"), lit("a x c")), "  a\n< b\n> x\n  c"),
    (lambda: text.base_name(lit("/a/b.txt")), "b.txt"), (lambda: text.dir_name(lit("/a/b.txt")), "/a"), (lambda: text.dir_name(lit("/a")), "/"), (lambda: text.dir_name(lit("a")), "."), (lambda: text.extension(lit("/x.d/.bashrc")), ""), (lambda: text.extension(lit("a.tar.gz")), "gz"),
    (lambda: text.without_extension(lit("/x.d/a.txt")), "/x.d/a"), (lambda: text.without_extension(lit("a.txt"), "txt"), "a"), (lambda: text.join_path(lit("a/"), lit("/b")), "a/b"), (lambda: text.plugin_name(lit("org.kde.plasma.digital-clock")), "DigitalClock"), (lambda: text.section_parts(lit("[A][B c]")), ["A", "B c"]),
    (lambda: text.escape_html(lit("<a&'\">")), "&lt;a&amp;&#x27;&quot;&gt;"), (lambda: text.unescape_html(lit("&eacute;&#64;")), "é@"), (lambda: text.html_to_text(lit("<p>a<script>x</script> <b>b</b>&amp;c</p>")), "a b &c"), (lambda: text.html_blocks_to_text(lit("<div>a</div><p>b<br>c</p>")), "a\nb\nc"),
    (lambda: text.scripts(lit("<script src='x'>1<2</script><SCRIPT>b</SCRIPT>")), ["1<2", "b"]), (lambda: text.links(lit("<a href='/x'>1</a><a href=\"y\">2</a><a href='http://z/'>3</a>"), lit("http://h/d/p.html")), ["http://h/x", "http://h/d/y", "http://z/"]),
    (lambda: text.links(lit("<base href='http://b/q/'><a href='y'>"), lit("http://h/p")), ["http://b/q/y"]), (lambda: text.images(lit("<img src='a.png'><img src='a.png'><img hidden src='b.png'><img src='//c/d.png'>"), lit("http://h/p.html")), ["http://h/a.png", "http://c/d.png"]), (lambda: text.charset(lit('<meta charset="UTF-8">')), "utf-8"),
    (lambda: text.clean(lit("A <b>B</b> - c &amp; “d”\n e")), "a b; c   \"d\" e"),
    (lambda: numbers.round_as_text(lit(1.5), 3), "1.500"), (lambda: numbers.to_int(lit("7.9")), 7), (lambda: numbers.to_int(lit("x"), 3), 3), (lambda: numbers.to_int(lit("ff"), base=16), 255), (lambda: numbers.to_bool(lit("Off")), False), (lambda: numbers.to_bool(lit("yes")), True), (lambda: numbers.to_bool(lit(None).cast("string")), False),
    (lambda: numbers.is_close(lit(1.0), lit(1.0 + 1e-12)), True), (lambda: numbers.is_close(lit(1.0), lit(1.1)), False), (lambda: numbers.whole_as_int(lit(3.0)), "3"), (lambda: numbers.whole_as_int(lit(3.5)), "3.5"),
    (lambda: numbers.is_prime(lit(97)), True), (lambda: numbers.is_prime(lit(1)), False), (lambda: numbers.is_prime(lit(91)), False), (lambda: numbers.prime_factors(lit(360)), [2, 2, 2, 3, 3, 5]), (lambda: numbers.prime_factors(lit(97)), [97]), (lambda: numbers.prime_factors(lit(9223372036854775783)), [9223372036854775783]), (lambda: numbers.prime_factors(lit(2147483647 * 2147483629 * 2)), [2, 2147483629, 2147483647]), (lambda: numbers.fibonacci(lit(10)), [0, 1, 1, 2, 3, 5, 8]), (lambda: numbers.rgb(lit("#abc"))["g"], 187), (lambda: numbers.rgb(lit("zz")), None),
    (lambda: dates.ddmmmyy(lit("2024-01-05").cast("date")), "05 jan 24"), (lambda: dates.parse_timestamp(lit("2023-10-01T10:20:27.1271709Z")).cast("string"), "2023-10-01 10:20:27.12717"), (lambda: dates.resolve_date(lit("Fri 5 Jan 24")).cast("string"), "2024-01-05"), (lambda: dates.resolve_date(lit("5 Jan 75")).cast("string"), "1975-01-05"), (lambda: dates.resolve_date(lit("junk")).cast("string"), "1900-01-01"), (lambda: dates.resolve_date(lit("31 Feb 2020")).cast("string"), "1900-01-01"),
    (lambda: dates.range_hours(lit("9:30-11 x")), 1.5), (lambda: dates.range_hours(lit("11-1: x")), 2.0), (lambda: dates.range_hours(lit("x")), None), (lambda: dates.short_weekday(lit("Tuesday: a")), "tue: a"), (lambda: dates.short_weekday(lit("wednes: a")), "wed: a"), (lambda: dates.transcript_time(lit("00:05:10 hi")), "5:10 hi"),
    (lambda: arrays.union_keeping(arr("a", "a"), arr("b", "a")), ["a", "a", "b"]), (lambda: arrays.relative_intersection(arr("a", "b"), arr("b")), 0.5), (lambda: arrays.relative_intersection(arr(), arr()), 0.0), (lambda: arrays.difference_keeping(arr("a", "b", "a"), arr("b")), ["a", "a"]), (lambda: arrays.remove_first(arr("a", "b", "a"), arr("a", "c")), ["b", "a"]),
    (lambda: arrays.remove_first(arr("A", "b"), arr("a"), ignore_case=True), ["b"]), (lambda: arrays.append_new(arr("a"), lit("a")), ["a"]), (lambda: arrays.unique(arr("a", "A", "", "b"), ignore_case=True, prune_empty=True), ["a", "b"]), (lambda: arrays.exactly_one(arr(True, False)), True), (lambda: arrays.exactly_one(arr(False, False)), False), (lambda: arrays.exactly_one(arr(False), zero_ok=True), True),
    (lambda: arrays.xor(lit(True), lit(True)), False), (lambda: arrays.is_subset(arr("a"), arr("a", "b")), True), (lambda: arrays.equivalent(arr("a", "b"), arr("b", "a", "a")), True), (lambda: arrays.overlap(arr("ACME", "Rocket", "Research"), arr("Rocket", "Research", "Labs")), ["Rocket", "Research"]), (lambda: arrays.overlap(arr("Rocket", "Res"), arr("Rocket", "Research")), []), (lambda: arrays.overlap(arr("b", "d"), arr("a", "b")), ["b"]),
    (lambda: arrays.title_case_ngram(arr("Bank", "of", "England"), ["of"]), True), (lambda: arrays.title_case_ngram(arr("Bank", "in", "England"), ["of"]), False), (lambda: arrays.windows(arr("a", "b", "c"), 2), [["a", "b"], ["b", "c"]]), (lambda: arrays.windows(arr("a"), 2), []), (lambda: arrays.unzip(F.array(arr("a", "b"), arr("c", "d")), 2)[1], ["b", "d"]),
    (lambda: urls.quote(lit("a b/*é")), "a+b%2F%2A%C3%A9"), (lambda: urls.quote(lit("a%20b+c"), idempotent=True), "a%20b+c"), (lambda: urls.unquote(lit("a+b%2F")), "a b/"), (lambda: urls.param(lit("http://h/?a-b=1&a-b=2&c=%C3%A9#x"), "a_b"), "2"), (lambda: urls.param(lit("http://h/?c=%C3%A9"), "c"), "é"), (lambda: urls.param(lit("http://h/"), "c", "d"), "d"), (lambda: urls.misc_params(lit("k=v, k2=v2"))["k2"], "v2"),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_value(spark, k):
    make, want = CASES[k]
    got = val(spark, make())
    if isinstance(want, float) and got is not None:
        assert abs(got - want) < 1e-12
    else:
        assert got == want


def test_factors_against_trial(spark):
    """Every number up to 3000 and around the square of the last prime that is tried on all."""
    def by_trial(n):
        f, d = [], 2
        while n > 1:
            if d * d > n:
                return [*f, n]
            while n % d == 0:
                f, n = [*f, d], n // d
            d += 1
        return f

    edge = numbers.TRIED[-1] ** 2
    t = spark.range(3000).union(spark.range(edge - 40, edge + 40)).union(spark.range(4099**2 - 1, 4099**2 + 2))
    for r in t.select("id", numbers.prime_factors("id").alias("f"), numbers.is_prime("id").alias("p")).collect():
        assert r.f == by_trial(r.id) and r.p == (len(r.f) == 1), r
    none = spark.sql("SELECT explode(array(null, -6, 12)) AS n").select(numbers.prime_factors("n").alias("f")).collect()
    assert [r.f for r in none] == [[], [], [2, 2, 3]]
