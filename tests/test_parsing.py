"""The record grammars and the separation of rows that fail to parse."""

import csv
import datetime as dt
import io

from hypothesis import given, settings
from hypothesis import strategies as st

from tamarisk.sources import grammar, records

LABELS = frozenset(["food", "sport"])
LAY = grammar.layouts(LABELS)
GOOD = '12,food,2020-02-29,4.5,"a ""b"", c"'


def reason(layout, text):
    r = grammar.single(LAY[layout], text)
    return r.fault.reason if r.fault else None


def test_valid_csv_record():
    r = grammar.single(LAY["snip_csv"], GOOD)
    assert r.values == {"id": 12, "label": "food", "seen_on": dt.date(2020, 2, 29), "rating": 4.5, "text": 'a "b", c'}
    assert grammar.single(LAY["snip_csv"], "1,food,2020-01-01,,a\nb").values["rating"] is None


def test_csv_reasons():
    for text, want in {
        '1,food,2020-01-01,4,"open': "quoting", '1,food,2020-01-01,4,a "b" c': "quoting", '1,food,2020-01-01,4,"a" x': "quoting", '1, "food",2020-01-01,4,a': "quoting",
        "1,food,2020-01-01,a": "columns", "1,food,2020-01-01,4,a,b": "columns", "": "columns", '1,food,2020-01-01,4,"a",': "columns",
        "0,food,2020-01-01,4,a": "value", "1234567890123456789,food,2020-01-01,4,a": "value", "1,Food,2020-01-01,4,a": "value", "1,food,2021-02-29,4,a": "value", "1,food,2020-1-01,4,a": "value",
        "1,food,2020-01-01,5.1,a": "value", "1,food,2020-01-01,4.,a": "value", "1,food,2020-01-01,-1,a": "value", "1,food,2020-01-01,4, \t": "value", "١,food,2020-01-01,4,a": "value",
    }.items():
        assert reason("snip_csv", text) == want, text
    assert reason("snip_csv", None) == "columns"


def test_quoting_comes_before_columns_and_values():
    assert reason("snip_csv", 'x,"open') == "quoting"


def test_tsv_and_pipe_reasons():
    assert reason("cat_tsv", "FOOD\t\"a") is None
    assert reason("cat_tsv", "food a") == "columns" and reason("cat_tsv", "food\ta\tb") == "columns"
    assert reason("cat_tsv", " food\ta") == "value" and reason("cat_tsv", "food\t ") == "value"
    ok = "2020-01-01 23:59:59 | 1.22.255.0 | 7 | wine route"
    assert reason("sess_pipe", ok) is None
    for bad in (ok.replace("255", "256"), ok.replace("23:", "24:"), ok.replace(":59 ", ":60 "), ok.replace("| 7", "| 0x7"), "2020-01-01 23:59:59 | 1.2.3.4 | 7 |  "):
        assert reason("sess_pipe", bad) == "value", bad
    assert reason("sess_pipe", ok.replace(" | ", "|")) == "columns"


def test_error_is_located():
    f = grammar.single(LAY["snip_csv"], '1,food,2020-01-01,9,a').fault
    assert (f.field, f.at) == (4, 18)


def test_document_resumes_at_anchor():
    text = f'{GOOD}\n13,food,2020-01-01,4,"never closed\nstill text, no anchor\n14,sport,2020-01-01,1,fine\n\n15,food,2020-01-01,1,"two\nlines"\n'
    out = list(grammar.document(LAY["snip_csv"], text))
    assert [r.values["id"] if r.values else r.fault.reason for r in out] == [12, "quoting", 14, 15]
    assert out[3].values["text"] == "two\nlines"
    assert list(grammar.document(LAY["snip_csv"], "")) == []


def outcomes(text):
    return [r.values["id"] if r.values else r.fault.reason for r in grammar.document(LAY["snip_csv"], text)]


def test_an_open_quote_swallows_no_record():
    assert outcomes('1,food,2020-01-01,4,"broken\n2,food,2020-01-02,4,good\n3,sport,2020-01-03,4,tail"\n4,food,2020-01-04,,x') == ["quoting", 2, "quoting", 4]
    assert outcomes('1,food,2020-01-01,4,"a\nb, c"\n2,food,2020-01-02,4,x') == [1, 2]


def test_two_bad_records_in_a_row_stay_two():
    assert outcomes('1,food, "2020-01-01",4,"a"\n1,food, "2020-01-01",4,"a"\n2,food,2020-01-02,4,x') == ["quoting", "quoting", 2]
    assert outcomes("1,food,2020-01-01\nno fields here\n2,sport,2020-01-02,x\n3,food,2020-01-03,4,x") == ["columns", "columns", 3]


def test_rows_as_running_text_with_known_starts():
    rows = [GOOD, '1,food,2020-01-01,4,"open', "", "2,food,2020-01-01,4,a\nb", GOOD]
    starts = [sum(len(r) + 1 for r in rows[:i]) for i in range(len(rows))]
    out = list(grammar.document(LAY["snip_csv"], "\n".join(rows), starts))
    for row, start, r in zip(rows, starts, out, strict=True):
        one = grammar.single(LAY["snip_csv"], row)
        assert r.values == one.values and (r.fault and (r.fault.reason, r.fault.at - start)) == (one.fault and (one.fault.reason, one.fault.at))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='ab,"\n é', min_size=0, max_size=8), min_size=1, max_size=6))
def test_fields_survive_a_csv_writer(fields):
    buffer = io.StringIO()
    csv.writer(buffer, quoting=csv.QUOTE_ALL, lineterminator="").writerow(fields)
    raw, end = grammar._record(LAY["snip_csv"], buffer.getvalue(), 0, len(buffer.getvalue()), False)
    assert [v for v, _ in raw] == fields and end == len(buffer.getvalue())


SCHEMA = "line_id bigint, file_name string, line_no int, layout string, text string, reason string"


def test_rows_are_separated(spark):
    rows = [(1, "f", 1, "snip_csv", "id,label", "x"), (2, "f", 2, "snip_csv", "# note", "x"), (3, "f", 3, "snip_csv", GOOD, "x"), (4, "f", 4, "snip_csv", GOOD, "x"), (5, "f", 5, "snip_csv", "1,2", "x"), (6, "f", None, "cat_tsv", None, "x"), (7, None, 7, "other", "a", "x"), (8, "f", 8, "cat_tsv", "food\t" + "a" * 300_000, "x")]
    labels = spark.createDataFrame([("food",), (None,), ("food",)], "label string")
    p = records.parse_rows(spark.createDataFrame(rows, SCHEMA), labels)
    assert sorted(r.line_id for r in records.valid(p).collect()) == [3, 4, 8]
    assert {r.line_id: r.reason for r in records.failed(p).collect()} == {5: "columns", 6: "columns", 7: "columns"}
    assert records.parse_rows(spark.createDataFrame([], SCHEMA), labels).count() == 0


def test_whole_texts(spark):
    t = spark.createDataFrame([("a", GOOD + '\n1,food,2020-01-01,4,"x\n' + GOOD), ("b", None), ("c", "")], "path string, text string")
    out = records.parse_texts(t, "snip_csv", ["food"]).orderBy("record_no").collect()
    assert [r.reason for r in out] == [None, "quoting", None] and out[0].fields["id"] == "12"
