"""Operators on small tables: exact results, brute force, and edge cases."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tamarisk.operators import columns, counting, evaluation, language, learning, lines, lookups, matrix, reports, sampling, search, tfidf
from tamarisk.plans import scale
from tamarisk.plans.scale import table
from tamarisk.sources import tabular

# TF-IDF

DOCS = [("d1", "The dog ran. The fox hid."), ("d2", "A dog, a cat! The dog slept"), ("d3", "Dog and fox: friends"), ("d4", None), ("d5", ""), ("d6", "!!! ???")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id string, text string")


def test_frequencies(docs):
    got = {(r.doc_id, r.ngram): (r.tf, r.doc_len) for r in tfidf.frequencies(docs).collect()}
    assert got["d2", "dog"] == (2, 7) and got["d1", "the"] == (2, 6) and not any(k[0] in ("d4", "d5", "d6") for k in got)


def test_ngrams_do_not_cross_clauses(docs):
    got = {r.ngram for r in tfidf.frequencies(docs, (2,)).where("doc_id = 'd2'").collect()}
    assert got == {"a dog", "a cat", "the dog", "dog slept"}


def test_stop_words_are_bridged(docs):
    got = {r.ngram for r in tfidf.frequencies(docs, (2,), ["and", "the", "a"]).where("doc_id = 'd3'").collect()}
    assert got == {"dog fox"}


@pytest.mark.parametrize("kind, want", [("basic", math.log(3 / 2)), ("freq", 1 / 2), ("smooth", math.log(5 / 2)), ("max", math.log(1 + 2 / 2)), ("prob", math.log(0.5 + 1e-6))])
def test_idf_of_fox(docs, kind, want):
    w = tfidf.weights(tfidf.frequencies(docs), 3).where("ngram = 'fox' AND doc_id = 'd3'").first()
    assert w[f"idf_{kind}"] == pytest.approx(want, abs=1e-6) and w.df == 2


def test_idf_prob_of_a_word_in_all_documents(docs):
    w = tfidf.weights(tfidf.frequencies(docs), 3).where("ngram = 'dog'").first()
    assert w.idf_prob == pytest.approx(math.log(1e-6)) and w.idf_basic == 0


def test_top_terms_limits_and_ties(docs):
    t = tfidf.top_terms(tfidf.frequencies(docs), 3, 2).orderBy("doc_id", "rank").collect()
    assert [r.ngram for r in t if r.doc_id == "d3"] == ["and", "friends"]
    assert tfidf.top_terms(tfidf.frequencies(docs.limit(0)), 0 or 1, 2).count() == 0


def test_prune(spark):
    t = spark.createDataFrame([("d", "new york city", 3.0, 1), ("d", "york city", 2.0, 2), ("d", "city hall", 1.0, 3), ("d", "hall", 0.5, 4)], "doc_id string, ngram string, score double, rank int")
    assert [r.ngram for r in tfidf.prune(t).orderBy("rank").collect()] == ["new york city"]
    assert [r.ngram for r in tfidf.prune(t, overlapping=False).orderBy("rank").collect()] == ["new york city", "city hall"]


# Columns


def test_field_specs():
    c = ["a", "b", "c", "d", "e", "f", "g", "hh"]
    assert columns.parse_fields("1,2,5-8,3,4", c) == [1, 2, 5, 6, 7, 8, 3, 4]
    assert columns.parse_fields("-3, 7-,hh,,b-d", c) == [1, 2, 3, 7, 8, 8, 2, 3, 4]
    for bad in ("9", "zz", "1-zz", "0"):
        with pytest.raises(ValueError):
            columns.parse_fields(bad, c)


def test_cut_repeats_and_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "x\ty")], "a int, b string")
    out = columns.cut(df, "b,a,b", most=2)
    assert out.columns == ["b", "a", "b_2"] and sorted(r.b for r in out.collect()) == ["", "x\t..."]
    assert columns.exclude(df, "a").columns == ["b"]


def test_transpose(spark):
    df = spark.createDataFrame([(2, "y", None), (1, "x", "q")], "k int, a string, b string")
    assert {r.field: r["values"] for r in columns.transpose(df, "k").collect()} == {"a": ["x", "y"], "b": ["q", "n/a"]}
    assert columns.unpivot_fields(df.limit(0), "k").count() == 0


def test_encodings(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, None)], "i int, l string")
    assert {r.l: r.id for r in columns.ids_by_appearance(df, "l", "i").collect()} == {"b": 0, "a": 1}
    assert {r.l: r.id for r in columns.ids_by_name(df, "l").collect()} == {"a": 0, "b": 1}


# Lines


def test_paragraphs_and_pages(spark):
    t = spark.createDataFrame([(1, "\na\nb\n\n \nc\fd\ne"), (2, None), (3, "")], "doc_id int, text string")
    ls = lines.numbered(t)
    assert [(r.para_no, r.first_line, r.text) for r in lines.paragraphs(ls).orderBy("para_no").collect()] == [(1, 2, "a\nb"), (2, 6, "c\fd\ne")]
    assert [(r.page_no, r.page_line, r.segment) for r in lines.pages(ls).where("doc_id = 1").orderBy("page_no", "page_line").collect()][-2:] == [(2, 1, "d"), (2, 2, "e")]


def test_ini_sections(spark):
    t = spark.createDataFrame([(1, "x=0\n[A][B]\nk = v=w\n[C]\nz=1")], "doc_id int, text string")
    assert [(r.section, r.name, r.value) for r in lines.sections(lines.numbered(t)).orderBy("line_no").collect()] == [("", "x", "0"), ("[A][B]", "k", "v=w"), ("[C]", "z", "1")]


def test_head_middle_tail_and_snips(spark):
    t = spark.createDataFrame([(1, "\n".join(["x"] * 5 + ["ERROR 1", "x", "error 2", "Error 3"] + ["x"] * 5)), (2, "a\nb")], "doc_id int, text string")
    ls = lines.numbered(t)
    kept = lines.head_middle_tail(ls, 2, 2, 2, "error")
    assert [r.line_no for r in kept.where("doc_id = 1").orderBy("line_no").collect()] == [1, 2, 6, 8, 13, 14]
    assert kept.where("doc_id = 2").count() == 2
    assert [(r.doc_id, r.removed) for r in lines.snipped(ls, kept).collect()] == [(1, 8)]


def test_carriage_returns_and_escapes(spark):
    t = spark.createDataFrame([("Step 1: 10%\rStep 1: 50%\rStep 1: Done\r",), ("\x1b[31mred\x1b[0m\x07",), ("abc\b\bX",), ("\x1b]0;title\x07a",)], "line string")
    assert [r.v for r in t.select(reports.collapsed("line").alias("v")).collect()] == ["Step 1: Done", "red", "aX", "a"]


def test_path_abbreviation(spark):
    p = "/very/long/path/of/build/artefacts/number/one"
    t = spark.createDataFrame([(f"cc {p}/a.c",), (f"cc {p}/b.c",), ("x",)], "line string")
    found = reports.frequent_paths(t, min_length=20)
    assert found == [p] and reports.abbreviate(t, found).first().line == "cc {path1}/a.c"


def test_time_sheet(spark):
    sheet = "Monday:\n9-11: [DEV] code\n11:30-1: lunch talk\nHours: 3.5\nTue:\n8-9: [DEV] x\nHours: 2\nTotal hours: 4.5"
    times = reports.time_lines(lines.numbered(spark.createDataFrame([(1, sheet)], "doc_id int, text string")))
    assert [(r.day, r.calculated, r.stated, r.agrees) for r in reports.time_blocks(times).orderBy("block").collect()] == [("mon", 3.5, 3.5, True), ("tue", 1.0, 2.0, False)]
    assert {r.tag: r.hours for r in reports.time_by_tag(times).where("doc_id = 1 AND tag IS NOT NULL").collect()} == {"dev": 3.0, "n/a": 1.5}
    assert reports.time_totals(times).first().agrees


def test_test_summaries(spark):
    t = lines.numbered(spark.createDataFrame([(1, "== 3 passed, 1 failed in 2.5s ==\n== 1 passed, 2 xfailed, 1 xpassed in 1s ==\nno"), (2, "= 1 skipped ="), (3, "x")], "doc_id int, text string"))
    last = {r.doc_id: r for r in reports.test_summaries(t, treat_x=True).collect()}
    both = {r.doc_id: r for r in reports.test_summaries(t, combine=True).collect()}
    assert (last[1].total, last[1].ok_pct) == (4, 50.0) and (both[1].passed, both[1].ok_pct, both[1].duration) == (4, 80.0, 3.5) and both[2].ok_pct == 0 and 3 not in both


# Counting and lookups


def test_count_it(spark):
    t = spark.createDataFrame([("Panama",), (None,), ("",)], "t string")
    assert {r.value: r.freq for r in counting.count_it(t, "t", "[a-z]").collect()} == {"a": 3, "n": 1, "m": 1}
    assert [r.freq for r in counting.count_it(t, "t", "[a-z]", first_only=True).collect()] == [1]


def test_lookup_tables(spark):
    t = spark.createDataFrame([(1, "K\tV"), (2, "k\tw\tx"), (3, "none"), (4, "#c\td")], "line_no int, line string")
    assert {r.key: r.value for r in lookups.lookup_table(t).collect()} == {"k": "w\tx", "#c": "d"}
    assert {r.word: r.freq for r in lookups.frequency_table(t).collect()} == {"k": "V"}


def test_closure_of_chain_and_cycle(spark):
    t = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 8), (8, 7), (None, 1), (1, 2)], "src int, dst int")
    got = {(r.src, r.dst) for r in lookups.closure(t).collect()}
    assert got == {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (7, 8), (8, 7), (7, 7), (8, 8)}


def test_salted_and_broadcast_lookups_agree(spark):
    big = spark.createDataFrame([(None if i % 7 == 0 else i % 3, i) for i in range(100)], "k int, v int")
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k int, w string")
    for how in ("left", "inner", "left_anti", "left_semi"):
        a = scale.lookup(big, small, ["k"], how)
        b = scale.lookup(big, small, ["k"], how, max_rows=1)
        assert sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(map(str, b.select(sorted(b.columns)).collect())), how


def test_latest_before(spark):
    a = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, ts int")
    b = spark.createDataFrame([(1, 2, "x"), (1, 5, "y"), (3, 1, "z")], "k int, ts int, v string")
    assert {(r.k, r.ts): r.latest_v for r in lookups.latest_before(a, b, "k", "ts", "v").collect()} == {(1, 5): "y", (1, 1): None, (2, 9): None}


# Search


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 8))
    t = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(60)] + [(99, None), (98, [1.0])], "vec_id bigint, embedding array<double>")
    q = F.col("vec_id") % 10 == 0
    got = search.vector_neighbours(t, q, 3, block=2).collect()
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    for i in range(0, 60, 10):
        want = [j for j in np.argsort(d[i], kind="stable") if j != i][:3]
        assert [r.vec_id for r in sorted((r for r in got if r.query == i), key=lambda r: r.rank)] == want


def test_cosine_of_documents_against_brute_force(spark):
    random.seed(4)
    words = "a b c d e f g h".split()
    texts = {i: " ".join(random.choices(words, k=6)) for i in range(1, 40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    v = search.tfidf_vectors(search.inverted_index(docs), 39)
    got = search.cosine_neighbours(v, F.col("doc_id") % 13 == 0, 4, block=1).collect()
    vec = {r.doc_id: dict(zip(r.terms, r.weights)) for r in v.collect()}
    for q in (13, 26, 39):
        sims = sorted(((-round(sum(w * vec[j].get(t, 0) for t, w in vec[q].items()), 9), j) for j in vec if j != q))
        want = [j for s, j in sims if s < 0][:4]
        assert [r.doc_id for r in sorted((r for r in got if r.query == q), key=lambda r: r.rank)] == want


def test_ties_beyond_the_cut_go_to_the_smallest_keys(spark):
    # 40 copies in one frame, far more than k, in another order than the keys'.
    keys = random.Random(6).sample(range(1, 41), 40)
    t = spark.createDataFrame([(0, [1.0, 0.0])] + [(i, [1.0, 1.0]) for i in keys] + [(99, [1.0, 0.1])], "vec_id bigint, embedding array<double>").coalesce(1)
    for metric in ("l2", "cosine"):
        got = search.vector_neighbours(t, F.col("vec_id") == 0, 4, metric=metric).collect()
        assert [r.vec_id for r in sorted(got, key=lambda r: r.rank)] == [99, 1, 2, 3]
    docs = spark.createDataFrame([(0, "a b")] + [(i, "a c") for i in keys] + [(99, "a b d"), (100, "e")], "doc_id bigint, text string").coalesce(1)
    v = search.tfidf_vectors(search.inverted_index(docs), 43).orderBy(F.xxhash64("doc_id")).coalesce(1)
    got = search.cosine_neighbours(v, F.col("doc_id") == 0, 4).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.rank)] == [99, 1, 2, 3]


def test_lsh_recall(spark):
    e = table(spark, "/root/testdata/sf0.01", "embeddings")
    q = e.where("vec_id % 50 = 0")
    exact = {(r.query, r.vec_id) for r in search.vector_neighbours(e, F.col("vec_id") % 50 == 0, 5, metric="cosine").collect()}
    near = {(r.query, r.vec_id) for r in search.lsh_neighbours(e, q, 5).collect()}
    assert len(exact & near) / len(exact) >= 0.9


def test_chunks(spark):
    t = spark.createDataFrame([(1, "abcdefghij"), (2, "abc"), (3, ""), (4, None)], "doc_id int, text string")
    assert [(r.start_index, r.content) for r in search.chunks(t, 4, 1).where("doc_id = 1").orderBy("start_index").collect()] == [(0, "abcd"), (3, "defg"), (6, "ghij")]
    assert search.chunks(t, 4, 1).where("doc_id > 2").count() == 0


# Language


@pytest.mark.parametrize("w, want", [("running", "run"), ("ponies", "poni"), ("caresses", "caress"), ("cats", "cat"), ("hopping", "hop"), ("relational", "relat"), ("hopeful", "hope"), ("happy", "happi"), ("sky", "sky"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"), ("formalize", "formal"), ("adjustment", "adjust"), ("é", "é")])
def test_stems(w, want):
    assert language.stem_word(w) == want


def test_language_model_sums_to_one(spark):
    s = spark.createDataFrame([("a b a b a",), ("b a",)], "sentence string")
    m = {(r.n, r.ngram): r for r in language.language_model(language.ngram_counts(s)).collect()}
    assert sum(10 ** m[1, w].logprob for w in ("a", "b", "</s>")) == pytest.approx(1)
    seen = [g for n, g in m if n == 2 and g.startswith("a ")]
    assert sum(10 ** m[2, g].logprob for g in seen) + 10 ** m[1, "a"].backoff == pytest.approx(1)
    sc = language.score_sentences(spark.createDataFrame([(1, "a b"), (2, "zz")], "id int, sentence string"), spark.createDataFrame([tuple(r) for r in m.values()], "n int, ngram string, logprob double, backoff double"), ["id"])
    got = {r.id: r for r in sc.collect()}
    assert got[1].logprob > got[2].logprob and got[2].unknown == 1 and got[1].tokens == 3


# Evaluation, matrices, sampling, learning


def test_binary_scores_and_auc(spark):
    t = spark.createDataFrame([(1, 1, 0.9), (0, 1, 0.8), (1, 0, 0.8), (0, 0, 0.1), (None, 1, 0.5)], "a int, p int, s double")
    r = evaluation.binary_scores(t, F.col("a"), F.col("p")).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.accuracy, r.kappa) == (1, 1, 1, 1, 0.5, 0.0)
    assert evaluation.roc_auc(t, F.col("a"), F.col("s")).first().auc == pytest.approx((1 + 1 + 0.5 + 1) / 4)
    assert evaluation.roc_auc(t.limit(0), F.col("a"), F.col("s")).first().auc is None


@pytest.mark.parametrize("n, p", [(10, 20), (10, 25), (3, 50), (1, 10), (2000, 33)])
def test_trailing_split(spark, n, p):
    t = spark.createDataFrame([(i * i + 5,) for i in range(n)], "k bigint")
    got = evaluation.trailing_split(t, "k", p).where("part = 'test'").collect()
    want = math.ceil(n * p / 100)
    assert sorted(r.k for r in got) == [i * i + 5 for i in range(n - want, n)]


def test_matrix_product(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 5, (4, 3)), rng.integers(0, 5, (3, 5))
    long = lambda m: spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])], "i int, j int, v double")
    out = np.zeros((4, 5))
    for r in matrix.multiply(long(a), long(b)).collect():
        out[r.i, r.j] = r.v
    assert (out == a @ b).all()


def test_samples(spark):
    t = spark.range(10_000).select(F.col("id").alias("k"))
    assert 800 < sampling.bernoulli(t, 0.1).count() < 1200 and sampling.bernoulli(t, 0.0, header="k = 0").count() == 1
    a, b = (sampling.by_hash(x, "k", 0.1).orderBy("k").collect() for x in (t, t.repartition(7)))
    assert a == b and 800 < len(a) < 1200
    s = [r.k for r in sampling.shuffled(t, percent=10).collect()]
    assert len(s) == len(set(s)) == 1000 and s != sorted(s)


def test_text_categorizer_round_trip(spark, tmp_path):
    rows = [("x", "red apple fruit"), ("x", "green apple pie"), ("y", "fast car engine"), ("y", "car wheel engine"), (None, "a"), ("x", None)]
    t = spark.createDataFrame(rows, "label string, text string")
    c = learning.TextCategorizer("nb", ngrams=2).train(t)
    c.save(str(tmp_path / "m"))
    again = learning.TextCategorizer().load(str(tmp_path / "m"))
    new = spark.createDataFrame([("apple",), ("engine",), (None,)], "text string")
    assert {r.text: r.predicted for r in again.categorize(new).collect()} == {"apple": "x", "engine": "y"}


def test_linear_fit(spark):
    t = spark.createDataFrame([(float(i), float(i % 4), 3.0 * i - 2.0 * (i % 4) + 5 + (i % 3) * 1e-3) for i in range(30)], "a double, b double, y double")
    est = {r.term: r.estimate for r in learning.linear_fit(t, "y", ["a", "b"]).collect()}
    assert est["a"] == pytest.approx(3, abs=1e-3) and est["b"] == pytest.approx(-2, abs=1e-3)


# Sources


def test_read_delimited(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('﻿aa,b,c\n1,"x, y",NA\n2\n3,4,5,6\n9 # note,8,7\n\n,,\n', encoding="utf-8")
    got = {tuple(r) for r in tabular.read_delimited(spark, str(p)).collect()}
    assert got == {("1", "x, y", "NA"), ("2", None, None), ("9 ", None, None), ("", "", "")}
    assert tabular.read_delimited(spark, str(p), "excel").where("aa = '9 # note'").count() == 1
    t = tmp_path / "x.tsv"
    t.write_text('a\tb\n"q\tr\n')
    assert tabular.read_delimited(spark, str(t)).first() == ('"q', "r")
    assert tabular.sniff(spark, str(p))["sep"] == "," and tabular.sniff(spark, str(t))["sep"] == "\t"


def test_read_lines_and_records(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x ; c\ny\n")
    (tmp_path / "e.txt").write_text("")
    assert [(r.line_no, r.line) for r in tabular.read_lines(spark, str(tmp_path), comments=True).orderBy("line_no").collect()] == [(1, "x "), (2, "y")]
    (tmp_path / "r.json").write_text('[{"a": "1"}, {"a": "2", "b": "3"}]')
    assert {tuple(r) for r in tabular.records(spark, str(tmp_path / "r.json"), ["a", "b", "z"]).collect()} == {("1", None, None), ("2", "3", None)}
    assert tabular.list_files(spark, str(tmp_path), "*.txt").count() == 1 and tabular.directory_listing(spark, str(tmp_path)).count() == 3


def test_xml_values(spark):
    t = spark.createDataFrame([("<r><a>1</a><a>2</a></r>",)], "x string")
    assert tabular.xml_values(t, "x", {"a": "r/a/text()"}).first().a == ["1", "2"]


# Small reports


def test_small_reports(spark):
    pal = spark.createDataFrame([("red", "ff0000"), ("blue", "00f")], "name string, hex string")
    t = spark.createDataFrame([("a #fe0101 and #0000ee",), ("none",), (None,)], "x string")
    assert [r.x for r in reports.colour_names(t, "x", pal).collect()] == ["a #fe0101 [red] and #0000ee [blue]", "none", None]
    ls = spark.createDataFrame([(1, "    # EX: f(1) => 2 "), (2, "x")], "line_no int, line string")
    assert [tuple(r) for r in reports.example_tests(ls).collect()] == [(1, "f(1)", "2")]
    j = spark.createDataFrame([('{"install": [{"metadata": {"name": "a", "requires_dist": ["b", "c"]}}, {"metadata": {"name": "b"}}]}',)], "json string")
    assert sorted(map(str, (tuple(r) for r in reports.dependencies(j).collect()))) == sorted(map(str, [("a", "b"), ("a", "c"), ("b", None)]))


def test_pairs_and_fidelity(spark):
    ls = spark.createDataFrame([(1, "K\tv"), (2, "only"), (3, "a\tb\tc"), (4, "k\tw")], "line_no int, line string")
    assert {r.key: r.value for r in lookups.pairs_table(ls, use_line=True).collect()} == {"k": "w", "2": "only"}
    assert lookups.missing_rows(ls, ls).count() == 0 and lookups.missing_rows(ls.union(ls), ls).count() == 4


def test_cross_validation(spark):
    rng = np.random.default_rng(2)
    rows = [(float(v + k * 3), float(rng.standard_normal()), "ab"[k]) for k in (0, 1) for v in rng.standard_normal(60)]
    data = learning.features(spark.createDataFrame(rows, "p double, q double, c string"), ["p", "q"], "c")
    mean, sd, best = learning.cross_validated(data, "tree", 3, {"maxDepth": [1, 2]})
    assert mean > 0.85 and sd >= 0 and best["maxDepth"] in (1, 2)
    assert learning.importances(data, ["p", "q"])[0][0] == "p"


@pytest.fixture
def many_parts(spark):
    """Ranges that are not put together again, so that rows pass on values from one to the next."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ranges_pass_values_on(spark, many_parts):
    random.seed(9)
    rows = [(random.choice([1, 1, 1, 1, 2, 3, None]), random.choice([None, *range(40)]), i) for i in range(300)]
    t = spark.createDataFrame(rows, "k int, s int, i int").selectExpr("k", "timestamp_micros(s * 7L) AS ts", "i", "s")
    got = {r.i: r.delta_us for r in lines.time_deltas(t, "k", "ts", "i").collect()}
    want, last = {}, {}
    for k, s, i in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2])):
        want[i] = (s - last[k]) * 7 if k in last else 0
        last[k] = s
    assert got == want | {i: None for _, s, i in rows if s is None}

    b = [(random.choice([1, 1, 1, 2, None]), random.choice([None, *range(0, 40, 3)]), random.choice([None, *"abcdefg"])) for _ in range(60)]
    got = {r.i: r.latest_v for r in lookups.latest_before(t.select("k", "s", "i"), spark.createDataFrame(b, "k int, s int, v string"), "k", "s", "v").collect()}
    for k, s, i in rows:
        known = [(x[1], x[2]) for x in b if None not in x and x[0] == k and s is not None and x[1] <= s]
        assert got[i] == (max(known)[1] if known else None)
    assert len(got) == 300


def test_ranges_number_labels_and_add_up(spark, many_parts):
    t = spark.createDataFrame([(f"w{i % 90:02d}", i, i % 3 == 0, (i * 7) % 50 / 10) for i in range(200)], "l string, i int, a boolean, s double")
    assert {r.l: r.id for r in columns.ids_by_name(t, "l").collect()} == {f"w{i:02d}": i for i in range(90)}
    assert {r.l: r.id for r in columns.ids_by_appearance(t, "l", "i").collect()} == {f"w{i:02d}": i for i in range(90)}
    rows = [(r.a, r.s) for r in t.collect()]
    for r in evaluation.curve(t, F.col("a"), F.col("s")).collect():
        assert (r.tp, r.fp) == (sum(a and s >= r.threshold for a, s in rows), sum((not a) and s >= r.threshold for a, s in rows))
    pos, neg = [s for a, s in rows if a], [s for a, s in rows if not a]
    assert evaluation.roc_auc(t, F.col("a"), F.col("s")).first().auc == pytest.approx(sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg))


def test_nearest_counts_rows_of_the_same_features_and_passes_over_boxes(spark, monkeypatch):
    """Against brute force over rows, with many ties, several files of points, and queries that stand on a point."""
    from pyspark.ml.functions import array_to_vector

    from tamarisk.operators import learning

    monkeypatch.setattr(search, "BOX_BLOCK", 150)
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 7, (900, 3)).astype(float), rng.integers(0, 9, (200, 3)).astype(float)
    make = lambda m, ys: spark.createDataFrame([(float(y), r.tolist()) for y, r in zip(ys, m)], "y double, f array<double>").coalesce(1).select("y", array_to_vector("f").alias("features"))
    ya, yb = rng.integers(0, 3, 900), np.arange(200)
    got = {r.y: r.prediction for r in learning.nearest(make(a, ya), make(b, yb)).collect()}
    for n, p in enumerate(b):
        order = np.lexsort((np.arange(900), np.round(np.sqrt(((a - p) ** 2).sum(axis=1)), 9)))[:5]
        votes = np.bincount(ya[order], minlength=3)
        assert got[float(n)] == votes.argmax(), n
    points = spark.createDataFrame([(n, r.tolist()) for n, r in enumerate(a)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(-n - 1, r.tolist()) for n, r in enumerate(b)], "vec_id long, embedding array<double>")
    want = {(r["query"], r.vec_id) for r in search.nearest_of(points, asked, 5).collect()}
    assert {(r["query"], r.vec_id) for r in search.nearest_points(points, asked, 5).collect()} == want and len(want) == 1000


def test_sketches_pass_over_pairs_without_a_loss(spark, monkeypatch):
    """Against all products, with several blocks and groups; and no sketch, whatever its axes, has less than a product."""
    rng = np.random.default_rng(8)
    monkeypatch.setattr(search, "GROUP_ROWS", 10)
    kinds = [rng.choice(400, 40, replace=False) for _ in range(8)]
    texts = {i: " ".join(f"w{t}" for t in rng.choice(kinds[i % 8], 25)) for i in range(1, 301)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    v = search.written(search.tfidf_vectors(search.inverted_index(docs), 300))
    got = {(r["query"], r["rank"]): r.doc_id for r in search.cosine_neighbours(v, F.col("doc_id") % 5 == 0, 3, block=20).collect()}
    vec = {r.doc_id: dict(zip(r.terms, r.weights)) for r in v.collect()}
    for q in range(5, 301, 5):
        sims = sorted(((-round(sum(w * vec[j].get(t, 0) for t, w in vec[q].items()), 9), j) for j in vec if j != q))
        assert [got[q, n + 1] for n in range(3)] == [j for _, j in sims[:3]]
    rows = pa.table({"doc_id": list(vec), "terms": [list(x) for x in vec.values()], "weights": [list(x.values()) for x in vec.values()]})
    (t, starts), (w, _) = search._flat(rows.column("terms")), search._flat(rows.column("weights"))
    terms = np.unique(t)[::2]
    short = search.Sketch(terms, np.linalg.qr(rng.standard_normal((len(terms), 20)))[0]).of(t, w, starts)
    dense = np.zeros((300, len(np.unique(t))))
    dense[np.repeat(np.arange(300), np.diff(starts)), np.unique(t, return_inverse=True)[1]] = w
    assert ((short @ short.T) - dense @ dense.T).min() > -search.SLACK
