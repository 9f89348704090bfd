"""TF-IDF over n-grams of a document collection."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.functions import arrays, text

#: Characters that no n-gram crosses.
CLAUSE = r'[^:;!^,?.\[|\]()"`]+'
WORD = r"[^ \t\r\n]+"
#: An n-gram with other characters than these is dropped.
GOOD = r"^[a-zA-Z0-9_'$ \-]+$"
CONTRACTION = r"(n't|'s|'re|'ll)$"
#: Shares into which the documents of one n-gram are split.
SALTS = 8
TF = ("basic", "log", "binary", "norm_50", "freq")
IDF = ("basic", "freq", "smooth", "max", "prob")

# Common function words, the default stop list of this engine.
STOP_WORDS = tuple("a an and are as at be but by for from had has have he her his i if in into is it its me my no not of on or our she so such that the their them then there these they this to was we were what when which who will with you your".split())


def clause_words(cleaned: Column, stop: Sequence[str] = ()) -> Column:
    """Array of clauses, each an array of words without stop words (contractions aside); n-grams may bridge a dropped word."""
    words = F.transform(F.regexp_extract_all(cleaned, F.lit(CLAUSE), F.lit(0)), lambda c: F.regexp_extract_all(c, F.lit(WORD), F.lit(0)))
    if stop:
        words = F.transform(words, lambda ws: F.filter(ws, lambda w: ~F.regexp_replace(w, CONTRACTION, "").isin(*stop)))
    return words


def ngrams(words: Column, sizes: Sequence[int]) -> Column:
    """All n-grams of the sizes, as text, over an array of clauses."""
    def of(n: int) -> Column:
        return F.flatten(F.transform(words, lambda ws: arrays.windows(ws, n)))

    per = [of(n) for n in sizes]
    joined = F.transform(F.concat(*per), lambda g: F.array_join(g, " "))
    return F.filter(joined, lambda g: g.rlike(GOOD))


def frequencies(docs: DataFrame, sizes: Sequence[int] = (1,), stop: Sequence[str] = (), key: str = "doc_id", column: str = "text", cleaned: Column | None = None) -> DataFrame:
    """``key``, ngram, tf (count) and doc_len (n-grams of the document). Documents without n-grams, null ones too, have no row.

    All n-grams of a document are counted in the task that reads it, so only the counts are shuffled.
    """
    grams = ngrams(clause_words(text.clean(column) if cleaned is None else cleaned, stop), sizes)
    # The outer form, as the plain one puts a filter on the array below, which would make it once more.
    rows = docs.select(key, grams.alias("g")).select(key, F.size("g").alias("n"), F.explode_outer("g").alias("ngram")).where("ngram IS NOT NULL")
    return rows.groupBy(key, "ngram").agg(F.count(F.lit(1)).alias("tf"), F.max("n").alias("doc_len"))


def with_df(tf: DataFrame, key: str = "doc_id", salts: int = SALTS) -> DataFrame:
    """Adds df, the number of documents that hold the n-gram.

    The rows of an n-gram are spread over ``salts`` shares by their document; the count goes back only to the shares that
    hold the n-gram, so a word of every document is no hot key and a rare one is not copied.
    """
    return document_counts(tf, "ngram", key, salts)


def document_counts(rows: DataFrame, term: str, key: str, salts: int = SALTS) -> DataFrame:
    """Adds df to rows unique on (term, key). The count reads the rows' own exchange again instead of making them twice."""
    salt = F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")
    spread = rows.withColumn("__s", salt).where("__s IS NOT NULL").repartition(term, "__s")
    # The count carries a hash of every column and both sides filter alike, else Catalyst prunes them differently and shares nothing.
    whole = F.max(F.hash(*[c for c in rows.columns if c != term])).alias("__h")
    part = spread.groupBy(term, "__s").agg(F.count(F.lit(1)).alias("__c"), whole)
    df = part.groupBy(term).agg(F.when(F.max("__h").isNotNull(), F.sum("__c")).alias("df"), F.collect_list("__s").alias("__in")).select(term, F.explode("__in").alias("__s"), "df")
    return spread.join(df, [term, "__s"]).drop("__s")


def tf_weight(kind: str, max_tf: Column | None = None) -> Column:
    """A weighting of ``tf`` and ``doc_len``; norm_50 needs the largest count of the document."""
    basic = F.col("tf") / F.col("doc_len")
    return {"basic": basic, "log": 1 + F.log(basic), "binary": F.lit(1.0), "freq": F.col("tf").cast("double"), "norm_50": 0.5 + 0.5 * (basic / (max_tf if max_tf is not None else F.lit(1.0)))}[kind]


def idf_weight(kind: str, n: int, max_tf: Column | None = None, epsilon: float = 0.0) -> Column:
    """A weighting of ``df`` among ``n`` documents; ``max`` needs the largest count in the collection. ``epsilon`` raises each df by a share."""
    df = F.col("df") * F.lit(1.0 + epsilon)
    odds = (F.lit(float(n)) - df) / df + 1e-6
    return {
        "basic": F.log(F.lit(float(n)) / df), "freq": 1 / df, "smooth": F.log(1 + F.lit(float(n)) / df),
        "max": F.log(1 + (max_tf if max_tf is not None else F.lit(1.0)) / df), "prob": F.when(odds > 0, F.log(odds)).otherwise(0.0),
    }[kind]


def weights(tf: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """Every weighting of every n-gram: columns tf_<kind> and idf_<kind>."""
    # The maxima come from aggregates, joined by the document or as one value.
    most = F.coalesce(tf.agg(F.max("tf")).scalar(), F.lit(1)).cast("double")
    per_doc = tf.groupBy(key).agg(F.max("tf").alias("__max"))
    full = with_df(tf, key).join(per_doc, key)
    return full.select(key, "ngram", "tf", "df", *[tf_weight(k, F.col("__max")).alias(f"tf_{k}") for k in TF], *[idf_weight(k, n, most).alias(f"idf_{k}") for k in IDF])


def top_terms(tf: DataFrame, n: int, limit: int = 100, key: str = "doc_id", epsilon: float = 0.0, length_weight: float = 1.0, min_df: float = 0, max_df: float = math.inf) -> DataFrame:
    """``key``, ngram, tf, df, score, rank: the best n-grams of each document by tf (share) times ln(n / df).

    Ties go to the smaller n-gram. ``min_df``/``max_df``: bounds on df, below 1 as a share of ``n``. ``length_weight`` to the power
    of the number of words multiplies the score.
    """
    bound = lambda v: v * n if v < 1 else v
    scored = with_df(tf, key)
    if min_df or max_df != math.inf:
        scored = scored.where((F.col("df") >= bound(min_df)) & (F.col("df") <= F.lit(float(bound(max_df)))))
    score = tf_weight("basic") * idf_weight("basic", n, epsilon=epsilon)
    if length_weight != 1.0:
        score = score * F.pow(F.lit(length_weight), F.size(F.split("ngram", " ")))
    ranked = scored.withColumn("score", score).withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY `{key}` ORDER BY round(score, 9) DESC, ngram)"))
    return ranked.where(F.col("rank") <= limit).select(key, "ngram", "tf", "df", "score", "rank")


def df_table(tf: DataFrame, n: int) -> DataFrame:
    """ngram, df, df_norm (df over the largest df) and df_share (df over ``n``); the largest df is a scalar subquery."""
    df = tf.groupBy("ngram").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("freq"))
    # Of both columns, so that the subquery's exchange is the one of the table and runs once.
    most = df.select(F.max(F.struct("df", "freq"))["df"]).scalar()
    return df.select("ngram", "df", "freq", (F.col("df") / most).alias("df_norm"), (F.col("df") / F.lit(float(n))).alias("df_share"))


def filter_extremes(df: DataFrame, n: int, no_below: int = 5, no_above: float = 0.5, keep: int = 100_000) -> DataFrame:
    """Terms in at least ``no_below`` documents and in at most ``no_above`` of them, the ``keep`` most frequent by df."""
    return df.where((F.col("df") >= no_below) & (F.col("df") <= F.lit(no_above * n))).orderBy(F.desc("df"), "ngram").limit(keep)


class _Seen:
    """The terms of a document so far, for finding those that clash with one of them without comparing pairs."""

    def __init__(self) -> None:
        self.whole: set[tuple[str, ...]] = set()
        self.runs: set[tuple[str, ...]] = set()
        self.starts: set[tuple[str, ...]] = set()
        self.ends: set[tuple[str, ...]] = set()

    def clash(self, words: tuple[str, ...], subsumed: bool, overlapping: bool) -> bool:
        n = len(words)
        runs = {words[i:j] for i in range(n) for j in range(i + 1, n + 1)}
        starts, ends = {words[:k] for k in range(1, n + 1)}, {words[k:] for k in range(n)}
        hit = subsumed and (words in self.runs or not runs.isdisjoint(self.whole)) or overlapping and (not ends.isdisjoint(self.starts) or not starts.isdisjoint(self.ends))
        self.whole.add(words)
        self.runs |= runs
        self.starts |= starts
        self.ends |= ends
        return hit


def prune(top: DataFrame, key: str = "doc_id", subsumed: bool = True, overlapping: bool = True, limit: int | None = None) -> DataFrame:
    """The top terms without those that a better-ranked term of the document contains, is contained in, or overlaps at word ends.

    Dropped terms still drop others. The ranked terms of one document are one array of at most the rank limit; one pass over it in an Arrow batch keeps the runs,
    starts and ends of the terms seen, so the work grows with the terms and not with their pairs.
    """
    kind = dict(top.dtypes)[key]
    terms = top.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "ngram", "score"))).alias("t")).select(key, "t.ngram", "t.score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rank, grams, scores = [], [], [], []
            for i, (ngrams_, values) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                seen, n = _Seen(), 0
                for g, v in zip(ngrams_, values):
                    if not seen.clash(tuple(g.split(" ")), subsumed, overlapping) and (limit is None or n < limit):
                        n += 1
                        at.append(i)
                        rank.append(n)
                        grams.append(g)
                        scores.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(rank, pa.int32()), pa.array(grams, pa.string()), pa.array(scores, pa.float64())], [key, "rank", "ngram", "score"])

    return terms.mapInArrow(run, f"`{key}` {kind}, rank int, ngram string, score double")


def boost(top: DataFrame, key: str = "doc_id", good: Sequence[str] = (), bad: Sequence[str] = (), stop: Sequence[str] = STOP_WORDS, good_by: float = 1.0, bad_by: float = 1.0, numeric_by: float = 1.0, stop_by: float = 1.0, punct_by: float = 1.0, drop_numeric: bool = False) -> DataFrame:
    """Scores multiplied for terms with good, bad, numeric, stop (once for each) or all-punctuation words, then ranked again."""
    words = F.split("ngram", " ")
    has = lambda f: F.exists(words, f)
    s = F.col("score")
    if good:
        s = F.when(has(lambda w: w.isin(*good)), s * good_by).otherwise(s)
    if bad:
        s = F.when(has(lambda w: w.isin(*bad)), s * bad_by).otherwise(s)
    s = F.when(has(text.is_numeric), s * numeric_by).otherwise(s)
    s = s * F.pow(F.lit(stop_by), F.size(F.filter(words, lambda w: w.isin(*stop))))
    s = F.when(has(lambda w: w.rlike(r"^[\p{P}\p{S}]+$")), s * punct_by).otherwise(s)
    out = top.where("trim(ngram) <> ''").withColumn("score", s)
    if drop_numeric:
        out = out.where(~F.exists(F.split("ngram", " "), text.is_numeric))
    return out.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY `{key}` ORDER BY round(score, 9) DESC, ngram)"))


def report(top: DataFrame, key: str = "doc_id", limit: int = 10, places: int = 3) -> DataFrame:
    """One line for each document: its best terms with rounded scores."""
    best = top.where(F.col("rank") <= limit).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "ngram", "score"))).alias("t"))
    return best.select(key, F.array_join(F.transform("t", lambda x: F.concat(x["ngram"], F.lit(":"), F.format_string(f"%.{places}f", x["score"]))), ", ").alias("terms"))


def positions(docs: DataFrame, term: str, key: str = "doc_id", column: str = "text") -> DataFrame:
    """``key``, start and end (characters from 0) and the original text of each occurrence of a term, in any case."""
    quoted = "(?i)" + "\\Q" + term + "\\E"
    parts = F.split(F.col(column), quoted, -1)
    found = F.regexp_extract_all(F.col(column), F.lit(quoted), F.lit(0))
    rows = docs.select(key, parts.alias("p"), F.posexplode(found).alias("i", "original"))
    before = F.aggregate(F.slice("p", F.lit(1), F.col("i") + 1), F.lit(0), lambda a, x: a + F.length(x)) + F.col("i") * len(term)
    return rows.select(key, before.alias("start"), (before + F.length("original")).alias("end"), "original")


def documents_of(rows: DataFrame, key: str, text: str, order: list[str]) -> DataFrame:
    """(doc_id, text): the texts of each key joined by a blank in the given order. A document is one value, so it must fit in a task."""
    parts = rows.where(F.col(text).isNotNull()).groupBy(F.col(key).alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__t")))).alias("p"))
    return parts.select("doc_id", F.array_join(F.transform("p", lambda x: x["__t"]), " ").alias("text"))


def term_matrix(tf: DataFrame, terms: Sequence[str], key: str = "doc_id") -> DataFrame:
    """One row for each document with any n-gram, one column with the count of each listed term."""
    return tf.groupBy(key).agg(*[F.coalesce(F.sum(F.when(F.col("ngram") == t, F.col("tf"))), F.lit(0)).alias(t) for t in terms])


def random_term(top: DataFrame, key: str = "doc_id", seed: int = 17) -> DataFrame:
    """One of the ranked terms of each document, chosen by a hash of seed, document and term."""
    return top.groupBy(key).agg(F.min_by("ngram", F.xxhash64(F.lit(seed), F.col(key), F.col("ngram"))).alias("ngram"))


def score_of(tf: DataFrame, n: int, term: str, key: str = "doc_id") -> DataFrame:
    """``key`` and the tf-idf of one term in the documents that hold it; only the rows of the term are shuffled."""
    rows = tf.where(F.col("ngram") == term)
    df = rows.agg(F.count(F.lit(1))).scalar()
    return rows.select(key, (tf_weight("basic") * F.log(F.lit(float(n)) / df)).alias("score"))


def capitals_first(terms: DataFrame, key: str, term: str = "term", score: str = "score") -> DataFrame:
    """Adds rank by score within ``key``; of equal scores terms in title case (stop words within them aside) come first, then the smaller term."""
    title = arrays.title_case_ngram(F.split(term, " "), list(STOP_WORDS))
    ranked = terms.withColumn("__t", F.coalesce(title, F.lit(False)))
    return ranked.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY `{key}` ORDER BY round(`{score}`, 9) DESC, __t DESC, `{term}`)")).drop("__t")


def counted_terms(docs: DataFrame, sizes: Sequence[int] = (1, 2), key: str = "doc_id", column: str = "text", lower: bool = True) -> DataFrame:
    """(``key``, term, n) of runs of words of two characters or more, as a count vectorizer sees them: no clauses, no cleaning."""
    words = F.regexp_extract_all(F.lower(column) if lower else F.col(column), F.lit("[A-Za-z0-9_]{2,}"), F.lit(0))
    # The array goes through a lambda, so that it is made once and not for every window.
    grams = F.flatten(F.transform(F.array(words), lambda ws: F.concat(*[F.transform(arrays.windows(ws, n), lambda g: F.array_join(g, " ")) for n in sizes])))
    return docs.select(key, F.explode_outer(grams).alias("term")).where("term IS NOT NULL").groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))
