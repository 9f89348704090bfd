"""Sentences, word tokens, parts of speech, stems, and n-gram language models."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.plans.scale import checkpoint, lookup

# The default part of speech, classes of tags by their beginnings.
DEFAULT_POS = "NN"
CLASSES = (("NN", "noun"), ("VB", "verb"), ("MD", "verb"), ("RB", "adverb"), ("JJ", "adjective"))


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, sentence_no (from 1), sentence: split after ``.``, ``!`` or ``?`` and white space; empty ones dropped."""
    parts = F.transform(F.split(F.regexp_replace(text, r"([.!?])[ \t\r\n]+", "$1\u0001"), "\u0001"), lambda s: F.regexp_replace(s, r"^[ \t\r\n]+|[ \t\r\n]+$", ""))
    return docs.select(key, F.posexplode_outer(F.filter(parts, lambda s: s != "")).alias("i", "s")).where("s IS NOT NULL").select(key, (F.col("i") + 1).alias("sentence_no"), F.col("s").alias("sentence"))


def word_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", punctuation: bool = True) -> DataFrame:
    """``key``, token_no (from 1), token: words and, with ``punctuation``, runs of other visible characters."""
    found = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]+" if punctuation else "[A-Za-z0-9_]+"), F.lit(0))
    return docs.select(key, F.posexplode_outer(found).alias("i", "token")).where("token IS NOT NULL").select(key, (F.col("i") + 1).alias("token_no"), "token")


def tag(tokens: DataFrame, pos: DataFrame) -> DataFrame:
    """Adds pos: that of the lower-cased token in (word, pos), else punctuation or the default."""
    k = tokens.withColumn("word", F.lower("token"))
    t = lookup(k, pos.select("word", "pos"), ["word"])
    return t.withColumn("pos", F.coalesce("pos", F.when(F.col("token").rlike(r"^[\p{P}\p{S}]+$"), "."), F.lit(DEFAULT_POS))).drop("word")


def pos_class(tagged: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds class: noun, verb, adverb, adjective or other; VBG and VBN count as verbs only after another verb tag."""
    prev = F.expr(f"coalesce(lag(pos) OVER (PARTITION BY `{key}` ORDER BY token_no), '')")
    c = F.lit("other")
    for start, name in reversed(CLASSES):
        c = F.when(F.col("pos").startswith(start), name).otherwise(c)
    return tagged.withColumn("__p", prev).withColumn("class", F.when(F.col("pos").isin("VBG", "VBN") & ~F.col("__p").rlike("^(VB|MD)"), "other").otherwise(c)).drop("__p")


# English suffix stripping, in the steps of the Porter algorithm

_V = "[aeiou]|(?<![aeiou])y|(?<=[aeiou])y(?=$)"


def _measure(stem: str) -> int:
    kinds = "".join("v" if c in "aeiou" or (c == "y" and i and stem[i - 1] not in "aeiou") else "c" for i, c in enumerate(stem))
    return len(re.findall("vc", re.sub(r"(.)\1+", r"\1", kinds)))


def _vowel(stem: str) -> bool:
    return any(c in "aeiou" or (c == "y" and i) for i, c in enumerate(stem))


def _short(w: str) -> bool:
    return len(w) >= 3 and w[-1] not in "aeiouwxy" and w[-2] in "aeiouy" and w[-3] not in "aeiou"


# Suffixes and what they become, for a stem of measure above 0 and above 1.
_LONG_SUFFIXES = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_MORE_SUFFIXES = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_LAST_SUFFIXES = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou")


def stem_word(w: str) -> str:
    """The stem of a lower-case English word: plural, past, and derivational endings are cut."""
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")) or (_measure(w) == 1 and _short(w)):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "lsz":
                    w = w[:-1]
                break
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_LONG_SUFFIXES, _MORE_SUFFIXES):
        for end in sorted(table, key=len, reverse=True):
            if w.endswith(end):
                w = w[: -len(end)] + table[end] if _measure(w[: -len(end)]) > 0 else w
                break
    for end in _LAST_SUFFIXES:
        if w.endswith(end):
            w = w[: -len(end)] if _measure(w[: -len(end)]) > 1 else w
            break
    else:
        if w.endswith(("sion", "tion")) and _measure(w[:-3]) > 1:
            w = w[:-3]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


def stems(words: DataFrame, word: str = "word") -> DataFrame:
    """(word, stem) of the distinct words: each word is stemmed once, to be looked up from the texts."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda w: None if w is None else stem_word(w))

    return words.select(F.lower(word).alias("word")).where("word IS NOT NULL").distinct().withColumn("stem", run("word"))


# Language model


def ngram_counts(sents: DataFrame, order: int = 3, text: str = "sentence") -> DataFrame:
    """(n, ngram, count) of token n-grams up to ``order`` over sentences with ``<s>`` and ``</s>`` around them."""
    # The tokens are a column of their own, as a lambda would evaluate an expression for each of its steps.
    sents = sents.select(F.concat(F.array(F.lit("<s>")), F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0)), F.array(F.lit("</s>"))).alias("t"))
    toks = F.col("t")

    def grams(n: int) -> Column:
        return F.when(F.size(toks) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(toks) - n + 1, F.lit(1))), lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice(toks, i, n), " ").alias("ngram")))).otherwise(F.array().cast("array<struct<n:int,ngram:string>>"))

    return sents.select(F.inline_outer(F.concat(*[grams(n) for n in range(1, order + 1)]))).where("n IS NOT NULL").groupBy("n", "ngram").agg(F.count(F.lit(1)).alias("count"))


def language_model(counts: DataFrame, discount: float = 0.5) -> DataFrame:
    """(n, ngram, logprob, backoff): absolute discounting; the weight taken from seen n-grams goes to the shorter history.

    ``logprob`` and ``backoff`` are base-10 logarithms, as in ARPA files; unigrams are shares of all tokens but ``<s>``.
    """
    hist = F.when(F.col("n") > 1, F.regexp_replace("ngram", " [^ ]+$", "")).otherwise(F.lit(""))
    # Counted once, used three times.
    c = checkpoint(counts).withColumn("history", hist)
    total = c.where("ngram <> '<s>' OR n > 1").groupBy("n", "history").agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("types"))
    p = c.join(total, ["n", "history"]).select("n", "ngram", F.when(F.col("n") == 1, F.log10(F.col("count") / F.col("total"))).otherwise(F.log10((F.col("count") - discount) / F.col("total"))).alias("logprob"))
    # What a history leaves: the discounted share, spread over the shorter n-grams.
    left = total.where("n > 1").select((F.col("n") - 1).alias("n"), F.col("history").alias("ngram"), F.log10(discount * F.col("types") / F.col("total")).alias("backoff"))
    return p.join(left, ["n", "ngram"], "left").select("n", "ngram", "logprob", F.coalesce("backoff", F.lit(0.0)).alias("backoff"))


def score_sentences(sents: DataFrame, model: DataFrame, key: Sequence[str], text: str = "sentence", floor: float = -7.0) -> DataFrame:
    """``key``, logprob (base 10), tokens, per_token and unknown (tokens outside the model) of each sentence under a trigram model.

    Each token takes its longest known n-gram; for each shorter one the back-off of the longer history is added. The joins
    are on n-grams, each side spread by them.
    """
    toks = F.concat(F.array(F.lit("<s>")), F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0)), F.array(F.lit("</s>")))
    rows = sents.select(*key, toks.alias("t")).select(*key, "t", F.explode(F.sequence(F.lit(2), F.size("t"))).alias("i"))
    gram = lambda n: F.when(F.col("i") >= n, F.array_join(F.slice("t", F.col("i") - n + 1, n), " "))
    past = lambda n: F.when(F.col("i") > n, F.array_join(F.slice("t", F.col("i") - n, n), " "))
    pos = rows.select(*key, "i", gram(1).alias("g1"), gram(2).alias("g2"), gram(3).alias("g3"), past(1).alias("h1"), past(2).alias("h2"))
    out, model = pos, checkpoint(model)
    for n in (1, 2, 3):
        out = lookup(out, model.where(F.col("n") == n).select(F.col("ngram").alias(f"g{n}"), F.col("logprob").alias(f"p{n}")), [f"g{n}"])
    for n in (1, 2):
        out = lookup(out, model.where(F.col("n") == n).select(F.col("ngram").alias(f"h{n}"), F.col("backoff").alias(f"b{n}")), [f"h{n}"])
    b1, b2 = F.coalesce("b1", F.lit(0.0)), F.coalesce("b2", F.lit(0.0))
    lp = F.coalesce(F.col("p3"), F.col("p2") + b2, F.col("p1") + b1 + b2, F.lit(floor))
    return out.groupBy(*key).agg(F.sum(lp).alias("logprob"), F.count(F.lit(1)).alias("tokens"), F.count(F.when(F.col("p1").isNull(), 1)).alias("unknown")).withColumn("per_token", F.col("logprob") / F.col("tokens"))


def to_arpa(model: DataFrame) -> DataFrame:
    """(n, line): the n-gram lines of an ARPA file, back-off only where it is not zero."""
    line = F.concat_ws("\t", F.format_string("%.6f", "logprob"), "ngram", F.when(F.col("backoff") != 0, F.format_string("%.6f", "backoff")))
    return model.select("n", line.alias("line"))


def from_arpa(lines: DataFrame, line: str = "line") -> DataFrame:
    """(n, ngram, logprob, backoff) of the n-gram lines of an ARPA file; other lines are skipped."""
    p = lines.select(F.split(line, "\t").alias("p")).where(F.size("p").between(2, 3) & F.col("p")[0].rlike(r"^-?[0-9.]+$"))
    return p.select(F.size(F.split(F.col("p")[1], " ")).alias("n"), F.col("p")[1].alias("ngram"), F.col("p")[0].cast("double").alias("logprob"), F.coalesce(F.try_element_at("p", F.lit(3)).cast("double"), F.lit(0.0)).alias("backoff"))
