"""Problem 3: mapping free-entered values to a canonical list, by token-level repair and soft TF-IDF.

Every distinct token of the distinct values is joined to the vocabulary of the reference list by edit distance: both sides
are spread over the strings that up to two deletions leave, equal ones meet in an equi-join, and the true distance of the
pairs decides. A value's repaired tokens then rank the entries that hold them by soft TF-IDF.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.plans.scale import lookup, written

# Letters of other scripts that look like Latin ones, and digits typed for letters.
LOOKALIKES = {"а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ν": "v", "ß": "ss", "ø": "o", "ł": "l", "đ": "d", "æ": "ae", "œ": "oe"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
_WORD = re.compile(r"[^\W_]+")
_CAMEL = re.compile(r"(?<=[a-zà-öø-ÿ]{2})(?=[A-ZÀ-ÖØ-Þ])")
_TAIL = re.compile(r"(?<=[^\W\d_])(?=[0-9]{3}(?![^\W_]))")


def max_edits(n: int) -> int:
    """Edits allowed in a word of ``n`` characters of the vocabulary: none up to 4, one for 5, else two."""
    return 0 if n <= 4 else 1 if n <= 5 else 2


def fold(text: str) -> str:
    """Lower case without marks, look-alike letters made Latin."""
    out = unicodedata.normalize("NFKD", text).lower()
    return "".join(LOOKALIKES.get(c, c) for c in out if not unicodedata.combining(c))


def tokens(text: str) -> list[str]:
    """Folded tokens; words run together are split at a capital or before three last digits, digits inside words become letters.

    A word with three last digits also stays whole, as those may stand for letters.
    """
    camel = _CAMEL.sub(" ", unicodedata.normalize("NFC", text))
    spaced = _TAIL.sub(" ", camel)
    out = []
    for w in _WORD.findall(fold(spaced)) + [x for x in _WORD.findall(fold(camel)) if _TAIL.search(x)]:
        if not w.isdigit() and any(c.isalpha() for c in w):
            w = "".join(DIGITS.get(c, c) for c in w)
        out.append(w)
    return out


#: Vocabulary words longer than this are found by pieces instead of deletions, whose number grows with the square of the length.
LONG = 24
#: Two edits, a swap of neighbours counting as one, touch at most four of so many pieces.
PIECES = 5


def deletions(w: str) -> set[str]:
    """What is left of a token after up to ``max_edits`` deletions."""
    return {"".join(c for i, c in enumerate(w) if i not in gone) for k in range(max_edits(len(w)) + 1) for gone in map(set, combinations(range(len(w)), k))}


def signatures(w: str, vocabulary: bool) -> set[str]:
    """Texts of which a token and a vocabulary word within two edits share at least one.

    Words up to LONG: what deletions leave. Longer ones: a word in PIECES pieces, and of a token the runs of those lengths, at most two
    places from where the pieces of a word up to two longer or shorter would be; one piece at least is whole and moved by no more.
    """
    out = deletions(w) if len(w) <= LONG + 2 * (not vocabulary) else set()
    if len(w) > LONG - 2 * (not vocabulary):
        for n in [len(w)] if vocabulary else range(max(LONG + 1, len(w) - 2), len(w) + 3):
            cuts = [n * k // PIECES for k in range(PIECES + 1)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                for move in [0] if vocabulary else range(-2, 3):
                    if a + move >= 0 and len(piece := w[a + move : b + move]) == b - a:
                        out.add(f"{n} {k} {piece}")
    return out


def distance(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions of neighbours; ``most + 1`` if it is larger than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def _tokenised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame([(v, w) for v in b["value"] for w in dict.fromkeys(tokens(v))], columns=["value", "token"])


def _variants(vocabulary: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(w, v) for w in b["token"] for v in signatures(w, vocabulary)], columns=["token", "variant"])

    return run


def _measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        d = [distance(t, w, max_edits(len(w))) for t, w in zip(b["token"], b["word"])]
        yield b.assign(edits=d)[[x <= max_edits(len(w)) for x, w in zip(d, b["word"])]]


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for x in b.itertuples():
            maker, rest = tokens(x.maker or ""), tokens(x.name)
            rest = rest[len(maker) :] if rest[: len(maker)] == maker else rest
            head, extra = rest[:1], rest[1:]
            words = [("".join(maker), "maker")] if maker else []
            words += [(w, "head") for w in head] + [(w, "extra") for w in extra]
            for w, kind in words:
                rows.append((x.id, w, kind, w))
            for a in tokens(x.abbr or ""):
                rows.append((x.id, "".join(maker), "maker", a))
            # Words run together without a sign of where they part stand for all of them.
            for run in {(*maker, *rest), (*maker, *head), tuple(rest)}:
                if len(run) > 1:
                    rows += [(x.id, w, kind, "".join(run)) for w, kind in words if w in run or (kind == "maker" and run[: len(maker)] == tuple(maker))]
        yield pd.DataFrame(rows, columns=["id", "word", "kind", "typed"])


def map_values(values: DataFrame, reference: DataFrame, need_head: bool = True, maker_agrees: bool = True) -> DataFrame:
    """``value``, ``id``, ``score``, ``second`` and ``second_score`` for every distinct non-blank value of ``values``; ``id`` is -1 where no entry is meant.

    ``reference`` has ``id``, ``name`` and, possibly null, ``maker`` (a leading part of the name that may be left out or
    written as ``abbr``). The first token of the name after the maker is its head. ``need_head``: an entry can only be meant if its head
    stands in the value; ``maker_agrees``: and, where the value names makers, if one of them is the entry's. Of these the highest soft
    TF-IDF wins: the squares of the inverse entry frequencies of the entry's words in the value, times the similarity of the tokens they
    were typed as, over the norm of the entry (that of the value is the same for all its entries); further words (years, remarks) do not
    count against it. The entry in second place is given, too. Values that two entries fit equally well, and values
    with only a maker, get -1. Null and blank values are left out; an empty reference maps all to -1. Repeated values are mapped once.

    Scale: all work is on distinct values and tokens. Tokens too long to be near any word of the vocabulary are left out first. Entries are
    candidates of a value through one of its heads (without ``need_head`` through any word), as rows of an equi-join, broadcast only after a check of rows and bytes and salted
    otherwise, so the maker in a third of all values is no hot key; a word that stands in every entry is met only by the entries that
    are candidates already. Nothing is gathered into lists but a value's two best entries.
    """
    v = values.select(F.col(values.columns[0]).alias("value")).where("value IS NOT NULL AND value RLIKE '(?U)\\\\S'").distinct()
    typed = written(v.mapInPandas(_tokenised, "value string, token string"))
    ref = reference.select("id", "name", "maker", "abbr").where("name IS NOT NULL").dropDuplicates(["id"])
    words = written(ref.mapInPandas(_entries, "id long, word string, kind string, typed string").distinct())

    # Token repair
    size = words.agg(F.countDistinct("id").alias("n"), F.coalesce(F.max(F.length("typed")), F.lit(0)).alias("longest")).first()
    vocab = words.select(F.col("typed").alias("token")).distinct()
    ours = typed.where(F.length("token") <= size["longest"] + 2).select("token").distinct().mapInPandas(_variants(False), "token string, variant string")
    theirs = vocab.mapInPandas(_variants(True), "token string, variant string").withColumnRenamed("token", "word")
    pairs = ours.join(theirs, "variant").select("token", "word").distinct()
    near = written(pairs.mapInPandas(_measured, "token string, word string, edits int"))
    least = near.groupBy("token").agg(F.min("edits").alias("edits"))
    best = near.join(least, ["token", "edits"]).select("token", F.col("word").alias("typed"), (1 - F.col("edits") / F.greatest(F.length("token"), F.length("word"))).alias("sim"))

    # Weights of soft TF-IDF, and the entries of each repaired token
    idf = words.groupBy("word").agg(F.log(1 + F.lit(max(size["n"], 1)) / F.countDistinct("id")).alias("w"))
    norm = words.select("id", "word").distinct().join(idf, "word").groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    entries = written(words.join(idf, "word").join(norm, "id"))
    fixed = written(lookup(typed, best, ["token"], "inner").select("value", "typed", "sim").groupBy("value", "typed").agg(F.max("sim").alias("sim")))
    through = entries.where("kind = 'head'") if need_head else entries
    candidates = lookup(fixed, through.select("typed", "id").distinct(), ["typed"], "inner").select("value", "id").distinct()
    # A candidate's words are few; each is looked for among the words of the value.
    full = lookup(candidates, entries, ["id"], "inner").join(fixed, ["value", "typed"])
    hits = full.groupBy("value", "id", "word", "kind").agg(F.max("sim").alias("sim"), F.max("w").alias("w"), F.max("norm").alias("norm"))
    scored = hits.groupBy("value", "id").agg(F.round(F.sum(F.col("w") * F.col("w") * F.col("sim") / F.col("norm")), 9).alias("score"), F.max(F.col("kind") == "maker").alias("maker"))
    if maker_agrees:
        makers = lookup(fixed, entries.where("kind = 'maker'").select("typed").distinct(), ["typed"], "inner").select("value").distinct().withColumn("any_maker", F.lit(True))
        scored = scored.join(makers, "value", "left").where("maker OR any_maker IS NULL")
    scored = written(scored.select("value", "id", "score"))
    top = scored.groupBy("value").agg(F.max(F.struct("score", "id")).alias("a"), F.count(F.lit(1)).alias("n"))
    rest = scored.join(top, "value").where("n > 1 AND id <> a.id").groupBy("value").agg(F.max(F.struct("score", "id")).alias("b"))
    mapped = top.join(rest, "value", "left").select("value", F.when(F.col("a.score") == F.col("b.score"), -1).otherwise(F.col("a.id")).alias("id"), "a.score", F.col("b.id").alias("second"), F.col("b.score").alias("second_score"))
    return v.join(mapped, "value", "left").select("value", F.coalesce("id", F.lit(-1)).cast("long").alias("id"), "score", "second", "second_score")
