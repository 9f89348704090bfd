"""Search: inverted index, boolean and phrase queries, cosine and vector neighbours, chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarisk.operators.tfidf import document_counts
from tamarisk.plans.scale import block_files, lookup, read_block, salted_lookup, spread, written

#: Query vectors that a task holds at once.
QUERY_BLOCK = 2000


def terms(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(F.col(text) if isinstance(text, str) else text), F.lit("[a-z0-9]+"), F.lit(0))


def inverted_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, ``key``, tf)."""
    return docs.select(key, F.explode_outer(terms(text)).alias("term")).where("term IS NOT NULL").groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"))


def index_counts(index: DataFrame, key: str = "doc_id") -> DataFrame:
    """The index as counts for ``tfidf``: ``key``, ngram, tf and doc_len, the number of words of the document."""
    length = F.sum("tf").over(Window.partitionBy(key))
    return index.select(key, F.col("term").alias("ngram"), "tf", length.alias("doc_len"))


def boolean_search(index: DataFrame, words: list[str], conjunctive: bool = False, key: str = "doc_id") -> DataFrame:
    """``key`` and matched (number of the words it holds) of documents with any, or all, of the words."""
    w = sorted({x.lower() for x in words})
    hits = index.where(F.col("term").isin(*w)).groupBy(key).agg(F.count(F.lit(1)).alias("matched"))
    return hits.where(F.col("matched") == len(w)) if conjunctive else hits


def phrase_search(docs: DataFrame, phrase: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and occurrences of documents in which the words of the phrase follow each other."""
    joined = F.concat(F.lit(" "), F.array_join(terms(text), "  "), F.lit(" "))
    p = " " + "  ".join(phrase.lower().split()) + " "
    n = ((F.length(joined) - F.length(F.replace(joined, F.lit(p), F.lit("")))) / len(p)).cast("int")
    return docs.select(key, n.alias("occurrences")).where("occurrences > 0")


def query_hits(index: DataFrame, queries: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of each query (query_id, query): documents that hold any of its words and its words' occurrences in all."""
    q = queries.select("query_id", F.explode(F.array_distinct(terms("query"))).alias("term"))
    hits = lookup(index, q, ["term"], "inner")
    return hits.groupBy("query_id").agg(F.countDistinct(key).alias("documents"), F.sum("tf").alias("occurrences"))


def tfidf_vectors(index: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """``key``, terms and weights: tf times ln(n / df), scaled to length 1; terms of all documents have no weight and are left out.

    A term stands as its 64-bit hash, which is shuffled and compared in place of the text.
    """
    hashed = index.select(key, F.xxhash64("term").alias("term"), "tf")
    counted = document_counts(hashed, "term", key)
    weighed = counted.where(F.col("df") < n).select(key, "term", (F.col("tf") * F.log(F.lit(float(n)) / F.col("df"))).alias("w"))
    doc = weighed.groupBy(key).agg(F.collect_list(F.struct("term", "w")).alias("v"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return doc.select(key, F.col("v.term").alias("terms"), F.transform("v", lambda x: x["w"] / F.col("norm")).alias("weights"))


def _best(scored: DataFrame, k: int, query: str, score: str, other: str, descending: bool) -> DataFrame:
    order = "DESC" if descending else "ASC"
    return scored.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY `{query}` ORDER BY round(`{score}`, 9) {order}, `{other}`)")).where(F.col("rank") <= k)


def cosine_neighbours(vectors: DataFrame, queries: Column, k: int = 10, key: str = "doc_id", block: int = QUERY_BLOCK) -> DataFrame:
    """query, ``key``, similarity, rank: the ``k`` documents most similar to each query document, itself left out.

    ``queries`` is the condition of the rows of ``vectors`` that are queries. See ``_blocks`` for how they meet all vectors, without a join on a frequent word, and ``_sparse`` for which pairs are
    scored. The queries meet one another first: what the last of the ``k`` best has there is the least that it has among all vectors.
    """
    vectors = written(vectors)
    asked, find = vectors.where(queries), _sparse(sketch(vectors, key))
    among = _blocks(asked, asked, k, key, block, find, True, "similarity").where(F.col("rank") == k).select(F.col("query").alias(key), F.round("similarity", 9).alias("least"))
    asked = written(salted_lookup(asked, written(among), [key]).withColumn("least", F.coalesce("least", F.lit(0.0))))
    return _blocks(vectors, asked, k, key, block, find, True, "similarity")


def vector_neighbours(vectors: DataFrame, queries: Column, k: int = 10, key: str = "vec_id", column: str = "embedding", metric: str = "l2", block: int = QUERY_BLOCK) -> DataFrame:
    """query, ``key``, distance (or similarity), rank: the nearest vectors by ``l2`` or ``cosine``, the query itself left out.

    Exact: blocks of queries against all rows by matrix products; vectors of another length than the query's are skipped.
    """
    return nearest_of(vectors, vectors.where(queries), k, key, column, metric, block)


def nearest_of(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", column: str = "embedding", metric: str = "l2", block: int = QUERY_BLOCK) -> DataFrame:
    """Like ``vector_neighbours`` with queries of their own; one with the key of a row does not find it."""
    v, q = (t.select(key, F.col(column).cast("array<double>").alias("weights")) for t in (vectors, queries))
    return _blocks(v, q, k, key, block, _scored(_dense_l2 if metric == "l2" else _dense_cosine, metric != "l2"), metric != "l2", "similarity" if metric == "cosine" else "distance")


#: Vectors up to this width are sought in boxes; rows of a box, queries that look for boxes together, vectors in a file that a task searches at once.
BOX_WIDTH, BOX_ROWS, BOX_QUERIES, BOX_BLOCK = 8, 24, 32, 50_000


def nearest_points(points: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query, ``key``, distance: what ``nearest_of`` finds by ``l2``, for vectors of one width up to BOX_WIDTH without gaps.

    Exact. Tasks take the queries in groups and go through the points file by file. Points lie in boxes, halves of halves along the widest side; boxes that are farther
    from a bunch of near queries than the ``k`` best so far are passed over.
    """
    files = block_files(points.where(F.col(key).isNotNull()).select(key, column), key, BOX_BLOCK)
    fields = pa.schema([("query", pa.int64()), (key, pa.int64()), ("distance", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            a, ids = _matrix(rows.column(column)), rows.column(key).to_numpy()
            bunches = _halves(a, BOX_QUERIES)
            best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
            least = np.full(len(a), np.inf)
            for f in files:
                block = read_block(f).sort_by(key)
                best, least = _nearer(a, bunches, _matrix(block.column(column)), block.column(key).to_numpy(), k, best, least)
            yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[1]), pa.array(best[2])], schema=fields)

    asked = queries.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias(key), column)
    return spread(asked, key).mapInArrow(run, f"query bigint, `{key}` bigint, distance double")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches of a task as tables of about GROUP_ROWS."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(map(len, held)) >= GROUP_ROWS:
            yield pa.Table.from_batches(held)
            held = []
    if sum(map(len, held)):
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values, at = _flat(column)
    return values.reshape(len(at) - 1, -1)


def _halves(points: np.ndarray, most: int) -> list[np.ndarray]:
    """Places of near points, at most so many at once."""
    done, open_ = [], [np.arange(len(points))]
    while open_:
        at = open_.pop()
        if len(at) <= most:
            done.append(at)
            continue
        own = points[at]
        half = np.argpartition(own[:, np.argmax(np.ptp(own, axis=0))], len(at) // 2)
        open_ += [at[half[: len(at) // 2]], at[half[len(at) // 2 :]]]
    return done


def _nearer(a: np.ndarray, bunches: list[np.ndarray], b: np.ndarray, keys: np.ndarray, k: int, best: tuple, least: np.ndarray) -> tuple[tuple, np.ndarray]:
    """``best`` (place of the query, key, distance) with what a block of points, in the order of their keys, has to add, and each query's ``k``-th distance."""
    boxes = _halves(b, BOX_ROWS)
    low, high, box = np.array([b[x].min(axis=0) for x in boxes]), np.array([b[x].max(axis=0) for x in boxes]), np.empty(len(b), np.int64)
    for n, x in enumerate(boxes):
        box[x] = n
    few, least = min(len(boxes), -(-2 * k // BOX_ROWS) + 1), least.copy()
    found = [best]

    def distances(of: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.round(np.sqrt(sum((b[at, i][None, :] - a[of, i][:, None]) ** 2 for i in range(a.shape[1]))), 9)

    for of in bunches:
        own = a[of]
        gap = np.maximum(np.maximum(low - own.max(axis=0), own.min(axis=0) - high), 0)
        gap = np.sqrt((gap * gap).sum(axis=1))
        if not np.isfinite(least[of]).all():
            some = distances(of, np.concatenate([boxes[n] for n in np.argpartition(gap, few - 1)[:few]]))
            if some.shape[1] >= k:
                least[of] = np.minimum(least[of], np.partition(some, k - 1, axis=1)[:, k - 1])
        # Boxes hold whole points, so that rounding is all that the gap may lack.
        at = np.flatnonzero((gap <= least[of].max() + 1e-8)[box])
        if len(at):
            d = distances(of, at)
            if len(at) >= k:
                least[of] = np.minimum(least[of], np.partition(d, k - 1, axis=1)[:, k - 1])
            q, r = np.nonzero(d <= least[of][:, None])
            found.append((of[q], keys[at[r]], d[q, r]))
    q, p, d = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((p, d, q))
    q, p, d = q[order], p[order], d[order]
    counts = np.bincount(q, minlength=len(a))
    rank = np.arange(len(q)) - np.repeat(np.cumsum(counts) - counts, counts)
    full = rank == k - 1
    least[q[full]] = d[full]
    return (q[rank < k], p[rank < k], d[rank < k]), least


#: Rows that a task compares with a block of queries before it gives their best, and rows whose scores it holds at once.
GROUP_ROWS, SCORE_ROWS = 20_000, 500
#: Queries whose sketches meet those of a group of rows at once.
SKETCH_QUERIES = 100


def _blocks(vectors: DataFrame, queries: DataFrame, k: int, key: str, block: int, prepare, descending: bool, name: str) -> DataFrame:
    """The ``k`` best rows of each query, ties, however many, to the smallest keys; rows without a key are left out.

    One pass over the vectors, whatever the number of queries: these lie in the shared folder in files of about ``block``, which a task reads one by
    one for each group of its rows. Neither driver nor plan holds them, a task never more than one block and one group. For each query a
    task passes on its ``k`` best of each group. ``prepare`` makes of a group of rows, in the order of their keys, a function that finds in it the best of a block
    of queries: places of queries, places of rows, scores.
    """
    known = F.col(key).isNotNull()
    files = block_files(queries.where(known), key, block)
    fields = pa.schema([("query", pa.int64()), (key, pa.int64()), (name, pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            rows = group.sort_by(key).combine_chunks()
            keys, find = rows.column(key).to_numpy(), prepare(rows, key, k)
            for f in files:
                q = read_block(f).combine_chunks()
                of, at, scores = find(q)
                yield pa.RecordBatch.from_arrays([pa.array(q.column(key).to_numpy()[of]), pa.array(keys[at]), pa.array(scores)], schema=fields)

    rows = spread(vectors.where(known).withColumn(key, F.col(key).cast("bigint")), key)
    return _best(rows.mapInArrow(run, f"query bigint, `{key}` bigint, `{name}` double"), k, "query", name, key, descending)


def _scored(score: Callable, descending: bool) -> Callable:
    """For ``_blocks``: all scores of a block and some rows at a time; ``score`` makes of queries and rows a function from a range of rows to scores, nan for none."""

    def prepare(rows: pa.Table, key: str, k: int) -> Callable:
        keys = rows.column(key).to_numpy()

        def find(q: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            ids = q.column(key).to_numpy()
            top, at = np.empty((len(ids), 0)), np.empty((len(ids), 0), dtype=np.int64)
            scores = score(q, rows)
            for start in range(0, len(keys), SCORE_ROWS):
                part = keys[start : start + SCORE_ROWS]
                s = scores(start, start + len(part))
                s[ids[:, None] == part[None, :]] = np.nan
                # Rows are in the order of their keys, so a stable sort of the rounded scores puts ties in it, too.
                both = np.concatenate([top, s], axis=1)
                where = np.concatenate([at, np.broadcast_to(np.arange(start, start + len(part)), s.shape)], axis=1)
                order = np.argsort(np.round(-both if descending else both, 9), axis=1, kind="stable")[:, :k]
                top, at = np.take_along_axis(both, order, 1), np.take_along_axis(where, order, 1)
            good = ~np.isnan(top)
            return np.repeat(np.arange(len(ids)), good.sum(axis=1)), at[good], top[good]

        return find

    return prepare


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of lists one after another, and where each list begins and the last ends; null lists are empty."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], column.type)
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


@dataclass(frozen=True)
class Sketch:
    """Short vectors whose products are never below those of the sparse ones.

    ``axes`` are orthonormal directions of the frequent ``terms``: the product of two vectors is that along the axes, at most the product of the lengths that are left of their
    frequent terms, and at most, for each of SKETCH_GROUPS groups of other terms, the product of the lengths within it. Which axes there are decides how near that is, not whether it holds.
    """

    terms: np.ndarray
    axes: np.ndarray

    def of(self, terms: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        n, width = len(starts) - 1, self.axes.shape[1]
        out = np.empty((n, width + 1 + SKETCH_GROUPS), np.float32)
        for a in range(0, n, SCORE_ROWS):
            b = min(a + SCORE_ROWS, n)
            t, w = terms[starts[a] : starts[b]], weights[starts[a] : starts[b]]
            i = np.repeat(np.arange(b - a), np.diff(starts[a : b + 1]))
            at = np.minimum(np.searchsorted(self.terms, t), max(len(self.terms) - 1, 0))
            hit = self.terms[at] == t if len(self.terms) else np.zeros(len(t), bool)
            frequent = np.bincount(i[hit] * len(self.terms) + at[hit], w[hit], (b - a) * len(self.terms)).reshape(b - a, -1)
            along = frequent @ self.axes
            rest = frequent - along @ self.axes.T
            out[a:b, :width], out[a:b, width] = along, np.sqrt((rest * rest).sum(axis=1))
            group = i[~hit] * SKETCH_GROUPS + (t[~hit] % SKETCH_GROUPS)
            out[a:b, width + 1 :] = np.sqrt(np.bincount(group, w[~hit] ** 2, (b - a) * SKETCH_GROUPS)).reshape(b - a, -1)
        return out


#: Frequent terms, axes and groups of a sketch, and the vectors, chosen by a hash of their keys and not too long for the driver, that its axes are fitted to.
SKETCH_TERMS, SKETCH_AXES, SKETCH_GROUPS, SKETCH_FIT, SKETCH_LENGTH = 512, 256, 128, 4000, 2000
#: What a product of two sketches, added up in single precision, may lack for vectors of length 1; candidates of a query that are scored before the others.
SLACK, FIRST = 1e-4, 48


def sketch(vectors: DataFrame, key: str) -> Sketch:
    """The axes along which some vectors extend most; no result depends on them, only how many pairs are scored."""
    some = vectors.where(F.size("terms") <= SKETCH_LENGTH).orderBy(F.xxhash64(key), key).limit(SKETCH_FIT).select("terms", "weights").toArrow()
    (t, starts), (w, _) = _flat(some.column("terms")), _flat(some.column("weights"))
    terms, counts = np.unique(t, return_counts=True)
    terms = np.sort(terms[np.argsort(-counts, kind="stable")[:SKETCH_TERMS]])
    if not len(terms):
        return Sketch(terms, np.empty((0, 0)))
    at = np.minimum(np.searchsorted(terms, t), len(terms) - 1)
    hit = terms[at] == t
    i = np.repeat(np.arange(len(some)), np.diff(starts))[hit]
    m = np.bincount(i * len(terms) + at[hit], w[hit], len(some) * len(terms)).reshape(len(some), -1)
    return Sketch(terms, np.ascontiguousarray(np.linalg.eigh(m.T @ m)[1][:, ::-1][:, :SKETCH_AXES]))


def _sparse(short: Sketch) -> Callable:
    """For ``_blocks``: the products of sparse vectors of positive weights.

    Sketches say how much a pair can have at most. For each query the rows that may have most are scored first, then those that may still be among the best; only these are scored.
    """

    def prepare(rows: pa.Table, key: str, k: int) -> Callable:
        keys = rows.column(key).to_numpy()
        (ft, fs), (fw, _) = _flat(rows.column("terms")), _flat(rows.column("weights"))
        terms, ft = np.unique(ft, return_inverse=True)
        bounds, lengths, ft = short.of(terms[ft], fw, fs), np.diff(fs), ft.astype(np.int32)
        longest = max(1.0, float(np.sqrt(np.bincount(np.repeat(np.arange(len(keys)), lengths), fw * fw, len(keys)).max(initial=0))))

        def find(q: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            ids = q.column(key).to_numpy()
            least = q.column("least").to_numpy() if "least" in q.column_names else np.zeros(len(ids))
            (qt, qs), (qw, _) = _flat(q.column("terms")), _flat(q.column("weights"))
            asked = short.of(qt, qw, qs)
            place = np.minimum(np.searchsorted(terms, qt), max(len(terms) - 1, 0))
            here = terms[place] == qt if len(terms) else np.zeros(len(qt), bool)
            slacks = SLACK * longest * np.maximum(np.sqrt(np.bincount(np.repeat(np.arange(len(ids)), np.diff(qs)), qw * qw, len(ids))), 1)
            weights = np.zeros(len(terms))
            found = []

            def scores(at: np.ndarray) -> np.ndarray:
                n = lengths[at]
                begin = np.cumsum(n) - n
                post = np.arange(n.sum()) + np.repeat(fs[at] - begin, n)
                products = weights[ft[post]] * fw[post]
                if n.min(initial=1):
                    return np.add.reduceat(products, begin) if len(n) else products
                return np.bincount(np.repeat(np.arange(len(at)), n), products, len(at))

            for start in range(0, len(ids), SKETCH_QUERIES):
                most = asked[start : start + SKETCH_QUERIES] @ bounds.T
                for j, row in enumerate(most, start):
                    own, slack = slice(qs[j], qs[j + 1]), slacks[j]
                    at = np.flatnonzero(row >= np.float32(least[j] - slack))
                    if not len(at):
                        continue
                    mine, known = place[own][here[own]], qw[own][here[own]]
                    weights[mine] = known
                    bar = least[j]
                    if len(at) > FIRST:
                        split = np.argpartition(-row[at], FIRST)
                        first, rest = at[split[:FIRST]], at[split[FIRST:]]
                        s = scores(first)
                        ranked = np.sort(np.round(s[(keys[first] != ids[j]) & (s > 0)], 9))
                        bar = max(bar, ranked[-k] if len(ranked) >= k else 0.0)
                        rest = rest[row[rest] >= np.float32(bar - slack)]
                        at, s = np.concatenate([first, rest]), np.concatenate([s, scores(rest)])
                    else:
                        s = scores(at)
                    weights[mine] = 0
                    good = (s > 0) & (np.round(s, 9) >= bar) & (keys[at] != ids[j])
                    at, s = at[good], s[good]
                    order = np.lexsort((at, -np.round(s, 9)))[:k]
                    found.append((np.full(len(order), j), at[order], s[order]))
            none = np.empty(0, np.int64)
            return tuple(np.concatenate(x) for x in zip(*found)) if found else (none, none, np.empty(0))

        return find

    return prepare


def _stacked(q: pa.Table, rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Queries and rows as matrices of the queries' width; vectors of another width are rows of nan."""

    def matrix(t: pa.Table, width: int | None) -> np.ndarray:
        values, at = _flat(t.column("weights"))
        n = np.diff(at)
        width = int(n.max(initial=0)) if width is None else width
        out = np.full((len(t), width), np.nan)
        if width:
            fit = n == width
            out[fit] = values[(at[:-1][fit][:, None] + np.arange(width)).ravel()].reshape(-1, width)
        return out

    a = matrix(q, None)
    return a, matrix(rows, a.shape[1])


def _dense_l2(q: pa.Table, rows: pa.Table) -> Callable[[int, int], np.ndarray]:
    a, b = _stacked(q, rows)

    def scores(i: int, j: int) -> np.ndarray:
        part = b[i:j]
        out = np.full((len(a), len(part)), np.nan)
        for n in range(len(a) if a.shape[1] else 0):
            out[n] = np.sqrt(((part - a[n]) ** 2).sum(axis=1))
        return out

    return scores


def _dense_cosine(q: pa.Table, rows: pa.Table) -> Callable[[int, int], np.ndarray]:
    a, b = _stacked(q, rows)
    with np.errstate(invalid="ignore", divide="ignore"):
        a, b = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (a, b))
    return lambda i, j: a @ b[i:j].T if a.shape[1] else np.full((len(a), j - i), np.nan)


def chunks(docs: DataFrame, size: int = 500, overlap: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, start_index (from 0) and content of windows of ``size`` characters that share ``overlap`` with the one before."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - F.lit(overlap + 1), F.lit(0)), F.lit(step))
    c = docs.where(F.length(text) > 0).select(key, text, F.explode(starts).alias("start_index"))
    return c.select(key, "start_index", F.substring(F.col(text), F.col("start_index") + 1, F.lit(size)).alias("content"))


def word_vector(text: Column | str, dims: int = 64) -> Column:
    """A text as counts of its words in ``dims`` buckets of their digests: an embedding that needs no model and that other engines can repeat."""
    bucket = lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % dims
    # The buckets go through a lambda, so that they are made once and not for every place of the vector.
    counted = F.transform(F.array(F.transform(terms(text), bucket)), lambda b: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.size(F.filter(b, lambda x: x == d)).cast("double")))
    return F.flatten(counted)


def add_chunks(docs: DataFrame, path: str, embed: Callable[[Column], Column] = word_vector, size: int = 500, overlap: int = 50, key: str = "doc_id", text: str = "text") -> None:
    """Adds the chunks of documents with their embeddings to a store, a folder of parquet files; ``embed`` makes a vector of a text column."""
    c = chunks(docs, size, overlap, key, text)
    c.select((F.col(key) * 1_000_000 + F.col("start_index")).cast("bigint").alias("vec_id"), key, "start_index", "content", embed(F.col("content")).alias("embedding")).write.mode("append").parquet(path)


def search_chunks(store: DataFrame, queries: DataFrame, k: int = 10, embed: Callable[[Column], Column] = word_vector) -> DataFrame:
    """query, vec_id, similarity, rank: the chunks of a store nearest to each query text (query, text) by cosine; exact. ``query`` is a whole number."""
    asked = queries.select((-F.col("query") - 1).cast("bigint").alias("vec_id"), embed(F.col("text")).alias("embedding"))
    return nearest_of(store, asked, k, metric="cosine").withColumn("query", -F.col("query") - 1)


def lsh_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", column: str = "embedding", planes: int = 6, tables: int = 48, seed: int = 5) -> DataFrame:
    """Approximate cosine neighbours: vectors meet in buckets of random half-spaces, then the exact similarity ranks them.

    Every row is indexed in ``tables`` hash tables of ``planes`` bits. The defaults find nine in ten of the nearest even among
    vectors without structure, where half of all rows are candidates; clustered vectors need fewer tables and more planes. Buckets are joined with the queries alone, so no pairs
    of rows arise within a bucket.
    """
    width = int(vectors.select(F.max(F.size(column))).first()[0] or 0)
    rng = np.random.default_rng(seed)
    normals = rng.standard_normal((tables * planes, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(planes)
        for b in batches:
            rows = [(i, np.asarray(v, dtype=float)) for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if v is not None and len(v) == width]
            if rows:
                x = np.vstack([v for _, v in rows])
                bits = (x @ normals.T > 0).reshape(len(rows), tables, planes) @ weights
                ids = np.repeat([i for i, _ in rows], tables)
                bucket = (np.arange(tables)[None, :] << planes) + bits
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bucket.ravel(), pa.int64())], ["id", "bucket"])

    hashed = lambda t: t.select(F.col(key).cast("long").alias("id"), column).mapInArrow(run, "id bigint, bucket bigint")
    pairs = hashed(queries).withColumnRenamed("id", "query").join(hashed(vectors), "bucket").where("query <> id").select("query", "id").distinct()
    a = queries.select(F.col(key).alias("query"), F.col(column).alias("a"))
    b = vectors.select(F.col(key).alias("id"), F.col(column).alias("b"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    scored = pairs.join(a, "query").join(b, "id").select("query", F.col("id").alias(key), (dot("a", "b") / F.sqrt(dot("a", "a") * dot("b", "b"))).alias("similarity"))
    return _best(scored, k, "query", "similarity", key, True)
