"""Exact top-k lexical search of a set of queries over all documents, by inner products of impact vectors in buckets of like length.

A document's vector has an integer impact for each of its terms that any query has; a query's has its terms' weights. Vectors are
ordered by length and read in buckets. A query skips a bucket if its length times the bucket's greatest can't reach its k-th best
score so far; else the fewest heavy terms are taken as its focus such that a document with none of them can't reach it, and of
the documents with any the products over the focus, and lengths of what is left, bound the score. Those that may reach it get
exact integer scores.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segloom.llm.common import as_text, stored
from segloom.llm.words import Lexer, segments

#: Results of a query; vectors of a bucket; longest vectors that are searched first; bytes of query text for one pass over the documents.
TOP, BUCKET, SEEDS, QUERY_BYTES = 20, 4096, 1 << 16, 8 << 20
#: Bytes of text that are read together.
BLOCK_BYTES = 1 << 20
#: ASCII that is in no term.
NOT_TERMS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
#: Bounds are in doubles: so much is allowed for their rounding.
SLACK = 1 + 1e-9


class Queries:
    """Terms of queries: ``codes`` of all in order; of query q the places in it and how often it has each."""

    def __init__(self, texts: list[str]):
        parts = [(block.row_of(), block.code) for block in _lexed(pa.array(texts, pa.large_string()))]
        row, code = (np.concatenate([p[j] for p in parts]) if parts else np.zeros(0, t) for j, t in ((0, np.int64), (1, np.uint64)))
        self.codes, place = np.unique(code, return_inverse=True)
        key, times = np.unique(row * max(1, len(self.codes)) + place.reshape(-1), return_counts=True)
        owner = key // max(1, len(self.codes))
        ends = np.searchsorted(owner, np.arange(len(texts) + 1))
        self.terms = [(key[a:b] % len(self.codes)) for a, b in zip(ends[:-1], ends[1:], strict=True)] if len(key) else [np.zeros(0, np.int64)] * len(texts)
        self.times = [times[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


class _Lexed:
    def __init__(self, row: int, text: np.ndarray, code: np.ndarray, count: np.ndarray, begins: bool, ends: bool):
        self.row, self.text, self.code, self.count, self.begins, self.ends = row, text, code, count, begins, ends

    def row_of(self) -> np.ndarray:
        return self.row + self.text


def _lexed(column: pa.Array) -> Iterator[_Lexed]:
    """The terms of a column's texts, block by block."""
    lexer = Lexer(NOT_TERMS)
    for block in segments(column, BLOCK_BYTES):
        found = lexer.scan(block.data, block.bounds)
        yield _Lexed(block.row, found.text_of(), found.code, np.diff(found.first), block.begins, block.ends)


def _vectorizer(codes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Document, number of terms, and the query terms that it has, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = codes.value
        for batch in batches:
            at, carried = 0, []
            for block in _lexed(batch.column(1)):
                place = np.minimum(np.searchsorted(terms, block.code), max(0, len(terms) - 1))
                real = terms[place] == block.code if len(terms) else np.zeros(len(block.code), bool)
                key, times = np.unique(block.text[real] << 32 | place[real], return_counts=True)
                count = block.count
                if not (block.begins and block.ends):
                    carried = [] if block.begins else carried
                    carried.append((key, times, count))
                    if not block.ends:
                        continue
                    key, of = np.unique(np.concatenate([c[0] for c in carried]), return_inverse=True)
                    times = np.bincount(of, np.concatenate([c[1] for c in carried])).astype(np.int64)
                    count = np.sum([c[2] for c in carried], 0)
                ends = np.searchsorted(key >> 32, np.arange(len(count) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in ((key & 0xFFFFFFFF).astype(np.int32), times.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(count)), pa.array(count.astype(np.int64)), *lists], names=["id", "n", "terms", "times"])
                at += len(count)

    return run


class _Bucket:
    """Vectors, by document and by term."""

    def __init__(self, batches: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        self.id = rows.column("id").to_numpy(zero_copy_only=False)
        self.length = rows.column("length").to_numpy(zero_copy_only=False)
        term, impact = rows.column("terms"), rows.column("impacts")
        size = term.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        term, impact = term.flatten().to_numpy(zero_copy_only=False), impact.flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(term, kind="stable")
        self.doc, self.impact = np.repeat(np.arange(len(size)), size)[order], impact[order].astype(np.int64)
        self.term, first = np.unique(term[order], return_index=True)
        self.first = np.append(first, len(order))
        self.longest = float(self.length.max())

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        at = int(np.searchsorted(self.term, term))
        if at == len(self.term) or self.term[at] != term:
            return self.doc[:0], self.impact[:0]
        part = slice(self.first[at], self.first[at + 1])
        return self.doc[part], self.impact[part]


class Search:
    """One task's search: each query's best so far, and the score that a document must reach."""

    def __init__(self, terms: list[np.ndarray], weights: list[np.ndarray], least: np.ndarray, k: int):
        self.terms, self.weights, self.focus = [], [], []
        for t, w in zip(terms, weights, strict=True):
            order = np.argsort(-w, kind="stable")
            self.terms.append(t[order])
            self.weights.append(w[order])
            self.focus.append(np.sqrt(np.cumsum((w[order].astype(float) ** 2)[::-1]))[::-1])  # length of the terms from each on
        self.length = np.array([f[0] if len(f) else 0.0 for f in self.focus])
        self.least, self.k = np.maximum(least.astype(np.int64), 1), k
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(terms)
        self.pruned = self.candidates = self.scored = 0

    def bucket(self, b: _Bucket) -> None:
        n = len(b.id)
        alive = np.flatnonzero(self.length * b.longest * SLACK >= self.least)  # Cauchy-Schwarz
        self.pruned += n * (len(self.terms) - len(alive))
        for q in alive.tolist():
            terms, weights, left, least = self.terms[q], self.weights[q], self.focus[q], int(self.least[q])
            focus = int(np.searchsorted(-left * b.longest * SLACK, -least, "right"))  # the terms from here on can't reach it alone
            score, square = np.zeros(n, np.int64), np.zeros(n)
            met = np.zeros(n, bool)
            for t, w in zip(terms[:focus].tolist(), weights[:focus].tolist(), strict=True):
                doc, impact = b.postings(t)
                score[doc] += w * impact
                square[doc] += impact.astype(float) ** 2
                met[doc] = True
            self.candidates += int(met.sum())
            if focus < len(terms):
                rest = np.sqrt(np.maximum(b.length**2 * SLACK - square, 0))
                met &= (score + left[focus] * rest) * SLACK >= least
                self.scored += int(met.sum())
                for t, w in zip(terms[focus:].tolist(), weights[focus:].tolist(), strict=True):
                    doc, impact = b.postings(t)
                    real = met[doc]
                    score[doc[real]] += w * impact[real]
            found = np.flatnonzero(met & (score >= least))
            if len(found):
                self.take(q, score[found], b.id[found])

    def take(self, q: int, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.concatenate([self.best[q][0], score]), np.concatenate([self.best[q][1], doc])
        order = np.lexsort((doc, -score))[: self.k]
        self.best[q] = score[order], doc[order]
        if len(order) == self.k:
            self.least[q] = max(self.least[q], score[order[-1]])


def _searcher(queries, k: int, bucket: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(*queries.value, k)
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, bucket):
                held.append(batch.slice(at, bucket))
                if sum(h.num_rows for h in held) >= bucket:
                    search.bucket(_Bucket(held))
                    held = []
        if held:
            search.bucket(_Bucket(held))
        for q, (score, doc) in enumerate(search.best):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), q, np.int64)), pa.array(doc), pa.array(score)], names=["query", "doc", "score"])

    return run


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", query_col: str = "item_id", query_text_col: str = "text", bucket: int = BUCKET, seeds: int = SEEDS, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """Of each row of ``queries`` the k documents with the highest score above 0: query id, rank from 1, document id (a long) and
    score; equal scores by ascending id, a document without an id last.

    With N documents that have a term, L terms in all, n of a document's, df documents with a term and tf its times in one: a
    term weighs floor(1000 ln((2 N + 2) / (2 df + 1))), a document has m = 75 + 25 n N div L, and the score is the sum of weight
    times (10^9 tf) div (1000 tf + 12 m) over the query's terms, repeats included, in 64-bit integers.

    All texts are read whole, once for each block of ``query_bytes`` of query text, which goes to the tasks with its terms'
    weights; vectors hold query terms only and are stored by length. The ``seeds`` longest are searched first, so that all
    tasks begin with a score to reach; a task returns k rows a query at most. Null and empty texts, of documents and queries,
    have no terms and no results; repeated documents and queries count as often as they occur. Other columns are not read.
    """
    spark = docs.sparkSession
    asked = queries.select(F.col(query_col).alias("query_id"), as_text(query_text_col).alias("t"))
    total = asked.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    passes = 1 + total // query_bytes
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = []
    for p in range(passes):
        block = (asked.where(F.pmod(F.xxhash64("query_id", "t"), F.lit(passes)) == p) if passes > 1 else asked).collect()
        found.append(_one_pass(rows, Queries([r.t for r in block]), k, bucket, seeds).join(F.broadcast(spark.createDataFrame([(i, r.query_id) for i, r in enumerate(block)], f"query long, query_id {dict(asked.dtypes)['query_id']}")), "query"))
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out.select(F.col("query_id").alias(query_col), "rank", F.when(F.col("doc") < (1 << 63) - 1, F.col("doc")).alias(id_col), "score")


def _one_pass(rows: DataFrame, queries: Queries, k: int, bucket: int, seeds: int) -> DataFrame:
    spark = rows.sparkSession
    made = stored(rows.mapInArrow(_vectorizer(spark.sparkContext.broadcast(queries.codes)), "id long, n long, terms array<int>, times array<long>").where("n > 0"), "query_terms")
    some, every = made.agg(F.count("*"), F.sum("n")).first()
    every = every or 1
    df = np.zeros(len(queries.codes), np.int64)
    counted = made.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()
    df[counted.column("term").to_numpy()] = counted.column("df").to_numpy()
    weight = np.array([math.floor(1000 * math.log((2 * some + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    own = [weight[t] * c for t, c in zip(queries.terms, queries.times, strict=True)]
    m = f"(100 - 25 + ((25 * n * {some}L) div {every}L))"
    vectors = made.where("size(terms) > 0").select("id", "terms", F.expr(f"transform(times, x -> CAST((1000000000L * x) div (1000L * x + 12L * {m}) AS INT))").alias("impacts"))
    vectors = vectors.withColumn("length", F.sqrt(F.aggregate("impacts", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))
    vectors = stored(vectors.repartitionByRange(F.desc("length"), "id").sortWithinPartitions(F.desc("length"), "id"), "impact_vectors")

    def search(part: DataFrame, least: np.ndarray) -> DataFrame:
        given = spark.sparkContext.broadcast((queries.terms, own, least))
        each = part.mapInArrow(_searcher(given, k, bucket), "query long, doc long, score long")
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc"))
        return each.withColumn("rank", rank).where(F.col("rank") <= k)

    least = np.zeros(len(queries.terms), np.int64)
    size = vectors.count()
    if size > 4 * seeds:
        bar = vectors.agg(F.percentile_approx("length", F.lit(1 - seeds / size), F.lit(10_000))).first()[0]
        for r in search(vectors.where(F.col("length") >= bar), least).where(F.col("rank") == k).select("query", "score").collect():
            least[r.query] = r.score
    return search(vectors, least)
