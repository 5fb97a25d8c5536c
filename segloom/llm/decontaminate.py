"""Benchmark decontamination: suffix arrays over shards of the training texts, searched for every benchmark suffix."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.llm.common import as_text, stored
from segloom.llm.words import NOT_ALNUM, Lexer, Words, runs

#: Words of a window; bytes of text under one suffix array; bytes of benchmark text searched for in one pass over the documents.
WINDOW, SHARD_BYTES, BENCH_BYTES = 10, 2 << 20, 64 << 20
#: Pairs of a hit and a benchmark position that are followed at a time.
PAIRS = 1 << 20


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes, compared over ``depth`` words at least. Prefix doubling: each round sorts
    what is still tied by the rank of the suffix that begins where the compared prefix ends."""
    n = len(codes)
    order = np.argsort(codes)
    new = np.ones(n, bool)
    new[1:] = codes[order[1:]] != codes[order[:-1]]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    done = 1
    while done < depth and n:
        tied = ~new | ~np.append(new[1:], True)
        at = np.flatnonzero(tied)
        if not len(at):
            break
        these = order[at]
        key = rank[these] * (n + 1) + rank[np.minimum(these + done, n)] + 1
        turn = np.argsort(key)
        these, key = these[turn], key[turn]
        order[at] = these
        new[at[1:]] = key[1:] != key[:-1]
        new[at[0]] = True
        rank[these] = np.maximum.accumulate(np.where(new[at], at, 0))
        done *= 2
    return order


def _compare(words: np.ndarray, at: np.ndarray, test: np.ndarray, queries: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 as the words at ``at`` sort before, with or after the test windows."""
    out = np.zeros(len(at), np.int8)
    for d in range(int(lengths.max(initial=0))):
        open_ = np.flatnonzero((out == 0) & (lengths > d))
        if not len(open_):
            break
        a, b = words[at[open_] + d], test[queries[open_] + d]
        out[open_] = (a > b).astype(np.int8) - (a < b)
    return out


def search(words: np.ndarray, order: np.ndarray, test: np.ndarray, queries: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of ``order`` whose suffixes begin with the test windows, by binary search. ``words`` is padded at its end."""
    sides = []
    keep = np.arange(len(queries))
    first = np.zeros(len(queries), np.int64)
    for last in (False, True):
        lo, hi = first[keep].copy(), np.full(len(keep), len(order))
        while len(busy := np.flatnonzero(lo < hi)):
            mid = (lo[busy] + hi[busy]) // 2
            c = _compare(words, order[mid], test, queries[keep[busy]], lengths[keep[busy]])
            right = c <= 0 if last else c < 0
            lo[busy[right]] = mid[right] + 1
            hi[busy[~right]] = mid[~right]
        if not last:
            first = lo
            there = np.flatnonzero(lo < len(order))
            keep = there[_compare(words, order[lo[there]], test, queries[there], lengths[there]) == 0]
            sides.append(lo)
        else:
            end = sides[0].copy()
            end[keep] = lo
            sides.append(end)
    return sides[0], sides[1]


class Tests:
    """The windows of a block of benchmark items: each different window once, with the items and the positions that have it.
    A 0 is before the first item and after each, so that no match crosses items."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.names = sorted({i for i, _ in items})
        name_at = {x: k for k, x in enumerate(self.names)}
        parts, pairs, at = [np.zeros(1, np.uint64)], [], 1
        lexer = Lexer(NOT_ALNUM)
        starts, lengths = [], []
        for block in lexer.blocks(pa.array([t for _, t in items], pa.large_string())):
            hashes, offsets = runs(block.code, block.first, window)
            count = np.diff(block.first)
            made = np.diff(offsets)
            text = np.repeat(np.arange(len(made)), made)
            starts.append(at + block.first[text] + text + np.arange(len(text)) - offsets[text])
            lengths.append(np.minimum(count, window)[text])
            pairs.append((hashes, np.array([name_at[items[block.rows.start + k][0]] for k in range(len(made))], np.int64)[text]))
            parts.append(np.zeros(len(block.code) + len(count), np.uint64))
            parts[-1][np.arange(len(block.code)) + block.text_of()] = np.maximum(block.code, np.uint64(1))
            at += len(parts[-1])
        joined = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        self.code = np.concatenate([joined(parts, np.uint64), np.zeros(window, np.uint64)])
        starts, lengths = joined(starts, np.int64), joined(lengths, np.int64)
        _, one, of = np.unique(joined([h for h, _ in pairs], np.uint64), return_index=True, return_inverse=True)
        self.query, self.length = starts[one], lengths[one]
        of, items_of = of.reshape(-1), joined([i for _, i in pairs], np.int64)
        order = np.argsort(of, kind="stable")
        self.place, self.place_item = starts[order], items_of[order]
        self.place_from = np.searchsorted(of[order], np.arange(len(one) + 1))
        both = np.unique(np.stack([of, items_of], 1), axis=0) if len(of) else np.zeros((0, 2), np.int64)
        self.item = both[:, 1]
        self.item_from = np.searchsorted(both[:, 0], np.arange(len(one) + 1))


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges, and which range each is of."""
    count = hi - lo
    of = np.repeat(np.arange(len(lo)), count)
    return np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + lo[of], of


def _longest(words: np.ndarray, at: np.ndarray, of: np.ndarray, text: np.ndarray, base: np.ndarray, tests: Tests) -> np.ndarray:
    """The longest match of each text: words, item, word offset. Every position of a window in the benchmark is followed, from
    where the word before differs on to the first that differs. Of equal lengths the earliest in the text counts, then the
    first item."""
    best = np.zeros((0, 4), np.int64)  # text, -words, place in the text, item
    total = np.cumsum(tests.place_from[of + 1] - tests.place_from[of])
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS, "right")))
        k, hit = _spread(tests.place_from[of[lo:hi]], tests.place_from[of[lo:hi] + 1])
        hit += lo
        q, here = tests.place[k], at[hit]
        left = np.flatnonzero((here == base[text[hit]]) | (tests.code[q - 1] == 0) | (words[np.maximum(here - 1, 0)] != tests.code[q - 1]))
        q, here, hit, item = q[left], here[left], hit[left], tests.place_item[k[left]]
        length = tests.length[of[hit]].copy()
        going = np.arange(len(left))
        while len(going):
            a, b = words[here[going] + length[going]], tests.code[q[going] + length[going]]
            going = going[(a == b) & (a != 0)]
            length[going] += 1
        best = np.concatenate([best, np.stack([text[hit], -length, here, item], 1)])
        best = best[np.lexsort(best.T[::-1])]
        best = best[np.unique(best[:, 0], return_index=True)[1]]
        lo = hi
    out = np.zeros((len(base), 3), np.int64)
    out[best[:, 0]] = np.stack([-best[:, 1], best[:, 3], best[:, 2] - base[best[:, 0]]], 1)
    return out


def _find(block: Words, tests: Tests, window: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Of one shard: hit words, (text, item) pairs, the longest match of each text (words, item, word offset)."""
    texts = len(block.first) - 1
    text_of = block.text_of()
    # a 0 after each text: no window has it, so no match crosses texts
    place = np.arange(len(block.code)) + text_of
    n = len(block.code) + texts
    words = np.zeros(n + window + 1, np.uint64)
    words[place] = np.maximum(block.code, np.uint64(1))
    order = suffix_array(words[:n], window)
    lo, hi = search(words, order, tests.code, tests.query, tests.length)
    at, of = _spread(lo, hi)
    at = order[at]
    ends = at + tests.length[of]
    hit = (np.cumsum(np.bincount(at, minlength=n + 1)[:n] - np.bincount(ends, minlength=n + 1)[:n]) > 0)[place]
    base = block.first[:-1] + np.arange(texts)  # where each text begins in words
    text = np.searchsorted(base, at, "right") - 1
    longest = _longest(words, at, of, text, base, tests)
    seen = np.unique(text * (len(tests.query) + 1) + of)
    seen_text, seen_of = seen // (len(tests.query) + 1), seen % (len(tests.query) + 1)
    item, k = _spread(tests.item_from[seen_of], tests.item_from[seen_of + 1])
    pairs = np.unique(np.stack([seen_text[k], tests.item[item]], 1), axis=0) if len(k) else np.zeros((0, 2), np.int64)
    return hit, pairs[:, 0], [pairs[:, 1]], longest


def _mapper(tests, window: int, shard_bytes: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexer = Lexer(NOT_ALNUM)
        known: Tests = tests.value
        for batch in batches:
            for block in lexer.blocks(batch.column(1), shard_bytes):
                rows = batch.slice(block.rows.start, block.rows.stop - block.rows.start)
                texts = rows.num_rows
                hit, pair_text, (pair_item,), longest = _find(block, known, window)
                text_of = block.text_of()
                inner = np.zeros(len(hit), bool)
                inner[1:] = hit[:-1] & (text_of[1:] == text_of[:-1])
                after = np.zeros(len(hit), bool)
                after[:-1] = hit[1:] & (text_of[1:] == text_of[:-1])
                begin, end = np.flatnonzero(hit & ~inner), np.flatnonzero(hit & ~after) + 1
                of = text_of[begin]
                spans = (np.stack([begin, end], 1) - block.first[of][:, None]).astype(np.int32).reshape(-1)
                cuts = lambda x: np.searchsorted(x, np.arange(texts + 1)).astype(np.int32)
                names = pa.array(np.array(known.names, object)[pair_item], pa.string())
                items = pa.ListArray.from_arrays(pa.array(cuts(pair_text)), names)
                best = pa.array([known.names[k] if n else None for n, k, _ in longest.tolist()], pa.string())
                columns = [rows.column(0), pa.array(np.diff(block.first)), pa.ListArray.from_arrays(pa.array(2 * cuts(of)), pa.array(spans)), items, pa.array(longest[:, 0]), best, pa.array(longest[:, 2])]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES, bench_bytes: int = BENCH_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, n_words, hit_spans (flat [from, to) word offsets), item_ids (sorted), and the longest
    verbatim match that holds a window: longest_words, longest_item, longest_at (of equal ones the earliest, then the first item).

    Each task cuts its texts into shards of about ``shard_bytes`` (a longer text is a shard of its own), sorts the shard's
    word suffixes and searches them for every suffix of the benchmark, as far as the window: ``window`` words, or the whole
    item if it has fewer. Every occurrence of a window is marked, and each match is followed to its end for the longest one.
    The benchmark is the query set: it goes to the tasks in blocks of at most ``bench_bytes`` of text (and one item), one pass
    over the documents for each block. With one block nothing is shuffled; with several the texts are stored once, a pass keeps
    the rows with hits, and those of all passes are brought together by row.

    Words are compared after lower-casing A-Z, by 64-bit hashes. Null and empty texts have no words and no hits; items
    without words match nothing; an item without an id is named 'null', repeated item ids count once. Without documents
    there are no rows; without items none is hit. Other columns are not read.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("i"), as_text(item_text_col).alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    passes = 1 + total // bench_bytes
    kind = dict(docs.dtypes)[id_col]
    schema = "n_words long, hit_spans array<int>, item_ids array<string>, longest_words long, longest_item string, longest_at long"
    fields = [("n_words", pa.int64()), ("hit_spans", pa.list_(pa.int32())), ("item_ids", pa.list_(pa.string())), ("longest_words", pa.int64()), ("longest_item", pa.string()), ("longest_at", pa.int64())]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def search(texts: DataFrame, block: DataFrame, kind: str, arrow: pa.DataType) -> DataFrame:
        tests = spark.sparkContext.broadcast(Tests([(r.i, r.t) for r in block.collect()], window))
        return texts.mapInArrow(_mapper(tests, window, shard_bytes, pa.schema([("id", arrow), *fields])), f"id {kind}, {schema}")

    if passes == 1:
        out = search(rows, items, kind, _arrow_type(docs, id_col))
    else:
        texts = stored(rows.withColumn("row", F.monotonically_increasing_id()), "searched_texts")
        found = []
        for k in range(passes):
            block = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == k)
            hits = search(texts.select(F.col("row").alias("id"), "text"), block, "long", pa.int64())
            found.append(stored(hits if k == 0 else hits.where("size(hit_spans) > 0"), "searched"))
        best = F.min(F.struct((-F.col("longest_words")).alias("n"), "longest_at", F.coalesce("longest_item", F.lit("")).alias("i"), "longest_item"))
        each = reduce(DataFrame.unionByName, found).groupBy("id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hit_spans")).alias("hit_spans"), F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids"), best.alias("b"))
        each = each.select("id", "n_words", "hit_spans", "item_ids", (-F.col("b.n")).alias("longest_words"), "b.longest_item", "b.longest_at").mapInArrow(_merge_spans, f"id long, {schema}")
        ids = texts.select("row", F.col("id").alias("own"))
        out = each.join(ids, each["id"] == ids["row"]).drop("id", "row").withColumnRenamed("own", "id")
        out = out.select("id", *[f[0] for f in fields])
    return out.withColumnRenamed("id", id_col).withColumn("item_ids", F.array_sort("item_ids"))


def _merge_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``hit_spans``, which may overlap and come in any order, as the spans that they cover."""
    for batch in batches:
        lists = []
        for spans in batch.column("hit_spans"):
            pairs = spans.values.to_numpy(zero_copy_only=False).reshape(-1, 2)
            pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
            reach = np.maximum.accumulate(pairs[:, 1]) if len(pairs) else pairs[:, 1]
            new = np.append(True, pairs[1:, 0] > reach[:-1]) if len(pairs) else np.zeros(0, bool)
            lists.append(np.stack([pairs[new, 0], reach[np.append(new[1:], True)] if len(pairs) else reach], 1).reshape(-1).astype(np.int32))
        at = batch.schema.get_field_index("hit_spans")
        yield batch.set_column(at, "hit_spans", pa.array(lists, pa.list_(pa.int32())))


def _arrow_type(df: DataFrame, col: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[col].dataType)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window, with all their columns."""
    hit = benchmark_hits(docs, benchmark, id_col, text_col, **options).where(F.size("hit_spans") > 0).select(id_col).distinct()
    hit = stored(hit, "contaminated")
    return docs.join(F.broadcast(hit) if hit.count() <= 500_000 else hit, id_col, "left_anti")
