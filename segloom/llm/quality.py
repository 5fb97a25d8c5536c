"""Quality by importance resampling: hashed n-gram models of target and raw text, and a Gumbel top-k sample of their ratio."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.llm.common import only_ids, stored
from segloom.llm.words import PUNCTUATION, SPACES, Lexer, Words, runs

#: Hash buckets of n-grams; at most so many labelled documents fit the target model and calibrate the sample's size.
BUCKETS, TARGET_ROWS = 1 << 14, 20_000
#: Count added to each bucket; share of calibration documents that the sample may leave out; Gumbel noise allowed for.
SMOOTHING, LEFT_OUT, MARGIN = 1.0, 0.001, 8.0


def _lexer() -> Lexer:
    return Lexer(SPACES, lower=False, apart=PUNCTUATION)


def _grams(block: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the unigrams and bigrams (words and runs of punctuation) of a block, and the text of each. A word after
    itself is one and the same bigram for all words, in bucket 0."""
    text = block.text_of()
    pairs, offsets = runs(block.code, block.first, 2)
    count = np.diff(block.first)
    pair_text = np.repeat(np.arange(len(count)), np.diff(offsets))
    real = count[pair_text] > 1
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
    first = np.flatnonzero(real) - offsets[:-1][pair_text[real]] + block.first[pair_text[real]]
    bigram = np.where(block.code[first] == block.code[first + 1], np.uint64(0), pairs[real] >> shift)
    return np.concatenate([block.code >> shift, bigram]).astype(np.int64), np.concatenate([text, pair_text[real]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each bucket over a task's texts: at most BUCKETS rows."""
    lexer, total = _lexer(), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for block in lexer.blocks(batch.column(0)):
            total += np.bincount(_grams(block)[0], minlength=BUCKETS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["bucket", "n"])


def gram_counts(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each of the BUCKETS n-gram buckets occurs over all texts."""
    rows = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(BUCKETS, np.int64)
    for r in rows.collect():  # at most BUCKETS rows
        total[r.bucket] = r.n
    return total


def log_ratio(target: np.ndarray, raw: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | raw)."""
    share = lambda x: np.log(x + smoothing) - np.log(x.sum() + smoothing * len(x))
    return share(target) - share(raw)


def _weigh(batches: Iterator[pa.RecordBatch], ratio) -> Iterator[pa.RecordBatch]:
    lexer, known = _lexer(), ratio.value
    for batch in batches:
        for block in lexer.blocks(batch.column(1)):
            bucket, text = _grams(block)
            n = len(block.first) - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(block.rows.start, n), pa.array(np.bincount(text, minlength=n)), pa.array(np.bincount(text, known[bucket], minlength=n))],
                names=["id", "n_grams", "log_weight"],
            )


def importance_weights(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_grams and log_weight (the log ratio of the two models, summed over the text's n-grams; 0 without words)."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _weigh(it, shared), f"id {kind}, n_grams long, log_weight double")


def gumbel(seed: int, *cols: str) -> F.Column:
    """Standard Gumbel noise that depends on the columns and the seed alone, so that a repeated task draws it again."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def top_k_threshold(rows: DataFrame, col: str, k: int, bins: int = 1024) -> float | None:
    """The k-th largest value of a stored table's column, by counting in ever narrower bins: each round returns at most
    ``bins`` rows to the driver. None if k is 0; minus infinity if there are no more than k rows."""
    if k <= 0:
        return None
    stats = rows.agg(F.min(col), F.max(col), F.count(col)).first()
    lo, hi, n = stats
    if n <= k:
        return float("-inf")
    above = 0  # rows over hi
    while lo < hi:
        width = (hi - lo) / bins
        if width == 0 or lo + width == lo:
            break
        index = F.least(F.floor((F.col(col) - lo) / width), F.lit(bins - 1))
        seen = rows.where(F.col(col).between(lo, hi)).groupBy(index.alias("bin")).agg(F.count("*").alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).collect()
        for r in sorted(seen, key=lambda r: -r.bin):
            if above + r.n >= k:
                lo, hi = r.lo, r.hi
                break
            above += r.n
        if above + 1 == k:
            return hi
    return lo


def resample(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None, seed: int = 7, target_rows: int = TARGET_ROWS, left_out: float = LEFT_OUT, margin: float = MARGIN) -> DataFrame:
    """One row per row of ``docs``: id, n_grams, log_weight, gumbel_score (log weight and Gumbel noise), selected.

    The target model counts the hashed unigrams and bigrams of three quarters of the documents in ``target_ids`` (of at most
    ``target_rows`` of them, drawn by a hash of the id), the raw model those of all documents. ``selected`` are the k largest
    scores, a sample without replacement in proportion to the weights. Without k it is calibrated on the other quarter: as
    many rows as have a weight of no less than the ``left_out`` quantile there, or 0 if that is smaller, less ``margin``.

    Rows that tie with the k-th are all selected (repeated rows do). Null and empty texts weigh 0. Without target documents
    nothing can be told and all rows are selected. Ids of any type; other columns are not read. Empty tables give no rows.
    """
    wanted = target_ids.select(F.col(id_col)).where(F.col(id_col).isNotNull()).distinct().orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(target_rows)
    wanted = stored(wanted, "target_ids")
    held = F.pmod(F.xxhash64(F.lit(seed + 1), id_col), F.lit(4)) == 0
    target = only_ids(docs, wanted.where(~held), id_col, target_rows)
    ratio = log_ratio(gram_counts(target, text_col), gram_counts(docs, text_col))
    scored = stored(importance_weights(docs, ratio, id_col, text_col).withColumn("gumbel_score", F.col("log_weight") + gumbel(seed, "id")), "weights")
    if k is None:
        ids = F.broadcast(wanted.where(held).withColumnRenamed(id_col, "id"))
        low = scored.join(ids, "id", "left_semi").agg(F.percentile_approx("log_weight", left_out, 100_000)).first()[0]
        k = scored.where(F.col("log_weight") >= min(low, 0.0) - margin).count() if low is not None else scored.count()
    least = top_k_threshold(scored, "gumbel_score", k)
    chosen = F.lit(False) if least is None else F.col("gumbel_score") >= F.lit(least)
    return scored.withColumn("selected", F.coalesce(chosen, F.lit(False))).withColumnRenamed("id", id_col)


def keep_selected(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are selected, with all their columns."""
    out = resample(docs, target_ids, id_col, text_col, **options).where("not selected").select(id_col).distinct()
    out = stored(out, "rejected")
    return docs.join(F.broadcast(out) if out.count() <= 500_000 else out, id_col, "left_anti")
