"""Substring dedup by sliding spans: runs of consecutive sentences, and stretches of words wherever they begin, that occur
earlier in the corpus are removed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.llm.common import BROADCAST_ROWS, HOT_ROWS, join_counted, stored
from segloom.llm.words import SPACES, Lexer, Words, mix

#: Sentences of a run at least, and words of a run at least; LONG words are a run of their own, whatever the sentences.
SENTENCES, LEAST_WORDS, LONG = 2, 25, 50
#: The filter of repeated anchors has 2^BITS bits at most (64 MB). Beyond it lets more through, which costs time only.
BITS = 29
#: Bits of one row of ``bitmap_construct_agg``.
BUCKET = 15


def sentences(block: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word of each sentence of a block, and the offsets of sentences by text. A sentence ends with a word that ends in
    . ! or ?, or at a line's end."""
    n = len(block.code)
    texts = len(block.first) - 1
    ends = np.isin(block.data[np.maximum(block.end - 1, 0)], np.frombuffer(b".!?", np.uint8)) if n else np.zeros(0, bool)
    lines = np.concatenate([[0], np.cumsum(block.data == 10)])
    new = np.ones(n, bool)
    if n:
        new[1:] = ends[:-1] | (lines[block.start[1:]] > lines[block.end[:-1]])
        begins = block.first[:-1]
        new[begins[begins < block.first[1:]]] = True
    first = np.flatnonzero(new)
    return first, np.searchsorted(first, block.first[: texts + 1])


def _hasher(block: Words, salt: int, base: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Hashes of the words from a to b: a polynomial over word codes, taken from running sums."""
    n = len(block.code)
    with np.errstate(over="ignore"):
        power = np.full(n + 1, base, np.uint64)
        power[:1] = 1
        power = np.multiply.accumulate(power)
        back = np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
        back[:1] = 1
        back = np.multiply.accumulate(back)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(block.code + np.uint64(salt)) * power[:n])])

    def of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64))

    return of


def _hashers(block: Words) -> list[Callable[[np.ndarray, np.ndarray], np.ndarray]]:
    return [_hasher(block, 1, 0x9E3779B97F4A7C15), _hasher(block, 2, 0xD6E8FEB86659FD93)]


def _grams(long: int) -> tuple[int, int]:
    """Words of an anchor, and anchors to choose one from, so that every stretch of ``long`` words has a chosen one."""
    size = max(1, 2 * long // 3)
    return size, long - size + 1


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set in a filter."""
    place = hashes >> np.uint64(65 - (len(bits) * 8).bit_length())
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def anchors(block: Words, size: int, among: int, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the chosen runs of ``size`` words: the least hash (the first of equal ones) of every
    ``among`` in a row. The choice depends on those words only, so equal stretches have equal anchors."""
    n = len(block.code) - size + 1
    if n < among:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n)
    hashes = of(at, at + size)
    least = hashes & np.uint64(0xFFFFFFFF00000000) | at.astype(np.uint64)
    width = 1
    while width < among:
        step = min(width, among - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    ends = np.repeat(block.first[1:], np.diff(block.first))[: len(least)]
    chosen = (least[at[: len(least)] + size + among - 1 <= ends] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    chosen = chosen[np.append(True, chosen[1:] != chosen[:-1])] if len(chosen) else chosen
    return chosen, hashes[chosen]


def runs_from(block: Words, least: int, least_words: int, long: int, repeated: np.ndarray) -> tuple[np.ndarray, ...]:
    """First word, word after the last, two hashes of each run, and whether it is a stretch of words. From each sentence goes
    the shortest run of ``least`` sentences and ``least_words`` words, or the sentence alone if it has ``long`` words; from
    each word, ``long`` words if they hold an anchor of the filter ``repeated``."""
    of = _hashers(block)
    size, among = _grams(long)
    at, hashes = anchors(block, size, among, of[0])
    at = at[passes(repeated, hashes)]
    n = len(block.code)
    following = np.full(n + 1, n, np.int64)  # the next such anchor
    following[at] = at
    following = np.minimum.accumulate(following[::-1])[::-1] + size

    first, offsets = sentences(block)
    total = len(first)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    word_to = np.append(first[1:], n).astype(np.int64)  # end of each sentence in words
    end = np.maximum(np.arange(total) + least, np.searchsorted(word_to, first + least_words) + 1)
    end = np.where(word_to - first >= long, np.arange(total) + 1, end)
    some = np.flatnonzero(end <= offsets[text + 1])
    a, b = first[some], word_to[end[some] - 1]

    c = np.arange(max(0, n - long + 1))
    ends = np.repeat(block.first[1:], np.diff(block.first))[: len(c)]
    c = c[(c + long <= ends) & (following[c] <= c + long)]
    # a stretch and a sentence run of the same words are no repeat of each other
    h1 = np.concatenate([of[0](a, b), mix(of[0](c, c + long) ^ np.uint64(0xA24BAED4963EE407))])
    h2 = np.concatenate([of[1](a, b) >> np.uint64(32) | np.uint64(1), np.zeros(len(c), np.uint64)])
    return np.concatenate([a, c]), np.concatenate([b, c + long]), h1, h2, np.repeat([False, True], [len(a), len(c)])


def _local_first(h1: np.ndarray, h2: np.ndarray, text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The place of each run's first in its text."""
    order = np.lexsort((at, h2, h1, text))
    new = np.ones(len(order), bool)
    new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1]) | (text[order][1:] != text[order][:-1])
    out = np.zeros(len(order), np.int64)
    out[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    return out


def _emit_anchors(batches: Iterator[pa.RecordBatch], long: int) -> Iterator[pa.RecordBatch]:
    lexer = Lexer(SPACES)
    for batch in batches:
        for block in lexer.blocks(batch.column(0)):
            _, hashes = anchors(block, *_grams(long), _hasher(block, 1, 0x9E3779B97F4A7C15))
            h, n = np.unique(hashes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])


def _emit(batches: Iterator[pa.RecordBatch], least: int, least_words: int, long: int, repeated, again=None) -> Iterator[pa.RecordBatch]:
    """``again``: the filter that runs of sentences must pass, if any."""
    lexer = Lexer(SPACES)
    for batch in batches:
        for block in lexer.blocks(batch.column(1)):
            at, _, h1, h2, stretch = runs_from(block, least, least_words, long, repeated.value)
            if again is not None:
                some = stretch | passes(again.value, h1)
                at, h1, h2 = at[some], h1[some], h2[some]
            text = np.searchsorted(block.first, at, "right") - 1
            first = np.unique(_local_first(h1, h2, text, at))
            ids = batch.column(0).slice(block.rows.start, len(block.first) - 1).take(pa.array(text[first]))
            yield pa.RecordBatch.from_arrays([pa.array(h1[first].view(np.int64)), pa.array(h2[first].astype(np.uint32).view(np.int32)), ids], names=["h1", "h2", "id"])


def _clean(batches: Iterator[pa.RecordBatch], least: int, least_words: int, long: int, repeated) -> Iterator[pa.RecordBatch]:
    """(id, text, repeated run hashes) -> id, n_sentences, n_removed, text without the covered words."""
    lexer = Lexer(SPACES)
    for batch in batches:
        known = batch.column(2)
        for block in lexer.blocks(batch.column(1)):
            n = len(block.first) - 1
            first, offsets = sentences(block)
            at, end, h1, h2, stretch = runs_from(block, least, least_words, long, repeated.value)
            text = np.searchsorted(block.first, at, "right") - 1
            local = _local_first(h1, h2, text, at)
            # a stretch that overlaps its first would take from it
            again = np.where(stretch, at >= end[local], at > at[local])
            here = known.slice(block.rows.start, n)
            lists, owner = here.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), np.repeat(np.arange(n), np.asarray(_lengths(here)))
            if len(lists):
                key = mix(h1 + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                again |= np.isin(key, mix(lists + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            words = len(block.code)
            cover = np.bincount(at[again], minlength=words + 1) - np.bincount(end[again], minlength=words + 1)
            gone = np.cumsum(cover)[:words] > 0
            sentence_text = np.repeat(np.arange(n), np.diff(offsets))
            lost = np.logical_or.reduceat(gone, first) if len(first) else np.zeros(0, bool)
            stop = np.minimum(np.append(block.start[1:], len(block.data))[:words], block.bounds[1:][block.text_of()])
            drop = np.zeros(len(block.data) + 1, np.int8)
            drop[block.start[gone]] += 1
            drop[stop[gone]] -= 1
            keep = np.cumsum(drop)[:-1] == 0
            sizes = np.concatenate([[0], np.cumsum(keep)])[block.bounds]
            cleaned = pa.LargeStringArray.from_buffers(n, pa.py_buffer(sizes.astype(np.int64)), pa.py_buffer(block.data[keep])).cast(pa.string())
            source = batch.column(1).slice(block.rows.start, n)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.rows.start, n), pa.array(np.diff(offsets)), pa.array(np.bincount(sentence_text, lost, n).astype(np.int64)), pa.compute.if_else(source.is_null(), pa.scalar(None, pa.string()), cleaned)], names=["id", "n_sentences", "n_removed", "text"])


def _lengths(lists: pa.Array) -> pa.Array:
    return pa.compute.fill_null(pa.compute.list_value_length(lists), 0)


def bit_filter(hashes: DataFrame, count: int) -> np.ndarray:
    """A bit for each value of the leading bits of the column ``h``, set where a row has it."""
    bits = min(BITS, max(BUCKET, (16 * count).bit_length()))
    place = F.shiftrightunsigned("h", 64 - bits)
    parts = hashes.groupBy(F.shiftright(place, BUCKET).alias("bucket")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit((1 << BUCKET) - 1).cast("long"))).alias("bits"))
    out = np.zeros((1 << (bits - BUCKET), (1 << BUCKET) // 8), np.uint8)
    for r in parts.toLocalIterator():
        out[r.bucket] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def drop_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = SENTENCES, least_words: int = LEAST_WORDS, long: int = LONG, most: int = BROADCAST_ROWS, hot: int = HOT_ROWS) -> DataFrame:
    """One row per row of ``docs``: id, n_sentences, n_removed (those that lost words), text without the words that a non-first
    repeated run covers.

    From every sentence goes a run: the shortest of ``least`` consecutive sentences with ``least_words`` words, or the
    sentence alone if it has ``long`` words; and from every word goes a run of ``long`` words, whatever the sentences. Words
    are compared after lower-casing A-Z, whatever the white space between, by 95-bit hashes of sentence runs and 64-bit ones of
    ``long`` words. A run's first occurrence is that in the smallest id, and there the earliest; all others are removed
    (in the first's own document those of ``long`` words that don't overlap it), with the white space after them.

    Only stretches whose anchor occurs twice can repeat: of every few runs of words the one of the least hash is an anchor,
    and each stretch of ``long`` words holds one. Anchors are counted, the repeated ones go to the tasks as a filter of
    bounded size, and only stretches with such an anchor are shuffled. What it lets through too much is compared in full.
    Each document sends a run once and counts are made before the shuffle, so a line of a third of all documents is one row
    a task; when the firsts of runs are joined back, runs of over ``hot`` documents stay where they are (``join_counted``). What comes back to a document are the hashes of its own repeated runs.

    Null texts stay null, empty ones empty, with no sentences. Rows that share an id count as one document each time: a run
    is kept in all of them. Rows with a null id are never first if another document has the run, and keep their own
    repeats only once. Other columns are not read. An empty table gives no rows.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    chosen = rows.select("text").mapInArrow(lambda it: _emit_anchors(it, long), "h long, n long")
    chosen = stored(chosen.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), "repeated_anchors")
    some = docs.sparkSession.sparkContext.broadcast(bit_filter(chosen, chosen.count()))
    runs = rows.mapInArrow(lambda it: _emit(it, least, least_words, long, some), f"h1 long, h2 int, id {kind}")
    repeated = runs.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    repeated = stored(repeated, "repeated_runs")
    seen = repeated.where("h2 <> 0").select(F.col("h1").alias("h"))
    seen = docs.sparkSession.sparkContext.broadcast(bit_filter(seen, seen.count()))
    runs = rows.mapInArrow(lambda it: _emit(it, least, least_words, long, some, seen), f"h1 long, h2 int, id {kind}")
    later = join_counted(runs, repeated, ["h1", "h2"], "id", most, hot).where("n IS NOT NULL").where(~F.col("id").eqNullSafe(F.col("first"))).select("id", "h1")
    later = stored(later, "later_runs")
    lists = later.groupBy("id").agg(F.collect_set("h1").alias("runs"))
    by_id = rows.join(lists, rows["id"].eqNullSafe(lists["id"]), "left").select(rows["id"], "text", "runs")
    out = by_id.mapInArrow(lambda it: _clean(it, least, least_words, long, some), f"id {kind}, n_sentences long, n_removed long, text string")
    return out.withColumnRenamed("id", id_col)
