"""Alignment of the tokens that two tokenizers make of one text, and how often two ids meet in a corpus.

Both token streams are byte ranges of one string. All ranges of a block are sorted by start; where a start reaches the running
maximum of the ends before it, a group ends, and the ranges that overlap are expanded into pairs inside their group. No token of
either tokenizer crosses a space after a character that is no white space, so a text falls apart there into chunks, and a worker
aligns each different chunk once, as far as it remembers them.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segloom.llm.common import BROADCAST_ROWS, HOT_ROWS, join_counted, stored
from segloom.llm.words import Lexer, Segment, mix, segments

A_MODEL, B_MODEL = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text that are aligned together; chunks, and entries of their lists, that a worker remembers at most before it begins anew.
BLOCK_BYTES, KNOWN_CHUNKS, KNOWN_ENTRIES = 1 << 20, 200_000, 8_000_000
#: A pair of ids is one number: A's times this, and B's.
PAIR = 1 << 20


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others in order from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """A: byte-level, of a text after a space. B: pieces, which adds that space itself. Ids, and the bytes of each id."""

    def __init__(self, a_model: str, b_model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_model)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_model)
        letter = _byte_letters()
        size = self.a.get_vocab_size(with_added_tokens=True)
        special = {i: t.content for i, t in self.a.get_added_tokens_decoder().items()}
        names = [special.get(i) or self.a.id_to_token(i) or "" for i in range(size)]
        self.a_bytes = [n.encode() if i in special else bytes(letter[c] for c in n) for i, n in enumerate(names)]
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            name = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace("▁", " ").encode())
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        if max(len(self.a_bytes), len(self.b_bytes)) > PAIR:
            raise ValueError("a vocabulary is too large")

    def encode(self, chunks: list[bytes]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        """A's and B's ids of chunks, each of which begins with a space, and which of them both give back byte by byte; the
        others have none."""
        texts = [c.decode() for c in chunks]
        a = [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)]
        b = self.b.encode([t[1:] for t in texts], num_threads=1)
        good = np.array([b"".join(map(self.a_bytes.__getitem__, x)) == c == b"".join(map(self.b_bytes.__getitem__, y)) for x, y, c in zip(a, b, chunks, strict=True)], bool)
        return [x if g else [] for x, g in zip(a, good, strict=True)], [y if g else [] for y, g in zip(b, good, strict=True)], good


@lru_cache(maxsize=2)
def tokenizers(a_model: str, b_model: str) -> Tokenizers:
    return Tokenizers(a_model, b_model)


def coalesce(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups of two tokenizations of the same bytes, given where their tokens end: the group of each A and each B token, and
    the pairs of an A and a B token that overlap."""
    n = len(a_end)
    start = np.concatenate([[0], a_end[:-1], [0], b_end[:-1]]) if n else np.zeros(0, np.int64)
    end = np.concatenate([a_end, b_end])
    side = np.arange(len(end)) >= n
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    breaks = np.zeros(len(end), np.int64)
    breaks[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(end), np.int64)
    group[order] = np.cumsum(breaks)
    lo, hi = np.searchsorted(b_end, start[:n], "right"), np.searchsorted(start[n:], end[:n], "left")
    width = hi - lo
    left = np.repeat(np.arange(n), width)
    right = np.arange(len(left)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(lo, width)
    return group[:n], group[n:], left, right


class _Lists:
    """A list of numbers for each chunk, end to end."""

    def __init__(self) -> None:
        self.flat, self.count, self.at = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, flat: np.ndarray, count: np.ndarray) -> None:
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(count) - count])
        self.flat, self.count = np.concatenate([self.flat, flat]), np.concatenate([self.count, count])

    def take(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of some chunks end to end, and their lengths."""
        count = self.count[chunks]
        total = np.cumsum(count)
        return self.flat[np.arange(total[-1] if len(total) else 0) + np.repeat(self.at[chunks] - total + count, count)], count


class _Known:
    """Ids, groups and links of the different chunks that a worker has met."""

    def __init__(self, models: Tokenizers, link: str):
        self.models, self.link, self.lexer = models, link, Lexer((), lower=False)
        self.clear()

    def clear(self) -> None:
        self.code, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.good, self.text = np.zeros(0, bool), []
        #: ids of A and B; how many of each a group has; places in the chunk of the tokens of a link
        self.a, self.b, self.group_a, self.group_b, self.link_a, self.link_b = (_Lists() for _ in range(6))

    def _where(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.code):
            return np.zeros(len(code), np.int64), np.zeros(len(code), bool)
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return self.place[at], self.code[at] == code

    def chunks(self, block: Segment) -> tuple[np.ndarray, np.ndarray]:
        """The chunks of a block's texts, as places in this object's lists, and the first of each text."""
        size = np.diff(block.bounds)
        shift = np.concatenate([[0], np.cumsum(size > 0)]) if block.begins else np.zeros(len(size) + 1, np.int64)
        bounds = block.bounds + shift
        data = np.full(bounds[-1], 0x20, np.uint8)
        data[np.arange(len(block.data)) + np.repeat(shift[1:], size)] = block.data
        cut = np.zeros(len(data), bool)
        # a space after what is no white space, beyond ASCII only where that is sure, and not the last byte of a text
        one, two, three = (np.concatenate([np.zeros(min(k, len(data)), np.uint8), data[:-k]]) for k in (1, 2, 3))
        cut = (data == 0x20) & (((one > 0x20) & (one < 0x7F)) | ((one > 0x7F) & (two != 0xC2) & (three != 0xE1) & (three != 0xE2) & (three != 0xE3)))
        cut[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = False
        cut[bounds[:-1][bounds[1:] > bounds[:-1]]] = True
        start = np.flatnonzero(cut)
        length = np.diff(np.append(start, len(data)))
        self.lexer._powers(len(data) + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.lexer.value[data] * self.lexer._power[: len(data)])])
            code = mix((sums[start + length] - sums[start]) * self.lexer._inverse[start] + length.astype(np.uint64))
        code, one, of = np.unique(code, return_index=True, return_inverse=True)
        fresh = np.flatnonzero(~self._where(code)[1])
        if len(self.code) + len(fresh) > KNOWN_CHUNKS or len(self.a.flat) + len(self.b.flat) > KNOWN_ENTRIES:
            self.clear()
            fresh = np.arange(len(code))
        if len(fresh):
            self._align([data[start[k] : start[k] + length[k]].tobytes() for k in one[fresh]], code[fresh])
        return self._where(code)[0][of.reshape(-1)], np.searchsorted(start, bounds)

    def _align(self, chunks: list[bytes], code: np.ndarray) -> None:
        a, b, good = self.models.encode(chunks)
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (a, b))
        ids_a, ids_b = (np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())) for ids, n in ((a, n_a), (b, n_b)))
        a_end, b_end = np.cumsum(self.models.a_len[ids_a]), np.cumsum(self.models.b_len[ids_b])
        of_a, of_b, left, right = coalesce(a_end, b_end)
        if self.link == "end":
            both = a_end[left] == b_end[right]
            left, right = left[both], right[both]
        groups = int(of_a[-1]) + 1 if len(of_a) else 0
        size_a, size_b = np.bincount(of_a, minlength=groups), np.bincount(of_b, minlength=groups)
        owner_a = np.repeat(np.arange(len(chunks)), n_a)
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        owner = owner_a[left]
        n_groups = np.bincount(owner_a[np.cumsum(size_a) - 1], minlength=len(chunks))
        n_links = np.bincount(owner, minlength=len(chunks))
        self.a.add(ids_a, n_a)
        self.b.add(ids_b, n_b)
        self.group_a.add(size_a, n_groups)
        self.group_b.add(size_b, n_groups)
        self.link_a.add(left - first_a[owner], n_links)
        self.link_b.add(right - first_b[owner], n_links)
        group = 0
        ends_a, ends_b = np.cumsum(size_a).tolist(), np.cumsum(size_b).tolist()
        name_a, name_b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
        for k in n_groups.tolist():
            parts = []
            for g in range(group, group + k):
                parts.append(",".join(name_a[ends_a[g - 1] if g else 0 : ends_a[g]]) + "|" + ",".join(name_b[ends_b[g - 1] if g else 0 : ends_b[g]]))
            self.text.append(";".join(parts))
            group += k
        known = np.concatenate([self.code, code])
        order = np.argsort(known)
        self.place = np.concatenate([self.place, len(self.good) + np.arange(len(code))])[order]
        self.code, self.good = known[order], np.concatenate([self.good, good])


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def _bytes_of(batch: pa.RecordBatch) -> pa.Array:
    return batch.column(1)


def _tokens(known: _Known, chunks: np.ndarray) -> list[np.ndarray]:
    """a_ids, b_ids, group_a, group_b, link_a and link_b of a text of these chunks."""
    a, n_a = known.a.take(chunks)
    b, n_b = known.b.take(chunks)
    link_a, n_links = known.link_a.take(chunks)
    link_b, _ = known.link_b.take(chunks)
    return [a, b, known.group_a.take(chunks)[0], known.group_b.take(chunks)[0], link_a + np.repeat(np.cumsum(n_a) - n_a, n_links), link_b + np.repeat(np.cumsum(n_b) - n_b, n_links)]


def _aligner(a_model: str, b_model: str, link: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["a_ids", "b_ids", "group_a", "group_b", "link_a", "link_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(tokenizers(a_model, b_model), link)
        for batch in batches:
            parts: list[list[np.ndarray]] = []
            good, at = True, 0
            for block in segments(_bytes_of(batch), BLOCK_BYTES):
                chunks, first = known.chunks(block)
                rows = []
                for k in range(len(first) - 1):
                    mine = chunks[first[k] : first[k + 1]]
                    if block.begins:
                        parts, good = [], True
                    good &= bool(known.good[mine].all())
                    own = _tokens(known, mine)
                    for j, side in ((4, 0), (5, 1)):
                        own[j] = own[j] + sum(len(p[side]) for p in parts)
                    parts.append(own)
                    if block.ends:
                        rows.append([np.concatenate(p) if good else np.zeros(0, np.int64) for p in zip(*parts, strict=True)])
                if rows:
                    columns = [pa.array([r[j].astype(np.int32) for r in rows], pa.list_(pa.int32())) for j in range(len(names))]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(rows)), *columns], names=["id", *names])
                    at += len(rows)

    return run


def align_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_model: str = A_MODEL, b_model: str = B_MODEL, link: str = "end") -> DataFrame:
    """One row per row of ``docs``: id, a_ids and b_ids; group_a and group_b, how many tokens of each a group has; link_a and
    link_b, the places in both of the tokens whose byte ranges end together (``link="overlap"``: that share a byte).

    Strings of special tokens are ordinary text. Null and empty texts, and those that a tokenizer does not give back byte by byte
    after a space (such as those with U+2581), have no tokens. Nothing is shuffled; a long text is read in stretches, but its
    lists are one row. Other columns are not read.
    """
    if link not in ("end", "overlap"):
        raise ValueError("link is end or overlap")
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_aligner(a_model, b_model, link), f"id {kind}, " + ", ".join(f"{c} array<int>" for c in ("a_ids", "b_ids", "group_a", "group_b", "link_a", "link_b")))
    return out.withColumnRenamed("id", id_col)


def _counter(a_model: str, b_model: str, link: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(tokenizers(a_model, b_model), link)
        for batch in batches:
            at = 0
            counts, pairs = [], []  # of a text in several stretches
            digest, good = hashlib.sha256(), True
            for block in segments(_bytes_of(batch), BLOCK_BYTES):
                chunks, first = known.chunks(block)
                texts = len(first) - 1
                if block.begins:
                    counts, pairs, digest, good = [], [], hashlib.sha256(), True
                numbers = np.stack([_sums(x.count[chunks], first) for x in (known.a, known.b, known.group_a, known.link_a)], 1)
                bad = _sums(~known.good[chunks], first) > 0
                a, n_a = known.a.take(chunks)
                b, n_b = known.b.take(chunks)
                link_a, n_links = known.link_a.take(chunks)
                link_b, _ = known.link_b.take(chunks)
                text = np.repeat(np.repeat(np.arange(texts), np.diff(first)), n_links)
                pair = a[link_a + np.repeat(np.cumsum(n_a) - n_a, n_links)] * PAIR + b[link_b + np.repeat(np.cumsum(n_b) - n_b, n_links)]
                key, times = np.unique(text << 40 | pair, return_counts=True)
                text, pair = key >> 40, key & ((1 << 40) - 1)
                names = known.text
                mine = [";".join([names[c] for c in chunks[first[k] : first[k + 1]].tolist()]) for k in range(texts)]
                if block.begins and block.ends:
                    numbers[bad] = 0
                    keep = ~bad[text]
                    text, pair, times = text[keep], pair[keep], times[keep]
                    shas = [hashlib.sha256(m.encode()).hexdigest() if n else "" for m, n in zip(mine, numbers[:, 0].tolist(), strict=True)]
                else:
                    good &= not bad.any()
                    digest.update((";" if counts and mine[0] else "").encode() + mine[0].encode())
                    counts.append(numbers[0])
                    pairs.append((pair, times))
                    if not block.ends:
                        continue
                    numbers = np.sum(counts, 0, keepdims=True) * good
                    pair, of = np.unique(np.concatenate([p for p, _ in pairs]), return_inverse=True)
                    times = np.bincount(of, np.concatenate([t for _, t in pairs])).astype(np.int64)
                    pair, times = (pair, times) if good else (pair[:0], times[:0])
                    text, shas = np.zeros(len(pair), np.int64), [digest.hexdigest() if numbers[0, 0] else ""]
                ends = np.searchsorted(text, np.arange(texts + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int64))) for x in (pair, times)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, texts), *(pa.array(numbers[:, j]) for j in range(4)), pa.array(shas, pa.string()), *lists], names=["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
                at += texts

    return run


def alignment_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_model: str = A_MODEL, b_model: str = B_MODEL, link: str = "end", most: int = BROADCAST_ROWS, hot: int = HOT_ROWS) -> DataFrame:
    """One row per row of ``docs``: id; n_a, n_b, n_groups and n_links; groups_sha256, the digest of its groups as
    ``a1,a2|b1;a3|b2,b3`` ('' without tokens); n_best, its links whose pair of ids is the most frequent of their B id in all
    documents (ties: all), and count_sum, the sum over its links of how many links of all documents have that pair.

    Texts as in ``align_tokens``; they are encoded once. Rows with equal or null ids stay apart. What is stored is each text's
    different pairs and how often it has them; those are added up before the shuffle, and joined back by broadcast of at most
    ``most`` pairs, else with the pairs of over ``hot`` rows kept where they are.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
    made = stored(rows.mapInArrow(_counter(a_model, b_model, link), schema).withColumn("row", F.monotonically_increasing_id()), "aligned")
    each = made.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    counts = each.groupBy("pair").agg(F.count("*").alias("n"), F.sum("times").alias("links"))
    top = F.max("links").over(Window.partitionBy(F.col("pair") % PAIR))
    counts = stored(counts.withColumn("best", F.col("links") == top), "pairs")
    both = join_counted(each, counts, ["pair"], "row", most, hot)
    sums = both.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("links")).alias("count_sum"))
    out = made.drop("pairs", "times").join(sums, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
