"""SentencePiece encoding and decoding with the N best segmentations of a text over the piece lattice.

No piece of the vocabulary has white space after another character, so a lattice falls apart into chunks: a run of spaces
with what follows it up to the next. A task segments each different chunk once (as far as it remembers them), by a forward
Viterbi pass over the new chunks of a block together. The N best of a text come from the chunks whose second best is nearest to their best, and
those chunks' own N best from a backward A* search, for which the forward scores are exact heuristics.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.llm.words import Lexer, mix, release

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Segmentations of a text; bytes of text that are segmented together; bytes of a chunk from which it is segmented alone.
NBEST, BLOCK_BYTES, LONG = 3, 1 << 20, 64
#: Bytes up to which a chunk's edges are listed at once; ends whose edges are made together in longer ones.
FEW_BYTES, WINDOW = 1 << 10, 1 << 16
#: Bytes of chunks that one forward pass holds.
CELLS = 500_000
#: Below the lowest score of a one-character piece (the lone space, which is never chosen freely, apart): a byte of a character without a piece.
BYTE_PENALTY = 10.0


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.text = [b""] * size
        self.byte_id = np.zeros(256, np.int32)
        self.pieces: dict[bytes, tuple[int, float]] = {}
        lowest = 0.0
        for i in range(size):
            name = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(name[3:5], 16)] = i
                self.text[i] = bytes([int(name[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                raw = name.replace("▁", " ").encode()
                self.text[i] = raw
                self.pieces[raw] = (i, sp.get_score(i))
                if len(name) == 1 and raw != b" ":
                    lowest = min(lowest, sp.get_score(i))
        self.byte_score = lowest - BYTE_PENALTY
        if any(b" " in raw.lstrip(b" ") for raw in self.pieces):
            raise ValueError("a piece has a space after another character")
        self.longest = max(map(len, self.pieces))
        self.lexer = Lexer((), lower=False)
        codes = _codes(list(self.pieces))
        order = np.argsort(codes)
        ids = np.array([i for i, _ in self.pieces.values()], np.int32)
        scores = np.array([s for _, s in self.pieces.values()])
        self.codes, self.ids, self.scores = codes[order], ids[order], scores[order]
        bucket = (self.codes >> np.uint64(44)).astype(np.int64)
        self.alive = np.zeros(1 << 20, bool)
        self.alive[bucket] = True
        self.first = np.searchsorted(bucket, np.arange(1 << 20)).astype(np.int32)
        self.crowd = int(np.bincount(bucket).max())

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which codes are pieces, and their places in ``ids`` and ``scores``."""
        bucket = (codes >> np.uint64(44)).view(np.int64)
        maybe = np.flatnonzero(self.alive[bucket])
        at, wanted = self.first[bucket[maybe]], codes[maybe]
        for _ in range(self.crowd - 1):  # on to the next of a bucket that is still smaller
            at = at + (self.codes[at] < wanted)
            at = np.minimum(at, len(self.codes) - 1)
        real = self.codes[at] == wanted
        return maybe[real], at[real]

    def edges(self, chunk: bytes) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each end the pieces that end there: (start, score, ids). A character without a piece is its bytes."""
        out: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(len(chunk) + 1)]
        starts = [i for i in range(len(chunk) + 1) if i == len(chunk) or chunk[i] & 0xC0 != 0x80]
        for k, e in enumerate(starts[1:], 1):
            for s in starts[max(0, k - self.longest) : k]:
                if e - s <= self.longest and (found := self.pieces.get(chunk[s:e])):
                    out[e].append((s, found[1], (found[0],)))
            s = starts[k - 1]
            if chunk[s:e] not in self.pieces:
                out[e].append((s, self.byte_score * (e - s), tuple(int(self.byte_id[b]) for b in chunk[s:e])))
        return out


def _codes(raw: list[bytes]) -> np.ndarray:
    """The code of each byte string, as that of the same bytes in a text."""
    data = np.frombuffer(b"".join(raw), np.uint8)
    end = np.cumsum([len(x) for x in raw])
    start = np.concatenate([[0], end[:-1]])
    lexer = Lexer((), lower=False)
    lexer._powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(lexer.value[data] * lexer._power[: len(data)])])
        return mix((sums[end] - sums[start]) * lexer._inverse[start] + (end - start).astype(np.uint64))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class _Lattice:
    """The edges of a long chunk as ``Vocabulary.edges`` has them, made for a window of ends at a time, and its forward scores."""

    def __init__(self, chunk: bytes, known: Vocabulary, window: int = WINDOW):
        self.known, self.window, self.data = known, window, np.frombuffer(chunk, np.uint8)
        self.lead = np.append((self.data & 0xC0) != 0x80, True)
        self.held: dict[int, tuple[np.ndarray, ...]] = {}

    def _made(self, w: int) -> tuple[np.ndarray, ...]:
        """Of window w the edges that end in it, by end and start: the first of each end, starts, scores, ids (-2: the bytes)."""
        if w not in self.held:
            known, first = self.known, w * self.window
            last = min(first + self.window, len(self.data))  # ends first + 1 to last
            base = max(0, first - known.longest)
            lexer = known.lexer
            lexer._powers(last - base + 1)
            part = self.data[base:last]
            sums = np.zeros(len(part) + 1, np.uint64)
            with np.errstate(over="ignore"):
                np.cumsum(lexer.value[part] * lexer._power[: len(part)], out=sums[1:])
            ends = np.flatnonzero(self.lead[first + 1 : last + 1]) + first + 1
            starts, stops, scores, ids = [], [], [], []
            for size in range(1, known.longest + 1):
                e = ends[ends >= size]
                e = e[self.lead[e - size]]
                s = e - size
                with np.errstate(over="ignore"):
                    code = mix((sums[e - base] - sums[s - base]) * lexer._inverse[s - base] + np.uint64(size))
                at, place = known.find(code)
                starts.append(s[at])
                stops.append(e[at])
                scores.append(known.scores[place])
                ids.append(known.ids[place])
                if size <= 4:  # one character without a piece
                    none = np.setdiff1d(np.arange(len(e)), at, assume_unique=True)
                    for j in range(1, size):
                        none = none[~self.lead[s[none] + j]]
                    starts.append(s[none])
                    stops.append(e[none])
                    scores.append(np.full(len(none), known.byte_score * size))
                    ids.append(np.full(len(none), -2, np.int32))
            start, stop, score, id_ = (np.concatenate(x) for x in (starts, stops, scores, ids))
            order = np.lexsort((start, stop))
            while len(self.held) > 1:
                self.held.pop(next(iter(self.held)))
            self.held[w] = (np.searchsorted(stop[order], np.arange(first + 1, last + 2)), start[order], score[order], id_[order], stop[order])
        return self.held[w]

    def __getitem__(self, e: int) -> list[tuple[int, float, tuple[int, ...]]]:
        w, k = divmod(e - 1, self.window)
        first, start, score, ids, _ = self._made(w)
        a, b = int(first[k]), int(first[k + 1])
        return [(s, x, (i,) if i >= 0 else tuple(self.known.byte_id[self.data[s:e]].tolist())) for s, x, i in zip(start[a:b].tolist(), score[a:b].tolist(), ids[a:b].tolist(), strict=True)]

    def forward(self) -> tuple[array, float]:
        """The best score of each prefix, and the second best of the whole."""
        n = len(self.data)
        best, second = array("d", [-np.inf]) * (n + 1), array("d", [-np.inf]) * (n + 1)
        best[0] = 0.0
        for w in range(-(-n // self.window)):
            _, start, score, _, stop = self._made(w)
            for e, s, x in zip(stop.tolist(), start.tolist(), score.tolist(), strict=True):
                one, two = best[s] + x, second[s] + x
                if one > best[e]:
                    second[e] = best[e] if best[e] > two else two
                    best[e] = one
                else:
                    if one > second[e]:
                        second[e] = one
                    if two > second[e]:
                        second[e] = two
        return best, second[n]


def _lattice(chunk: bytes, known: Vocabulary):
    """Edges by end, forward scores, and the second best of a chunk."""
    if len(chunk) > FEW_BYTES:
        edges = _Lattice(chunk, known)
        return edges, *edges.forward()
    edges = known.edges(chunk)
    best, second = [0.0] + [-np.inf] * len(chunk), [-np.inf] * (len(chunk) + 1)
    for e in range(1, len(chunk) + 1):
        for s, score, _ in edges[e]:
            one = best[s] + score
            second[e] = max(min(best[e], one), second[e], second[s] + score)
            best[e] = max(best[e], one)
    return edges, best, second[-1]


def _nbest(edges, ahead, length: int, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """Backward A* from the end of a lattice, a path's rank being its score so far and the forward score of what is left.

    That is exact, so a path taken from the queue is followed to the start along the best edges (of equal ones the one from the
    earliest start, as in the forward pass), and where it leaves another edge aside, that begins one other path of known score.
    The queue keeps as many as are still to be found; a path in it is a place in the path that it leaves, and an edge.
    """
    out: list[tuple[float, tuple[int, ...]]] = []
    paths: list[tuple[array, array]] = []  # places from the end to the start, and the ids between them, backward
    queue: list[tuple[float, int, int, int, int, float, tuple[int, ...]]] = [(ahead[length], -1, 0, 0, length, 0.0, ())]
    while queue and len(out) < n:
        total, parent, upto, had, e, score, ids = queue.pop(0)
        places, labels = (paths[parent][0][:upto], paths[parent][1][:had]) if parent >= 0 else (array("q"), array("i"))
        places.append(e)
        labels.extend(reversed(ids))
        while e:
            step = None
            for s, more, other in edges[e]:
                if step is None and ahead[s] + more == ahead[e]:
                    step = s, more, other
                    continue
                rank = ahead[s] + score + more
                if len(queue) < n - len(out) - 1 or (queue and rank > queue[-1][0]):
                    k = len(queue)
                    while k and queue[k - 1][0] < rank:
                        k -= 1
                    queue.insert(k, (rank, len(paths), len(places), len(labels), s, score + more, other))
                    del queue[max(0, n - len(out) - 1) :]
            s, more, ids = step
            score += more
            e = s
            places.append(e)
            labels.extend(reversed(ids))
        paths.append((places, labels))
        out.append((total, tuple(reversed(labels))))
    return out


def nbest_chunk(chunk: bytes, n: int, known: Vocabulary) -> list[tuple[float, tuple[int, ...]]]:
    """The n best segmentations of a chunk with their scores, best first; time and memory are linear in its length."""
    edges, ahead, _ = _lattice(chunk, known)
    return _nbest(edges, ahead, len(chunk), n)


def _viterbi(data: np.ndarray, sums: np.ndarray, inverse: np.ndarray, start: np.ndarray, length: np.ndarray, known: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best segmentation of chunks, which come longest first: ids row by row, their counts, the best and second best scores."""
    m, longest = len(start), int(length[0])
    best = np.full((longest + 1, m), -np.inf)
    best[0] = 0
    second = np.full((longest + 1, m), -np.inf)
    back = np.zeros((longest + 1, m), np.int16)
    piece = np.full((longest + 1, m), -1, np.int32)
    reach = np.searchsorted(-length, -np.arange(longest + 2), "right")  # chunks of at least so many bytes
    lead = np.ones((longest + 1, m), bool)
    for j in range(longest):
        at = start[: reach[j + 1]]
        lead[j, : len(at)] = data[at + j] & 0xC0 != 0x80

    def offer(e: int, s: int, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        one, two = best[s, at] + score, second[s, at] + score
        old = best[e, at]
        second[e, at] = np.maximum(np.minimum(old, one), np.maximum(second[e, at], two))
        win = one > old
        at = at[win]
        best[e, at] = one[win]
        back[e, at] = s
        piece[e, at] = ids[win]

    with np.errstate(over="ignore", invalid="ignore"):
        for e in range(1, longest + 1):
            live = reach[e]
            first, upto = start[:live], sums[start[:live] + e]
            for s in range(max(0, e - known.longest), e):
                code = mix((upto - sums[first + s]) * inverse[first + s] + np.uint64(e - s))
                at, place = known.find(code)
                if len(at):
                    offer(e, s, at, known.scores[place], known.ids[place])
                if e - s <= 4:  # one character without a piece
                    single = lead[s, :live] & lead[e, :live]
                    for j in range(s + 1, e):
                        single &= ~lead[j, :live]
                    single[at] = False
                    if len(none := np.flatnonzero(single)):
                        offer(e, s, none, np.full(len(none), known.byte_score * (e - s)), np.full(len(none), -2, np.int32))
    chosen = np.full((m, longest + 1), -1, np.int32)
    row, at = np.arange(m), length.astype(np.int64)
    while len(row):
        s, ids = back[at, row].astype(np.int64), piece[at, row]
        chosen[row, at] = ids
        for k in np.flatnonzero(ids == -2):
            for j in range(s[k] + 1, at[k] + 1):
                chosen[row[k], j] = known.byte_id[data[start[row[k]] + j - 1]]
        row, at = row[s > 0], s[s > 0]
    used = chosen[:, 1:] >= 0
    every = np.arange(m)
    return chosen[:, 1:][used], used.sum(1), best[length, every], second[length, every]


def _alone(chunk: bytes, known: Vocabulary) -> tuple[list[int], float, float]:
    """As _viterbi, for one long chunk."""
    edges, ahead, second = _lattice(chunk, known)
    return list(_nbest(edges, ahead, len(chunk), 1)[0][1]), ahead[len(chunk)], second


class _Known:
    """Segmentations of the different chunks that a task has met, in the order of their codes: most words of a block were in
    one before. At most ``most`` chunks (some 30 MB) are kept; then it begins again with the block at hand."""

    def __init__(self, most: int = 400_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.code, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.count, self.at, self.best, self.gap = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)

    def add(self, code: np.ndarray, ids: np.ndarray, count: np.ndarray, best: np.ndarray, second: np.ndarray) -> None:
        """Takes in chunks that it does not have."""
        code = np.concatenate([self.code, code])
        order = np.argsort(code, kind="stable")
        at = len(self.flat) + np.cumsum(count) - count
        self.code, self.flat = code[order], np.concatenate([self.flat, ids])
        self.count, self.at = np.concatenate([self.count, count.astype(np.int32)])[order], np.concatenate([self.at, at])[order]
        self.best, self.gap = np.concatenate([self.best, best])[order], np.concatenate([self.gap, best - second])[order]

    def place(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where codes are, and which are there."""
        if not len(self.code):
            return np.zeros(len(code), np.int64), np.zeros(len(code), bool)
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return at, self.code[at] == code


class _Block:
    """Texts of a batch, a space before each that is not empty, as chunks; every different chunk that is new segmented once."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, known: Vocabulary, lexer: Lexer, met: _Known):
        texts = len(bounds) - 1
        full = np.diff(bounds) > 0
        shift = np.concatenate([[0], np.cumsum(full)])
        self.bounds = bounds + shift
        self.data = np.full(self.bounds[-1], 32, np.uint8)
        self.data[np.arange(len(data)) + np.repeat(shift[1:], np.diff(bounds))] = data
        kind = np.where(self.data == 32, 1, np.where(self.data < 32, 2, 3))
        new = np.ones(len(kind), bool)
        new[1:] = (kind[1:] == 2) | (kind[:-1] == 2) | ((kind[1:] == 1) & (kind[:-1] != 1))
        new[self.bounds[:-1][full]] = True
        start = np.flatnonzero(new)
        length = np.diff(np.append(start, len(self.data)))
        self.chunk_from = np.searchsorted(start, self.bounds)
        lexer._powers(len(self.data) + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(lexer.value[self.data] * lexer._power[: len(self.data)])])
            code = mix((sums[start + length] - sums[start]) * lexer._inverse[start] + length.astype(np.uint64))
        code, one, self.type_of = np.unique(code, return_index=True, return_inverse=True)
        self.start, self.length = start[one], length[one]
        if len(met.code) + np.count_nonzero(~met.place(code)[1]) > met.most:
            met.clear()
        fresh = np.flatnonzero(~met.place(code)[1])
        fresh = fresh[np.argsort(-self.length[fresh], kind="stable")]
        parts = []
        for t in fresh[self.length[fresh] >= LONG]:
            ids, best, second = _alone(self.chunk(t), known)
            parts.append((code[[t]], np.array(ids, np.int32), np.array([len(ids)]), np.array([best]), np.array([second])))
        at = len(parts)
        while at < len(fresh):  # as many as make half a million cells
            to = at + max(1, CELLS // int(self.length[fresh[at]]))
            some = fresh[at:to]
            parts.append((code[some], *_viterbi(self.data, sums, lexer._inverse, self.start[some], self.length[some], known)))
            at = to
        if parts:
            met.add(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        here, _ = met.place(code)
        self.flat, self.at = met.flat, met.at[here]
        self.count, self.best, self.gap = met.count[here].astype(np.int64), met.best[here], met.gap[here]
        self.texts = texts

    def chunk(self, t: int) -> bytes:
        return self.data[self.start[t] : self.start[t] + self.length[t]].tobytes()

    def best_ids(self) -> tuple[np.ndarray, np.ndarray]:
        """The best ids of all texts, and the offset of each chunk's."""
        count = self.count[self.type_of]
        offsets = np.concatenate([[0], np.cumsum(count)])
        at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], count) + np.repeat(self.at[self.type_of], count)
        return self.flat[at], offsets


def _alternatives(block: _Block, text: int, offsets: np.ndarray, n: int, known: Vocabulary, seen: dict) -> tuple[list[float], list[list[int]]]:
    """Score losses and edits of the 2nd to n-th best segmentation of a text. Only the n - 1 chunks with the smallest gaps
    can differ from the best; a choice of ranks for them is an edit of the best ids: from, to, count, ids, and so on."""
    a, b = block.chunk_from[text], block.chunk_from[text + 1]
    gaps = block.gap[block.type_of[a:b]]
    few = np.sort(np.argpartition(gaps, n - 2)[: n - 1]) if b - a > n - 1 else np.arange(b - a)
    heads: list[tuple[float, tuple]] = [(0.0, ())]
    mine = {}
    for k in few[np.isfinite(gaps[few])].tolist():
        raw = block.chunk(block.type_of[a + k])
        ranked = seen.get(raw)
        if ranked is None:
            ranked = nbest_chunk(raw, n, known)
            if len(seen) > 5_000:
                seen.clear()
            if len(raw) <= FEW_BYTES:
                seen[raw] = ranked
        mine[k] = ranked
        choices = [(ranked[0][0] - score, r) for r, (score, _) in enumerate(ranked)]
        heads = sorted(((loss + more, (*picks, (k, r)) if r else picks) for loss, picks in heads for more, r in choices), key=lambda x: x[0])[:n]
    losses, edits = [], []
    base = offsets[a]
    for loss, picks in heads[1:]:
        edit: list[int] = []
        for k, r in picks:
            ids = mine[k][r][1]
            edit += [int(offsets[a + k] - base), int(offsets[a + k + 1] - base), len(ids), *ids]
        losses.append(loss)
        edits.append(edit)
    return losses, edits


def _encode(batches: Iterator[pa.RecordBatch], path: str, n: int) -> Iterator[pa.RecordBatch]:
    known, lexer, seen, met = vocabulary(path), Lexer((), lower=False), {}, _Known()
    for batch in batches:
        column = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
        at = 0
        while at < len(column):
            to = min(max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1), len(column))
            block = _Block(raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], known, lexer, met)
            ids, chunk_at = block.best_ids()
            ends = chunk_at[block.chunk_from]
            score = np.array([block.best[block.type_of[a:b]].sum() for a, b in zip(block.chunk_from[:-1], block.chunk_from[1:], strict=True)])
            found = [_alternatives(block, t, chunk_at, n, known, seen) if n > 1 and block.chunk_from[t] < block.chunk_from[t + 1] else ([], []) for t in range(block.texts)]
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).slice(at, to - at) for i in range(batch.num_columns)), lists, pa.array(score), pa.array([[float(s - x) for x in losses] for s, (losses, _) in zip(score, found, strict=True)], pa.list_(pa.float64())), pa.array([e for _, e in found], pa.list_(pa.list_(pa.int32())))],
                names=[*batch.schema.names, "ids", "score", "other_scores", "other_edits"],
            )
            at = to
            release()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, nbest: int = NBEST) -> DataFrame:
    """One row per row of ``docs``: id, text, ids (best segmentation), score, other_scores and other_edits (2nd to N-th best).

    An edit is a flat list of from, to, count and count ids, repeated: pieces [from, to) of ``ids`` give way to the new ones.
    A text begins with the model's space of its own; a character without a piece, U+2581 itself included, becomes its bytes,
    so that decoding gives back the text exactly. Null and empty texts have no ids and no others. Nothing is shuffled. A
    text of any length is segmented whole, in time linear in it and some 100 bytes of memory for each byte of the longest text;
    of segmentations of equal score any is taken. Other columns are not read.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(lambda it: _encode(it, model, nbest), f"id {kind}, text string, ids array<int>, score double, other_scores array<double>, other_edits array<array<int>>")
    return out.withColumnRenamed("id", id_col)


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    text = vocabulary(path).text
    for batch in batches:
        ids, edits = batch.column("ids"), batch.column("other_edits")
        values, offsets = ids.values.to_numpy(), ids.offsets.to_numpy()
        whole, same = [], []
        for k in range(batch.num_rows):
            mine = values[offsets[k] : offsets[k + 1]].tolist()
            whole.append(b"".join(map(text.__getitem__, mine))[1:].decode())
            good = True
            for edit in edits[k].as_py() or []:
                at = 0
                while at < len(edit):
                    a, b, n = edit[at : at + 3]
                    good &= b"".join(text[i] for i in mine[a:b]) == b"".join(text[i] for i in edit[at + 3 : at + 3 + n])
                    at += 3 + n
            same.append(good)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(whole, pa.string()), pa.array(same)], names=[*batch.schema.names, "decoded", "others_decode"])


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """Adds ``decoded``, the text of ``ids``, and ``others_decode``: whether all other segmentations have the same text."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(lambda it: _decode(it, model), f"{ddl}, decoded string, others_decode boolean")


def _round_trip(batches: Iterator[pa.RecordBatch], path: str, n: int) -> Iterator[pa.RecordBatch]:
    for batch in _decode(_encode(batches, path, n), path):
        same = pc.equal(batch.column("decoded"), pc.fill_null(batch.column("text").cast(pa.string()), ""))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "ids", "score", "other_scores", "other_edits", "others_decode")), same], names=["id", "ids", "score", "other_scores", "other_edits", "others_decode", "round_trip"])


def encode_checked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, nbest: int = NBEST) -> DataFrame:
    """``encode`` and ``decode`` in one pass of one worker: id, ids, score, other_scores, other_edits, others_decode and
    round_trip, whether the decoded text is the text (null: empty). Texts don't go back to the JVM."""
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(lambda it: _round_trip(it, model, nbest), f"id {kind}, ids array<int>, score double, other_scores array<double>, other_edits array<array<int>>, others_decode boolean, round_trip boolean")
    return out.withColumnRenamed("id", id_col)
