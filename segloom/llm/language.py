"""Language identification by word frequencies, with shorter and shorter character n-grams for words that are not known.

Words are runs of ASCII letters (A to Z lower-cased) and of bytes beyond ASCII; all words of all labelled texts are counted by
language. Known are those that make up a certain share of some language's words, so a language has a bounded number of them at
any size of corpus, and so it is with the n-grams of each length. A word that is not known is scored by its n-grams of the greatest
length of which any is known.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.llm.common import stored
from segloom.llm.words import Lexer, Segment, segments

#: Shares of a language's words, or of its n-grams of one length, from which they are known: 100,000 of each at most.
WORD_SHARE, GRAM_SHARE = 1e-5, 1e-5
#: Characters of an n-gram, the longest first; a word is read between two spaces.
ORDERS = (5, 4, 3, 2, 1)
#: What is added to every count; bytes of text at a time; the most languages that a model may have.
ADDED, BLOCK_BYTES, LANGUAGES = 0.5, 1 << 20, 1_000
#: A longer word is read in parts of so many bytes (on to the next character).
LONG_WORD = 256
NO_LETTERS = [b for b in range(128) if not chr(b).isalpha()]
UNKNOWN = "und"


def _words(block: Segment, lexer: Lexer) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start, end and code of the words of a block, long ones in parts."""
    found = lexer.scan(block.data, block.bounds)
    text, start, end, code = found.text_of(), found.start, found.end, found.code
    long = np.flatnonzero(end - start > LONG_WORD)
    if not len(long):
        return text, start, end, code
    parts = [np.stack([text, start, end])[:, end - start <= LONG_WORD]]
    for k in long.tolist():
        lead = np.flatnonzero((block.data[start[k] : end[k]] & 0xC0) != 0x80)
        cuts, at = [0], 0
        while at + LONG_WORD < end[k] - start[k]:
            nxt = int(np.searchsorted(lead, at + LONG_WORD))
            if nxt == len(lead):
                break
            at = int(lead[nxt])
            cuts.append(at)
        edges = start[k] + np.array([*cuts, end[k] - start[k]])
        parts.append(np.stack([np.full(len(cuts), text[k]), edges[:-1], edges[1:]]))
    text, start, end = np.concatenate(parts, 1)
    return text, start, end, _code(found.sums, found.inverse, start, end)


def _code(sums: np.ndarray, inverse: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    from segloom.llm.words import mix

    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def _grams(words: list[bytes], lexer: Lexer) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each order the words and the codes of their n-grams, with a space before and after each word."""
    data = np.frombuffer(b"".join(b" " + w + b" " for w in words), np.uint8)
    size = np.array([len(w) + 2 for w in words], np.int64)
    found = lexer.scan(data, np.array([0, len(data)]))
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    word = np.searchsorted(np.cumsum(size), lead, "right")
    edge = np.append(lead, len(data))
    for n in ORDERS:
        m = len(lead) - n + 1
        if m <= 0:
            yield n, np.zeros(0, np.int64), np.zeros(0, np.uint64)
            continue
        whole = word[:m] == word[n - 1 :]
        if n == 1:
            whole = data[lead] != 0x20
        at = np.flatnonzero(whole)
        yield n, word[at], _code(found.sums, found.inverse, edge[at], edge[at + n])


def _lexer() -> Lexer:
    return Lexer(NO_LETTERS)


def _word_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Language, word and count of each block's words."""
    lexer = _lexer()
    for batch in batches:
        langs = batch.column(0).to_pylist()
        names = sorted(set(langs))
        place = {x: i for i, x in enumerate(names)}
        of = np.array([place[x] for x in langs], np.int64)
        for block in segments(batch.column(1), BLOCK_BYTES):
            text, start, end, code = _words(block, lexer)
            lang = of[block.row + text]
            order = np.lexsort((code, lang))
            new = np.ones(len(order), bool)
            new[1:] = (code[order][1:] != code[order][:-1]) | (lang[order][1:] != lang[order][:-1])
            first = np.flatnonzero(new)
            one = order[first]
            raw = block.data.tobytes().lower()
            words = [raw[a:b] for a, b in zip(start[one].tolist(), end[one].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in lang[one].tolist()], pa.string()), pa.array(words, pa.binary()), pa.array(np.diff(np.append(first, len(order))))], names=["lang", "word", "n"])


def _gram_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lexer = _lexer()
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        n_of = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
        for lang in sorted(set(langs.tolist())):
            at = np.flatnonzero(langs == lang)
            words = batch.column(1).take(pa.array(at)).to_pylist()
            for order, word, code in _grams(words, lexer):
                code, of = np.unique(code, return_inverse=True)
                times = np.bincount(of, n_of[at][word], len(code)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(np.full(len(code), order, np.int32)), pa.array(code.view(np.int64)), pa.array(times)], names=["lang", "size", "code", "n"])


@dataclass
class Table:
    """Codes in order; of the k-th the entries ``first[k]:first[k + 1]``: languages that have it, and by how much their log
    frequency is above that of what a language does not have (``floor``)."""

    code: np.ndarray
    first: np.ndarray
    lang: np.ndarray
    gain: np.ndarray
    floor: np.ndarray

    def find(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.code):
            return np.zeros(len(code), np.int64), np.zeros(len(code), bool)
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return at, self.code[at] == code

    def add(self, scores: np.ndarray, row: np.ndarray, at: np.ndarray, weight: np.ndarray) -> None:
        """To each ``row`` of scores the log frequencies of the entry ``at``, times ``weight``."""
        k = scores.shape[1]
        count = self.first[at + 1] - self.first[at]
        total = np.cumsum(count)
        entry = np.arange(total[-1] if len(total) else 0) + np.repeat(self.first[at] - total + count, count)
        cell = np.repeat(row, count) * k + self.lang[entry]
        scores += np.bincount(cell, np.repeat(weight, count) * self.gain[entry], scores.size).reshape(scores.shape)
        scores += np.outer(np.bincount(row, weight, len(scores)), self.floor)


@dataclass
class Model:
    """Languages in order, the logs of their shares of the labelled texts, the words, and the n-grams by order."""

    languages: list[str]
    prior: np.ndarray
    words: Table
    grams: dict[int, Table]


def _table(code: np.ndarray, lang: np.ndarray, n: np.ndarray, totals: np.ndarray) -> Table:
    """From the counts of known codes by language."""
    order = np.lexsort((lang, code))
    code, lang, n = code[order], lang[order], n[order]
    new = np.ones(len(code), bool)
    new[1:] = code[1:] != code[:-1]
    first = np.append(np.flatnonzero(new), len(code))
    size = totals + ADDED * max(1, len(first) - 1)
    floor = np.log(ADDED / size)
    return Table(code[new], first, lang, np.log((n + ADDED) / size[lang]) - floor[lang], floor)


def train(texts: DataFrame, lang_col: str = "lang", text_col: str = "text", word_share: float = WORD_SHARE, gram_share: float = GRAM_SHARE) -> Model:
    """The model of the texts with a language (empty or null texts say nothing). The driver gets what is known: at most
    languages / share rows of words and of each order of n-grams, and of each of those one row a language."""
    rows = texts.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang IS NOT NULL")
    counted = rows.mapInArrow(_word_counter, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = stored(counted, "language_words")
    shares = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()}
    if len(shares) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    languages = sorted(shares)
    place = {x: i for i, x in enumerate(languages)}
    prior = np.log(np.array([shares[x] for x in languages], float) / max(1, sum(shares.values())))
    grams = stored(words.mapInArrow(_gram_counter, "lang string, size int, code long, n long").groupBy("size", "lang", "code").agg(F.sum("n").alias("n")), "language_grams")

    def known(counts: DataFrame, share: float) -> Table:
        total = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        totals = np.array([total.get(x, 0) for x in languages], float)
        if not total:
            return _table(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0), totals)
        of_lang = lambda values: F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("lang")]
        often = counts.where(F.col("n") >= of_lang({x: n * share for x, n in total.items()})).select("code").distinct()
        got = counts.join(often, "code", "left_semi").select("code", of_lang(place).alias("lang"), "n").toArrow()
        code, lang, n = (c.to_numpy() for c in got.columns)
        return _table(code.astype(np.int64).view(np.uint64), lang.astype(np.int64), n.astype(float), totals)

    lexer = _lexer()

    def word_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            ends = np.cumsum([0, *map(len, raw)])
            found = lexer.scan(np.frombuffer(b"".join(raw), np.uint8), ends)
            code = _code(found.sums, found.inverse, ends[:-1], ends[1:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code.view(np.int64)), batch.column(2)], names=["lang", "code", "n"])

    coded = words.mapInArrow(word_codes, "lang string, code long, n long")
    return Model(languages, prior, known(coded, word_share), {n: known(grams.where(F.col("size") == n), gram_share) for n in ORDERS})


def _unseen(words: list[bytes], lexer: Lexer, model: Model) -> np.ndarray:
    """Scores of words that are not known: the mean over those of their n-grams that are, of the longest order with any."""
    scores = np.zeros((len(words), len(model.languages)))
    open_ = np.ones(len(words), bool)
    for n, word, code in _grams(words, lexer):
        table = model.grams[n]
        at, real = table.find(code)
        real &= open_[word]
        word, at = word[real], at[real]
        count = np.bincount(word, minlength=len(words))
        if len(word):
            table.add(scores, word, at, 1.0 / count[word])
        open_ &= count == 0
        if not open_.any():
            break
    return scores


def _scorer(model, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Model = model.value
        lexer, k = _lexer(), len(known.languages)
        names = np.array([*known.languages, UNKNOWN], object)
        for batch in batches:
            lettered = np.array(batch.column(2).to_pylist(), bool)
            sums = np.tile(known.prior, (batch.num_rows, 1))
            for block in segments(batch.column(1), BLOCK_BYTES):
                text, start, end, code = _words(block, lexer)
                code, one, of = np.unique(code, return_index=True, return_inverse=True)
                at, real = known.words.find(code)
                scores = np.zeros((len(code), k))
                known.words.add(scores, np.flatnonzero(real), at[real], np.ones(int(real.sum())))
                rest = np.flatnonzero(~real)
                if len(rest):
                    raw = block.data.tobytes().lower()
                    scores[rest] = _unseen([raw[a:b] for a, b in zip(start[one[rest]].tolist(), end[one[rest]].tolist(), strict=True)], lexer, known)
                for j in range(k):
                    sums[block.row : block.row + len(block.bounds) - 1, j] += np.bincount(text, scores[of.reshape(-1), j], len(block.bounds) - 1)
            if k:
                best = sums.argmax(1)
                score = 1.0 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
            else:
                best, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            best, score = np.where(lettered, best, k), np.where(lettered, score, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(score)], schema=schema)

    return run


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, lang_pred and score, the probability of that language among the model's.

    A text that is null or has no letter, and any text if the model has no language, is ``und`` with score 0; a text of which
    nothing is known gets the language with most labelled texts. Of equal scores the language first in the alphabet is taken. Case
    matters beyond ASCII. Nothing is shuffled; the model goes to every task. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    from segloom.llm.decontaminate import _arrow_type

    schema = pa.schema([("id", _arrow_type(docs, id_col)), ("lang_pred", pa.string()), ("score", pa.float64())])
    out = rows.mapInArrow(_scorer(spark.sparkContext.broadcast(model), schema), f"id {dict(docs.dtypes)[id_col]}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def identify_languages(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``predict`` on ``docs`` with the model of all rows of ``labelled``."""
    return predict(docs, train(labelled, lang_col, text_col), id_col, text_col)
