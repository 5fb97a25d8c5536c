"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier on its posteriors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.llm.common import stored
from segloom.llm.words import NOT_ALNUM, Lexer, Words, mix

#: At most so many labelled rows find terms, anchor the label model and fit the classifier; terms that are kept.
LABELLED_ROWS, TERMS = 20_000, 2048
#: Terms that vote alone, pools that the other toxic terms vote in, and documents in which a term must occur.
SOLO, POOLS, LEAST_DOCS = 40, 8, 5
#: Bytes of the word stems that count as terms beside whole words.
STEMS = (4, 5, 6)
#: Pattern voters, in order: what is said by the form of a text rather than by its words.
PATTERNS = ("shouting", "exclamations", "symbol_runs", "digits", "no_words", "short")
#: How often a given label is right: it votes in the training rows' posteriors.
LABEL_RIGHT = 0.98


def _terms(block: Words, alive: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The different (text, term) pairs of a block: whole words and stems by byte length. ``alive``: which high 20 bits occur in the terms of interest."""
    text = block.text_of()
    texts, codes = [], []
    for length in (0, *STEMS):
        code = block.code if not length else mix(block.prefix(length) ^ np.uint64(length))
        keep = alive[(code >> np.uint64(44)).astype(np.int64)] if alive is not None else slice(None)
        texts.append(text[keep])
        codes.append(code[keep])
    text, code = np.concatenate(texts), np.concatenate(codes)
    order = np.lexsort((code, text))
    text, code = text[order], code[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (text[1:] != text[:-1])
    return text[new], code[new]


def _patterns(block: Words) -> np.ndarray:
    """One row of PATTERNS (0 or 1) per text."""
    n = len(block.first) - 1
    data = block.data
    of = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[block.bounds])
    upper, lower = of((data >= 65) & (data <= 90)), of((data >= 97) & (data <= 122))
    symbol = np.isin(data, np.frombuffer(b"#$%&*@", np.uint8))
    runs = np.zeros(len(data), bool)
    runs[1:] = symbol[1:] & symbol[:-1]
    words = np.diff(block.first)
    digits = of((data >= 48) & (data <= 57))
    size = np.maximum(np.diff(block.bounds), 1)
    out = np.stack([upper > lower, of(data == 33) * 100 > size, of(runs) * 50 > size, digits * 20 > size, words == 0, words < 20], 1)
    return out.astype(np.int8).reshape(n, len(PATTERNS))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lexer = Lexer(NOT_ALNUM)
    for batch in batches:
        toxic = np.asarray(batch.column(1)).astype(bool)
        for block in lexer.blocks(batch.column(0)):
            text, code = _terms(block, None)
            label = toxic[block.rows][text]
            terms, at = np.unique(code, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(np.bincount(at, label, len(terms)).astype(np.int64)), pa.array(np.bincount(at, ~label, len(terms)).astype(np.int64))], names=["term", "pos", "neg"])


@dataclass
class Lexicon:
    """Terms in the order of their codes, and the voter of each (-1: none)."""

    codes: np.ndarray
    voter: np.ndarray
    solo: int

    def __post_init__(self) -> None:
        self.alive = np.zeros(1 << 20, bool)
        self.alive[(self.codes >> np.uint64(44)).astype(np.int64)] = True

    @property
    def voters(self) -> int:
        return self.solo + POOLS + len(PATTERNS)

    def find(self, block: Words) -> tuple[np.ndarray, np.ndarray]:
        """(text, term index) of the known terms of each text."""
        if not len(self.codes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        text, code = _terms(block, self.alive)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        known = self.codes[at] == code
        return text[known], at[known]

    def votes(self, block: Words, text: np.ndarray, term: np.ndarray) -> np.ndarray:
        """A row of 0 and 1 per text: which voters say toxic."""
        n = len(block.first) - 1
        out = np.zeros((n, self.voters), np.int8)
        voter = self.voter[term]
        out[text[voter >= 0], voter[voter >= 0]] = 1
        out[:, self.solo + POOLS :] = _patterns(block)
        return out


def _moments(batches: Iterator[pa.RecordBatch], lexicon) -> Iterator[pa.RecordBatch]:
    """Of a task's texts: how often each two voters both say toxic (with themselves: either one alone)."""
    lexer, known = Lexer(NOT_ALNUM), lexicon.value
    total = np.zeros((known.voters, known.voters))
    for batch in batches:
        for block in lexer.blocks(batch.column(0)):
            votes = known.votes(block, *known.find(block)).astype(np.float32)
            total += votes.T @ votes
    i, j = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j].astype(np.int64))], names=["i", "j", "n"])


@dataclass
class LabelModel:
    """P(vote | toxic) and P(vote | clean) of each voter, the prior, and how far its correlated neighbours discount it."""

    hit: np.ndarray
    false: np.ndarray
    prior: float
    discount: np.ndarray

    def logit(self, votes: np.ndarray) -> np.ndarray:
        yes = np.log(self.hit / self.false) * self.discount
        no = np.log((1 - self.hit) / (1 - self.false)) * self.discount
        return np.log(self.prior / (1 - self.prior)) + votes @ (yes - no) + no.sum()


def fit_label_model(both: np.ndarray, n: int, votes: np.ndarray, labels: np.ndarray, rounds: int = 50, linked: float = 0.1) -> LabelModel:
    """Estimates the voters from how they agree over all documents.

    Given the class, independent voters have covariance prior (1 - prior) d_i d_j, where d is P(vote | toxic) less P(vote |
    clean): d is fitted to the off-diagonal covariances by alternating least squares, starting from its value on the
    labelled rows. Pairs whose covariance is left unexplained by more than ``linked`` of their deviations are taken as
    correlated given the class, and leave the fit; a voter's weight is divided by 1 and its correlations. Rates are then
    averaged with those of the labelled rows, each by its count.
    """
    m = len(both)
    prior = float(np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99))
    pos, neg = max(labels.sum(), 1.0), max((1 - labels).sum(), 1.0)
    hit0, false0 = (votes * labels[:, None]).sum(0) / pos, (votes * (1 - labels)[:, None]).sum(0) / neg
    rate = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(rate, rate)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    v = prior * (1 - prior)
    d = hit0 - false0
    far = ~np.eye(m, dtype=bool)
    for _ in range(rounds):
        left = (cov - v * np.outer(d, d)) / np.outer(sd, sd)
        far = (np.abs(left) <= linked) & ~np.eye(m, dtype=bool)
        top, bottom = (far * cov) @ d, v * (far @ (d * d))
        d = np.where(bottom > 1e-9, 0.5 * d + 0.5 * top / np.maximum(bottom, 1e-9), d)
        d = np.clip(d, -0.99, 0.99)
    left = (cov - v * np.outer(d, d)) / np.outer(sd, sd)
    near = np.where(far | np.eye(m, dtype=bool), 0, np.maximum(left, 0))
    model_hit, model_false = np.clip(rate + (1 - prior) * d, 0, 1), np.clip(rate - prior * d, 0, 1)
    weight = 1 / (1 + np.sqrt(len(labels)) / 20)  # of the model beside the labelled rows' own rates
    hit, false = weight * model_hit + (1 - weight) * hit0, weight * model_false + (1 - weight) * false0
    return LabelModel(np.clip((hit * pos + 0.5) / (pos + 1), 1e-4, 1 - 1e-4), np.clip((false * neg + 0.5) / (neg + 1), 1e-5, 1 - 1e-4), prior, 1 / (1 + near.sum(1)))


def _features(batches: Iterator[pa.RecordBatch], lexicon) -> Iterator[pa.RecordBatch]:
    lexer, known = Lexer(NOT_ALNUM), lexicon.value
    for batch in batches:
        for block in lexer.blocks(batch.column(0)):
            text, term = known.find(block)
            votes = known.votes(block, text, term)
            n = len(votes)
            offsets = np.searchsorted(text, np.arange(n + 1)).astype(np.int32)
            lists = lambda o, x: pa.ListArray.from_arrays(pa.array(o), pa.array(x.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([lists(offsets, term), lists(np.arange(n + 1, dtype=np.int32) * known.voters, votes.reshape(-1)), batch.column(1).slice(block.rows.start, n)], names=["terms", "votes", "toxic"])


def fit_linear(rows: np.ndarray, columns: np.ndarray, dense: np.ndarray, wide: int, goal: np.ndarray, steps: int = 600, rate: float = 0.1, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on posteriors ``goal`` (Adam, all rows at once): weights of terms, of patterns, and the intercept."""
    n = len(goal)
    w = np.zeros(wide + dense.shape[1] + 1)
    m, s = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = np.bincount(rows, w[columns], n) + dense @ w[wide:-1] + w[-1]
        gap = 1 / (1 + np.exp(-z)) - goal
        grad = np.concatenate([np.bincount(columns, gap[rows], wide), dense.T @ gap, [gap.sum()]]) / n + decay * w
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return w[:wide], w[wide:-1], float(w[-1])


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    lexer = Lexer(NOT_ALNUM)
    known, terms, patterns, base = model.value
    for batch in batches:
        for block in lexer.blocks(batch.column(1)):
            text, term = known.find(block)
            n = len(block.first) - 1
            z = np.bincount(text, terms[term], n) + _patterns(block) @ patterns + base
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.rows.start, n), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=["id", "score"])


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", labelled_rows: int = LABELLED_ROWS, terms: int = TERMS) -> DataFrame:
    """One row per row of ``docs``: id and score (0 to 1, of the whole text, from the text alone).

    1. Of at most ``labelled_rows`` rows of ``labels`` (drawn by a hash of the id), documents with and without each word or
       word stem are counted by label; the terms that tell most are kept.
    2. Toxic terms vote, the strongest alone, the others in pools, and so do patterns of form. Over all documents it is
       counted how often each two voters agree, and from that the label model gets its accuracies and correlations.
    3. The labelled rows' posteriors (votes, and the label as one more) train a linear classifier on terms and patterns.
    4. All documents are scored by it.

    What goes to the driver is bounded: term counts of the kept terms, one number for each two voters, and the labelled
    rows' known terms. Null and empty texts have no terms and score by their patterns. Without labelled rows every score
    is 0. Repeated ids in ``labels`` count each; rows with a null id or label are left out. Other columns are not read.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    given = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IS NOT NULL")
    given = given.orderBy(F.xxhash64(F.lit(11), "id"), "id", "toxic").limit(labelled_rows)
    train = stored(rows.join(F.broadcast(stored(given, "labels")), "id").select("text", "toxic"), "labelled")
    found = train.agg(F.count("*"), F.sum("toxic")).first()
    if not found[0]:
        return rows.select(F.col("id").alias(id_col), F.lit(0.0).alias("score"))
    pos, neg = float(found[1] or 0), float(found[0] - (found[1] or 0))
    counts = train.mapInArrow(_count_terms, "term long, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(F.col("pos") + F.col("neg") >= LEAST_DOCS)
    lift = F.log(((F.col("pos") + 0.5) / (pos + 1)) / ((F.col("neg") + 0.5) / (neg + 1)))
    gain = F.abs(lift) * F.greatest(F.col("pos") / max(pos, 1.0), F.col("neg") / max(neg, 1.0) / 10)
    best = counts.select("term", "pos", "neg", lift.alias("lift"), gain.alias("gain")).orderBy(F.desc("gain"), "term").limit(terms).collect()
    codes = np.array([r.term for r in best], np.int64).view(np.uint64)
    toxic = [k for k, r in enumerate(best) if r.lift > 2]
    solo = min(SOLO, len(toxic))
    voter = np.full(len(best), -1, np.int64)
    for at, k in enumerate(toxic):
        voter[k] = at if at < solo else solo + at % POOLS
    order = np.argsort(codes)
    lexicon = Lexicon(codes[order], voter[order], solo)
    shared = spark.sparkContext.broadcast(lexicon)
    pairs = rows.select("text").mapInArrow(lambda it: _moments(it, shared), "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both = np.zeros((lexicon.voters, lexicon.voters))
    for r in pairs:
        both[r.i, r.j] = r.n
    sample = train.mapInArrow(lambda it: _features(it, shared), "terms array<int>, votes array<int>, toxic int").toArrow()
    term_lists = sample.column("terms").combine_chunks()
    label = np.asarray(sample.column("toxic")).astype(float)
    votes = sample.column("votes").combine_chunks().flatten().to_numpy().reshape(len(label), lexicon.voters).astype(float)
    model = fit_label_model(both, rows.count(), votes, label)
    goal = model.logit(votes) + np.where(label > 0, 1, -1) * np.log(LABEL_RIGHT / (1 - LABEL_RIGHT))
    goal = 1 / (1 + np.exp(-np.clip(goal, -30, 30)))
    row = np.repeat(np.arange(len(label)), np.diff(term_lists.offsets.to_numpy()))
    fitted = fit_linear(row, term_lists.flatten().to_numpy(), votes[:, solo + POOLS :], len(best), goal)
    classifier = spark.sparkContext.broadcast((lexicon, *fitted))
    return rows.mapInArrow(lambda it: _score(it, classifier), f"id {kind}, score double").withColumnRenamed("id", id_col)
