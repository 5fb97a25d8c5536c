"""Token alignment, language identification and ranked search against brute force, and on odd rows."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_corpus import DOCS, ODD, docs_of, sample, words

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


# --- alignment --------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def models():
    import sentencepiece
    from segloom.llm.alignment import A_MODEL, B_MODEL, tokenizers
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A_MODEL)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_MODEL), tokenizers(A_MODEL, B_MODEL)


def aligned(text, models):
    """Ids, groups and links of a whole text, encoded at once, from the sets of token ends."""
    a, b, known = models
    if not text:
        return [], [], [], []
    raw = (" " + text).encode()
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    if b"".join(known.a_bytes[i] for i in x) != raw or b"".join(known.b_bytes[i] for i in y) != raw:
        return [], [], [], []
    ends = [np.cumsum([len(t[i]) for i in ids]).tolist() for t, ids in ((known.a_bytes, x), (known.b_bytes, y))]
    both = sorted(set(ends[0]) & set(ends[1]))
    groups, i, j = [], 0, 0
    for stop in both:
        p, q = i, j
        while i < len(x) and ends[0][i] <= stop:
            i += 1
        while j < len(y) and ends[1][j] <= stop:
            j += 1
        groups.append((x[p:i], y[q:j]))
    return x, y, groups, [(g[-1], h[-1]) for g, h in groups]


TEXTS = [
    *ODD, "hello world", "Hello, World!  \n\n  two  spaces ", " lead", "tail ", "tail  ", "\u00a0nbsp \u2003 em\u3000ideo graphic", "été à la façon", "漢字かな交じり文 です", "👩‍👩‍👧 emoji 🇫🇷 x", "a▁b no tokens", "<s> </s> <|endoftext|> <unk> <0x41>",
    "x" * 300 + " " + "#" * 50, "tab\tand\x0bvt \x1c\x85 x", "don't can't 123 4567890 3.14", "I'll\r\nwe've", "\x00 nul", "é \u200b zero", "word\u2028 line", "hello world", " ", "  ", "\n", "á à", "ﬁ ligature ½ ①",
]


def test_coalesce():
    from segloom.llm.alignment import coalesce

    of_a, of_b, left, right = coalesce(np.array([2, 5, 6, 9]), np.array([2, 3, 6, 8, 9]))
    assert of_a.tolist() == [0, 1, 1, 2] and of_b.tolist() == [0, 1, 1, 2, 2]
    assert list(zip(left.tolist(), right.tolist(), strict=True)) == [(0, 0), (1, 1), (1, 2), (2, 2), (3, 3), (3, 4)]
    assert [len(x) for x in coalesce(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0, 0, 0, 0]


def test_alignment(spark, models, monkeypatch):
    from segloom.llm import alignment

    rng = random.Random(4)
    alphabet = ["a", "the ", " ", "  ", "é", "漢", "\n", ".", "1", "'s", "\u00a0", "-", "Q"]
    texts = [*TEXTS, *("".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40))) for _ in range(150))]
    want = [aligned(t, models) for t in texts]
    counts = collections.Counter(x for _, _, _, links in want for x in links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    got = {r.doc_id: r for r in alignment.align_tokens(docs_of(spark, texts)).collect()}
    tables = [alignment.alignment_counts(docs_of(spark, texts), **limits) for limits in ({}, {"most": 1, "hot": 3})]
    found = [{r.doc_id: r for r in t.collect()} for t in tables]
    for i, (x, y, groups, links) in enumerate(want):
        r = got[i]
        assert (r.a_ids, r.b_ids) == (x, y), texts[i]
        assert (r.group_a, r.group_b) == ([len(g) for g, _ in groups], [len(h) for _, h in groups])
        assert [(x[a], y[b]) for a, b in zip(r.link_a, r.link_b, strict=True)] == links
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        row = (len(x), len(y), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if x else "")
        for table in found:
            assert tuple(table[i])[1:] == row
    assert sum(bool(x) for x, *_ in want) > 150
    wide = {r.doc_id: r for r in alignment.align_tokens(docs_of(spark, texts[:12]), link="overlap").collect()}
    for i, (x, y, _, _) in enumerate(want[:12]):
        ends = [[0, *np.cumsum([len(t[k]) for k in ids]).tolist()] for t, ids in ((models[2].a_bytes, x), (models[2].b_bytes, y))]
        pairs = [(a, b) for a in range(len(x)) for b in range(len(y)) if min(ends[0][a + 1], ends[1][b + 1]) > max(ends[0][a], ends[1][b])]
        assert sorted(zip(wide[i].link_a, wide[i].link_b, strict=True)) == pairs
    assert alignment.alignment_counts(docs_of(spark, [])).count() == 0 and alignment.align_tokens(docs_of(spark, [])).count() == 0
    rows = docs_of(spark, ["q r", "q r"]).unionByName(docs_of(spark, ["q r"])).withColumn("doc_id", F.when(F.col("doc_id") == 0, F.col("doc_id")))
    assert [(r.n_a, r.count_sum) for r in alignment.alignment_counts(rows).collect()] == [(2, 6)] * 3


def test_alignment_in_stretches(models, monkeypatch):
    """Long texts in stretches, and a worker that forgets, give what whole texts give."""
    import pyarrow as pa
    from segloom.llm import alignment

    texts = [*TEXTS, "one two three " * 200, ("é ▁ x " * 40), "x" * 900, "".join(TEXTS[10:20]) * 3]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["id", "text"])
    run = lambda f: [r for b in f(iter([batch])) for r in b.to_pylist()]
    whole = [run(f(alignment.A_MODEL, alignment.B_MODEL, "end")) for f in (alignment._aligner, alignment._counter)]
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 64)
    monkeypatch.setattr(alignment, "KNOWN_CHUNKS", 9)
    assert [run(f(alignment.A_MODEL, alignment.B_MODEL, "end")) for f in (alignment._aligner, alignment._counter)] == whole


# --- languages --------------------------------------------------------------------------------------------------------


def slow_languages(labelled, texts, share=1e-5):
    """The same model with dictionaries of whole words and n-grams."""
    import re

    cut = lambda t: [w for w in re.findall(rb"[a-z\x80-\xff]+", (t or "").encode().lower())]
    langs = sorted({x for x, _ in labelled if x is not None})
    prior = collections.Counter(x for x, _ in labelled if x is not None)
    count = collections.Counter((x, w) for x, t in labelled if x is not None for w in cut(t))

    def table(counts):
        totals = collections.Counter()
        for (x, _), n in counts.items():
            totals[x] += n
        known = {k for (x, k), n in counts.items() if n >= share * totals[x]}
        return {k: [math.log((counts.get((x, k), 0) + 0.5) / (totals[x] + 0.5 * max(1, len(known)))) for x in langs] for k in known}

    grams = lambda w, n: [g for k in range(len(w) + 3 - n) if (g := (" " + w + " ")[k : k + n]) != " "]
    by_order = {}
    for n in (5, 4, 3, 2, 1):
        c = collections.Counter()
        for (x, w), k in count.items():
            for g in grams(w.decode(), n):
                c[x, g] += k
        by_order[n] = table(c)
    known, out = table(count), []
    for t in texts:
        s = np.log([prior[x] / sum(prior.values()) for x in langs]) if langs else np.zeros(0)
        for w in cut(t):
            if w in known:
                s = s + known[w]
                continue
            for n in (5, 4, 3, 2, 1):
                hits = [by_order[n][g] for g in grams(w.decode(), n) if g in by_order[n]]
                if hits:
                    s = s + np.mean(hits, axis=0)
                    break
        letters = any(c.isalpha() for c in t or "")
        out.append((langs[int(s.argmax())], float(1 / np.exp(s - s.max()).sum())) if letters and langs else ("und", 0.0))
    return out


def test_languages(spark):
    from segloom.llm.language import identify_languages

    rng = random.Random(3)
    stems = {"en": ["the", "and", "with", "there", "house"], "fr": ["été", "avec", "maison", "et", "là"], "ru": ["дом", "и", "там", "с", "лето"]}
    say = lambda x, n: " ".join(rng.choice(stems[x]) + rng.choice(["", "s", "e", "er"]) for _ in range(n))
    labelled = [(x, say(x, rng.randrange(1, 30))) for x in rng.choices(list(stems), [5, 3, 2], k=80)] + [(None, "zz zz"), ("fr", None), ("en", "")]
    texts = [*ODD, "1234 !! 77", "…—", "ß", "漢字", "qqq", "the", "maisonette", "THE HOUSE", "Дом там", *(say(x, 4) for x in "en fr ru".split() for _ in range(10))]
    train = spark.createDataFrame(labelled, "lang string, text string").repartition(3)
    got = {r.doc_id: r for r in identify_languages(docs_of(spark, texts), train).collect()}
    for i, (lang, score) in enumerate(slow_languages(labelled, texts)):
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(score, abs=1e-9), (texts[i], got[i])
    assert [got[i].lang_pred for i in (0, 1, 2, 9, 10)] == ["und"] * 5
    none = identify_languages(docs_of(spark, texts), train.where("false")).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)} and len(none) == len(texts)
    assert identify_languages(docs_of(spark, []), train).count() == 0


def test_languages_in_stretches(spark, monkeypatch):
    import pyarrow as pa
    from segloom.llm import language

    texts = ["one two three " * 300, "é" * 2000 + " end", "漢字" * 400, None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(["x"] * 5), pa.array(texts, pa.string())], names=["lang", "text"])
    total = lambda: collections.Counter({(r["lang"], r["word"]): 0 for r in []}) + sum((collections.Counter({r["word"]: r["n"]}) for b in language._word_counter(iter([batch])) for r in b.to_pylist()), collections.Counter())
    whole = total()
    assert all(len(w) <= language.LONG_WORD + 3 for w in whole) and sum(len(w) * n for w, n in whole.items() if w.decode()[0] in "é漢字") == 4000 + 2400
    monkeypatch.setattr(language, "BLOCK_BYTES", 100)
    assert total() == whole


def test_language_query(spark, sf):
    from segloom.llm.queries import QUERIES

    rows = QUERIES["op12_language"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 200 and len(held) > 30 and np.mean([r.lang == r.lang_pred for r in held]) >= 0.95


# --- ranked search ----------------------------------------------------------------------------------------------------


def slow_search(docs, items, k):
    sets = [(i, collections.Counter(words(t, TERM))) for i, t in docs]
    some, total = sum(bool(c) for _, c in sets), sum(sum(c.values()) for _, c in sets)
    df = collections.Counter(t for _, c in sets for t in c)
    out = []
    for item, text in items:
        asked, found = collections.Counter(words(text, TERM)), []
        for i, c in sets:
            m = 75 + (25 * sum(c.values()) * some) // max(1, total)
            score = sum(n * math.floor(1000 * math.log((2 * some + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, n in asked.items() if t in c)
            if score > 0:
                found.append((-score, i if i is not None else 1 << 62))
        out += [(item, rank, i if i < 1 << 62 else None, -s) for rank, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def test_ranked_search(spark):
    from segloom.llm.ranked_search import ranked_search

    texts = [*ODD, *sample(1, 300, 60, 80), *sample(2, 40, 3000, 300), *["w1 w2 w3"] * 40, "W1 É w1", "x-y_z w2"]
    items = [(f"i{k}", t) for k, t in enumerate(sample(3, 25, 60, 20))] + [("none", "absent"), ("null", None), ("void", "!!"), (None, "w1 w1 w2"), ("many", " ".join(f"w{i}" for i in range(60))), ("rare", "w2999 w2998 w5"), ("é", "É é")]
    docs = [(i, t) for i, t in enumerate(texts)]
    table, bench = docs_of(spark, texts), spark.createDataFrame(items, "item_id string, text string")
    for k, options in ((20, {}), (5, {"bucket": 16, "seeds": 20}), (20, {"query_bytes": 200}), (400, {"bucket": 7})):
        got = sorted((tuple(r) for r in ranked_search(table, bench, k, **options).collect()), key=repr)
        assert got == slow_search(docs, items, k)
    twice = table.where("doc_id >= 300").unionByName(table.where("doc_id >= 300")).withColumn("doc_id", F.when(F.col("doc_id") % 5 > 0, F.col("doc_id")))
    got = sorted((tuple(r) for r in ranked_search(twice, bench, 7).collect()), key=repr)
    assert got == slow_search([(i if i % 5 else None, t) for i, t in docs[300:]] * 2, items, 7)
    assert ranked_search(docs_of(spark, []), bench).count() == 0 and ranked_search(table, bench.where("false")).count() == 0
    assert ranked_search(docs_of(spark, [None, "", "!"]), bench).count() == 0


def test_pruning():
    """Buckets and candidates are left out, and the results are those of all products."""
    import pyarrow as pa
    from segloom.llm.ranked_search import Search, _Bucket

    rng = np.random.default_rng(2)
    rows = [(i, sorted(rng.choice(400, rng.integers(1, 30), replace=False, p=np.arange(400, 0, -1) / np.arange(401).sum()).tolist())) for i in range(6000)]
    rows = [(i, t, rng.integers(200_000, 900_000, len(t)).tolist()) for i, t in rows]
    rows = sorted(((i, t, x, math.sqrt(sum(v * v for v in x))) for i, t, x in rows), key=lambda r: -r[3])
    terms = [np.sort(rng.choice(400, 8, replace=False)) for _ in range(12)]
    weights = [np.where(t < 100, 300, 4000).astype(np.int64) for t in terms]
    search = Search(terms, weights, np.zeros(12, np.int64), 10)
    for at in range(0, len(rows), 256):
        part = rows[at : at + 256]
        search.bucket(_Bucket([pa.RecordBatch.from_arrays([pa.array([r[0] for r in part]), pa.array([r[1] for r in part], pa.list_(pa.int32())), pa.array([r[2] for r in part], pa.list_(pa.int32())), pa.array([r[3] for r in part])], names=["id", "terms", "impacts", "length"])]))
    for q in range(12):
        weight = dict(zip(terms[q].tolist(), weights[q].tolist(), strict=True))
        full = sorted((-sum(weight.get(t, 0) * x for t, x in zip(r[1], r[2], strict=True)), r[0]) for r in rows)
        assert [(-s, d) for s, d in zip(search.best[q][0].tolist(), search.best[q][1].tolist(), strict=True)] == full[:10]
    assert search.pruned > 1000 and search.scored < search.candidates < 12 * 6000 - search.pruned
