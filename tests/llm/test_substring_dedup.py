"""Substring dedup against brute force."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from feedlake.llm import substring_dedup as D


def plain(docs, window):
    """docs: list of (id, text) -> list of (id, words, removed, kept)."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    first = {}
    for (i, _), w in zip(docs, split):
        for k in range(len(w) - window + 1):
            x = tuple(w[k:k + window])
            if i is not None:
                first[x] = min(first.get(x, i), i)
    out = []
    for (i, _), w in zip(docs, split):
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k:k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def check(spark, docs, window, **types):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("row", F.lit(1)).withColumn("found", F.lit(2))
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in D.drop_repeats(df.repartition(5), window=window).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(got, key=key) == sorted(plain(docs, window), key=key)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(D, "LOT", 4)                    # references split over many lots
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    say = lambda n: r.choices(vocab, k=n)
    passages = [say(n) for n in (12, 13, 20, 25, 40, 90)]
    docs = []
    for i in range(160):
        w = say(r.randint(0, 50))
        for _ in range(r.randint(0, 3)):
            p = list(r.choice(passages))
            if r.random() < .4:                         # a variant, which others may share though the first holder does not
                p[r.choice([3, 7, 11])] = r.choice("xy")
            w += p + say(r.randint(0, 15))
        docs.append([i * 3, "\t".join(w[:9]) + " \n" + " ".join(w[9:])])
    docs += [[i + 1000, docs[r.randrange(160)][1]] for i in range(30)]       # exact copies
    base = say(120)
    docs += [[2000 + i, " ".join(base[r.randint(0, 60):])] for i in range(30)]
    docs += [[5000 + i, " ".join(["z"] * n)] for i, n in enumerate((11, 12, 30, 200))]      # one word over and over
    docs += [docs[3], docs[40], [None, docs[3][1]], [docs[5][0], docs[6][1]], [7777, None], [7778, ""], [7779, " \n "], [7780, "É é"]]
    r.shuffle(docs)
    check(spark, [tuple(d) for d in docs], 12)


def test_long_texts_and_production_window(spark):
    r = random.Random(5)
    vocab = [f"é{i}" for i in range(2000)]
    long = r.choices(vocab, k=60_000)
    shared = r.choices(vocab, k=55)
    docs = [(1, " ".join(long)), (2, " ".join(long[30_000:30_049])), (3, " ".join(long[30_000:30_050])), (4, " ".join(long[100:500] + ["x"] + long[400:460])),
            (9, " ".join(r.choices(vocab, k=70) + shared)), (5, " ".join(shared + r.choices(vocab, k=70))), (6, " ".join(shared[1:51] + shared[:50]))]
    check(spark, docs, 50)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert D.drop_repeats(df).collect() == [] and D.drop_repeats(df).columns == ["doc_id", "n_words", "n_removed", "kept"]


def test_anchor_is_the_first_least_gram():
    r = np.random.default_rng(1)
    h = r.integers(0, 5, 300).astype(np.uint64)
    at, grams = D.anchors(h, 17)
    assert at.tolist() == [s + int(np.argmin(grams[s:s + 8] & ~D.PLACE)) for s in range(300 - 17 + 1)]
    assert len(D.anchors(h[:16], 17)[0]) == 0


def test_matching_statistics():
    r = random.Random(2)
    refs = [[r.randrange(3) for _ in range(r.randint(0, 30))] for _ in range(6)]
    a = D.Automaton()
    for x in refs:
        a.add(x)
    text = [r.randrange(4) for _ in range(200)]
    held = {tuple(x[i:j]) for x in refs for i in range(len(x)) for j in range(i, len(x) + 1)}
    want = [max(n for n in range(k + 2) if tuple(text[k + 1 - n:k + 1]) in held) for k in range(len(text))]
    assert a.matching(text).tolist() == want
