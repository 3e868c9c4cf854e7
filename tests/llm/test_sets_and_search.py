"""Near-dedup and top-k search against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from feedlake.llm import near_dedup as N
from feedlake.llm.maxscore import search


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain_components(texts, percent=85):
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * len(sets[a] | sets[b]):
                    parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i), root(i) == i) for i in texts}


def edited(r, words, edits):
    w = list(words)
    for _ in range(edits):
        w[r.randrange(len(w))] = f"e{r.randrange(10 ** 6)}"
    return " ".join(w)


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(8)
    vocab = [f"v{i}" for i in range(400)]
    texts = [None, "", "  \n ", "one", "ONE", "a b c d", "a b c d", "a b c d e", "É b c d e f"]
    for _ in range(6):                  # groups whose members are at times linked only through others
        base = r.choices(vocab, k=150)
        texts += [edited(r, base, r.choice([0, 1, 2, 3, 4, 5, 6])) for _ in range(25)]
    shared = r.choices(vocab, k=60)
    texts += [" ".join(shared + r.choices(vocab, k=r.randint(5, 60))) for _ in range(30)]
    chain = r.choices(vocab, k=300)     # each linked with the next only
    for _ in range(20):
        texts.append(" ".join(chain))
        for _ in range(3):
            chain[r.randrange(len(chain))] = f"c{r.randrange(10 ** 6)}"
    r.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("rep", F.lit(1))
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in N.near_duplicates(df.repartition(5)).collect()}
    assert got == plain_components(dict(enumerate(texts)))


def test_limits_follow_the_threshold():
    assert N.limits(85) == (32, 80, 45, 420) and N.limits(80).bands == 40 and N.limits(100) == (32, 0, 0, 0)
    r = np.random.default_rng(4)
    values, off = [], [0]
    for _ in range(1000):               # pairs at similarity 0.8
        x = r.integers(0, 1 << 63, 100, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for part in (x[:90], x[10:]):
            values.append(np.sort(part))
            off.append(off[-1] + 90)
    values, off = np.concatenate(values), np.array(off)
    samples = N.samples_of(values, off, N.WIDE_SAMPLES)
    for count, bits, limit in ((N.SAMPLES, N.SKETCH, N.limits(80).sketch), (N.WIDE_SAMPLES, N.WIDE, N.limits(80).wide)):
        sk = N.odd_sketch(samples[:, :count], bits)
        apart = np.bitwise_count(sk[::2] ^ sk[1::2]).sum(1)
        mean, deviation = N.differing(count, bits, 0.8)
        assert abs(apart.mean() - mean) < 0.2 * deviation and abs(apart.std() / deviation - 1) < 0.15
        assert apart.max() <= limit
    assert apart.max() > 420            # the wide limit of 0.85 would lose some
    keys, _ = N.sketches(values, off, 40)
    assert (keys[::2] == keys[1::2]).any(1).all()


def test_pipeline_stage_against_brute_force(spark):
    """The stage takes 0.8 or more: of the groups, many links lie between 0.80 and 0.85."""
    r = random.Random(14)
    vocab = [f"v{i}" for i in range(400)]
    texts = []
    for size in (60, 100, 150):
        base = r.choices(vocab, k=size)
        texts += [edited(r, base, r.choice([1, 2, 3])) for _ in range(30)]
    chain = r.choices(vocab, k=200)     # each at 0.80 to 0.84 with the next only
    for _ in range(20):
        texts.append(" ".join(chain))
        for k in range(r.randint(0, 30), 200, 50):
            chain[k] = f"c{r.randrange(10 ** 6)}"
    r.shuffle(texts)
    plain = {p: {i for i, x in plain_components(dict(enumerate(texts)), p).items() if x[2]} for p in (80, 85)}
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {x.doc_id for x in corpus_pipeline.near_dedup(spark, df.repartition(5), "").collect()}
    assert got == plain[80] and len(plain[80]) < len(plain[85])


def test_blocks_find_what_stars_miss(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 3)
    monkeypatch.setattr(N, "SALTED", 2)
    r = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    texts = [edited(r, base, 5) for _ in range(40)] + [" ".join(base)]      # copies meet in the base, which comes last
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in N.near_duplicates(df).collect()}
    assert got == plain_components(dict(enumerate(texts)))


@pytest.mark.parametrize("lot", [250_000, 7])
def test_components_of_a_path(spark, monkeypatch, lot):
    monkeypatch.setattr(N, "LOT", lot)
    n = 60
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(100, 101), (5, 5)], "a long, b long").repartition(12)
    got = {r.node: r.component for r in N.components(edges).collect()}
    assert got == {**{i: 0 for i in range(n)}, 100: 100, 101: 100}


def test_dropping_keeps_one_of_each_group(spark):
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (3, "other text of five words"), (3, "other text of five words"), (4, None), (5, ""), (None, "a b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", F.lit(7))
    out = N.drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or -1, r.text) for r in out.collect() if r.doc_id != 4) == [(-1, "a b c d e f"), (1, "a b c d e f"), (3, "other text of five words"), (5, "")]
    assert N.drop_near_duplicates(df.limit(0)).count() == 0
    assert N.near_duplicates(df.limit(0)).count() == 0


def test_one_very_long_text(spark):
    text = " ".join(f"w{i % 5000}" for i in range(200_000))
    df = spark.createDataFrame([(1, text), (2, text + " end"), (3, "x" * 2_000_000)], "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in N.near_duplicates(df).collect()}
    assert got == {1: (1, 5000), 2: (1, 5001), 3: (3, 1)}


# --- search
def plain_top(rows, k=5):
    ok = [(i, np.array([int(np.floor(256 * float(x))) for x in v])) for i, v in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = defaultdict(list)
    for q, a in ok:
        if q % 50 == 0:
            n = lambda b: min(len(a), len(b))
            scored = sorted(((-int(a[:n(b)] @ b[:n(b)]), i) for i, b in ok if i != q))[:k]
            out[q] = [(rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    return {q: v for q, v in out.items() if v}


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("x")).withColumn("score", F.lit(0))
    got = defaultdict(list)
    for r in search(df, F.col("id") % 50 == 0, **more).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in got.items()}


def test_search_against_brute_force(spark, monkeypatch):
    from feedlake.llm import maxscore as M

    monkeypatch.setattr(M, "SHARD", 90)
    monkeypatch.setattr(M, "BLOCK", 4)
    r = np.random.default_rng(5)
    vectors = r.normal(0, 0.2, (700, 24)).astype(np.float32)
    vectors[100:160] = vectors[100]                 # ties
    vectors[300:320] = 0
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(1000, None), (1001, [None] * 24), (1002, [float("nan")] * 24), (1050, [float("inf")] * 24), (None, [1.0] * 24), (1100, [0.5] * 3), (1150, [])]
    assert found(spark, rows) == plain_top(rows)


def test_search_small_tables(spark):
    assert found(spark, []) == {}
    assert found(spark, [(0, [1.0, 2.0])]) == {}
    rows = [(0, [1.0, -1.0]), (1, [0.5, 0.5]), (50, [-1.0, 0.0])]
    assert found(spark, rows) == plain_top(rows)


def test_close_pairs_are_no_rows(spark, monkeypatch):
    """Of a group whose pairs are all close but mostly no links, no row is made of each pair, and no link is lost."""
    texts = []
    for k in range(310):        # any two at 75 of 95 shingles, but those that have a word in common
        words = [f"w{n}" for n in range(89)]
        words[20], words[60] = f"x{k % 300}", f"y{k}"
        texts.append(" ".join(words))
    sets = [frozenset(zip(*[t.split()[k:] for k in range(5)])) for t in texts]
    parent = list(range(len(sets)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    made, confirm, lists = [], N.confirm, getattr(N, "confirm_lists", None)
    monkeypatch.setattr(N, "confirm", lambda pairs, *a: (made.append(pairs.count()), confirm(pairs, *a))[1])
    monkeypatch.setattr(N, "confirm_lists", lambda rows, *a: (made.append(rows.count()), lists(rows, *a))[1], raising=False)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in N.near_duplicates(docs, percent=80).collect()}
    assert got == {k: top(k) for k in range(len(sets))}
    assert sum(made) < 30 * len(texts), made
