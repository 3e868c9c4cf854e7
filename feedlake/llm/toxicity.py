"""Toxicity (10): a bidirectional gated recurrent network with attention pooling, in numpy.

Each word of a text is an input vector of a learned word vector, the mean of its character trigrams' vectors, and
one number that says how much more often than chance the word stood in toxic training documents.  Windows of 32
words that overlap by half run through a forward and a backward gated recurrent layer; attention pools their states
and a logistic output scores the window.  Every window of a text is scored; the text's score is that of its highest
window, calibrated on training documents that were set aside.

Training takes a bounded sample of labelled documents (``sample``, about).  A training document sees the words'
numbers without its own part in them, as an unseen document would.  A label names a whole document, so each
document is learnt by its highest window: first by the words' own numbers, then by the network's scores.  Documents
with the same two MinHash samples of their 5-word shingles are near copies and count once.

Scoring keeps the inputs' products with the first weight matrices for known words, so that a step costs a look-up
and one small product.  Cases: null and empty texts, and texts without letters, get the middle score of clean training
documents; with no labels, or one label only, every score is that label's share (0 without labels); null labels and ids are
not learnt from; repeated rows give repeated rows; clashing extra columns are not read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.arrowtext import U64, column, give_back, hashed_words, mix, ship
from feedlake.llm.langid import LETTERS, characters, fold, grams, lowered

STEPS, STRIDE = 32, 16
HIDDEN, WORD, CHARS, BUCKETS = 8, 8, 6, 2048
VOCABULARY = 20_000


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word positions of all windows of a run (rows of STEPS, -1 beyond the text's end), and the row of each."""
    n = np.diff(first)
    count = np.where(n > STEPS, -(-(n - STEPS) // STRIDE) + 1, (n > 0).astype(int))
    row = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = (first[:-1][row] + nth * STRIDE)[:, None] + np.arange(STEPS)
    return np.where(at < first[1:][row][:, None], at, -1), row


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class BiGRU:
    """Weights and the two ways through the network.  ``vocab``: sorted word hashes; ``odds``: their numbers."""

    def __init__(self, vocab: np.ndarray, odds: np.ndarray, seed: int = 17):
        r = np.random.default_rng(seed)
        size = WORD + CHARS + 1
        self.vocab, self.odds = vocab, odds.astype(np.float32)
        self.p = {"word": r.normal(0, 0.1, (len(vocab) + 1, WORD)), "char": r.normal(0, 0.1, (BUCKETS, CHARS)),
                  "attend": r.normal(0, 0.3, 2 * HIDDEN), "out": r.normal(0, 0.3, 2 * HIDDEN), "bias": np.zeros(1)}
        for d in "fb":
            self.p["w" + d] = r.normal(0, size ** -0.5, (size, 3 * HIDDEN))
            self.p["u" + d] = r.normal(0, HIDDEN ** -0.5, (HIDDEN, 3 * HIDDEN))
            self.p["b" + d] = np.zeros(3 * HIDDEN)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.scale, self.shift, self.known, self.wordless = 1.0, 0.0, None, 0.0

    # --- inputs
    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Rows of the word table; the last row stands for unknown words."""
        n = len(self.vocab)
        if not n:
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.vocab, h), n - 1)
        return np.where(self.vocab[at] == h, at, n)

    def inputs(self, rows: np.ndarray, bucket: np.ndarray, owner: np.ndarray, odds: np.ndarray | None = None):
        """Input vectors of words given their table rows and character buckets (``owner``: word of each bucket)."""
        n = len(rows)
        count = np.maximum(1, np.bincount(owner, minlength=n)).astype(np.float32)
        vectors = self.p["char"][bucket]
        chars = np.stack([np.bincount(owner, vectors[:, k], minlength=n) for k in range(CHARS)], 1).astype(np.float32) / count[:, None]
        if odds is None:
            odds = np.append(self.odds, np.float32(0))[rows]
        return np.concatenate([self.p["word"][rows], chars, odds[:, None]], 1), count

    # --- the network on windows of word numbers
    def forward(self, x: np.ndarray, at: np.ndarray, keep: bool = False):
        """Logits of windows; ``x``: input products by direction {d: (words + 1, 3H)}, ``at``: word numbers, the
        last one for steps beyond the end."""
        p, (n, steps) = self.p, at.shape
        pad = len(x["f"]) - 1
        live = at != pad
        states = np.empty((steps, n, 2 * HIDDEN), np.float32)
        saved: dict[str, list] = {"f": [], "b": []}
        for d, order, lo in (("f", range(steps), 0), ("b", range(steps - 1, -1, -1), HIDDEN)):
            u, xd = p["u" + d], x[d]
            h = np.zeros((n, HIDDEN), np.float32)
            for t in order:
                g = xd[at[:, t]]
                hu = h @ u
                zr = sigmoid(g[:, :2 * HIDDEN] + hu[:, :2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(g[:, 2 * HIDDEN:] + r * hu[:, 2 * HIDDEN:])
                new = h + z * (c - h)
                if not live[:, t].all():
                    new = np.where(live[:, t, None], new, h)
                if keep:
                    saved[d].append((t, h, z, r, c, hu[:, 2 * HIDDEN:]))
                h = new
                states[t, :, lo:lo + HIDDEN] = h
        e = np.where(live.T, states @ p["attend"], np.float32(-1e9))
        a = np.exp(e - e.max(0))
        a *= live.T
        a /= np.maximum(a.sum(0), np.float32(1e-9))
        pooled = np.einsum("tn,tnh->nh", a, states)
        logit = pooled @ p["out"] + p["bias"][0]
        return (logit, (live, states, a, pooled, saved)) if keep else logit

    def backward(self, x_words, x, at, dlogit, kept):
        """Gradients for all weights but the input tables, and for the input vectors."""
        p, (n, steps) = self.p, at.shape
        live, states, a, pooled, saved = kept
        g = {"out": pooled.T @ dlogit, "bias": np.array([dlogit.sum()], np.float32)}
        dpool = dlogit[:, None] * p["out"]
        da = np.einsum("nh,tnh->tn", dpool, states)
        de = a * (da - (a * da).sum(0))
        g["attend"] = np.einsum("tn,tnh->h", de, states)
        dstates = a[:, :, None] * dpool[None] + de[:, :, None] * p["attend"]
        dx = np.zeros_like(x_words)
        for d, lo in (("f", 0), ("b", HIDDEN)):
            u = p["u" + d]
            du, dprod = np.zeros_like(u), np.zeros_like(x[d])
            dh = np.zeros((n, HIDDEN), np.float32)
            for t, h, z, r, c, hu in reversed(saved[d]):
                dh = dh + dstates[t, :, lo:lo + HIDDEN]
                m = live[:, t, None]
                step = np.where(m, dh, 0)
                dc = step * z * (1 - c * c)
                dz = step * (c - h) * z * (1 - z)
                dr = dc * hu * r * (1 - r)
                gate = np.concatenate([dz, dr, dc], 1)
                np.add.at(dprod, at[:, t], gate)
                through = np.concatenate([dz, dr, dc * r], 1)
                du += h.T @ through
                dh = np.where(m, step * (1 - z), dh) + through @ u.T
            dprod = dprod[:-1]                                   # the last row is the padding
            g["u" + d], g["b" + d], g["w" + d] = du, dprod.sum(0), x_words.T @ dprod
            dx += dprod @ p["w" + d].T
        return g, dx

    def products(self, x_words: np.ndarray) -> dict[str, np.ndarray]:
        zero = np.zeros((1, 3 * HIDDEN), np.float32)
        return {d: np.concatenate([x_words @ self.p["w" + d] + self.p["b" + d], zero]) for d in "fb"}

    def freeze(self, bucket: np.ndarray, owner: np.ndarray) -> None:
        """Keep the products of the known words (their character buckets given)."""
        x, _ = self.inputs(np.arange(len(self.vocab)), bucket, owner)
        self.known = {d: (x @ self.p["w" + d] + self.p["b" + d]).astype(np.float32) for d in "fb"}

    # --- texts
    def text_logits(self, arr: pa.Array) -> np.ndarray:
        """Of each text, the logit of its highest window; texts without words have ``wordless``."""
        out = np.full(len(arr), self.wordless, np.float32)
        for i, j, low, starts, ends, h, first in hashed_words(lowered(arr), LETTERS):
            if not len(h):
                continue
            value, one, number = np.unique(h, return_index=True, return_inverse=True)
            rows = self.lookup(value)
            x = {d: np.zeros((len(value) + 1, 3 * HIDDEN), np.float32) for d in "fb"}
            seen = np.flatnonzero(rows < len(self.vocab))
            new = np.flatnonzero(rows == len(self.vocab))
            for d in "fb":
                x[d][seen] = self.known[d][rows[seen]]
            if len(new):
                cp, word = characters(low, starts[one[new]], ends[one[new]])
                gram, owner = grams(cp, word, 3)
                vectors, _ = self.inputs(rows[new], (gram % U64(BUCKETS)).astype(np.int64), owner)
                for d in "fb":
                    x[d][new] = vectors @ self.p["w" + d] + self.p["b" + d]
            at, row = windows(first)
            numbered = np.append(number, len(value))[at]
            logit = np.concatenate([self.forward(x, numbered[k:k + 4096]) for k in range(0, len(at), 4096)])
            begin = np.flatnonzero(np.diff(row, prepend=-1))        # a row's windows stand together
            out[i + row[begin]] = np.maximum.reduceat(logit, begin)
        return out

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale * logit.astype(float) + self.shift)


class Prior:
    """Stands in when there is nothing to learn from: one score for every text."""

    def __init__(self, share: float):
        self.share = share

    def text_logits(self, arr: pa.Array) -> np.ndarray:
        return np.zeros(len(arr), np.float32)

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return np.full(len(logit), self.share)


class Chars:
    """The character buckets of numbered words, in one array: a word stands at its first occurrence."""

    def __init__(self, value: np.ndarray, named: list, lengths: list, buckets: list):
        names, n = np.concatenate(named), np.concatenate(lengths)
        begin = np.concatenate([[0], np.cumsum(n)[:-1]])
        _, at = np.unique(names, return_index=True)         # ``value`` has the same words in the same order
        self.flat, self.begin, self.n = np.concatenate(buckets), begin[at], n[at]

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' buckets, and the place of each bucket's word."""
        n = self.n[words]
        owner = np.repeat(np.arange(len(words)), n)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.begin[words], n)
        return self.flat[at].astype(np.int64), owner


def fit(texts: list[str], labels: np.ndarray, seed: int = 23) -> BiGRU | Prior:
    """Train on documents held in memory."""
    labels = np.asarray(labels, float)
    if len(set(labels.tolist())) < 2:
        return Prior(float(labels.mean()) if len(labels) else 0.0)
    # words of all documents, each distinct word numbered, with the buckets of its character grams side by side
    hashes, sizes, named, lengths, buckets = [], [], [], [], []
    for i, j, low, starts, ends, h, first in hashed_words(lowered(pa.array(texts, pa.string())), LETTERS):
        hashes.append(h)
        sizes.append(np.diff(first))
        value, one = np.unique(h, return_index=True)
        if len(value):
            cp, word = characters(low, starts[one], ends[one])
            gram, owner = grams(cp, word, 3)
            named.append(value)
            lengths.append(np.bincount(owner, minlength=len(value)))
            buckets.append((gram % U64(BUCKETS)).astype(np.int16))
    h = np.concatenate(hashes)
    first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    # near copies count once
    seen, use = set(), []
    for d in range(len(texts)):
        w = h[first[d]:first[d + 1]]
        if len(w) >= 5:
            s = mix(w[:-4] + w[1:-3] * U64(3) + w[2:-2] * U64(5) + w[3:-1] * U64(7) + w[4:] * U64(11))
            key = (int(s.min()), int((s * U64(0x9E3779B97F4A7C15)).min()))
            if key in seen:
                continue
            seen.add(key)
        if len(w):
            use.append(d)
    use = np.array(use, int)
    value, number = np.unique(h, return_inverse=True)
    del hashes, sizes
    chars = Chars(value, named, lengths, buckets)
    del named, lengths, buckets
    # document counts by label, of training documents only
    rng = np.random.default_rng(seed)
    held = np.zeros(len(texts), bool)
    for y in (0.0, 1.0):
        own = rng.permutation(use[labels[use] == y])
        held[own[:len(own) // 4]] = True
    train = use[~held[use]]
    if len(set(labels[train].tolist())) < 2:
        return Prior(float(labels.mean()))
    both = np.zeros((2, len(value)))
    for d in train:
        both[int(labels[d]), np.unique(number[first[d]:first[d + 1]])] += 1
    share, many = labels[train].mean(), len(value)

    def more_than_chance(toxic: np.ndarray, df: np.ndarray) -> np.ndarray:
        return np.clip((toxic - df * share) / np.sqrt(np.maximum(df, 0) * share + 4), -6, 6) / 3

    df = both.sum(0)
    odds = more_than_chance(both[1], df)
    order = np.argsort(-(df + 1e6 * (np.abs(odds) > 0.8)), kind="stable")[:VOCABULARY]
    vocab_at = np.sort(order[df[order] > 1])
    net = BiGRU(value[vocab_at], odds[vocab_at])
    # each word three times: as others see it, and as a clean or a toxic training document sees it without itself
    rows = np.tile(net.lookup(value), 3)
    seen_odds = np.concatenate([odds, more_than_chance(both[1], df - 1), more_than_chance(both[1] - 1, df - 1)])
    seen_odds = np.where(rows < len(net.vocab), seen_odds, 0).astype(np.float32)
    in_train = np.zeros(len(texts), bool)
    in_train[train] = True
    at, owner_doc = windows(first)
    version = np.where(in_train, 1 + labels.astype(int), 0)[owner_doc]
    padded = np.empty(at.shape, np.int32)
    for k in range(0, len(at), 4096):
        part = at[k:k + 4096]
        padded[k:k + 4096] = np.where(part >= 0, number[part] + many * version[k:k + 4096, None], 3 * many)
    del at
    guess = np.concatenate([np.maximum(np.append(seen_odds, 0)[padded[k:k + 4096]], 0).sum(1) for k in range(0, len(padded), 4096)])

    def batch_inputs(win):
        words, local = np.unique(win, return_inverse=True)
        local = local.reshape(win.shape)
        if words[-1] == 3 * many:
            words = words[:-1]
        bucket, owner = chars.of(words % many)
        x, count = net.inputs(rows[words], bucket, owner, seen_odds[words])
        return words, local, bucket, owner, x, count

    def all_logits():
        """Logits of all windows, some at a time."""
        out = []
        for k in range(0, len(padded), 2048):
            _, local, _, _, x, _ = batch_inputs(padded[k:k + 2048])
            out.append(net.forward(net.products(x), local))
        return np.concatenate(out)

    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for stage, epochs in enumerate((4, 3, 3)):
        if stage:
            guess = all_logits()
        top: dict[int, int] = {}
        for k in np.argsort(guess, kind="stable").tolist():       # the last one stays: the highest
            top[int(owner_doc[k])] = k
        chosen = [(k, labels[d]) for d, k in top.items() if in_train[d]]
        spare = np.flatnonzero(in_train[owner_doc] & (labels[owner_doc] == 0))
        chosen += [(int(k), 0.0) for k in rng.choice(spare, min(len(spare), 2 * len(chosen)), replace=False)]
        ks, ys = np.array([k for k, _ in chosen]), np.array([y for _, y in chosen], np.float32)
        weight = np.where(ys > 0, np.sqrt((1 - ys).sum() / max(1, ys.sum())), 1).astype(np.float32)
        for _ in range(max(epochs, -(-epochs * 2500 // len(ks)))):
            shuffle = rng.permutation(len(ks))
            for b in range(0, len(ks), 128):
                pick = shuffle[b:b + 128]
                words, local, bucket, owner, xw, count = batch_inputs(padded[ks[pick]])
                x = net.products(xw)
                logit, kept = net.forward(x, local, keep=True)
                dlogit = (weight[pick] * (sigmoid(logit) - ys[pick]) / len(pick)).astype(np.float32)
                g, dx = net.backward(xw, x, local, dlogit, kept)
                g["word"] = np.zeros_like(net.p["word"])
                np.add.at(g["word"], rows[words], dx[:, :WORD])
                g["char"] = np.zeros_like(net.p["char"])
                np.add.at(g["char"], bucket, (dx[:, WORD:WORD + CHARS] / count[:, None])[owner])
                step += 1
                for name in net.p:
                    m[name] += 0.1 * (g[name] - m[name])
                    v2[name] += 0.001 * (g[name] ** 2 - v2[name])
                    if name in ("word", "char"):            # few documents hold a rare word: keep its vectors small
                        net.p[name] *= 1 - min(0.02, 20 / len(ks))
                    net.p[name] -= ((0.004 if name in ("word", "char") else 0.01) * (m[name] / (1 - 0.9 ** step)) / (np.sqrt(v2[name] / (1 - 0.999 ** step)) + 1e-7)).astype(np.float32)
    net.freeze(*chars.of(vocab_at))
    logit = all_logits()
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, owner_doc, logit)
    net.wordless = float(np.median(best[use[labels[use] == 0]]))
    check = np.flatnonzero(held & np.isfinite(best))
    if len(set(labels[check].tolist())) == 2:
        mean, spread = best[check].mean(), best[check].std() + 1e-6
        z, y, a, b = (best[check] - mean) / spread, labels[check], 1.0, 0.0
        for _ in range(2000):
            q = sigmoid(a * z + b)
            a, b = max(0.1, a - 0.5 * np.mean((q - y) * z)), b - 0.5 * np.mean(q - y)
        net.scale, net.shift = float(a / spread), float(b - a * mean / spread)
    return net


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          sample: int = 4_000, folds: int = 5) -> BiGRU | Prior:
    """A network from at most ``sample`` labelled documents whose fold is not 0, the first by a hash of their ids; of an
    id with several labels or texts the greatest label and the least text.  One task trains it and returns it."""
    spark = docs.sparkSession
    ship(spark)
    own = labels.select(labels[id_col].alias("id"), labels[label_col].cast("double").alias("label"))
    own = own.where((fold(F.col("id"), folds) != 0) & F.col("label").isNotNull()).groupBy("id").agg(F.max("label").alias("label"))
    own = own.orderBy(F.xxhash64("id"), "id").limit(sample)
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).where(F.col("text").isNotNull())
    rows = src.join(F.broadcast(own), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label"))

    def run(batches):
        found = [x for b in batches for x in zip(*(column(b, c).to_pylist() for c in ("id", "text", "label")))]
        found.sort(key=lambda r: r[0])
        net = fit([r[1] for r in found], np.array([float(r[2] > 0) for r in found]))
        del found
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], ["net"])

    got = rows.repartition(1).mapInArrow(run, "net binary").collect()
    return pickle.loads(got[0]["net"]) if got else fit([], np.zeros(0))


def score(docs: DataFrame, model: BiGRU | Prior, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"),
                      F.coalesce(fold(docs[id_col], folds) == 0, F.lit(False)).alias("held_out"))
    return _scored(src, model).select(F.col("id").alias(id_col), "held_out", "score",
                                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _scored(src: DataFrame, model: BiGRU | Prior) -> DataFrame:
    """``src`` (text, ...) with the score in the text's place."""
    spark = src.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    names = [c for c in src.columns if c != "text"]

    def run(batches):
        m = sent.value
        for b in batches:
            p = m.probability(m.text_logits(column(b, "text")))
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in names), pa.array(p, pa.float64())], [*names, "score"])
        give_back()

    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema if f.name != "text")
    return src.mapInArrow(run, ddl + "score double")


def reject_toxic(docs: DataFrame, model: BiGRU | Prior, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents whose score is below ``threshold``, same columns."""
    src = docs.select(docs[text_col].alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return _scored(src, model).where(F.col("score") < threshold).select(*[F.col("row")[c].alias(c) for c in docs.columns])
