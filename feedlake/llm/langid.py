"""Language identification (8): word-first backoff.

Training counts words and character n-grams (orders 1 to 5, over word types, with word ends marked) for each
language on a bounded sample of labelled documents, as many of each language where there are as many.  A text's known words score by their log frequency in each
language; an unseen word falls back to its known n-grams of the longest order that has any, then to shorter ones.
The scores of all words add up, and their softmax gives the answer's probability.

Words and n-grams are handled as 64-bit hashes of lower-cased letters, so that a whole run of texts is scored by
array operations.  The model's size is bounded by the sample (``sample`` documents, about), whatever the corpus.

Cases: null texts and texts without a letter get ``und`` with score 0; with nothing to learn from, every text gets
``und``; rows without a label are scored only; a null id counts as neither held out nor learnable; repeated rows
give repeated rows; of languages that score the same, the first by name is given; whole texts are read, whatever
their length; clashing extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake.llm.arrowtext import U64, byte_class, column, hashed_words, mix, ship

#: letters a-z after lower-casing, and every non-ASCII byte
LETTERS = byte_class((0x61, 0x7A), (0x80, 0xFF))
ORDERS = (5, 4, 3, 2, 1)
SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def fold(id_col: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds))


def characters(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the given words, each word between two marks, and the word of each code point."""
    raw = low.tobytes()
    text = "".join("\x02" + raw[s:e].decode("utf-8", "replace") + "\x03" for s, e in zip(starts.tolist(), ends.tolist()))
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return cp, np.cumsum(cp == 2) - 1


def grams(cp: np.ndarray, word: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of one order, and the word of each.  Order 1 leaves the marks out."""
    n = len(cp) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(order):
        h += cp[k:k + n].astype(np.uint64) * SPREAD[k]
    own = word[:n] == word[order - 1:order - 1 + n] if order > 1 else cp > 3
    return mix(h[own] + U64(order)), word[:n][own]


class Table:
    """Sorted hashes with a row of log frequencies by language each."""

    def __init__(self, hashes: np.ndarray, rows: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.rows = hashes[order], rows[order]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row numbers, -1 where unknown."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)


class Model:
    def __init__(self, langs: list[str], tables: dict[int, Table]):
        self.langs, self.tables = langs, tables

    def unseen(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Scores of words that no table of words has: mean over the known n-grams of the longest order that has any."""
        out = np.zeros((len(starts), len(self.langs)))
        todo = np.arange(len(starts))
        for order in ORDERS:
            if not len(todo):
                break
            cp, word = characters(low, starts[todo], ends[todo])
            h, w = grams(cp, word, order)
            at = self.tables[order].find(h)
            known = at >= 0
            n = np.bincount(w[known], minlength=len(todo))
            got = n > 0
            if got.any():
                rows = self.tables[order].rows[at[known]]
                for k in range(len(self.langs)):
                    total = np.bincount(w[known], rows[:, k], minlength=len(todo))
                    out[todo[got], k] = total[got] / n[got]
            todo = todo[~got]
        return out

    def scores(self, arr: pa.Array):
        """For each run of texts: first row, end row, language scores, has words, has ASCII letters."""
        words = self.tables[0]
        for i, j, low, starts, ends, h, first in hashed_words(arr, LETTERS):
            at = words.find(h)
            rows = words.rows[at] if len(words.rows) else np.zeros((len(h), len(self.langs)))
            miss = np.flatnonzero(at < 0)
            if len(miss):
                _, one, back = np.unique(h[miss], return_index=True, return_inverse=True)
                rows[miss] = self.unseen(low, starts[miss[one]], ends[miss[one]])[back]
            total = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(rows, 0, dtype=float)])
            ascii_letters = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])
            some = first[1:] > first[:-1]
            plain = np.zeros(j - i, bool)
            plain[some] = ascii_letters[ends[first[1:][some] - 1]] > ascii_letters[starts[first[:-1][some]]]
            yield i, j, total[first[1:]] - total[first[:-1]], some, plain


def lowered(arr: pa.Array) -> pa.Array:
    return pc.utf8_lower(arr.fill_null("").cast(pa.large_string()))


def labelled_sample(src: DataFrame, sample: int) -> DataFrame:
    """Of ``src`` (id, text, lang), about ``sample / languages`` rows of each language by a hash of id and text, all of
    a language with fewer, and never more than twice as many, so that repeated rows can't exceed the bound."""
    sizes = src.groupBy("lang").count()
    each = F.greatest(F.lit(1), F.floor(F.lit(sample) / F.count("lang").over(Window.partitionBy())))
    share = sizes.select("lang", each.alias("each"), F.greatest(F.lit(1), F.floor(F.col("count") / each)).alias("share"))
    # one row a language, as the model holds a column for each
    may = src.withColumn("h", F.xxhash64("id", "text")).join(F.broadcast(share), "lang").where(F.pmod("h", "share") == 0)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("h", F.lit(1)), "id", "text"))
    return may.withColumn("place", place).where((F.col("place") <= 2 * sample) & (F.col("place") <= 2 * F.col("each"))).select("text", "lang")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 4_000,
          folds: int = 5) -> Model:
    """Counts from about ``sample`` labelled documents (all, if fewer) whose fold is not 0, shared out evenly among the
    languages, so that a rare one is learnt however large the table is."""
    ship(docs.sparkSession)
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].cast("string").alias("lang"))
    may = src.where((fold(F.col("id"), folds) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    picked = labelled_sample(may, sample)

    def tally(batches):
        for b in batches:
            lang = np.array(column(b, "lang").to_pylist(), object)
            names, which = np.unique(lang.astype(str), return_inverse=True)
            kinds, hashes, langs, counts = [], [], [], []
            for i, j, low, starts, ends, h, first in hashed_words(lowered(column(b, "text")), LETTERS):
                row = np.repeat(np.arange(i, j), np.diff(first))
                for k in range(len(names)):
                    own = np.flatnonzero(which[row] == k)
                    if not len(own):
                        continue
                    value, one, n = np.unique(h[own], return_index=True, return_counts=True)
                    found = [(0, value, n)]
                    cp, word = characters(low, starts[own[one]], ends[own[one]])
                    for order in ORDERS:
                        found.append((order, *np.unique(grams(cp, word, order)[0], return_counts=True)))
                    for order, value, n in found:
                        kinds.append(np.full(len(value), order, np.int32))
                        hashes.append(value.view(np.int64))
                        langs.append(np.full(len(value), k, np.int32))
                        counts.append(n.astype(np.int64))
            if kinds:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(kinds)), pa.array(np.concatenate(hashes)),
                     pa.array([str(x) for x in names], pa.string()).take(pa.array(np.concatenate(langs))),
                     pa.array(np.concatenate(counts))], ["kind", "hash", "lang", "n"])

    sums = (picked.mapInArrow(tally, "kind int, hash long, lang string, n long")
            .groupBy("kind", "hash", "lang").agg(F.sum("n").alias("n")))
    got = sums.toArrow()
    names = got.column("lang").combine_chunks().dictionary_encode()
    langs = sorted(names.dictionary.to_pylist())
    kind, n = got.column("kind").to_numpy(), got.column("n").to_numpy()
    value = got.column("hash").to_numpy().view(np.uint64)
    place = np.array([langs.index(x) for x in names.dictionary.to_pylist()], int)
    lang = place[names.indices.to_numpy()]
    tables = {}
    for k in (0, *ORDERS):
        own = kind == k
        hashes, at = np.unique(value[own], return_inverse=True)
        counts = np.zeros((len(hashes), len(langs)))
        counts[at, lang[own]] = n[own]
        total = counts.sum(0, keepdims=True)
        tables[k] = Table(hashes, np.log((counts + 0.5) / (total + 0.5 * max(1, len(hashes)))).astype(np.float32))
    return Model(langs, tables)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for b in batches:
            texts = column(b, "text")
            pred, score = ["und"] * len(texts), [0.0] * len(texts)
            if m.langs:
                for i, j, total, some, plain in m.scores(lowered(texts)):
                    best = total.argmax(1)
                    p = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                    for r in np.flatnonzero(some):
                        if plain[r] or any(c.isalpha() for c in texts[i + int(r)].as_py()):
                            pred[i + r], score[i + r] = m.langs[best[r]], float(p[r])
            yield pa.RecordBatch.from_arrays(
                [column(b, "id"), column(b, "held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                [id_col, "held_out", "lang_pred", "score"])

    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"),
                      F.coalesce(fold(docs[id_col], folds) == 0, F.lit(False)).alias("held_out"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")
