"""Benchmark decontamination (4): a generalised suffix automaton of the test items.

The normalised words of all items go into one suffix automaton.  A text's words are streamed through it, keeping
the length of the longest match that ends at each word; where it reaches the window (ten words, or a whole shorter
item) the words of the window are hit and the items that hold it are noted.  Hits are joined to spans, which
``decontaminate`` removes; a text covered beyond a limit goes whole.

Before the automaton, a text's words are looked up as hashes: a stretch in which some word, or some pair of
neighbours, stands in no item cannot hold a window, since the automaton would fall back there.  Only stretches of
pairs that items hold, long enough for the shortest window, are streamed.

The items are dealt to shards by size, equal items to different ones, and each shard's automaton is built in a task
of its own.  An automaton is kept as sorted arrays (about 30 bytes a state, two states a word at most) in a table in
the checkpoint folder.  A pass over the documents broadcasts ``SHARDS_A_PASS`` shards of at most ``SHARD_BYTES`` of
item text each (or of one longer item), read for that pass alone, and more items make more passes.  Documents are
never shuffled.

Cases: null and empty texts have no words; an item without words is ignored; an empty benchmark hits nothing;
texts of any length are streamed whole; repeated rows give repeated rows; repeated items count each; clashing
extra columns are kept aside.
"""

from __future__ import annotations

import pickle
from array import array
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.arrowtext import ALNUM, U64, column, hashed_words, mix, saved, ship

SHARD_BYTES = 1 << 20
SHARDS_A_PASS = 8


class Automaton:
    """Generalised suffix automaton over sequences of word numbers, with the items of each window."""

    def __init__(self, items: list[tuple[object, np.ndarray]], window: int):
        words = np.unique(np.concatenate([w for _, w in items])) if items else np.zeros(0, np.uint64)
        self.window, self.words = window, words
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(key, np.searchsorted(words, w).tolist()) for key, w in items]
        pairs = [mix(w[:-1] * U64(3) + w[1:]) for _, w in items if len(w) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.uint64)
        self.shortest = min((min(window, len(w)) for _, w in coded), default=0)
        for _, seq in coded:
            last = 0
            for c in seq:
                last = self.extend(last, c)
        n = len(self.link)
        # the state of a state's suffix of exactly ``window`` words
        self.at_window = [-1] * n
        for s in sorted(range(n), key=self.length.__getitem__):
            if self.length[s] >= window:
                up = self.link[s]
                self.at_window[s] = s if self.length[up] < window else self.at_window[up]
        self.holders: dict[int, list] = {}
        self.short: dict[int, list[tuple[int, object]]] = {}
        for key, seq in coded:
            s, seen = 0, set()
            for c in seq:
                s = self.next[s][c]
                if self.length[s] >= window and (w := self.at_window[s]) not in seen:
                    seen.add(w)
                    self.holders.setdefault(w, []).append(key)
            if len(seq) < window:
                self.short.setdefault(s, []).append((len(seq), key))
        # nearest state on the suffix path, itself included, that holds whole short items
        self.short_at = [-1] * n
        if self.short:
            for s in sorted(range(n), key=self.length.__getitem__):
                self.short_at[s] = s if s in self.short else self.short_at[self.link[s]] if s else -1
        self.freeze()

    def freeze(self) -> None:
        """Transitions as sorted (state, word) keys with their targets, and the rest as arrays, in place of dicts and lists."""
        base = len(self.words) + 1
        moves = sorted((s * base + c, t) for s, after in enumerate(self.next) for c, t in after.items())
        self.base, self.keys, self.targets = base, array("q", [k for k, _ in moves]), array("i", [t for _, t in moves])
        self.link, self.length = array("i", self.link), array("i", self.length)
        self.at_window, self.short_at = array("i", self.at_window), array("i", self.short_at)
        self.next = None

    def step(self, s: int, c: int) -> int:
        """The state after ``c``, -1 where there is none."""
        key = s * self.base + c
        i = bisect_left(self.keys, key)
        return self.targets[i] if i < len(self.keys) and self.keys[i] == key else -1

    def state(self, length: int, link: int, after: dict[int, int]) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def extend(self, last: int, c: int) -> int:
        """The state of the sequence read so far and ``c``, made where it is missing."""
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self.split(last, c, q)
        new = self.state(length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self.split(p, c, q)
        return new

    def split(self, p: int, c: int, q: int) -> int:
        nxt = self.next
        clone = self.state(self.length[p] + 1, self.link[q], dict(nxt[q]))
        self.link[q] = clone
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = self.link[p]
        return clone

    def stretches(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
        """Word ranges of one text each that may hold a window."""
        if not len(self.words) or not len(h):
            return []
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        known = self.words[at] == h
        if self.shortest <= 1:
            ok, extra = known, 0            # ranges of known words
            edge = np.zeros(len(h), bool)
            edge[first[:-1][first[:-1] < len(h)]] = True
        else:
            both = np.flatnonzero(known[:-1] & known[1:])
            ok, extra = np.zeros(len(h) - 1, bool), 1
            if len(both) and len(self.pairs):
                p = mix(h[both] * U64(3) + h[both + 1])
                i = np.minimum(np.searchsorted(self.pairs, p), len(self.pairs) - 1)
                ok[both[self.pairs[i] == p]] = True
            cut = first[1:-1]
            ok[cut[(cut > 0) & (cut < len(h))] - 1] = False      # no pair across two texts
            edge = np.zeros(len(ok), bool)
        begin = ok.copy()
        begin[1:] &= ~ok[:-1] | edge[1:]
        end = ok.copy()
        end[:-1] &= ~ok[1:] | edge[1:]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1 + extra
        long = ends - starts >= self.shortest
        return list(zip(starts[long].tolist(), ends[long].tolist()))

    def stream(self, codes: list[int], base: int, hits: list[tuple[int, int]], found: set) -> int:
        """Walk one stretch; notes word ranges and items, gives the longest match."""
        link, length, window = self.link, self.length, self.window
        s = matched = longest = 0
        for i, c in enumerate(codes, base):
            t = self.step(s, c)
            while s and t < 0:
                s = link[s]
                matched = length[s]
                t = self.step(s, c)
            if t >= 0:
                s = t
                matched += 1
            longest = max(longest, matched)
            if matched >= window:
                hits.append((i + 1 - window, i + 1))
                found.update(self.holders.get(self.at_window[s], ()))
            if self.short:
                t, limit = self.short_at[s], matched
                while t > 0:
                    for n, key in self.short[t]:
                        if n <= limit:
                            hits.append((i + 1 - n, i + 1))
                            found.add(key)
                    t = self.short_at[link[t]]
        return longest

    def codes(self, h: np.ndarray) -> list[int]:
        return np.searchsorted(self.words, h).tolist()


def joined(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that meet or overlap, as one."""
    out: list[list[int]] = []
    for a, b in sorted(hits):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def shards(items: DataFrame, item_col: str, text_col: str, window: int) -> tuple[DataFrame, int]:
    """A written table (shard, automaton) of the pickled automata, of about half of SHARD_BYTES of text or one longer
    item each, and the number of shards."""
    src = items.select(F.col(item_col).alias("key"), F.coalesce(text_col, F.lit("")).alias("text"))
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * size // SHARD_BYTES)) if size > SHARD_BYTES else 1

    def build(table: pa.Table) -> pa.Table:
        found = []
        keys = table.column("key").to_pylist()
        texts = table.column("text").combine_chunks()
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts.to_pylist(), pa.string())
        for i, j, _, _, _, h, first in hashed_words(texts, ALNUM):
            found += [(keys[r], h[first[r - i]:first[r - i + 1]]) for r in range(i, j) if first[r - i + 1] > first[r - i]]
        return pa.table({"shard": table.column("shard")[:1], "automaton": pa.array([pickle.dumps(Automaton(found, window))], pa.binary())})

    # the item's id in the hash: equal texts are spread, and each shard names its own items
    built = (src.withColumn("shard", F.pmod(F.xxhash64("text", "key"), F.lit(n))).groupBy("shard")
             .applyInArrow(build, "shard long, automaton binary"))
    return saved(built, "automata"), n


@lru_cache(SHARDS_A_PASS)
def _unpacked(blob: bytes) -> Automaton:
    return pickle.loads(blob)


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """One row per document: ``id_col``, n_words, n_hit, items (array of text, sorted), longest (words of the longest
    match streamed), spans (array of UTF-8 byte ranges of hit words, end exclusive)."""
    return _probe(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")),
                  items, item_col, item_text_col, window).select(
        F.col("id").alias(id_col), "n_words", "n_hit", "items", "longest", "spans")


def _probe(src: DataFrame, items: DataFrame, item_col: str, item_text_col: str, window: int) -> DataFrame:
    """``src`` (id, text, ...) with n_words, n_hit, items, longest, spans."""
    spark = src.sparkSession
    ship(spark)
    table, total = shards(items, item_col, item_text_col, window)
    names = src.columns
    words = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    added = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("longest", pa.int32()),
             ("hits", words), ("spans", words)]
    ddl = (", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema)
           + ", n_words long, n_hit long, items array<string>, longest int,"
             " hits array<struct<begin:long,end:long>>, spans array<struct<begin:long,end:long>>")
    for k in range(0, total, SHARDS_A_PASS):
        own = table.where(F.col("shard").between(k, k + SHARDS_A_PASS - 1)).select("automaton")
        sent = [spark.sparkContext.broadcast(bytes(r[0])) for r in own.toLocalIterator()]

        def run(batches, sent=sent, again=k > 0):
            automata = [_unpacked(b.value) for b in sent]
            for b in batches:
                old_hits = column(b, "hits").to_pylist() if again else None
                old_items = column(b, "items").to_pylist() if again else None
                old_longest = column(b, "longest").to_pylist() if again else None
                out = {n: [] for n, _ in added}
                for i, j, _, starts, ends, h, first in hashed_words(column(b, "text"), ALNUM):
                    hits: list[list] = [[] for _ in range(i, j)]
                    found: list[set] = [set() for _ in range(i, j)]
                    longest = [0] * (j - i)
                    for a in automata:
                        for u, v in a.stretches(h, first):
                            r = int(np.searchsorted(first, u, "right")) - 1
                            longest[r] = max(longest[r], a.stream(a.codes(h[u:v]), u - int(first[r]), hits[r], found[r]))
                    base = 0
                    off = first[:-1]
                    text_start = _row_starts(column(b, "text"), i, j)
                    for r in range(j - i):
                        own = hits[r]
                        names_found = {str(x) for x in found[r]}
                        if again:
                            own = own + [(x["begin"], x["end"]) for x in old_hits[i + r]]
                            names_found |= set(old_items[i + r])
                            longest[r] = max(longest[r], old_longest[i + r])
                        own = joined(own)
                        base = int(off[r])
                        out["n_words"].append(int(first[r + 1] - first[r]))
                        out["n_hit"].append(sum(e - s for s, e in own))
                        out["items"].append(sorted(names_found))
                        out["longest"].append(longest[r])
                        out["hits"].append([{"begin": s, "end": e} for s, e in own])
                        out["spans"].append([{"begin": int(starts[base + s] - text_start[r]), "end": int(ends[base + e - 1] - text_start[r])} for s, e in own])
                cols = [column(b, n) for n in names] + [pa.array(out[n], t) for n, t in added]
                yield pa.RecordBatch.from_arrays(cols, names + [n for n, _ in added])

        src = src.mapInArrow(run, ddl)
        if k + SHARDS_A_PASS < total:
            src = saved(src, "overlaps")
            for b in sent:
                b.unpersist()
    return src.drop("hits")


def _row_starts(arr: pa.Array, i: int, j: int) -> list[int]:
    """Byte positions of the rows i to j - 1 within their run."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(arr.slice(i, j - i)), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)[:-1]]).tolist() if j > i else []


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = 10,
                  max_coverage: float = 0.5, chars_col: str | None = "n_chars") -> DataFrame:
    """The documents without hit spans, same columns; one whose hit words exceed ``max_coverage`` of its words goes.
    White space around a removed span becomes one line break; ``chars_col``, if there, is counted anew."""
    columns = docs.columns
    src = docs.select(docs[text_col].alias("text"), F.struct(*[docs[c] for c in columns]).alias("row"))
    marked = _probe(src, items, item_col, item_text_col, window).where(F.col("n_hit") <= max_coverage * F.col("n_words"))
    cut = _without(marked.select("row", "text", "spans"))
    out = [F.col("text").alias(c) if c == text_col
           else F.char_length("text").cast(docs.schema[c].dataType).alias(c) if c == chars_col
           else F.col("row")[c].alias(c) for c in columns]
    changed = F.size("spans") > 0
    same = [F.when(changed, x).otherwise(F.col("row")[c]).alias(c) if c in (text_col, chars_col) else x for x, c in zip(out, columns)]
    return cut.select(*same)


def _without(marked: DataFrame) -> DataFrame:
    """Column ``text`` without its byte spans, in SQL functions: pieces between spans, joined by line breaks."""
    raw = F.encode("text", "UTF-8")
    n = F.size("spans")
    pieces = F.transform(F.sequence(F.lit(0), n), lambda i: F.decode(
        F.substring(raw, F.when(i == 0, F.lit(1)).otherwise((F.get("spans", i - 1)["end"] + 1).cast("int")),
                    (F.when(i == n, F.octet_length("text").cast("long")).otherwise(F.get("spans", i)["begin"])
                     - F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get("spans", i - 1)["end"])).cast("int")), "UTF-8"))
    kept = F.filter(F.transform(pieces, lambda p: F.trim(p)), lambda p: p != "")
    return marked.withColumn("text", F.when(n > 0, F.array_join(kept, "\n")).otherwise(F.col("text")))
