"""Substring dedup (13): suffix automata of reference texts, matching statistics of the documents streamed through them.

A word goes when some window of ``window`` words that covers it also starts in a document with a smaller id.

1. Anchors.  Of the ``GRAM``-word grams of a window the one with the smallest hash (the first of equal ones) is its
   anchor; windows with equal words have equal anchors, and neighbouring windows mostly share one, so a text has
   about one anchor in twenty words.  Anchors are counted by hash (with partial counts): those of one document only
   are dropped, and every other has a home, the smallest id that holds it.
2. Segments.  The stretch around an anchor, or a run of neighbouring ones of one home, is streamed against its
   home's own stretches.  The home's text is the reference: its suffix automaton goes to every lot of ``LOT``
   documents that are streamed against it, which is a broadcast to just the tasks that need it.  (One automaton of
   all references for every task would grow with the corpus; a popular reference is split over many lots.)
3. Matching statistics: the length of the longest match that ends at each word.  Where it reaches ``window`` the
   window's words go.
4. A window whose anchor has a smaller home, but that the home does not hold (an edge of a shared passage, an edited
   copy), may stand in some other smaller document.  Those windows are counted by hash, and where two documents hold
   one, the smaller is the reference of a second round, streamed likewise.  A second round is enough, since each
   window's own smallest holder is its reference there.

Words are numbered by 64-bit hashes; hashes of windows only propose, automata decide.  Hit spans are joined and cut
out of the whole texts; documents without hits are not shuffled with their texts.

Cases: null, empty and short texts have no window and keep every word; rows without an id lose nothing and take
nothing from others; rows with one id never take from each other; repeated rows give repeated rows; texts of any
length are read whole; clashing extra columns are not read; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.arrowtext import NOT_SPACE, U64, column, mix, powers, runs, saved, ship, span_hash, text_bytes, word_spans
from feedlake.llm.near_dedup import grouped, spotted

GRAM = 10
LOT = 512           # documents streamed against one copy of a reference
PLACE = U64((1 << 30) - 1)      # low bits, which hold a gram's place: a text of 2 GB has fewer words


def words_of(arr: pa.Array):
    """For each run of texts: (first row, end row, bytes, word starts, word ends, word hashes, first word of each row)."""
    data, off = text_bytes(arr)
    for i, j in runs(off):
        part, rel = data[off[i]:off[j]], off[i:j + 1] - off[i]
        _, starts, ends, first = word_spans(part, rel, NOT_SPACE)
        yield i, j, part, starts, ends, span_hash(part, starts, ends), first


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n neighbouring values."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    p, q = powers(len(h))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h) * p[:len(h)], out=total[1:])
    return mix((total[n:] - total[:-n]) * q[:len(h) - n + 1])


def anchors(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of words ``h``: where its anchor begins; and the hashes of all grams."""
    grams = rolled(h, GRAM)
    across = window - GRAM + 1                      # grams of a window
    n = len(grams) - across + 1
    if n <= 0:
        return np.zeros(0, np.int64), grams
    key = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)       # of equal ones the first is the least
    pad = np.full(-len(key) % across, ~U64(0), np.uint64)
    tiles = np.concatenate([key, pad]).reshape(-1, across)
    ahead = np.minimum.accumulate(tiles, axis=1).ravel()
    behind = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[across - 1:across - 1 + n]) & PLACE).astype(np.int64), grams


def valid(first: np.ndarray, window: int) -> np.ndarray:
    """Starts of the windows that lie within one row."""
    return np.concatenate([np.arange(s, max(s, e - window + 1)) for s, e in zip(first[:-1], first[1:])] or [np.zeros(0, np.int64)])


def anchor_rows(src: DataFrame, window: int) -> DataFrame:
    """``src`` (id, row, text) -> id, row, anchor (hash), at (place of its first word): a row for each of a text's anchors."""
    def run(batches):
        for b in batches:
            ids, rows = column(b, "id"), column(b, "row")
            for i, j, _, _, _, h, first in words_of(column(b, "text")):
                at, grams = anchors(h, window)
                at = np.unique(at[valid(first, window)]) if len(at) else at
                of = np.searchsorted(first, at, "right") - 1
                take = pa.array(of + i)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(take), rows.take(take), pa.array(grams[at].view(np.int64)), pa.array((at - first[of]).astype(np.int32))],
                    ["id", "row", "anchor", "at"])

    return src.mapInArrow(run, "id long, row long, anchor long, at int")


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list[int]) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in words:
            q = nxt[last].get(c)
            if q is not None:                       # the sequence read so far is known
                last = q if length[q] == length[last] + 1 else self.split(last, c, q)
                continue
            new = len(link)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[new] = q if length[q] == length[p] + 1 else self.split(p, c, q)
            last = new

    def split(self, p: int, c: int, q: int) -> int:
        """A state of its own for the shorter sequences of ``q`` that end with ``p`` and ``c``."""
        nxt, link = self.next, self.link
        short = len(link)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        self.length.append(self.length[p] + 1)
        link[q] = short
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = short
            p = link[p]
        return short

    def matching(self, words: list[int]) -> np.ndarray:
        """Length of the longest match that ends at each word."""
        nxt, link, length = self.next, self.link, self.length
        out, s, matched = [], 0, 0
        for c in words:
            t = nxt[s].get(c)
            while t is None and s:
                s = link[s]
                matched = length[s]
                t = nxt[s].get(c)
            if t is not None:
                s = t
                matched += 1
            out.append(matched)
        return np.array(out, np.int64)


def stretches(at: list[int], n: int, window: int) -> Iterator[tuple[int, int, list[int]]]:
    """Runs of anchors whose windows meet: (first word, end, the run's anchors) in a text of n words."""
    reach = window - GRAM
    k = 0
    while k < len(at):
        m = k + 1
        while m < len(at) and at[m] - at[m - 1] <= window:
            m += 1
        yield max(0, at[k] - reach), min(n, at[m - 1] + window), at[k:m]
        k = m


def streamed(members: DataFrame, src: DataFrame, window: int, leftover: bool) -> DataFrame:
    """Stream texts against their references.  ``members``: ref, id, row, at (sorted places, of anchors or, without
    ``leftover``, of windows); the rows with id = ref are the reference.  -> ref, id, row, hits (begin, end word) and
    with ``leftover`` the hash and start of each asked window that the reference lacks."""
    sizes = saved(members.groupBy("ref").agg(F.ceil(F.count("*") / LOT).cast("int").alias("lots")), "lots")
    uses = members.join(sizes, "ref").groupBy("id", "row").agg(F.collect_list(F.struct("ref", "lots", "at")).alias("uses"))
    cut = segments(uses.join(spotted(src, members).where("seen"), ["id", "row"]), window, leftover)
    own = F.col("id") == F.col("ref")
    lot = F.when(own, F.sequence(F.lit(0), F.col("lots") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id", "row"), F.col("lots")).cast("int")))
    stream = (cut.withColumn("role", F.when(own, 0).otherwise(1)).withColumn("lot", F.explode(lot)).drop("lots")
              .repartition("ref", "lot").sortWithinPartitions("ref", "lot", "role", "id", "row", "begin"))

    def run(batches):
        automaton = None
        for fresh, b in grouped(batches, ("ref", "lot")):
            if fresh:
                automaton = Automaton()
            role, ids, rows, begins = (column(b, c).to_numpy() for c in ("role", "id", "row", "begin"))
            at = column(b, "at")
            out = {"id": [], "row": [], "begin": [], "end": [], "hash": []}
            for i, j, _, _, _, h, first in words_of(column(b, "text")):
                names = h.tolist()
                for r in range(j - i):
                    u, v = int(first[r]), int(first[r + 1])
                    if role[i + r] == 0:
                        automaton.add(names[u:v])
                        continue
                    ends = np.flatnonzero(automaton.matching(names[u:v]) >= window) + 1
                    base = int(begins[i + r])
                    if len(ends):
                        gap = np.flatnonzero(np.diff(ends) > window)
                        lo = ends[np.append(0, gap + 1)] - window
                        hi = ends[np.append(gap, len(ends) - 1)]
                        out["begin"] += (lo + base).tolist()
                        out["end"] += (hi + base).tolist()
                        out["hash"] += [None] * len(lo)
                    asked = np.zeros(0, np.int64)
                    if leftover:
                        anchor, _ = anchors(h[u:v], window)
                        asked = np.flatnonzero(np.isin(anchor, np.array(at[i + r].as_py())))
                        asked = asked[~np.isin(asked, ends - window)]
                        out["begin"] += (asked + base).tolist()
                        out["end"] += [0] * len(asked)
                        out["hash"] += rolled(h[u:v], window)[asked].view(np.int64).tolist() if len(asked) else []
                    more = len(out["begin"]) - len(out["id"])
                    out["id"] += [int(ids[i + r])] * more
                    out["row"] += [int(rows[i + r])] * more
                    if len(out["id"]) > 100_000:
                        yield record(out)
                        out = {k: [] for k in out}
            if out["id"]:
                yield record(out)

    def record(out):
        kinds = {"begin": pa.int32(), "end": pa.int32()}
        return pa.RecordBatch.from_arrays([pa.array(x, kinds.get(k, pa.int64())) for k, x in out.items()], list(out))

    return stream.mapInArrow(run, "id long, row long, begin int, end int, hash long")


def segments(rows: DataFrame, window: int, by_anchor: bool) -> DataFrame:
    """``rows`` (id, row, uses: array of ref, lots, at; text) -> ref, lots, id, row, begin (word of the text), at (anchors,
    counted from there), text of the segment."""
    def run(batches):
        for b in batches:
            ids, keys, uses = column(b, "id"), column(b, "row"), column(b, "uses")
            for i, j, part, starts, ends, _, first in words_of(column(b, "text")):
                out = {k: [] for k in ("ref", "lots", "of", "begin", "at", "text")}
                size = 0
                for r in range(j - i):
                    u, n = int(first[r]), int(first[r + 1] - first[r])
                    for use in uses[i + r].as_py():
                        places = sorted(use["at"])
                        found = stretches(places, n, window) if by_anchor else covered(places, window)
                        for s, e, own in found:
                            text = part[starts[u + s]:ends[u + e - 1]].tobytes()
                            for k, v in (("ref", use["ref"]), ("lots", use["lots"]), ("of", i + r), ("begin", s),
                                         ("at", [a - s for a in own]), ("text", text)):
                                out[k].append(v)
                            size += len(text)
                            if size > 1 << 22:
                                yield record(out, ids, keys)
                                out, size = {k: [] for k in out}, 0
                if out["of"]:
                    yield record(out, ids, keys)

    def record(out, ids, keys):
        of = pa.array(out["of"], pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(out["ref"], pa.int64()), pa.array(out["lots"], pa.int32()), ids.take(of), keys.take(of),
             pa.array(out["begin"], pa.int32()), pa.array(out["at"], pa.list_(pa.int32())), pa.array(out["text"], pa.binary()).cast(pa.string())],
            ["ref", "lots", "id", "row", "begin", "at", "text"])

    return rows.select("id", "row", "uses", "text").mapInArrow(
        run, "ref long, lots int, id long, row long, begin int, at array<int>, text string")


def covered(starts: list[int], window: int) -> Iterator[tuple[int, int, list[int]]]:
    """Runs of windows that overlap: (first word, end, nothing)."""
    k = 0
    while k < len(starts):
        m = k + 1
        while m < len(starts) and starts[m] - starts[m - 1] <= window:
            m += 1
        yield starts[k], starts[m - 1] + window, []
        k = m


def holders(rows: DataFrame, key: str) -> DataFrame:
    """Of ``rows`` (key, id, ...) the keys that several ids hold, with the smallest; a table, so that the join with it
    can split a key that many rows have."""
    return saved(rows.groupBy(key).agg(F.min("id").alias("ref"), F.max("id").alias("last")).where("ref < last").select(key, "ref"), "holders")


def placed(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (key, id, row, at) with shared keys -> ref, id, row, at (sorted places)."""
    return saved(rows.join(holders(rows, key), key).groupBy("ref", "id", "row").agg(F.sort_array(F.collect_set("at")).alias("at")), "places")


def repeats(src: DataFrame, window: int) -> DataFrame:
    """``src`` (id, row, text) -> id, row, found (sorted ranges of words that go)."""
    first = saved(streamed(placed(saved(anchor_rows(src, window), "anchors"), "anchor"), src, window, leftover=True), "matched")
    left = first.where("hash is not null").select("hash", "id", "row", F.col("begin").alias("at"))
    second = streamed(placed(left, "hash"), src, window, leftover=False)
    spans = first.where("hash is null").unionByName(second).select("id", "row", "begin", "end")
    return spans.groupBy("id", "row").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("found"))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_words, n_removed, kept (the words that stay, joined by one space)."""
    if window <= GRAM:
        raise ValueError(f"a window has more than {GRAM} words")
    ship(docs.sparkSession)
    text = F.coalesce(docs[text_col], F.lit(""))
    src = docs.select(docs[id_col].alias("key"), docs[id_col].cast("long").alias("id"), text.alias("text")).withColumn("row", F.xxhash64("id", "text"))
    # a repeated row is streamed once: its other rows get the same spans
    named = src.where(F.col("id").isNotNull() & (F.octet_length("text") >= 2 * window - 1)).select("id", "row", "text")
    gone = saved(repeats(named, window), "repeats")

    marked = spotted(src, gone)
    some = marked.where("seen").join(gone, ["id", "row"], "left").select("key", "text", "found")
    none = marked.where("not seen").select("key", "text", F.lit(None).cast("array<struct<begin:int,end:int>>").alias("found"))
    return without(some.unionByName(none), docs.schema[id_col].dataType.simpleString()).select(F.col("key").alias(id_col), "n_words", "n_removed", "kept")


def without(rows: DataFrame, kind: str) -> DataFrame:
    """``rows`` (key, text, found) -> key, n_words, n_removed, kept."""
    def run(batches):
        for b in batches:
            found = column(b, "found")
            for i, j, part, starts, ends, _, first in words_of(column(b, "text")):
                n = np.diff(first).astype(np.int64)
                removed = np.zeros(j - i, np.int64)
                gone = np.zeros(len(starts), bool)
                for r in range(j - i):
                    if found[i + r].is_valid:
                        u = int(first[r])
                        for x in found[i + r].as_py():
                            gone[u + x["begin"]:u + x["end"]] = True
                        removed[r] = int(gone[u:u + n[r]].sum())
                raw = part.tobytes()
                kept = []
                for r in range(j - i):
                    u = int(first[r])
                    stay = u + np.flatnonzero(~gone[u:u + n[r]])
                    kept.append(b" ".join([raw[s:e] for s, e in zip(starts[stay].tolist(), ends[stay].tolist())]))
                yield pa.RecordBatch.from_arrays(
                    [column(b, "key").slice(i, j - i), pa.array(n), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["key", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(run, f"key {kind}, n_words long, n_removed long, kept string")
