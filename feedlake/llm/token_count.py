"""Token counts (2): heap-and-linked-list byte-pair merging.

A text is cut as the library cuts it (special tokens first, then the byte-level pattern).  Each cut piece starts
as its bytes in a linked list; a heap gives the lowest-rank adjacent pair again and again, which is merged until
no pair is left.  The count is initial symbols minus merges; no identifiers are made.  Counts of pieces seen
before are kept in a bounded memory of the Python worker, since words repeat.

Cases: null and empty texts have 0 tokens; texts of any length are counted whole; other columns are kept out of
the result, so clashing names do no harm; repeated rows give repeated rows; an empty table gives an empty one.
"""

from __future__ import annotations

import json
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from feedlake.llm.arrowtext import column, ship, strings

#: white space as Unicode has it, which is what the library's pattern means by \s
SPACE = r"\t-\r \x85\xa0  -     　"
#: fixed value: the byte-level pattern of this vocabulary family, its \s spelt out
PATTERN = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+"
           rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
KEPT_PIECES = 1_200_000       # entries of the worker's memory; it starts anew beyond that
AGAIN = 1 << 50             # marks a piece whose cut depends on its neighbours


def byte_alphabet() -> list[str]:
    """The printable character by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class MergeCounter:
    """Counts tokens by the merges of a byte-level BPE file; ``counts`` remembers pieces that follow a space."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.first = [vocab[c] for c in byte_alphabet()]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.made = [vocab[a + b] for a, b in merges]                       # by rank, the symbol a merge gives
        self.ranks = {vocab[a] << 20 | vocab[b]: r for r, (a, b) in reversed([*enumerate(merges)])}
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.special_texts = special
        self.cut = regex.compile(PATTERN).findall
        self.counts = _AfterSpace(self)

    def merged(self, data: bytes) -> int:
        """Symbols left of a piece after all merges."""
        n = len(data)
        if n < 2:
            return n
        rank_of, made, first = self.ranks.get, self.made, self.first
        sym = [first[b] for b in data]
        here = [rank_of(a << 20 | b, -1) for a, b in zip(sym, sym[1:])]     # rank of the pair that begins here
        heap = [r << 32 | i for i, r in enumerate(here) if r >= 0]
        if not heap:
            return n
        heapify(heap)
        here.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        left = n
        while heap:
            top = heappop(heap)
            i, r = top & 0xFFFFFFFF, top >> 32
            if here[i] != r:                                # the pair that stood here is gone
                continue
            j = after[i]
            k = after[i] = after[j]
            s = sym[i] = made[r]
            here[j] = -1
            left -= 1
            if k < n:
                before[k] = i
                r = here[i] = rank_of(s << 20 | sym[k], -1)
                if r >= 0:
                    heappush(heap, r << 32 | i)
            else:
                here[i] = -1
            k = before[i]
            if k >= 0:
                r = here[k] = rank_of(sym[k] << 20 | s, -1)
                if r >= 0:
                    heappush(heap, r << 32 | k)
        return left

    def by_pattern(self, text: str) -> int:
        counts, total = self.counts, 0
        for p in self.cut(text):
            total += counts[p[1:]] if p[0] == " " and p[1:].isalpha() else counts.plain(p)
        return total

    def section(self, text: str) -> int:
        """Tokens of a text without special tokens."""
        if not text:
            return 0
        head, *rest = text.split(" ")
        if rest and (not head or head[-1].isspace()):
            return self.by_pattern(text)
        total = self.by_pattern(head) + sum(map(self.counts.__getitem__, rest))
        if total >= AGAIN:
            return self.by_pattern(text)
        return total

    def count(self, text: str) -> int:
        if len(self.counts) > KEPT_PIECES:
            self.counts.clear()
        if self.special and any(s in text for s in self.special_texts):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self.section, parts))
        return self.section(text)


class _AfterSpace(dict):
    """Piece after one space -> its tokens with that space; the pattern never joins across such a space when
    neither neighbour is white space.  Pieces without that space are kept under a leading space, which no
    piece after a space has."""

    def __init__(self, counter: MergeCounter):
        self.counter = counter

    def plain(self, piece: str) -> int:
        n = self.get(key := " " + piece)
        if n is None:
            n = self.counter.merged(piece.encode("utf-8"))
            if len(piece) < 64:
                self[key] = n
        return n

    def __missing__(self, piece: str) -> int:
        if piece.isalpha():
            n = self.counter.merged(b" " + piece.encode("utf-8"))
        elif not piece or piece[0].isspace() or piece[-1].isspace():
            return AGAIN
        else:
            n = self.counter.by_pattern(" " + piece)
        if len(piece) < 64:
            self[piece] = n
        return n


@lru_cache(2)
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 1024) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit.  ``vocabulary``: a byte-level BPE .json file that
    every worker can read.  One pass, no shuffle."""
    ship(docs.sparkSession)

    def run(batches):
        c = counter(vocabulary)
        for b in batches:
            texts = strings(b, "text")
            tokens = [c.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [column(b, "id"), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()),
                 pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens])],
                [id_col, "n_bytes", "n_tokens", "over_limit"])

    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
