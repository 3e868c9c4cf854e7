"""Packing (7): vector bin packing of token sequences by the dot-product heuristic.

Every example is turned into ids and an end id.  Runs that fill a whole sequence leave at once; the rest of each
example waits in a bounded pool of the task.  A sequence is filled under three limits together (tokens, segments,
loss-bearing tokens): of the pool's items that fit, the one whose demand vector has the greatest dot product with
what the sequence has left goes in.  When nothing fits, the smallest longer item is cut at the gap and its rest
goes back.  A sequence that a limit ends early, and what the task has left in the end, is cut at a power of two, which
needs no padding; what is cut off goes back to the pool.  Each task packs the examples it reads, so nothing is
shuffled, and a task that runs again gives the same pieces.

A piece bears loss on all its tokens but the first, which nothing precedes, and but those among the first ``context``
tokens of its example.  With a context of 0 and a loss limit of at least tokens - 1 the loss limit never binds and the
vector has two live parts, tokens and segments.

Cases: null and empty texts give the end id alone; very long texts are cut into many pieces; repeated rows and ids
are packed row by row; clashing extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from feedlake.llm.arrowtext import column, ship, strings
from feedlake.llm.token_count import PATTERN, byte_alphabet

KEPT_PIECES = 250_000       # pieces whose ids a Python worker remembers
POOL = 2048                 # examples that wait in a task at most


class PieceIds(dict):
    """Piece after one space -> its ids (little-endian 32-bit), of a byte-level BPE .json file.

    The ids are those of the file's own library; a piece is merged by the tiktoken core over the same ranks, which
    is several times as fast."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.core = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.special = special

    def whole(self, text: str) -> bytes:
        return array("I", self.core.encode_ordinary(text)).tobytes()

    def __missing__(self, piece: str) -> bytes | None:
        if piece.isalpha():
            ids = array("I", self.core.encode_single_piece(b" " + piece.encode("utf-8"))).tobytes()
        elif not piece or piece[0].isspace() or piece[-1].isspace():
            return None                                     # its cut depends on its neighbours
        else:
            ids = self.whole(" " + piece)
        if len(piece) < 64:
            self[piece] = ids
        return ids

    def section(self, text: str) -> bytes:
        head, *rest = text.split(" ")
        if rest and (not head or head[-1].isspace()):
            return self.whole(text)
        try:
            return self.whole(head) + b"".join(map(self.__getitem__, rest))
        except TypeError:
            return self.whole(text)

    def ids(self, text: str) -> bytes:
        if len(self) > KEPT_PIECES:
            self.clear()
        for s, i in self.special.items():
            if s in text:
                return array("I", [i]).tobytes().join(map(self.ids, text.split(s)))
        return self.section(text)


@lru_cache(2)
def piece_ids(path: str) -> PieceIds:
    return PieceIds(path)


class Packer:
    """Fills sequences from a pool.  Items: (key, ids, start, whole length)."""

    def __init__(self, first_id: int, tokens: int, segments: int, loss: int, context: int = 0):
        self.next_id, self.cap = first_id, np.array([tokens, segments, loss], float)
        self.tokens, self.segments, self.loss, self.context = tokens, segments, loss, context
        self.items: list[tuple] = []
        self.out: list[tuple] = []

    def free(self, start: int) -> int:
        """Leading tokens without loss of a piece that begins there."""
        return max(1, self.context - start)

    def emit(self, parts: list[tuple]) -> None:
        """A finished sequence: parts are (key, ids, start, whole length)."""
        offset = 0
        for segment, (key, ids, start, whole) in enumerate(parts):
            n = len(ids) >> 2
            self.out.append((key, start, n, ids, whole, self.next_id, offset, segment, max(0, n - self.free(start))))
            offset += n
        self.next_id += 1

    def close(self, parts: list[tuple]) -> list[tuple]:
        """Emit a sequence, cut at a power of two where it is not full; what is cut off, as items."""
        total = sum(len(x[1]) >> 2 for x in parts)
        excess = 0 if total == self.tokens else total - (1 << (total.bit_length() - 1))
        back = []
        while excess:
            key, ids, start, whole = parts.pop()
            n = len(ids) >> 2
            keep = max(0, n - excess)
            if keep:
                parts.append((key, ids[:4 * keep], start, whole))
            back.append((key, ids[4 * keep:], start + keep, whole))
            excess -= n - keep
        self.emit(parts)
        return back

    def add(self, key, ids: bytes) -> None:
        whole = len(ids) >> 2
        start = 0
        while (step := min(self.tokens, self.loss + self.free(start))) <= whole - start:
            step = step if step == self.tokens else 1 << (step.bit_length() - 1)
            self.emit([(key, ids[4 * start:4 * (start + step)], start, whole)])
            start += step
        if start < whole:
            self.items.append((key, ids[4 * start:], start, whole))
            if len(self.items) >= POOL:
                self.fill(POOL // 2)

    def fill(self, keep: int) -> None:
        """Pack until at most ``keep`` items wait, or fewer tokens than a sequence holds."""
        items = self.items
        size = np.array([len(x[1]) >> 2 for x in items], np.int64)
        free = np.array([self.free(x[2]) for x in items], np.int64)
        bears = np.maximum(0, size - free)
        live = len(items)
        waiting = int(size.sum())
        weight = 1.0 / np.maximum(1.0, self.cap)
        while live > keep and waiting >= self.tokens:
            left_t, left_s, left_l = self.tokens, self.segments, self.loss
            parts: list[tuple] = []
            own: list[int] = []
            while left_t and left_s:
                # demand (size, 1, loss) against what is left, each in shares of its limit
                fits = (size > 0) & (size <= left_t) & (bears <= left_l)
                score = size * (left_t * weight[0] ** 2) + left_s * weight[1] ** 2 + bears * (left_l * weight[2] ** 2)
                score = np.where(fits, score, -1.0)
                i = int(np.argmax(score))
                if score[i] >= 0:
                    n = int(size[i])
                else:
                    room = np.minimum(left_t, left_l + free)
                    longer = np.where(size > room, size, np.iinfo(np.int64).max)
                    i = int(np.argmin(longer))
                    n = int(room[i])
                    if size[i] <= n or parts and n == 1 < left_t:      # nothing to cut, or no loss left
                        break
                key, ids, start, whole = items[i]
                parts.append((key, ids[:4 * n], start, whole))
                own.append(i)
                left_t, left_s, left_l = left_t - n, left_s - 1, left_l - max(0, n - int(free[i]))
                items[i] = (key, ids[4 * n:], start + n, whole)
                size[i] -= n
                free[i] = self.free(start + n)
                bears[i] = max(0, size[i] - free[i])
                waiting -= n
                live -= not size[i]
            for key, ids, start, whole in self.close(parts):
                i = own.pop()
                live += not size[i]
                items[i] = (key, ids + items[i][1], start, whole)
                size[i] = len(items[i][1]) >> 2
                free[i] = self.free(start)
                bears[i] = max(0, size[i] - free[i])
                waiting += len(ids) >> 2
        self.items = [x for x, n in zip(items, size) if n]

    def finish(self) -> None:
        """Pack what is left; the last tokens are cut into sequences whose lengths are powers of two."""
        self.fill(0)
        rest, self.items = self.items[::-1], []
        while rest:
            parts, left_t, left_l = [], self.tokens, self.loss
            while left_t and rest and len(parts) < self.segments:
                key, ids, start, whole = rest.pop()
                n = min(left_t, left_l + self.free(start), len(ids) >> 2)
                parts.append((key, ids[:4 * n], start, whole))
                left_t, left_l = left_t - n, left_l - max(0, n - self.free(start))
                if 4 * n < len(ids):
                    rest.append((key, ids[4 * n:], start + n, whole))
                    break
            rest += self.close(parts)

    def take(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", tokens: int = 1024,
         segments: int = 128, loss: int = 1023, context: int = 0, end_id: int = 0) -> DataFrame:
    """One row per piece: id, start, length, ids (binary, little-endian 32-bit), doc_tokens, sequence_id, offset,
    segment, loss_tokens."""
    ship(docs.sparkSession)
    end = array("I", [end_id]).tobytes()
    fields = [("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
              ("sequence_id", pa.int64()), ("offset", pa.int64()), ("segment", pa.int32()), ("loss_tokens", pa.int32())]

    def run(batches):
        memory = piece_ids(vocabulary)
        packer = Packer(TaskContext.get().partitionId() << 33, tokens, segments, loss, context)
        kind = pa.int64()

        def table(rows):
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind)] + [pa.array(c, t) for c, (_, t) in zip(cols[1:], fields)],
                                              [id_col] + [n for n, _ in fields])

        for b in batches:
            keys = column(b, "id")
            kind = keys.type
            for key, text in zip(keys.to_pylist(), strings(b, "text")):
                packer.add(key, memory.ids(text) + end)
                if len(packer.out) >= 2000:
                    yield table(packer.take())
        packer.finish()
        if rows := packer.take():
            yield table(rows)

    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long, "
                               "sequence_id long, offset long, segment int, loss_tokens int")
