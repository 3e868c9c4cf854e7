"""Conversation structure repair (11): the cheapest edits that make a conversation's roles legal, with their audit.

Roles are legal when their initials spell ``(s?(ua)+)?``.  A turn is kept (K, 0), given the role user or assistant
(R, 3) or deleted (D, 4, the only edit for blank and duplicate turns); an empty turn of either role may be inserted
anywhere (I, 3); a truncated turn that stays costs 3 more.  Of equally cheap audits the ASCII-least is taken.

*Persistent audit DP.*  After each turn, a state (nothing yet, a system turn, after a user, after an assistant) has its
cheapest cost and its least audit.  Audits are nodes of a tree in which a node links to the audit without its last
letter, so that all states share their prefixes.  Nodes have binary-lifting ancestors and rolling hashes: two audits of
one cost are compared at the letter behind their longest common prefix, found by search over the ancestors' hashes;
prefixes with equal hashes are walked until they meet, so a collision is seen.  Equally cheap audits of one state are
never each other's prefixes (an inserted turn costs), so the least prefix stays the least.

*Scale.*  Turns are dealt by ranges of (conversation, turn), so that a conversation of any size spreads over many tasks.
A task cuts its stretch of a conversation into chunks of at most ``CHUNK`` turns and gives for each chunk the cheapest
edits from every state to every state; chunks of a conversation are then joined in order, which takes a step for each
chunk.  The repaired turns are written in a last pass that streams each conversation's turns and edits side by side,
holding one Arrow batch.

Cases: a null role or text counts as one space; a null turn comes first, turns of one number go by role and text;
repeated rows are duplicates of the first; a role that does not begin with s, u or a, an empty one too, is never kept;
an empty table gives none; a null conversation id is a conversation of its own; clashing extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.arrowtext import column, saved, ship

CHUNK = 2048        # turns
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: states of the roles so far: nothing, a system turn, after a user, after an assistant
NONE, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
AFTER = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: the role that an inserted or renamed turn takes in a state
NEXT = {NONE: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
ROLE = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
MODULUS, RADIX = (1 << 61) - 1, 1_000_003


class Audits:
    """A tree of audits: node 0 is the empty one."""

    def __init__(self) -> None:
        self.up: list[list[int]] = [[]]         # ancestors 1, 2, 4, ... letters shorter
        self.letter, self.depth, self.hash = [""], [0], [0]

    def add(self, node: int, letter: str) -> int:
        up = [node]
        while len(self.up[up[-1]]) >= len(up):
            up.append(self.up[up[-1]][len(up) - 1])
        self.up.append(up)
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * RADIX + ord(letter)) % MODULUS)
        return len(self.up) - 1

    def extend(self, node: int, letters: str) -> int:
        for x in letters:
            node = self.add(node, x)
        return node

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def cut(self, node: int, depth: int) -> int:
        """The prefix of ``depth`` letters."""
        apart = self.depth[node] - depth
        while apart:
            k = apart.bit_length() - 1
            node = self.up[node][k]
            apart -= 1 << k
        return node

    def same(self, a: int, b: int) -> bool:
        """Whether two audits of one length are equal; equal hashes are verified."""
        if self.hash[a] != self.hash[b]:
            return False
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether audit a comes before b."""
        n = min(self.depth[a], self.depth[b])
        x, y = self.cut(a, n), self.cut(b, n)
        if self.same(x, y):
            return self.depth[a] < self.depth[b]
        for k in range(len(self.up[x]) - 1, -1, -1):        # up to the shortest prefixes that differ
            if k < len(self.up[x]) and not self.same(self.up[x][k], self.up[y][k]):
                x, y = self.up[x][k], self.up[y][k]
        return self.letter[x] < self.letter[y]

    def least(self, offers: list[tuple[int, int, str]]) -> tuple[int, int]:
        """The cheapest offer (cost, node, letters to add), of equal ones the least audit: (cost, node)."""
        cost = min(x[0] for x in offers)
        best = None
        for c, node, letters in offers:
            if c == cost:
                new = self.extend(node, letters)
                if best is None or self.less(new, best):
                    best = new
        return cost, best


Best = list[tuple[int, int] | None]


def inserted(audits: Audits, best: Best) -> Best:
    """``best`` with empty turns inserted where that is cheaper (or as cheap and less)."""
    best, open_ = list(best), {s for s in STATES if best[s]}
    while open_:
        s = min(open_, key=lambda x: best[x][0])        # an insertion costs, so a cheapest state is final
        open_.remove(s)
        cost, node = best[s]
        t = AFTER[s, NEXT[s]]
        if best[t] is None or best[t][0] >= cost + INSERT:
            best[t] = audits.least([*([(*best[t], "")] if best[t] else []), (cost + INSERT, node, "I")])
            open_.add(t)
    return best


def repaired_from(start: int, turns: list[tuple[str, str | None]]) -> list[tuple[int, int, str]]:
    """For turns (initial, fault): the states they may end in from ``start``, with the cheapest cost and least audit."""
    audits = Audits()
    best: Best = [None] * 4
    best[start] = (0, 0)
    best = inserted(audits, best)
    for initial, fault in turns:
        offers: list[list] = [[] for _ in STATES]
        more = TRUNCATED if fault == "truncated" else 0
        for s in STATES:
            if best[s]:
                cost, node = best[s]
                offers[s].append((cost + DELETE, node, "D"))
                if fault in ("blank", "duplicate"):
                    continue
                if (s, initial) in AFTER:
                    offers[AFTER[s, initial]].append((cost + KEEP + more, node, "K"))
                offers[AFTER[s, NEXT[s]]].append((cost + REROLE + more, node, "R"))
        best = inserted(audits, [audits.least(x) if x else None for x in offers])
    return [(s, best[s][0], audits.text(best[s][1])) for s in STATES if best[s]]


class Chunk:
    """Turns of one conversation in order, as they are counted."""

    def __init__(self, starts) -> None:
        self.starts = starts
        self.turns: list[tuple[str, str | None]] = []
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = 0

    def add(self, initial: str, fault: str | None) -> None:
        if self.turns and self.turns[-1][0] + initial not in LEGAL:
            self.illegal += 1
        self.turns.append((initial, fault))
        if fault:
            self.faults[fault] += 1

    def summary(self) -> dict:
        paths = [{"start": s, "end": e, "cost": c, "audit": a} for s in self.starts for e, c, a in repaired_from(s, self.turns)]
        return {**self.faults, "illegal": self.illegal, "first": self.turns[0][0], "last": self.turns[-1][0], "paths": paths}


def judged(turns: DataFrame) -> DataFrame:
    """``turns`` (conv, turn, role, text; no null role or text), a row each, with ``fault`` and ``copy``.  Equal rows
    are counted before they are dealt, and first holders of a role and text by partial minima."""
    rows = saved(turns.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies")), "turns")
    said = F.md5("text")
    held = saved(rows.groupBy("conv", "role", said.alias("said")).agg(
        F.min("turn").alias("least"), F.max(F.col("turn").isNull().cast("int")).alias("unnumbered")), "said").withColumnRenamed("role", "by").withColumnRenamed("conv", "of")
    own = rows.join(held, F.col("conv").eqNullSafe(F.col("of")) & (F.col("role") == F.col("by")) & (F.md5("text") == F.col("said")))
    holder = F.col("turn").isNull() | ((F.col("unnumbered") == 0) & (F.col("turn") == F.col("least")))
    each = own.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    fault = (F.when(~F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")), "blank")
             .when(~holder | (F.col("copy") > 1), "duplicate")
             .when(~F.rlike("text", F.lit(r"[.!?][\x20\x09-\x0D]*\z")), "truncated"))
    return each.select("conv", "turn", "role", "text", "copy", fault.alias("fault"))


def chunked(rows: DataFrame) -> DataFrame:
    """The judged turns in order, numbered (part, chunk, at), and behind each chunk a row with its summary."""
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "copy"]
    paths = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    counts = ["blank", "duplicate", "truncated", "illegal"]
    kinds = [("conv", pa.string()), ("part", pa.int32()), ("chunk", pa.int64()), ("at", pa.int32()), ("role", pa.string()), ("text", pa.string()),
             ("first", pa.string()), ("last", pa.string()), *[(c, pa.int64()) for c in counts], ("paths", paths)]
    ddl = ("conv string, part int, chunk long, at int, role string, text string, first string, last string, blank long, duplicate long,"
           " truncated long, illegal long, paths array<struct<start:int,end:int,cost:long,audit:string>>")

    def run(batches):
        part = TaskContext.get().partitionId()
        now: Chunk | None = None
        conv, number = None, -1

        def closed() -> pa.RecordBatch:
            row = {"conv": conv, "part": part, "chunk": number, "at": None, "role": None, "text": None, **now.summary()}
            return pa.RecordBatch.from_arrays([pa.array([row[k]], t) for k, t in kinds], [k for k, _ in kinds])

        for b in batches:
            convs, roles, faults = (column(b, c).to_pylist() for c in ("conv", "role", "fault"))
            chunks, places = [], []
            for c, role, fault in zip(convs, roles, faults):
                fresh = now is None or c != conv
                if fresh or len(now.turns) == CHUNK:
                    if now:
                        yield closed()
                    # the first of a task, and one that goes on, may follow another chunk in any state
                    now = Chunk(STATES if number < 0 or not fresh else (NONE,))
                    conv, number = c, number + 1
                chunks.append(number)
                places.append(len(now.turns))
                now.add(role[:1], fault)
            n = b.num_rows
            made = {"conv": column(b, "conv"), "part": pa.array([part] * n, pa.int32()), "chunk": pa.array(chunks, pa.int64()),
                    "at": pa.array(places, pa.int32()), "role": column(b, "role"), "text": column(b, "text")}
            yield pa.RecordBatch.from_arrays([made.get(k, pa.nulls(n, t)).cast(t) for k, t in kinds], [k for k, _ in kinds])
        if now:
            yield closed()

    return saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "role", "text", "fault").mapInArrow(run, ddl), "chunks")


def conversations(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, object, dict]]:
    """Rows of sorted batches with whether a conversation begins."""
    last, any_ = None, False
    for b in stream:
        for row in b.to_pylist():
            yield not any_ or row["conv"] != last, row["conv"], row
            last, any_ = row["conv"], True


def decided(chunks: DataFrame) -> DataFrame:
    """For each chunk its edits; on a conversation's last chunk also its counts, cost and whole audit."""
    ddl = "conv string, part int, chunk long, edits string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    counts = ("blank", "duplicate", "truncated", "illegal")
    kinds = [("conv", pa.string()), ("part", pa.int32()), ("chunk", pa.int64()), ("edits", pa.string()), *[(c, pa.int64()) for c in (*counts, "cost")], ("audit", pa.string())]

    def run(batches):
        def begin():
            return {"links": [(-1, "")], "best": [(0, 0), None, None, None], "chunks": [], "last": None, **dict.fromkeys(counts, 0)}

        def back(c, node, until=0):
            """Edits of the chunks that lead from node ``until`` to ``node``."""
            out = []
            while node != until:
                node, edits = c["links"][node]
                out.append(edits)
            return out[::-1]

        def less(c, a, b):
            """Whether audit (node, edits) a comes before b: compared from the last chunk's end that they share."""
            x, y = a[0], b[0]
            while x != y:
                x, y = c["links"][x][0], c["links"][y][0]
            return "".join([*back(c, a[0], x), a[1]]) < "".join([*back(c, b[0], x), b[1]])

        def follow(c, row):
            """One more chunk: the least audit of every state that it may end in."""
            if c["last"] is not None and c["last"] + row["first"] not in LEGAL:
                c["illegal"] += 1
            c["last"] = row["last"]
            for k in counts:
                c[k] += row[k]
            found: list = [None] * 4                # (cost, (node, edits))
            for p in row["paths"]:
                before = c["best"][p["start"]]
                if before:
                    new, now = (before[0] + p["cost"], (before[1], p["audit"])), found[p["end"]]
                    if now is None or new[0] < now[0] or (new[0] == now[0] and less(c, new[1], now[1])):
                        found[p["end"]] = new
            c["best"] = [None] * 4
            for s, x in enumerate(found):
                if x:
                    c["links"].append(x[1])
                    c["best"][s] = (x[0], len(c["links"]) - 1)
            c["chunks"].append((row["part"], row["chunk"]))

        def end(conv, c):
            """Rows of a finished conversation."""
            cost, node = min((c["best"][s] for s in (NONE, ASSISTANT) if c["best"][s]), key=lambda x: (x[0], "".join(back(c, x[1]))))
            edits = back(c, node)
            rows = [{"conv": conv, "part": p, "chunk": k, "edits": e} for (p, k), e in zip(c["chunks"], edits)]
            rows[-1] |= {k: c[k] for k in counts} | {"cost": cost, "audit": "".join(edits)}
            return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in kinds], [k for k, _ in kinds])

        now, of = None, None
        for fresh, conv, row in conversations(batches):
            if fresh:
                if now:
                    yield end(of, now)
                now, of = begin(), conv
            follow(now, row)
        if now:
            yield end(of, now)

    rows = chunks.where("paths is not null").select("conv", "part", "chunk", "first", "last", *counts, "paths")
    return saved(rows.repartition("conv").sortWithinPartitions("conv", "part", "chunk").mapInArrow(run, ddl), "edits")


def applied(chunks: DataFrame, edits: DataFrame, digest: bool) -> DataFrame:
    """The repaired turns (conv, place, role, text, edit), or with ``digest`` the sha256 of each conversation's
    ``role:text`` lines.  A conversation's turns are streamed behind their chunk's edits."""
    rows = chunks.where("at is not null").select("conv", "part", "chunk", "at", "role", "text").unionByName(
        edits.select("conv", "part", "chunk", F.lit(-1).alias("at"), F.lit(None).cast("string").alias("role"), F.col("edits").alias("text")))
    stream = rows.repartition("conv").sortWithinPartitions("conv", "part", "chunk", "at")

    def run(batches):
        state, place, edits_left, sha, lines, of = NONE, 0, "", hashlib.sha256(), [], None
        out: list[tuple] = []

        def say(role, text, edit):
            nonlocal state, place
            state = AFTER[state, role[:1]]
            if digest:
                sha.update((("\n" if place else "") + f"{role}:{text}").encode())
            else:
                out.append((of, place, role, text, edit))
            place += 1

        def insertions():
            nonlocal edits_left
            while edits_left.startswith("I"):
                edits_left = edits_left[1:]
                say(ROLE[NEXT[state]], "", "I")

        def record():
            columns = list(zip(*out)) or [[]] * (2 if digest else 5)
            kinds = [("conv", pa.string()), ("repaired_sha256", pa.string())] if digest else [
                ("conv", pa.string()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(columns, kinds)], [k for k, _ in kinds])

        some = False
        for fresh, conv, row in conversations(batches):
            if fresh:
                if some and digest:
                    out.append((of, sha.hexdigest()))
                state, place, edits_left, sha, of, some = NONE, 0, "", hashlib.sha256(), conv, True
            if row["at"] < 0:
                edits_left = row["text"]
            else:
                edit, edits_left = edits_left[0], edits_left[1:]
                if edit != "D":
                    say(row["role"] if edit == "K" else ROLE[NEXT[state]], row["text"], edit)
            insertions()
            if len(out) >= 1000:
                yield record()
                out.clear()
        if some and digest:
            out.append((of, sha.hexdigest()))
        if out:
            yield record()

    return stream.mapInArrow(run, "conv string, repaired_sha256 string" if digest else "conv string, place long, role string, text string, edit string")


def solved(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    ship(turns.sparkSession)
    src = turns.select(turns[conv_col].cast("string").alias("conv"), turns[turn_col].alias("turn"),
                       F.coalesce(turns[role_col], F.lit(" ")).alias("role"), F.coalesce(turns[text_col], F.lit(" ")).alias("text"))
    chunks = chunked(judged(src))
    return src, chunks, decided(chunks)


def repaired_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired conversations: conversation (as text), place, role, text, edit (K, R or I)."""
    _, chunks, edits = solved(turns, conv_col, turn_col, role_col, text_col)
    return applied(chunks, edits, False).withColumnRenamed("conv", conv_col)


def repair_report(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_col`` (as text), gaps (numbers missing between the first and the last turn),
    blank, duplicate, truncated (turns by first fault), illegal (neighbouring roles that may not meet), cost, audit,
    repaired_sha256 (of the repaired ``role:text`` lines)."""
    src, chunks, edits = solved(turns, conv_col, turn_col, role_col, text_col)
    number = lambda c: c.cast("decimal(20,0)")
    gaps = src.groupBy("conv").agg((number(F.max("turn")) - number(F.min("turn")) + 1 - F.count_distinct("turn")).alias("g")).select(
        F.col("conv").alias("c"), F.coalesce(F.col("g").try_cast("long"), F.lit(0).cast("long")).alias("gaps"))
    told = edits.where("cost is not null").select("conv", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    sha = applied(chunks, edits, True).withColumnRenamed("conv", "d")
    return (told.join(gaps, F.col("conv").eqNullSafe(F.col("c"))).join(sha, F.col("conv").eqNullSafe(F.col("d")))
            .select(F.col("conv").alias(conv_col), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``turns`` (conversation, turn, role, text) with repeatable faults, by crc32 of ``conversation:turn`` mod 20: 0 drops
    the row, 1 empties the text, 2 removes its ends of sentences, 3 repeats the row, 4 makes it the user's.  Nulls in the
    key, the role and the text count as one space."""
    blank = lambda c: F.coalesce(turns[c].cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank(conv_col), F.lit(":"), blank(turn_col))) % 20
    rows = turns.select(turns[conv_col], turns[turn_col], blank(role_col).alias(role_col), blank(text_col).alias(text_col), kind.alias("_kind"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace(text_col, "[.!?]", "")).otherwise(F.col(text_col))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col(role_col))
    times = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.where("_kind <> 0").select(conv_col, turn_col, role.alias(role_col), text.alias(text_col), times.alias("_")).drop("_")
