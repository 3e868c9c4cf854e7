"""Chat formatting (6): a compiler for a small, sandboxed template language.

A template is parsed into a syntax tree, constant parts are folded, and the tree becomes Python closures.  Rendering
a conversation gives its text and the spans of its generation markers (what the loss is taken on).  The language
has ``{{ expression }}``, ``{% if %}/{% elif %}/{% else %}/{% endif %}``, ``{% for x in list %}/{% endfor %}`` (with
``loop.index0``, ``loop.first``, ``loop.last``) and ``{% generation %}/{% endgeneration %}``; expressions have text,
whole numbers, true/false, names, ``.field``, ``[index]``, ``+ == != < >``, ``and or not``, brackets and the filters
``trim``, ``upper``, ``lower``, ``escape`` and ``line``.  There are no calls and no attribute access to Python objects, so a
template cannot reach anything but the conversation.

Texts may hold the template's control strings.  ``escape`` doubles each backslash and puts one after a control
string's first character, ``line`` also writes line breaks as a backslash and n; ``unescape`` takes both back, so what is read from the output is what went in.

Cases: null roles and texts count as empty; turns are ordered by number, then role, then text, null first, so equal
or missing numbers have a defined order; repeated rows are turns each; a null conversation id is a conversation of
its own; an empty table gives no rows; clashing extra columns are not read.

Scale: turns are rendered one by one, each in the task that has its range of (conversation, turn), so a conversation of
any size spreads over many tasks and a task holds one Arrow batch.  The template must therefore name ``messages`` in one
loop outside any other tag (else ``TemplateError``); what it says of other turns must come from ``loop``.
``compile_template`` renders a list of messages by any template.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlake.llm.arrowtext import column, saved, ship

#: fixed values: strings that steer public chat models, none of which may come out of a text unescaped
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
TEMPLATE = (
    "{{ '<s>' }}{% for m in messages %}{{ '<|im_start|>' + m.role | line }}{{ '\\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}{{ '<|im_end|>' + '\\n' }}{% endfor %}{{ '</s>' }}")

_control = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_escaped = re.compile(r"\\([\\n]?)")


def escape(text: str) -> str:
    if "\\" in text:
        text = text.replace("\\", "\\\\")
    if "<" in text or "[" in text:
        text = _control.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)
    return text


def line(text: str) -> str:
    """Escaped, on one line; no control string has an n after its first character."""
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    return _escaped.sub(lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


class TemplateError(ValueError):
    """The template is not of the language."""


# --- syntax tree: tuples whose first element names the kind
_part = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
_token = re.compile(r"\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[+<>|.()\[\]]))")
_codes = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}
FILTERS: dict[str, Callable[[str], str]] = {"trim": str.strip, "upper": str.upper, "lower": str.lower, "escape": escape, "line": line}


def _lex(source: str) -> list[tuple[str, object]]:
    out, at = [], 0
    while source[at:].strip():
        m = _token.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at:].strip()[:20]!r}")
        kind = m.lastgroup
        value: object = m[kind]
        if kind == "text":
            value = re.sub(r"\\(.)", lambda e: _codes.get(e[1], e[1]), m[kind][1:-1], flags=re.S)
        elif kind == "number":
            value = int(m[kind])
        out.append((kind, value))
        at = m.end()
    return out + [("end", None)]


class _Expression:
    """Recursive descent over one expression's tokens; operators from loose to tight."""

    def __init__(self, source: str):
        self.tokens, self.at = _lex(source), 0

    def whole(self):
        node = self.either()
        if self.tokens[self.at][0] != "end":
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def accept(self, kind: str, *values) -> object:
        k, v = self.tokens[self.at]
        if k == kind and (not values or v in values):
            self.at += 1
            return v
        return None

    def expect(self, kind: str, *values) -> object:
        v = self.accept(kind, *values)
        if v is None:
            raise TemplateError(f"expected {values or kind}, found {self.tokens[self.at][1]!r}")
        return v

    def either(self):
        node = self.both()
        while self.accept("name", "or"):
            node = ("or", node, self.both())
        return node

    def both(self):
        node = self.negated()
        while self.accept("name", "and"):
            node = ("and", node, self.negated())
        return node

    def negated(self):
        return ("not", self.negated()) if self.accept("name", "not") else self.compared()

    def compared(self):
        node = self.added()
        op = self.accept("op", "==", "!=", "<", ">")
        return (op, node, self.added()) if op else node

    def added(self):
        node = self.filtered()
        while self.accept("op", "+"):
            node = ("+", node, self.filtered())
        return node

    def filtered(self):
        node = self.value()
        while True:
            if self.accept("op", "."):
                node = ("field", node, self.expect("name"))
            elif self.accept("op", "["):
                node = ("field", node, self.either())
                self.expect("op", "]")
            elif self.accept("op", "|"):
                name = self.expect("name")
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                node = ("filter", name, node)
            else:
                return node

    def value(self):
        kind, v = self.tokens[self.at]
        self.at += 1
        if kind in ("text", "number"):
            return ("const", v)
        if kind == "name" and v not in ("or", "and", "not"):
            return ("const", v == "true") if v in ("true", "false") else ("name", v)
        if (kind, v) == ("op", "("):
            node = self.either()
            self.expect("op", ")")
            return node
        raise TemplateError(f"unexpected {v!r}")


def parse(source: str) -> list:
    """The template's tree: a list of ('text', s), ('put', e), ('if', [(e, body)...]), ('for', name, e, body),
    ('generation', body)."""
    parts = [p for p in _part.split(source) if p]
    at = 0

    def body(ends: tuple[str, ...]) -> tuple[list, str]:
        nonlocal at
        out: list = []
        while at < len(parts):
            p = parts[at]
            at += 1
            if p.startswith("{{"):
                out.append(("put", _Expression(p[2:-2]).whole()))
            elif p.startswith("{%"):
                tag = p[2:-2].strip()
                word = tag.split(None, 1)[0] if tag else ""
                if word in ends:
                    return out, tag
                if word == "if":
                    arms, rest = [], tag[2:]
                    while True:
                        test = ("const", True) if rest is None else _Expression(rest).whole()
                        inner, end = body(("elif", "else", "endif") if rest is not None else ("endif",))
                        arms.append((test, inner))
                        if end == "endif":
                            break
                        rest = end[4:] if end.startswith("elif") else None
                    out.append(("if", arms))
                elif word == "for":
                    m = re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+(.+)", tag, re.S)
                    if not m:
                        raise TemplateError(f"bad loop {tag!r}")
                    out.append(("for", m[1], _Expression(m[2]).whole(), body(("endfor",))[0]))
                elif word == "generation":
                    out.append(("generation", body(("endgeneration",))[0]))
                else:
                    raise TemplateError(f"unknown tag {tag!r}")
            else:
                out.append(("text", p))
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return out, ""

    return body(())[0]


_plain = {"+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else f"{a}{b}", "==": lambda a, b: a == b,
          "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b}


def fold(node):
    """An expression with its constant parts worked out."""
    kind = node[0]
    if kind in _plain:
        a, b = fold(node[1]), fold(node[2])
        return ("const", _plain[kind](a[1], b[1])) if a[0] == b[0] == "const" else (kind, a, b)
    if kind == "not":
        a = fold(node[1])
        return ("const", not a[1]) if a[0] == "const" else ("not", a)
    if kind in ("and", "or"):
        a, b = fold(node[1]), fold(node[2])
        if a[0] == "const":
            return b if bool(a[1]) == (kind == "and") else a
        return (kind, a, b)
    if kind == "filter":
        a = fold(node[2])
        return ("const", FILTERS[node[1]](str(a[1]))) if a[0] == "const" else ("filter", node[1], a)
    if kind == "field":
        return ("field", fold(node[1]), fold(node[2]) if isinstance(node[2], tuple) else ("const", node[2]))
    return node


def fold_body(body: list) -> list:
    """A body with folded expressions, without arms that cannot be taken, its neighbouring texts joined."""
    out: list = []

    def text(s: str) -> None:
        if out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + s)
        elif s:
            out.append(("text", s))

    for node in body:
        if node[0] == "text":
            text(node[1])
        elif node[0] == "put":
            e = fold(node[1])
            text(str(e[1])) if e[0] == "const" else out.append(("put", e))
        elif node[0] == "if":
            arms = []
            for test, inner in node[1]:
                test = fold(test)
                if test[0] == "const" and not test[1]:
                    continue
                arms.append((test, fold_body(inner)))
                if test[0] == "const":
                    break
            if arms and arms[0][0][0] == "const":
                for x in arms[0][1]:
                    text(x[1]) if x[0] == "text" else out.append(x)
            elif arms:
                out.append(("if", arms))
        elif node[0] == "for":
            out.append(("for", node[1], fold(node[2]), fold_body(node[3])))
        else:
            out.append(("generation", fold_body(node[1])))
    return out


# --- closures: expressions take the names, bodies take the names and the output
class Output:
    """The rendered parts, their length so far and the generation spans."""

    __slots__ = ("parts", "length", "spans")

    def __init__(self):
        self.parts, self.length, self.spans = [], 0, []

    def put(self, s: str) -> None:
        self.parts.append(s)
        self.length += len(s)


def _value(node) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        v = node[1]
        return lambda names: v
    if kind == "name":
        name = node[1]
        return lambda names: names.get(name, "")
    if kind == "field":
        a, b = _value(node[1]), _value(node[2])

        def field(names):
            whole, key = a(names), b(names)
            if isinstance(whole, dict):
                return whole.get(key, "")
            if isinstance(whole, list) and isinstance(key, int):
                return whole[key] if key < len(whole) else ""
            return ""
        return field
    if kind == "filter":
        f, a = FILTERS[node[1]], _value(node[2])
        return lambda names: f(str(a(names)))
    if kind == "not":
        a = _value(node[1])
        return lambda names: not a(names)
    a, b = _value(node[1]), _value(node[2])
    if kind == "and":
        return lambda names: a(names) and b(names)
    if kind == "or":
        return lambda names: a(names) or b(names)
    op = _plain[kind]
    return lambda names: op(a(names), b(names))


def _body(nodes: list) -> Callable[[dict, Output], None]:
    steps = [_step(n) for n in nodes]

    def run(names: dict, out: Output) -> None:
        for s in steps:
            s(names, out)
    return run


def _step(node) -> Callable[[dict, Output], None]:
    kind = node[0]
    if kind == "text":
        s = node[1]
        return lambda names, out: out.put(s)
    if kind == "put":
        e = _value(node[1])
        return lambda names, out: out.put(str(e(names)))
    if kind == "if":
        arms = [(_value(t), _body(b)) for t, b in node[1]]

        def choose(names, out):
            for test, inner in arms:
                if test(names):
                    inner(names, out)
                    return
        return choose
    if kind == "for":
        name, items, inner = node[1], _value(node[2]), _body(node[3])

        def loop(names, out):
            rows = items(names)
            rows = rows if isinstance(rows, list) else []
            own = dict(names)
            for i, x in enumerate(rows):
                own[name] = x
                own["loop"] = {"index0": i, "first": i == 0, "last": i == len(rows) - 1}
                inner(own, out)
        return loop
    inner = _body(node[1])

    def generation(names, out):
        start = out.length
        inner(names, out)
        out.spans.append((start, out.length))
    return generation


@lru_cache(16)
def compile_template(source: str) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
    """Closures that render messages (dicts of role and text) to a text and its generation spans."""
    run = _body(fold_body(parse(source)))

    def render(messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        run({"messages": messages}, out)
        return "".join(out.parts), out.spans
    return render


_turn = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)


def read_back(text: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a text that TEMPLATE rendered."""
    return [(unescape(m[1]), unescape(m[2])) for m in _turn.finditer(text)]


@lru_cache(16)
def turn_renderer(source: str) -> Callable[[dict, int, bool], tuple[str, list[tuple[int, int]]]]:
    """Closures that render one turn: (message, place, whether it is the last) to its text and generation spans.  The
    first turn takes what stands before the template's loop over the messages along, the last one what stands behind."""
    nodes = fold_body(parse(source))

    def named(tree) -> bool:
        return tree == ("name", "messages") or isinstance(tree, (list, tuple)) and any(map(named, tree))

    loops = [i for i, n in enumerate(nodes) if n[0] == "for" and n[2] == ("name", "messages")]
    if len(loops) != 1 or named(nodes[:loops[0]]) or named(nodes[loops[0]][3]) or named(nodes[loops[0] + 1:]):
        raise TemplateError("messages must be named by one loop, outside any other tag")
    at = loops[0]
    name, head, turn, tail = nodes[at][1], _body(nodes[:at]), _body(nodes[at][3]), _body(nodes[at + 1:])

    def render(message: dict, place: int, last: bool) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        if place == 0:
            head({}, out)
        turn({name: message, "loop": {"index0": place, "first": place == 0, "last": last}}, out)
        if last:
            tail({}, out)
        return "".join(out.parts), out.spans
    return render


def placed(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """The turns (id, role, text) with their place in the conversation and whether they are its last.  They are dealt by
    ranges of their order, so that a conversation of any size spreads over many tasks."""
    rows = turns.select(turns[id_col].alias("id"), turns[turn_col].alias("turn"), F.coalesce(turns[role_col], F.lit("")).alias("role"),
                        F.coalesce(turns[text_col], F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())      # tells repeated rows apart, to spread them too
    order = ("id", "turn", "role", "text", "row")

    def run(batches):
        part, at, of, held = TaskContext.get().partitionId(), -1, None, None

        def told(b, places, last):
            n = b.num_rows
            return pa.RecordBatch.from_arrays([column(b, "id"), pa.array([part] * n, pa.int32()), pa.array(places, pa.int64()),
                                               pa.array(last, pa.bool_()), column(b, "role"), column(b, "text")],
                                              ["id", "part", "at", "last", "role", "text"])

        for b in batches:
            if not b.num_rows:
                continue
            ids, places = column(b, "id").to_pylist(), []
            if held:                                # whether its last row ends a conversation shows only here
                yield told(*held[:2], [*held[2], ids[0] != of])
            for x in ids:
                at = at + 1 if at >= 0 and x == of else 0
                of = x
                places.append(at)
            held = b, places, [x != y for x, y in zip(ids, ids[1:])]
        if held:
            yield told(*held[:2], [*held[2], True])

    kind = rows.schema["id"].dataType.simpleString()
    parts = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "role", "text").mapInArrow(
        run, f"id {kind}, part int, at long, last boolean, role string, text string"), "turns")
    # a part shares its first and its last conversation at most, so the edges have two rows a part
    along = Window.partitionBy("id").orderBy("part")
    edges = parts.groupBy("id", "part").agg(F.count("*").alias("n")).select(
        F.col("id").alias("e"), F.col("part").alias("p"), F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.lead("part").over(along).isNotNull().alias("goes_on")).where("before is not null or goes_on")
    own = F.col("id").eqNullSafe(F.col("e")) & (F.col("part") == F.col("p"))
    return parts.join(F.broadcast(edges), own, "left").select(
        "id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("place"),
        (F.col("last") & ~F.coalesce("goes_on", F.lit(False))).alias("last"), "role", "text")


def format_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", template: str = TEMPLATE) -> DataFrame:
    """One row per turn: id, place (from 0), formatted, spans (array of begin, end; code points of ``formatted`` under the
    loss mask).  A conversation's text is its rows' texts, joined by place."""
    turn_renderer(template)                        # a bad template fails here
    ship(turns.sparkSession)
    rows = placed(turns, id_col, turn_col, role_col, text_col)
    item = pa.struct([("begin", pa.int64()), ("end", pa.int64())])

    def run(batches):
        render = turn_renderer(template)
        for b in batches:
            texts, spans = [], []
            for role, text, place, last in zip(*(column(b, c).to_pylist() for c in ("role", "text", "place", "last"))):
                formatted, own = render({"role": role, "text": text}, place, last)
                texts.append(formatted)
                spans.append([{"begin": s, "end": e} for s, e in own])
            yield pa.RecordBatch.from_arrays([column(b, "id"), column(b, "place"), pa.array(texts, pa.string()), pa.array(spans, pa.list_(item))],
                                             [id_col, "place", "formatted", "spans"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, place long, formatted string, spans array<struct<begin:long,end:long>>")


def digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What the formatted texts say when read back: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest of a whole text needs the text in order: a conversation's rows are streamed through one task, which holds
    an Arrow batch and what has not yet been read back, a turn at most."""
    ship(formatted.sparkSession)
    own = formatted.select(formatted[id_col].alias("id"), "place", "formatted", "spans")
    kinds = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]

    def run(batches):
        found, kind = [], pa.int64()

        def table():
            cols = list(zip(*found))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, k) for c, (_, k) in zip(cols[1:], kinds))],
                                              [id_col, *(n for n, _ in kinds)])

        def rows():
            nonlocal kind
            for b in batches:
                kind = column(b, "id").type
                yield from zip(*(column(b, c).to_pylist() for c in ("id", "formatted", "spans")))

        for key, pieces in groupby(rows(), itemgetter(0)):
            said, loss, n_turns, n_loss, n_chars, rest = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, ""
            for _, text, spans in pieces:
                n_chars += len(text)
                for s in spans:
                    part = unescape(text[s["begin"]:s["end"]])
                    n_loss += len(part)
                    loss.update(part.encode())
                rest, end = rest + text, 0
                for m in _turn.finditer(rest):
                    n_turns, end = n_turns + 1, m.end()
                    said.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                rest = rest[end:]
            found.append((key, n_turns, said.hexdigest(), n_loss, loss.hexdigest(), n_chars))
            if len(found) >= 1000:
                yield table()
                found.clear()
        if found:
            yield table()

    kind = own.schema["id"].dataType.simpleString()
    return own.repartition("id").sortWithinPartitions("id", "place").drop("place").mapInArrow(
        run, f"`{id_col}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
