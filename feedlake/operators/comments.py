"""Comment extraction from raw post rows.

A post's comments arrive as one text cell: a JSON list of comment objects
with nested ``replies`` (N1), or the Python-repr text of such a list (N2).
Everything here is a narrow, per-row transformation — no shuffle:

* N1 has two ways, chosen per row by how deep the cell's brackets nest.  Up to
  ``WALK_DEPTH`` the cell is parsed once as VARIANT and walked level by level
  with one ``aggregate`` (frontier -> children), on the JVM.  A deeper cell,
  whatever its depth, goes through one token scan with a stack of open brackets
  (``comment_bodies``), which is linear in the cell and cuts it into comment
  objects without their replies; those are parsed as VARIANT like any other.
  Nested lists are spliced in place; non-object items are skipped; order is the
  depth-first pre-order.
* N2 runs one regex over the cell (five capture groups, zipped) and decodes
  Python string escapes and ``datetime(...)`` arguments.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlake.functions import text as X

_VARRAY = T.ArrayType(T.VariantType())
#: brackets nested deeper than this are scanned instead of walked (the JSON reader itself stops at 1000)
WALK_DEPTH = 100
# fixed values: the key names a comment object may use, first present wins
_FIELDS = {
    "username": ["author", "username", "user", "name"],
    "raw_id": ["comment_id", "id", "commentId"],
    "text": ["text", "content", "body", "comment"],
    "time": ["date", "time", "created_at", "timestamp"],
    "parent": ["parent_id"],
}
COMMENT_COLUMNS = ["comment_id", "post_id", "user_id", "username", "comment_text", "comment_time",
                   "parent_comment_id", "parent_comment_key"]


# N1 -------------------------------------------------------------------------
def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def nesting(cell: Column) -> Column:
    """How deep the brackets of a JSON text nest, strings left out."""
    bare = F.regexp_replace(cell, r'(?s)"(?:[^"\\]++|\\.)*+"', "")
    marks = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    walk = F.aggregate(
        marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda acc, m: F.struct(
            (acc["now"] + F.when(m.isin("[", "{"), 1).when(m.isin("]", "}"), -1).otherwise(0)).alias("now"),
            F.greatest(acc["most"], acc["now"] + F.when(m.isin("[", "{"), 1).otherwise(0)).alias("most")),
        lambda acc: acc["most"])
    return F.coalesce(walk, F.lit(0))


def _node_fields(node: Column) -> list[Column]:
    out = []
    for name, keys in _FIELDS.items():
        vals = [F.try_variant_get(node, f"$.{k}", "string") for k in keys]
        out.append(F.coalesce(*[F.nullif(v, F.lit("")) for v in vals]).alias(name))
    return out


_STEP_TYPE = T.ArrayType(T.StructType([T.StructField("path", T.ArrayType(T.IntegerType())),
                                         T.StructField("node", T.VariantType())]))


def comment_bodies():
    """UDF: a JSON text -> its containers on the comment path (lists, comment
    objects, ``replies`` and what they hold) in the order they open, each as
    its own text with the containers inside it replaced by null; null where
    brackets do not match.  The stack holds one entry per open bracket."""

    def scan(cell: str) -> list[dict] | None:
        import json
        import re

        out: list[dict] = []            # comment?, body
        stack: list[list] = []          # of containers on the path: [place in out, is list?, pieces, start of the next piece, last string, value next?]
        off = 0                         # open brackets within a value that is not on the path
        for m in re.finditer(r'"(?:[^"\\]|\\.)*"|[\[\]{}:,]', cell, re.S):
            t, top = m[0], stack[-1] if stack else None
            if off:
                off += (t in "[{") - (t in "]}") if len(t) == 1 else 0
            elif t in ("[", "{"):
                if top and not (top[1] or (top[5] and top[4] == "replies")):
                    off = 1
                    continue
                if not top and out:
                    return None         # a second value
                if top:
                    top[2].append(cell[top[3]:m.start()] + "null")
                out.append({"comment": t == "{", "body": None})
                stack.append([len(out) - 1, t == "[", [], m.start(), None, False])
            elif t in ("]", "}"):
                if not top or top[1] != (t == "]"):
                    return None
                place, _, pieces, start, *_ = stack.pop()
                out[place]["body"] = "".join(pieces) + cell[start:m.end()]
                if stack:
                    stack[-1][3] = m.end()
            elif top and not top[1]:
                if t in (":", ","):
                    top[5] = t == ":"
                elif not top[5]:
                    top[4] = json.loads(t, strict=False) if "\\" in t else t[1:-1]
        return out if not stack and not off else None

    @F.pandas_udf("array<struct<comment:boolean,body:string>>")
    def bodies(cells: pd.Series) -> pd.Series:
        return cells.map(lambda c: None if c is None else scan(c))

    return bodies


def _scanned(cell: Column) -> Column:
    """Nodes of a deep cell; null where it is not JSON.  A value off the
    comment path that the JSON reader cannot open is an error, not a loss."""
    parts = comment_bodies()(cell)
    opened = F.transform(parts, lambda p: F.struct(
        p["comment"].alias("comment"), F.try_parse_json(p["body"]).alias("node"),
        (nesting(p["body"]) > 1000).alias("too_deep")))
    checked = F.when(F.exists(opened, lambda p: p["too_deep"]), F.raise_error(F.lit("a comment field nests deeper than the JSON reader goes"))) \
        .when(F.forall(opened, lambda p: p["node"].isNotNull()), opened)
    kept = F.filter(checked, lambda p: p["comment"])
    return F.transform(kept, lambda p, i: F.struct(F.array(i).alias("path"), *_node_fields(p["node"])))


def with_comment_nodes(df: DataFrame, comments: str, out: str = "_nodes", is_json: str = "_is_json") -> DataFrame:
    """Add ``out``: the cell's comment objects as (path, fields) structs in
    depth-first pre-order (empty unless the cell is JSON), and ``is_json``.

    The walk's state is (frontier, seen).  A step opens every frontier value:
    a list gives its items, an object is a comment and gives its ``replies``;
    anything else ends.  Each step goes one bracket deeper, so ``nesting``
    steps see every comment; once the frontier is empty a step costs nothing."""
    cell = F.col(comments)
    df = df.withColumn("_depth", nesting(cell))
    deep = F.col("_depth") > WALK_DEPTH
    root = F.when(~deep, F.try_parse_json(cell))
    none = F.array().cast(_STEP_TYPE)
    first = F.when(root.isNotNull(), F.array(F.struct(F.array().cast("array<int>").alias("path"), root.alias("node"))).cast(_STEP_TYPE)).otherwise(none)
    init = F.struct(first.alias("frontier"), none.alias("seen"))

    def opened(p: Column) -> Column:
        node, path = p.getField("node"), p.getField("path")
        items = F.when(_kind(node).startswith("ARRAY"), F.try_variant_get(node, "$", "array<variant>")) \
            .when(_kind(node).startswith("OBJECT"), F.array(F.try_variant_get(node, "$.replies", "variant"))) \
            .otherwise(F.array().cast(_VARRAY))
        return F.transform(items, lambda c, j: F.struct(F.concat(path, F.array(j)).alias("path"), c.alias("node")))

    def step(acc, _):
        frontier = acc.getField("frontier")
        children = F.filter(F.flatten(F.transform(frontier, opened)), lambda p: p.getField("node").isNotNull())
        comments_here = F.filter(frontier, lambda p: _kind(p.getField("node")).startswith("OBJECT"))
        return F.when(F.size(frontier) == 0, acc).otherwise(F.struct(
            children.cast(_STEP_TYPE).alias("frontier"),
            F.concat(acc.getField("seen"), comments_here).alias("seen")))

    steps = F.when(root.isNotNull(), F.col("_depth")).otherwise(F.lit(0))
    walked = F.aggregate(F.sequence(F.lit(0), steps), init, step)
    cur = df.withColumn("_walk", walked).withColumn("_deep", _scanned(F.when(deep, cell)))
    nodes = F.array_sort(F.transform(F.col("_walk.seen"), lambda p: F.struct(p.getField("path").alias("path"),
                                                                             *_node_fields(p.getField("node")))))
    found = cur.withColumn(out, nodes)
    kind = found.schema[out].dataType
    return (found.withColumn(out, F.when(deep, F.coalesce(F.col("_deep").cast(kind), F.array().cast(kind))).otherwise(F.col(out)))
            .withColumn(is_json, F.when(deep, F.col("_deep").isNotNull()).otherwise(root.isNotNull())).drop("_walk", "_deep", "_depth"))


def _explode_nodes(cur: DataFrame, post_id: str, nodes: str = "_nodes") -> DataFrame:
    """One output row per node, numbered in node order (the running index)."""
    # the outer form: for plain explode Spark infers `size(nodes) > 0` and
    # pushes it below the node projection, inlining the whole tree walk
    exploded = (cur.select("*", F.posexplode_outer(nodes).alias("_i", "_n")).drop(nodes)
                .filter(F.col("_i").isNotNull()))
    i = F.col("_i").cast("string")
    pid = F.col(post_id).cast("string")
    username = F.coalesce(F.col("_n.username"), F.concat(F.lit("anonymous_"), i))
    raw_id = F.coalesce(F.col("_n.raw_id"), F.concat_ws("_", pid, i, username))
    return exploded.select(
        "*",
        X.make_id("comment", raw_id).alias("comment_id"),
        username.alias("username"),
        X.make_id("user", username).alias("user_id"),
        F.coalesce(F.col("_n.text"), F.lit("")).alias("comment_text"),
        F.coalesce(F.col("_n.time"), F.lit("")).alias("comment_time"),
        F.coalesce(F.col("_n.parent"), F.lit("")).alias("parent_comment_id"),
        # The parent id hashed like comment ids, so replies join to parents
        F.when(F.coalesce(F.col("_n.parent"), F.lit("")) != "", X.make_id("comment", F.col("_n.parent")))
        .otherwise(F.lit("")).alias("parent_comment_key"),
    ).drop("_i", "_n")


def flatten_comment_objects(df: DataFrame, post_id: str, comments: str) -> DataFrame:
    """One output row per comment object, in depth-first pre-order."""
    return _explode_nodes(with_comment_nodes(df, comments).drop("_is_json"), post_id)


# N2 -------------------------------------------------------------------------
# fixed value: the repr-text pattern (five groups: id, author, timestamp args,
# content, parent), dot matching newlines.  The content group is written with
# possessive quantifiers (same matches; its alternatives are disjoint) so long
# texts do not exhaust the JVM regex stack.
REPR_PATTERN = (r"(?s)'comment_id':\s*'([^']*)'.*?"
                r"'author':\s*'([^']*)'.*?"
                r"'timestamp':\s*datetime\.datetime\(([^\)]*)\).*?"
                r"'content':\s*'((?:[^'\\]++|\\.)*+)'.*?"
                r"'parent_id':\s*(None|'[^']*')")

# fixed values: the string escapes of one character
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"', "a": "\a", "b": "\b", "f": "\f",
            "v": "\v", "\n": ""}
_ESCAPE_TOKENS = (r"(?s)\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8}|\\[0-7]{1,3}|\\.|[^\\]++|\\$")


def _code_point(hex_digits: Column) -> Column:
    """The character of a code point in hex digits."""
    return F.decode(F.unhex(F.lpad(hex_digits, 8, "0")), "UTF-32")


def decode_py_literal(col: Column) -> Column:
    """Undo Python string escapes: single characters, octal, \\x, \\u and
    \\U; an unknown escape stays as it is."""
    tokens = F.regexp_extract_all(col, F.lit(_ESCAPE_TOKENS), 0)

    def one(tok: Column) -> Column:
        expr = F.when(~tok.startswith("\\") | (F.length(tok) < 2), tok)
        expr = expr.when(tok.rlike(r"(?s)^\\[xuU][0-9a-fA-F]{2}"), _code_point(tok.substr(F.lit(3), F.length(tok) - 2)))
        expr = expr.when(tok.rlike(r"^\\[0-7]"), _code_point(F.conv(tok.substr(F.lit(2), F.length(tok) - 1), 8, 16)))
        for k, v in _ESCAPES.items():
            expr = expr.when(tok == F.lit("\\" + k), F.lit(v))
        return expr.otherwise(tok)

    return F.when(col.contains("\\"), F.array_join(F.transform(tokens, one), "")).otherwise(col)


def repr_nodes(comments: str) -> Column:
    """N2 as nodes: one struct per regex match, in text order, with the same
    fields as the tree nodes (an empty id falls back like a missing one)."""
    text = F.col(comments)
    groups = [F.regexp_extract_all(text, F.lit(REPR_PATTERN), g) for g in range(1, 6)]

    def node(m, i):
        raw_id, author, ts_args, content, parent = [m.getField(str(g)) for g in range(5)]
        par = F.when(parent.isNull() | (parent == "None"), F.lit("")).otherwise(
            decode_py_literal(parent.substr(F.lit(2), F.length(parent) - 2)))
        return F.struct(F.array(i).alias("path"), decode_py_literal(author).alias("username"),
                        F.nullif(raw_id, F.lit("")).alias("raw_id"), decode_py_literal(content).alias("text"),
                        X.parse_datetime_repr(ts_args).alias("time"), par.alias("parent"))

    return F.transform(F.arrays_zip(*groups), node)


def comments_from_repr(df: DataFrame, post_id: str, comments: str) -> DataFrame:
    """One row per regex match, in text order."""
    return _explode_nodes(df.withColumn("_nodes", repr_nodes(comments)), post_id)


# N3 -------------------------------------------------------------------------
def extract_comments(df: DataFrame, post_id: str = "post_id", comments: str = "comments") -> DataFrame:
    """JSON cells go through N1, other text through N2, null cells yield
    nothing — decided per row, then one explode (no union, one pass).
    Output: the input columns + the comment columns."""
    c = F.col(comments)
    cur = with_comment_nodes(df, comments, out="_tree")
    node_type = cur.schema["_tree"].dataType
    nodes = (F.when(F.col("_is_json"), F.col("_tree"))
             .when(c.isNotNull(), repr_nodes(comments).cast(node_type))
             .otherwise(F.array().cast(node_type)))
    return _explode_nodes(cur.withColumn("_nodes", nodes).drop("_tree", "_is_json"), post_id)


def repr_count(comments: str = "comments") -> Column:
    return F.size(F.regexp_extract_all(F.col(comments), F.lit(REPR_PATTERN), 1))


# N4 -------------------------------------------------------------------------
def _raw_title() -> Column:
    return F.coalesce(F.col("title"), F.concat(F.lit("post_"), F.col("index").cast("string")))


def raw_post_key() -> Column:
    """The natural key a raw row's post id is hashed from."""
    return F.coalesce(F.col("url"), F.concat(_raw_title(), F.col("index").cast("string")))


def post_rows(raw: DataFrame) -> DataFrame:
    """Raw dataset row -> staging post row (id from url, else title + index; a
    missing title is ``post_<index>``; alternative image keys; comment count
    defaults to the comments found)."""
    post_id = X.make_id("post", raw_post_key())
    kind = {f.name: f.dataType for f in raw.schema.fields}
    text = lambda c: X.safe_text(F.col(c), kind[c])
    author = F.coalesce(F.col("author"), F.lit("unknown_author"))
    image = X.first_non_empty("featured_image", "image", "image_url")
    image_url = F.coalesce(image, F.lit(""))
    c = F.col("comments")
    found = (F.when(c.isNull(), F.lit(0))
             .when(F.col("_is_json"), F.size("_nodes"))
             .otherwise(repr_count("comments")))
    return with_comment_nodes(raw, "comments").select(
        post_id.alias("post_id"),
        X.safe_text(_raw_title()).alias("title"),
        X.make_id("user", author).alias("author_id"),
        X.safe_text(author).alias("author"),
        text("url").alias("url"),
        text("content").alias("content"),
        text("excerpt").alias("excerpt"),
        text("categories").alias("categories"),
        text("tags").alias("tags"),
        X.safe_text(F.coalesce(F.col("published_at"), F.col("date"))).alias("published_at"),
        F.coalesce(F.col("comments_count"), found).alias("comments_count"),
        image_url.alias("image_url"),
        X.image_filename(image_url, post_id).alias("image_path"),
    )


def comment_rows(raw: DataFrame) -> DataFrame:
    """N3 over raw rows keyed by their derived post id."""
    keyed = raw.select(X.make_id("post", raw_post_key()).alias("post_id"), "comments")
    return extract_comments(keyed).select(*COMMENT_COLUMNS)
