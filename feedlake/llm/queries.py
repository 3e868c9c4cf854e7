"""The registered queries of the operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.llm.chat_template import digests, format_conversations
from feedlake.llm.conversation_repair import damaged, repair_report
from feedlake.llm.decontaminate import overlaps
from feedlake.llm.html_text import extract_main_text
from feedlake.llm.langid import predict as predict_language
from feedlake.llm.langid import train as train_language
from feedlake.llm.maxscore import search
from feedlake.llm.near_dedup import near_duplicates
from feedlake.llm.packing import pack
from feedlake.llm.secret_scan import find_secrets
from feedlake.llm.secret_scan import train as train_secrets
from feedlake.llm.token_count import count_tokens
from feedlake.llm.substring_dedup import drop_repeats
from feedlake.llm.toxicity import score as score_toxicity
from feedlake.llm.toxicity import train as train_toxicity
from feedlake.llm.whitening import whiten
from feedlake.session import apply_defaults
from feedlake.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
SQL: dict[str, str] = {}


def vocabulary() -> str:
    """The public byte-level vocabulary file (a parameter of the operators, never copied)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def register(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(apply_defaults(spark), sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    REGISTRY[fn.__name__] = run
    return run


@register
def op2_token_counts(spark, d):
    """Token count of every document."""
    return count_tokens(read_table(spark, d, "documents"), vocabulary(), limit=1024)


@register
def op7_packing(spark, d):
    """Pieces of every document, packed into sequences of 1024 tokens."""
    p = pack(read_table(spark, d, "documents"), vocabulary(), tokens=1024)
    return p.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@register
def op3_html_text(spark, d):
    """Main text of every page."""
    return extract_main_text(read_table(spark, d, "pages"))


@register
def op4_decontamination(spark, d):
    """Benchmark windows found in every document."""
    found = overlaps(read_table(spark, d, "documents"), read_table(spark, d, "benchmark"), window=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@register
def op5_secrets(spark, d):
    """Secrets found in every document, by the base patterns and the network."""
    docs = read_table(spark, d, "documents")
    found = find_secrets(docs, net=train_secrets(docs))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")  # noqa: E731
    span = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])  # noqa: E731
    base = F.filter("found", lambda x: x["kind"] != "model")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(F.array_join(F.transform(base, span), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("found", span), ",").alias("spans"))


@register
def op8_language_id(spark, d):
    """Language of every document."""
    docs = read_table(spark, d, "documents")
    return predict_language(docs, train_language(docs))


@register
def op10_toxicity(spark, d):
    """Toxicity of every document."""
    docs = read_table(spark, d, "documents")
    return score_toxicity(docs, train_toxicity(docs, read_table(spark, d, "labels")))


@register
def op9_exact_topk(spark, d):
    """The five best candidates of every query vector."""
    return search(read_table(spark, d, "embeddings"), F.col("id") % 50 == 0, k=5)


SQL["op9_exact_topk"] = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(CAST(x AS DOUBLE))]) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(coalesce(list_sum([coalesce(z[1] * z[2], 0) FOR z IN list_zip(a.q, b.q)]), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@register
def op6_chat_formatting(spark, d):
    """Every conversation (and one of control strings) formatted and read back."""
    turns = read_table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return digests(format_conversations(turns.unionByName(extra)))


@register
def op1_near_dedup(spark, d):
    """Near-duplicate components of all documents."""
    return near_duplicates(read_table(spark, d, "documents"), percent=85)


@register
def op11_conversation_repair(spark, d):
    """The cheapest repair of every damaged conversation; those without rows after the damage have an empty one."""
    turns = read_table(spark, d, "conversations")
    report = repair_report(damaged(turns)).withColumnRenamed("conv_id", "conv")
    named = turns.select("conv_id").distinct()
    rows = named.join(report, F.col("conv_id").cast("string").eqNullSafe(F.col("conv")), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                       F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _repair_sql() -> str:
    """The repair as a recursion over turns: each state is (cost, audit, lines), compared in that order."""
    def add(x, cost, letter, line):
        return f"CASE WHEN {x} IS NOT NULL THEN {{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}', 'o': {x}.o || {line}}} END"

    def least(*xs):
        return f"list_min([{', '.join(xs)}])"

    user, assistant = "'user:' || chr(10)", "'assistant:' || chr(10)"
    keep = lambda x, f: add(f"(CASE WHEN f = '{f}' AND NOT must THEN {x} END)", "more", "K", "role || ':' || text || chr(10)")  # noqa: E731
    name = lambda x, r: add(f"(CASE WHEN NOT must THEN {x} END)", "more + 3", "R", f"'{r}:' || text || chr(10)")  # noqa: E731
    drop = lambda x: add(x, 4, "D", "''")  # noqa: E731
    nothing = "CAST({'c': 0, 'a': '', 'o': ''} AS STRUCT(c BIGINT, a VARCHAR, o VARCHAR))"
    return rf"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
c AS (
  SELECT *, xor(list_reduce(list_concat([4294967295], [CAST(ascii(key[i]) AS BIGINT) FOR i IN range(1, length(key) + 1)]),
    lambda h, b: list_reduce(list_concat([xor(h, b)], range(8)), lambda x, j: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 AS kind FROM k),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM c WHERE kind <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d),
q AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][ 	-]*\z') THEN 'truncated' ELSE '' END AS fault,
    substring(role, 1, 1) AS f, lag(substring(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM n),
r AS (SELECT *, fault IN ('blank', 'duplicate') AS must, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more FROM q),
z AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, {nothing} AS e, CASE WHEN false THEN {nothing} END AS s,
         {add(nothing, 3, "I", user)} AS u, {add(add("(" + nothing + ")", 3, "I", user).join("()"), 3, "I", assistant)} AS a
  FROM conversations
  UNION ALL
  SELECT conv_id, i, e, s, {least("u", add("e", 3, "I", user), add("s", 3, "I", user), add("a", 3, "I", user))},
         {least("a", add("u", 3, "I", assistant), add(add("e", 3, "I", user).join("()"), 3, "I", assistant), add(add("s", 3, "I", user).join("()"), 3, "I", assistant))}
  FROM (
    SELECT z.conv_id, r.i, {drop("e")} AS e, {least(drop("s"), keep("e", "s"))} AS s,
           {least(drop("u"), *[g(x, y) for x in "esa" for g, y in ((keep, "u"), (name, "user"))])} AS u,
           {least(drop("a"), keep("u", "a"), name("u", "assistant"))} AS a
    FROM z JOIN r ON r.conv_id IS NOT DISTINCT FROM z.conv_id AND r.i = z.i + 1)),
t AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE before IS NOT NULL AND before || f NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS i
  FROM r GROUP BY conv_id),
w AS (SELECT z.conv_id, z.i, list_min([e, a]) AS x FROM z)
SELECT w.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, x.c AS cost, x.a AS audit, sha256(CASE WHEN x.o = '' THEN '' ELSE left(x.o, length(x.o) - 1) END) AS repaired_sha256
FROM w LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.i = coalesce(t.i, 0)
"""


SQL["op11_conversation_repair"] = _repair_sql()


@register
def op12_whitening(spark, d):
    """Every usable vector on the first eight whitened components."""
    w = whiten(read_table(spark, d, "embeddings"), k=8)
    return w.select("vec_id", "n", "deviation", "identity_error", "explained", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.col("explained")[F.col("at")].alias("explained"), "identity_error")


@register
def op13_substring_dedup(spark, d):
    """Every document without the passages that a document with a smaller id has, too."""
    kept = drop_repeats(read_table(spark, d, "documents"), window=50)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL["op13_substring_dedup"] = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
w AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t),
p AS (
  SELECT doc_id, i, word, count(*) OVER o AS n, md5(string_agg(word, ' ') OVER o) AS h
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
f AS (SELECT h, min(doc_id) AS first FROM p WHERE n = 50 GROUP BY h),
hit AS (SELECT doc_id, i FROM p JOIN f USING (h) WHERE n = 50 AND first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM hit),
k AS (
  SELECT doc_id, count(gone.i) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone.i IS NULL), '') AS kept
  FROM w LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN k USING (doc_id)
"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL["op1_near_dedup"] = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS u, a AS v FROM e UNION SELECT r.u, e.b FROM r JOIN e ON e.a = r.v),
c AS (SELECT u, min(v) AS component FROM r GROUP BY u)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component, doc_id) AS component_id,
       doc_id = coalesce(c.component, doc_id) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.u = doc_id
"""

SQL["op4_decontamination"] = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 10 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[k:k + 9], ' ') FOR k IN range(1, len(w) - 8)] END) AS s
  FROM i),
sizes AS (SELECT DISTINCT len(string_split(s, ' ')) AS size FROM iw),
dp AS (
  SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS k
  FROM d, sizes WHERE len(w) >= size),
hits AS (
  SELECT doc_id, size, k, item_id FROM dp JOIN iw ON array_to_string(w[k:k + size - 1], ' ') = s),
words AS (
  SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS x FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names
  FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_ESCAPED = (r"regexp_replace(replace({0}, '\', '\\'), "
            r"'(<|\[)(s>|/s>|<SYS>>|</SYS>>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|INST\]|/INST\])', '\1\\\2', 'g')")
SQL["op6_chat_formatting"] = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (
  SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
         length({_ESCAPED.format("role")}) + length(role) - length(replace(role, chr(10), '')) + length({_ESCAPED.format("text")})
         + length('<|im_start|>') + length('<|im_end|>') + 2 AS size
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(length(loss)) AS BIGINT) AS loss_chars,
       sha256(string_agg(loss, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
       CAST(length('<s>') + length('</s>') + sum(size) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
