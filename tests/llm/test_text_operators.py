"""Token counts, HTML text, decontamination, packing and chat formatting against plain versions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlake.llm import chat_template as C
from feedlake.llm import queries as Q
from feedlake.llm.decontaminate import decontaminate, overlaps
from feedlake.llm.html_text import extract_main_text, main_text
from feedlake.llm.packing import pack
from feedlake.llm.token_count import count_tokens, counter

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "a  b", "\n\na b\n", "<|endoftext|>", "x <|endoftext|>  y<|endoftext|>", "it's I'll 12 3a",
       "a\x1cb \x1c c", "x\x85 y", "日本語 テキスト", "é́ 👍🏽  ok", "a\xa0b \xa0c  ", "x" * 3000, "ab " * 4000, "ſecret", "\x00 \x01"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(Q.vocabulary())


def docs_of(spark, texts, extra=True):
    schema = "doc_id long, text string, lang string, source string, n_chars long" + (", id string, row int, score string, kept int, a int" if extra else "")
    rows = [(i, t, "en", "s", len(t or "")) + (("x", 1, "y", 2, 3) if extra else ()) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def words(text, pattern):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(pattern, low)


# --- token counts
def test_counts_as_the_library(library):
    c = counter(Q.vocabulary())
    r = random.Random(1)
    pieces = ["a", "bc", " ", "  ", "\n", "\x1c", "\x85", "1", "'s", "é", "!?", "<|endoftext|>", "日", "\t", "the", "ing"]
    for text in [t or "" for t in ODD] + ["".join(r.choices(pieces, k=r.randint(1, 15))) for _ in range(2000)]:
        assert c.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_token_count_rows(spark, library):
    rows = count_tokens(docs_of(spark, ODD + ODD[:2]), Q.vocabulary(), limit=1024).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        text = (ODD + ODD[:2])[r.doc_id] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 1024)
    assert count_tokens(empty_docs(spark), Q.vocabulary()).count() == 0


def test_token_count_query(spark, library):
    got = {r.doc_id: r.n_tokens for r in Q.REGISTRY["op2_token_counts"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got == {d.doc_id: len(library.encode(d.text, add_special_tokens=False).ids) for d in docs}


# --- packing
def check_packing(rows, texts, library, limit=1024, segments=128):
    ids = {k: np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for k, t in texts.items()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        by_doc[r.doc_id].append((r.start, r.length))
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(ids)
    for k, parts in by_doc.items():
        at = 0
        for s, n in sorted(parts):
            assert s == at
            at += n
        assert at == len(ids[k])
    padding = 0
    for parts in by_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= limit and len(parts) <= segments
        padding += 0 if at & (at - 1) == 0 else limit - at
    assert padding <= 0.01 * sum(map(len, ids.values())) + limit


def test_packing_query(spark, library):
    rows = Q.REGISTRY["op7_packing"](spark, SF).collect()
    texts = {d.doc_id: d.text for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check_packing(rows, texts, library)


def test_packing_cases(spark, library):
    with_crc = lambda df: df.withColumn("ids_crc32", F.crc32("ids"))
    texts = ODD + ["word " * n for n in range(300)]
    rows = with_crc(pack(docs_of(spark, texts).repartition(3), Q.vocabulary())).collect()
    check_packing(rows, dict(enumerate(texts)), library)
    small = with_crc(pack(docs_of(spark, texts), Q.vocabulary(), tokens=64, segments=2, loss=40)).collect()
    by_seq = defaultdict(int)
    for r in small:
        by_seq[r.sequence_id] += r.loss_tokens
    assert max(by_seq.values()) <= 40
    assert pack(empty_docs(spark), Q.vocabulary()).count() == 0


def test_packing_of_short_texts(spark, library):
    """Sequences that the segment limit ends hold a power of two: no padding, whatever the length of the texts."""
    with_crc = lambda df: df.withColumn("ids_crc32", F.crc32("ids"))
    r = random.Random(8)
    for low, high, segments in ((1, 4, 32), (5, 20, 32), (5, 20, 128), (20, 40, 32)):
        texts = [" ".join(["word"] * r.randint(low, high)) for _ in range(3000)]
        rows = with_crc(pack(docs_of(spark, texts).coalesce(1), Q.vocabulary(), segments=segments)).collect()
        check_packing(rows, dict(enumerate(texts)), library, segments=segments)
        sizes = defaultdict(int)
        for x in rows:
            sizes[x.sequence_id] += x.length
        assert all(n == 1024 or n & (n - 1) == 0 for n in sizes.values())
        if segments == 128:
            assert sum(n for n in sizes.values() if n == 1024) >= 0.9 * sum(sizes.values())


def test_packing_with_a_loss_limit_that_binds(spark, library):
    """The first ``context`` tokens of an example bear no loss; all three limits hold for every sequence."""
    with_crc = lambda df: df.withColumn("ids_crc32", F.crc32("ids"))
    r = random.Random(9)
    texts = [" ".join(["word"] * r.choice([3, 9, 40, 200, 700])) for _ in range(1200)]
    rows = with_crc(pack(docs_of(spark, texts).coalesce(1), Q.vocabulary(), tokens=256, segments=16, loss=200, context=12)).collect()
    check_packing(rows, dict(enumerate(texts)), library, limit=256, segments=16)
    loss, size = defaultdict(int), defaultdict(int)
    for x in rows:
        assert x.loss_tokens == max(0, x.start + x.length - max(x.start + 1, 12))
        loss[x.sequence_id] += x.loss_tokens
        size[x.sequence_id] += x.length
    assert max(loss.values()) <= 200 and max(size.values()) == 256      # contexts fill what the loss limit leaves
    assert any(loss[k] > 128 and size[k] == 256 for k in size) and any(n < 256 for n in size.values())


# --- HTML
def test_main_text_rules():
    page = ("<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a href=x>Home</a></nav>"
            "<div class='cookie-notice'>We use cookies and you agree to all of the terms of this long notice</div>"
            "<article><h1>Head &amp; Title</h1><p>First <b>bold\n text</b> here.<p>&nbsp;Second&#8212;one.<br>line</p>"
            "<form><input>Search this</form><script>var t='</p>';</script><!-- no --><p>Third.</p></article>"
            "<aside>Related things</aside><section id=comments><p>Nice post, the best of all that I have read</p></section>"
            "<footer>&copy; me</footer></body></html>")
    assert main_text(page) == "Head & Title First bold text here. Second—one. line Third."


def test_main_text_without_article():
    long = "The people of the town have been in the house for a long time and they are not of the kind that leave it. " * 3
    page = f"<body><div><a href=a>one</a> <a href=b>two</a></div><div><p>{long}</p><p>Short.</p><p>{long}</p></div><div class=ad>Buy now</div></body>"
    assert main_text(page) == " ".join([*long.split(), "Short.", *long.split()])
    assert main_text("plain text only") == "plain text only"
    assert main_text("<p>open <b>tags") == "open tags"
    assert main_text("<!-- never closed <p>x") == ""
    assert main_text("") == ""


PROSE = "The story of the town is one that we have told for many years, and it was on a day in the spring that they came to it. " * 2


def test_main_text_in_named_wrappers():
    """A class or id word, or a form around the whole page, loses no article."""
    body, want = f"<h1>Title</h1><p>{PROSE}</p><p>Short.</p>", "Title " + PROSE + "Short."
    comments = f"<div class='user-comments'><h2>Comments</h2><article class=comment><p>{PROSE} they said</p></article></div>"
    for wrapper in ("<div class='layout has-sidebar'><article>%s</article></div>", "<div id='content-no-comments'><main>%s</main></div>",
                    "<article class='post share-enabled'>%s</article>", "<div class='page-with-widgets'>%s</div>",
                    "<div class='social-post'>%s</div>", "<form id=page>%s</form>", "<form><div><article>%s</article></div></form>",
                    "<div class='sidebar'><article>%s</article></div>", "<div class='social'>%s</div>", "<div class='nav-page'><main>%s</main></div>"):
        page = f"<body><nav><a href=x>Home</a></nav>{wrapper % body}<footer>end</footer>{comments}</body>"
        assert main_text(page) == want, wrapper


def test_main_text_leaves_named_furniture_out():
    for part in (f"<div class='related-posts'><article><h3>More</h3><p>{PROSE}</p></article></div>", f"<div class='cookie-text'><h2>We care</h2><p>{PROSE}</p></div>",
                 f"<div class=comment-body><h1>I</h1><p>{PROSE}</p></div>", "<form><h3>Leave a reply</h3><p>Your address will not be shown to any of the others. Fill all the fields</p></form>",
                 f"<div class='sidebar-box'><h3>About</h3><p>{PROSE}</p></div>", f"<div class=comments><article><p>{PROSE}</p></article></div>"):
        assert main_text(f"<body><div><h1>Title</h1><p>{PROSE}</p></div>{part}</body>") == "Title " + PROSE.strip(), part
        assert main_text(f"<body><article><h1>Title</h1><p>Few.</p></article>{part}</body>") == "Title Few.", part
    assert main_text(f"<body><div class=cookie-notice><h2>We care</h2><p>{PROSE}</p></div><div class=comments><p>{PROSE}</p></div></body>") == ""


def test_html_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "v", "<p>" + "a b " * 50000 + "</p>"), (3, "v", "<p>x</p>"), (None, "w", "<article><p>Enoipa.</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("id", F.lit(0))
    got = extract_main_text(df).collect()
    assert [(r.page_id, r.url, r.n_chars) for r in got] == [(1, "u", 0), (2, None, 0), (3, "v", 199999), (3, "v", 1), (None, "w", 7)]
    assert extract_main_text(df.limit(0)).count() == 0


def test_html_query_matches_articles(spark):
    import html

    got = {r.page_id: r.text for r in Q.REGISTRY["op3_html_text"](spark, SF).collect()}
    for p in spark.read.parquet(f"{SF}/pages.parquet").collect():
        m = re.search(r"<article>(.*)</article>", p.html, re.S) or re.search(r"<article>(.*?)<footer", p.html, re.S)
        assert got[p.page_id] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", m[1])).split())


# --- decontamination
PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_overlaps(texts, items, window):
    wins = defaultdict(set)
    for key, text in items:
        w = words(text, PATTERN)
        for x in [tuple(w)] if 0 < len(w) < window else [tuple(w[i:i + window]) for i in range(len(w) - window + 1)]:
            wins[x].add(str(key))
    sizes = {len(x) for x in wins}
    out = []
    for text in texts:
        w, hit, found = words(text, PATTERN), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in wins:
                    hit.update(range(i, i + n))
                    found |= wins[tuple(w[i:i + n])]
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_overlaps_against_brute_force(spark):
    r = random.Random(4)
    vocab = ["a", "b", "c", "Dé"]
    items = [(i, " ".join(r.choices(vocab, k=r.choice([1, 2, 3, 5, 9])))) for i in range(12)] + [(50, None), (51, " ! "), (0, "a b c a")]
    texts = [" ".join(r.choices([*vocab, "x", "y,"], k=r.randint(0, 60))) for _ in range(150)] + [None, "", "!!", "a", "b-c"]
    for window in (1, 2, 4, 10):
        got = overlaps(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string"), window=window).collect()
        want = plain_overlaps(texts, items, window)
        assert [(g.n_words, g.n_hit, g["items"]) for g in sorted(got, key=lambda g: g.doc_id)] == want, window


def test_overlaps_in_several_passes(spark, monkeypatch):
    from feedlake.llm import decontaminate as D

    monkeypatch.setattr(D, "SHARD_BYTES", 30)
    monkeypatch.setattr(D, "SHARDS_A_PASS", 2)
    items = [(i, f"w{i} b c d e f") for i in range(9)]
    texts = ["zz w1 b c d e f w2 b c d e f", "b c d e f", None]
    got = overlaps(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string"), window=4).collect()
    assert [(g.n_words, g.n_hit, g["items"]) for g in sorted(got, key=lambda g: g.doc_id)] == plain_overlaps(texts, items, 4)


def test_equal_items_in_several_shards(spark, monkeypatch):
    """A third of the items equal: they are dealt to many shards, and all are named."""
    from feedlake.llm import decontaminate as D

    monkeypatch.setattr(D, "SHARD_BYTES", 200)
    items = spark.createDataFrame([(i, "one two three four five") for i in range(40)] + [(100 + i, f"x{i} one two three y{i}") for i in range(80)],
                                  "item_id long, text string")
    table, total = D.shards(items, "item_id", "text", 5)
    assert total > 10 and 10 < table.count() <= total
    got = overlaps(docs_of(spark, ["zero one two three four five six"]), items, window=5).collect()
    assert got[0].n_hit == 5 and got[0]["items"] == sorted(str(i) for i in range(40))


def test_decontaminate_removes_spans(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    texts = [f"Éa one two, {passage}! three four five six seven eight nine ten eleven twelve thirteen", passage, "clean text", None, ""]
    items = spark.createDataFrame([(1, passage.upper())], "item_id long, text string")
    docs = docs_of(spark, texts)
    out = {r.doc_id: r for r in decontaminate(docs, items).collect()}
    assert sorted(out) == [0, 2, 3, 4]
    assert out[0].text.startswith("Éa one two,") and "w3" not in out[0].text and out[0].n_chars == len(out[0].text)
    assert out[2].text == "clean text" and out[3].text is None and out[4].text == ""
    assert decontaminate(docs, items).columns == docs.columns
    assert decontaminate(docs, items.limit(0)).count() == 5
    assert decontaminate(empty_docs(spark), items).count() == 0


# --- chat formatting
def test_template_language():
    t = "{% for m in messages %}{% if loop.first and not (1 == 2) %}[{{ m.role | upper }}]{% elif m.text %}+{{ m['text'] | trim }}{% else %}-{% endif %}{% endfor %}{{ 'a' + 'b' }}{% if false %}never{% endif %}"
    render = C.compile_template(t)
    assert render([{"role": "u", "text": "x"}, {"role": "v", "text": " y "}, {"role": "w", "text": ""}])[0] == "[U]+y-ab"
    assert C.fold_body(C.parse("{{ 'a' + 'b' }}c{% if 1 == 1 %}d{% endif %}")) == [("text", "abcd")]
    for bad in ("{% for x %}{% endfor %}", "{% if a %}", "{{ a b }}", "{% call x %}", "{{ x | nope }}", "{{ 'open }}", "{{ }}"):
        with pytest.raises(C.TemplateError):
            C.compile_template(bad)
    assert C.compile_template("{{ messages.__class__ }}{{ x.y }}")([])[0] == ""


def test_escapes_are_reversible():
    r = random.Random(2)
    parts = [*C.CONTROL, "\\", "\n", "n", "<", "[", "|", "a", " ", "/s>", "", "\\n", "é", "<\\", "s>"]
    render = C.compile_template(C.TEMPLATE)
    for _ in range(3000):
        conv = [("assistant" if r.random() < 0.5 else "".join(r.choices(parts, k=r.randint(0, 4))), "".join(r.choices(parts, k=r.randint(0, 8)))) for _ in range(r.randint(0, 4))]
        text, spans = render([{"role": a, "text": b} for a, b in conv])
        assert C.read_back(text) == conv
        assert "".join(C.unescape(text[a:b]) for a, b in spans) == "".join(b for a, b in conv if a == "assistant")


def test_conversation_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, None, None, None), (None, 0, "assistant", "x" * 100000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("id", F.lit(9)).withColumn("spans", F.lit(9))
    got = {r.conv_id: r for r in C.digests(C.format_conversations(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 3 and got[1].turns_sha256 == sha("user\na\nuser\na\nassistant\nb\n") and got[1].loss_sha256 == sha("b")
    assert got[2].turns_sha256 == sha("\n\n") and got[2].loss_chars == 0
    assert got[None].loss_chars == 100000
    assert C.digests(C.format_conversations(df.limit(0))).count() == 0


def test_long_conversation_spreads_over_tasks(spark):
    """Turns are rendered by the task that has them; joined they are what the whole template gives."""
    template = ("{{ '<<' }}{% for m in messages %}{% if loop.first %}F{% endif %}{{ loop.index0 }}{% generation %}{{ m.text | escape }}{% endgeneration %}"
                "{% if loop.last %}L{% endif %}{% endfor %}>>")
    r = random.Random(4)
    rows = [(7, t // 2, r.choice(["user", "assistant"]), "ab<s>"[:r.randint(0, 5)] * r.randint(0, 3)) for t in range(3000)]
    rows += [(7, 700, "user", "same")] * 900 + [(i, t, "user", f"{t}") for i in (1, 9, 20) for t in range(2)] + [(3, 0, "assistant", "one")]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = C.format_conversations(df, template=template).withColumn("task", F.spark_partition_id()).collect()
        told = {x.conv_id: x for x in C.digests(C.format_conversations(df)).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len({x.task for x in parts if x.conv_id == 7}) > 3
    for conv in (1, 3, 7, 9, 20):
        own = sorted((x for x in parts if x.conv_id == conv), key=lambda x: x.place)
        turns = [{"role": a, "text": b} for _, _, a, b in sorted(x for x in rows if x[0] == conv)]
        text, spans = C.compile_template(template)(turns)
        assert [x.place for x in own] == list(range(len(turns)))
        assert "".join(x.formatted for x in own) == text
        at, got = 0, []
        for x in own:
            got += [(at + s.begin, at + s.end) for s in x.spans]
            at += len(x.formatted)
        assert got == spans
        assert told[conv].n_turns == len(turns) and told[conv].formatted_chars == len(C.compile_template(C.TEMPLATE)(turns)[0])
        assert told[conv].turns_sha256 == hashlib.sha256("".join(f"{x['role']}\n{x['text']}\n" for x in turns).encode()).hexdigest()
        assert told[conv].loss_sha256 == hashlib.sha256("".join(x["text"] for x in turns if x["role"] == "assistant").encode()).hexdigest()
    for whole in ("{% for m in messages %}{% endfor %}{{ messages[0].text }}", "{% if true %}x{% endif %}", "{% for m in messages %}{{ messages }}{% endfor %}",
                  "{% generation %}{% for m in messages %}{% endfor %}{% endgeneration %}"):
        C.compile_template(whole)
        with pytest.raises(C.TemplateError):
            C.turn_renderer(whole)


def test_schema_types(spark):
    kinds = dict(Q.REGISTRY["op6_chat_formatting"](spark, SF).dtypes)
    assert kinds == {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"}
    assert isinstance(Q.REGISTRY["op2_token_counts"](spark, SF).schema["over_limit"].dataType, T.BooleanType)
