"""Secret scans (5): a character convolutional network over candidates and their context, besides base patterns.

Candidates are the matches of three base patterns and every run of 16 or more token characters that holds a digit
and a letter; of a run that base findings overlap, what they leave on either side.  A network in numpy reads each
candidate character by character with the text around it: character vectors, one convolution, a maximum over
positions, a logistic output.  It reads ``BODY`` characters of a candidate at once; a longer one is read in every
window of that size, at each of its characters, and the windows above the threshold are the spans found.  It is trained on labelled findings: base
matches are secrets, other candidates and ordinary numbers are not, and both kinds are varied (other alphabets,
lengths and surrounding words) so that secrets of no base form are known too.  Training takes all findings of all
documents, dealt by a hash into lots of about ``findings``: in each of ``EPOCHS`` rounds the lots go through their
findings side by side, from the same parameters, and the mean of what they end with (weighted by their rows) begins
the next round.  Scores are calibrated on all findings of a held-out part, counted by score, and the threshold must
keep ``recall`` of the held-out secrets and is at least one half where that does.  Every text is
scanned whole; base findings always stay and the network adds spans that overlap none of them.  Of a long finding,
training takes at most ``WINDOWS`` windows, spread evenly from its first to its last.

Cases: null and empty texts have no findings; without a labelled secret and a labelled other there is no network
and only base findings remain; repeated rows give repeated rows; clashing extra columns are kept aside; texts of
any length are scanned whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.arrowtext import LOWER, byte_class, column, runs, saved, ship, strings, text_bytes

#: fixed values: the base patterns; kinds in the order in which equal starts are listed
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "model")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
OTHER = re.compile(r"[A-Za-z0-9+/_=-]{16,}")

HEX_BYTES = byte_class((0x30, 0x39), (0x61, 0x66))
RUN_BYTES_CLASS = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x2B, 0x2B), (0x2F, 0x2F), (0x5F, 0x5F), (0x3D, 0x3D), (0x2D, 0x2D))
DIGITS = byte_class((0x30, 0x39))

BODY, BEFORE, AFTER = 48, 24, 8         # characters the network reads of a candidate and around it
WIDTH = BEFORE + BODY + AFTER
WINDOWS = 4                             # of a long finding, in training only
CHUNK = 2048                            # windows scored at once
SYMBOLS = 98                            # printable ASCII, any other, none
EPOCHS = 12
EXACT = 50_000                          # held-out rows whose scores are told apart exactly; of more, to FINE parts of one
FINE = 256


def base_findings(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost and without overlaps in each kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def other_candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Token runs with a digit and a letter that touch no base finding (of the others a part may be a secret's: they
    are no labelled others)."""
    out = []
    for m in OTHER.finditer(text):
        s, e = m.span()
        run = m[0]
        if any(c.isdigit() for c in run) and any(c.isalpha() for c in run) and not any(a < e and s < b for a, b, _ in base):
            out.append((s, e))
    return out


def left_over(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """What base findings leave of token runs with a digit and a letter, where it holds one of either: the runs of
    ``other_candidates`` whole, of others the parts between findings."""
    out, k = [], 0
    for m in OTHER.finditer(text):
        at, e = m.span()
        run = m[0]
        if not (any(c.isdigit() for c in run) and any(c.isalpha() for c in run)):
            continue
        while k < len(base) and base[k][0] < e:
            # findings of several kinds may overlap; one that goes on beyond the run is met again by the next
            a, b, _ = base[k]
            if at < a:
                out.append((at, a))
            at = max(at, b)
            if b > e:
                break
            k += 1
        if at < e:
            out.append((at, e))
    return [(s, e) for s, e in out if any(c.isalnum() for c in text[s:e])]


def windows(start: int, end: int, most: int = WINDOWS) -> list[tuple[int, int]]:
    """At most ``most`` parts of ``BODY`` characters, spread evenly from the first to the last; a short span itself."""
    if end - start <= BODY:
        return [(start, end)]
    n = min(most, -(-(end - start) // BODY))
    return [(s, s + BODY) for s in (start + (end - BODY - start) * k // (n - 1) for k in range(n))]


def _long_runs(mask: np.ndarray, off: np.ndarray, least: int, need: np.ndarray | None = None) -> np.ndarray:
    """Rows in which the mask holds for ``least`` bytes on end (with one of ``need`` among them)."""
    m = np.empty(len(mask) + 2, bool)
    m[0] = m[-1] = False
    m[1:-1] = mask
    d = np.flatnonzero(m[1:] != m[:-1])
    starts, ends = d[::2], d[1::2]
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    if need is not None and len(starts):
        total = np.concatenate([[0], np.cumsum(need, dtype=np.int64)])
        has = total[ends] > total[starts]
        starts = starts[has]
    return np.searchsorted(off, starts, "right") - 1


def flagged(arr: pa.Array) -> np.ndarray:
    """Rows that may hold a candidate, found on the bytes; the exact patterns then run on these alone.  A run over
    a row's end only flags a row too many."""
    data, off = text_bytes(arr)
    out = np.zeros(len(off) - 1, bool)
    for i, j in runs(off):
        part, rel = data[off[i]:off[j]], off[i:j + 1] - off[i]
        for rows in (_long_runs(HEX_BYTES[part], rel, 24), _long_runs(RUN_BYTES_CLASS[part], rel, 16, DIGITS[part])):
            for r in rows:
                out[i + r] = True
                if r + 1 < j - i:       # the run may go on into the next row
                    out[i + r + 1] = True
        low = LOWER[part].tobytes()
        for word in (*KEYWORDS, b"akia"):
            at = low.find(word)
            while at >= 0:
                r = int(np.searchsorted(rel, at, "right")) - 1
                out[i + r] = True
                at = low.find(word, int(rel[r + 1]))
    return out


def symbols(text: str) -> np.ndarray:
    o = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where((o >= 32) & (o < 127), o - 32, SYMBOLS - 2).astype(np.int16)


def codes(text: str, start: int, end: int) -> np.ndarray:
    """The symbols of a candidate of at most ``BODY`` characters and its surroundings."""
    assert end - start <= BODY
    before, body, after = text[max(0, start - BEFORE):start], text[start:end], text[end:end + AFTER]
    out = np.full(WIDTH, SYMBOLS - 1, np.int16)
    for at, part in ((BEFORE - len(before), before), (BEFORE, body), (BEFORE + BODY, after)):
        out[at:at + len(part)] = symbols(part)
    return out


class CharCNN:
    """Character vectors (with a flag for the candidate's own), a convolution, a maximum, a logistic output."""

    def __init__(self, vectors: int = 8, filters: int = 24, span: int = 5, seed: int = 5):
        r = np.random.default_rng(seed)
        self.span = span
        self.p = {"emb": r.normal(0, 0.3, (SYMBOLS, vectors)), "conv": r.normal(0, 0.2, (span * (vectors + 1), filters)),
                  "cb": np.zeros(filters), "out": r.normal(0, 0.2, filters), "ob": np.zeros(1)}
        self.inside = np.zeros((WIDTH, 1))
        self.inside[BEFORE:BEFORE + BODY] = 1.0
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5
        self.found = self.false_alarms = None

    def forward(self, x: np.ndarray):
        p, n = self.p, len(x)
        e = np.concatenate([p["emb"][x], np.broadcast_to(self.inside, (n, WIDTH, 1))], 2)
        cols = np.concatenate([e[:, k:WIDTH - self.span + 1 + k] for k in range(self.span)], 2)
        z = cols @ p["conv"] + p["cb"]
        best = z.argmax(1)
        top = np.take_along_axis(z, best[:, None], 1)[:, 0]
        h = np.maximum(top, 0)
        return h @ p["out"] + p["ob"][0], (cols, best, top, h)

    def vector(self) -> np.ndarray:
        """The parameters on end."""
        return np.concatenate([self.p[k].ravel() for k in self.p])

    def named(self, vector: np.ndarray) -> dict[str, np.ndarray]:
        ends = np.cumsum([v.size for v in self.p.values()])
        return {k: part.reshape(self.p[k].shape).copy() for k, part in zip(self.p, np.split(vector, ends[:-1]))}

    def epoch(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, nth: int, means: np.ndarray, batch: int = 64, rate: float = 0.01,
              seed: int = 7) -> np.ndarray:
        """Go through the rows once, for the ``nth`` time, each in an order of its own; ``means``: the two running means of
        Adam on end, whose new values are returned."""
        r, p = np.random.default_rng(seed), self.p
        m, v2 = (self.named(part) for part in np.split(means, 2))
        step = nth * -(-len(x) // batch)
        for _ in range(nth + 1):
            order = r.permutation(len(x))
        for k in range(0, len(x), batch):
            i = order[k:k + batch]
            logit, (cols, best, top, h) = self.forward(x[i])
            d = weight[i] * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[i]) / len(i)
            g = {"out": h.T @ d, "ob": np.array([d.sum()])}
            dz = (d[:, None] * p["out"]) * (top > 0)                       # one position for each filter
            picked = cols[np.arange(len(i))[:, None], best]                # row, filter, column
            g["conv"] = np.einsum("nfc,nf->cf", picked, dz)
            g["cb"] = dz.sum(0)
            back = (dz[:, :, None] * p["conv"].T[None]).reshape(len(i), -1, self.span, p["emb"].shape[1] + 1)[..., :-1]
            g["emb"] = np.zeros_like(p["emb"])
            at = best[:, :, None] + np.arange(self.span)
            np.add.at(g["emb"], x[i][np.arange(len(i))[:, None, None], at], back)
            step += 1
            for name in p:
                m[name] = 0.9 * m[name] + 0.1 * g[name]
                v2[name] = 0.999 * v2[name] + 0.001 * g[name] ** 2
                p[name] -= rate * (m[name] / (1 - 0.9 ** step)) / (np.sqrt(v2[name] / (1 - 0.999 ** step)) + 1e-8)
        return np.concatenate([part[k].ravel() for part in (m, v2) for k in p])

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float) -> None:
        """``settle`` on the scores of held-out findings."""
        logit = self.forward(x)[0]
        self.settle(logit, logit, logit, np.ones(len(logit)), y, recall)

    def settle(self, logit: np.ndarray, low: np.ndarray, high: np.ndarray, count: np.ndarray, y: np.ndarray, recall: float) -> None:
        """Platt scaling on held-out findings, then the threshold: of those that keep ``recall`` of the secrets, the
        lowest with the fewest false alarms, and one half where that keeps both.  ``found`` and ``false_alarms`` are the
        shares of held-out secrets and others that reach it.  An entry stands for ``count`` findings of a label, from
        ``low`` to ``high``, about ``logit``: those that may fall short of the threshold count as not found,
        those that may reach it as false alarms."""
        a, b, total = 1.0, 0.0, count.sum()
        for _ in range(200):
            q = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
            a, b = max(0.05, a - 0.05 * (count * (q - y) * logit).sum() / total), b - 0.05 * (count * (q - y)).sum() / total
        self.scale, self.shift = a, b
        low, high, secret = self.chance(low), self.chance(high), y > 0
        order = np.argsort(low[secret], kind="stable")
        reached = np.cumsum(count[secret][order])
        highest = float(low[secret][order][np.searchsorted(reached, int((1 - recall) * reached[-1]), "right")])
        others = high[~secret & (high < highest)]
        self.threshold = min(highest, max(0.5, float(others.max()) + 1e-6 if len(others) else 0.5))
        self.found = float((count * (low >= self.threshold))[secret].sum() / count[secret].sum())
        self.false_alarms = float((count * (high >= self.threshold))[~secret].sum() / count[~secret].sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.chance(self.forward(x)[0])

    def chance(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logit + self.shift, -30, 30)))

    def window_scores(self, text: str, start: int, end: int):
        """(first, scores of the windows from there on) of a candidate longer than ``BODY``, a window at each of its
        characters: what ``score`` gives for each, with the characters convolved once and the maxima slid."""
        p, span, vectors = self.p, self.span, self.p["emb"].shape[1]
        conv = p["conv"].reshape(span, vectors + 1, -1)
        table = p["emb"] @ conv[:, :-1]                                        # place, symbol, filter
        inside = np.stack([self.inside[k:WIDTH - span + 1 + k, 0] for k in range(span)], 1) @ conv[:, -1] + p["cb"]
        last, mid = BEFORE - span + 1, BEFORE + BODY - span + 1                 # windows of the convolution: before, mixed, own, mixed, after
        for first in range(start, end - BODY + 1, CHUNK):
            n = min(CHUNK, end - BODY + 1 - first)
            x = np.full(n - 1 + WIDTH, SYMBOLS - 1, np.int16)
            lead = max(0, BEFORE - first)
            part = symbols(text[max(0, first - BEFORE):first + n - 1 + BODY + AFTER])
            x[lead:lead + len(part)] = part
            z = table[0][x[:len(x) - span + 1]]
            for k in range(1, span):
                z = z + table[k][x[k:len(x) - span + 1 + k]]

            def highest(low: int, high: int) -> np.ndarray:
                """Maxima over z[w + low:w + high] for each window w."""
                m, size = z[low:n - 1 + high], 1
                while 2 * size <= high - low:
                    m, size = np.maximum(m[:-size], m[size:]), 2 * size
                more = high - low - size
                return np.maximum(m[:n], m[more:more + n]) if more else m[:n]

            top = highest(0, last) + inside[0]
            for k in (*range(last, BEFORE), *range(mid, BEFORE + BODY)):
                top = np.maximum(top, z[k:k + n] + inside[k])
            top = np.maximum(top, highest(BEFORE, mid) + inside[BEFORE])
            top = np.maximum(top, highest(BEFORE + BODY, WIDTH - span + 1) + inside[-1])
            yield first, self.chance(np.maximum(top, 0) @ p["out"] + p["ob"][0])

    def found_in(self, text: str, start: int, end: int) -> list[tuple[int, int, float]]:
        """(start, end, highest score) of the windows of a long candidate that reach the threshold, those that overlap
        or touch as one."""
        out: list[tuple[int, int, float]] = []
        for first, score in self.window_scores(text, start, end):
            hit = np.flatnonzero(score >= self.threshold)
            for part in np.split(hit, np.flatnonzero(np.diff(hit) > BODY) + 1) if len(hit) else ():
                s, e, best = first + int(part[0]), first + int(part[-1]) + BODY, float(score[part].max())
                if out and s <= out[-1][1]:
                    s, best = out[-1][0], max(best, out.pop()[2])
                out.append((s, e, best))
        return out


ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
             "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
             "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "0123456789ABCDEF")


def varied(findings: list[tuple[str, str, str, int]], seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Training rows from labelled (before, body, after, label), with variants of both kinds."""
    r = np.random.default_rng(seed)
    pick = lambda alphabet, n: "".join(alphabet[k] for k in r.integers(0, len(alphabet), n))
    rows: list[tuple[str, str, str, int]] = list(findings)
    words = [w for before, _, after, _ in findings for w in re.findall(r"[^\W\d_]{3,}", before + " " + after)] or ["word"]
    for before, body, after, label in findings:
        plain = " ".join(words[k] for k in r.integers(0, len(words), 3)) + " "
        if label:
            value = pick(ALPHABETS[r.integers(len(ALPHABETS))], int(r.integers(20, 44)))
            rows.append((plain if r.random() < 0.5 else before, value, " " + words[r.integers(len(words))], 1))
        else:
            rows.append((plain, body, after, 0))
        kind = r.integers(6)
        if kind == 0:       # joined words with a number
            value = "".join(words[k].lower() for k in r.integers(0, len(words), 3)) + str(r.integers(1, 9999))
        elif kind == 1:     # dates and times
            value = f"{r.integers(1990, 2030)}-{r.integers(1, 13):02d}-{r.integers(1, 29):02d}T{r.integers(24):02d}-{r.integers(60):02d}-{r.integers(60):02d}"
        elif kind == 2:     # path of words
            value = "/".join(words[k].lower() for k in r.integers(0, len(words), 3)) + f"/{r.integers(1, 999)}"
        elif kind == 3:     # dashed or underscored names
            value = "-_"[r.integers(2)].join(words[k] for k in r.integers(0, len(words), 4)) + str(r.integers(10))
        elif kind == 4:     # long runs of words with a number, read in windows
            many = [words[k].lower() if r.random() < 0.8 else str(r.integers(1, 9999)) for k in r.integers(0, len(words), r.integers(8, 24))]
            value = "/-_+="[r.integers(5)].join([*many, str(r.integers(1, 9999))])
        else:               # long numbers
            value = str(r.integers(10 ** 15, 10 ** 16))
        rows.append((plain, value, after, 0))
    parts = [(a + b + c, s, e, y) for a, b, c, y in rows for s, e in windows(len(a), len(a) + len(b))]
    return np.stack([codes(t, s, e) for t, s, e, _ in parts]), np.array([y for *_, y in parts], float)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int | None = None, findings: int = 3_000,
          recall: float = 0.98) -> CharCNN | None:
    """A calibrated network from the labelled findings of all documents (of about ``sample`` where a caller asks for it),
    in lots of about ``findings``; None when either label is missing.  A quarter of the findings is held out for the
    calibration; where that quarter lacks a label, the training findings calibrate."""
    ship(docs.sparkSession)
    src = docs.select(docs[text_col].alias("text"), F.xxhash64(docs[id_col].cast("string"), docs[text_col]).alias("h"))
    picked = src if sample is None else src.where(F.pmod("h", F.lit(max(1, src.count() // sample))) == 0)

    def label(batches):
        for b in batches:
            may, keys = flagged(column(b, "text")), column(b, "h").to_pylist()
            rows = []
            for text, key, hit in zip(strings(b, "text"), keys, may):
                if not hit:
                    continue
                base = base_findings(text)
                spans = [(s, e, 1) for s, e, _ in base] + [(s, e, 0) for s, e in other_candidates(text, base)]
                spans += [(m.start(), m.end(), 0) for m in re.finditer(r"\d{8,}", text) if not any(a < m.end() and m.start() < e for a, e, _ in base)]
                spans = [(a, b, y) for s, e, y in spans for a, b in windows(s, e)]
                for k, (s, e, y) in enumerate(spans):
                    rows.append((key, k, text[max(0, s - BEFORE):s], text[s:e], text[e:e + AFTER], y))
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.string()) for c in cols[2:5]), pa.array(cols[5], pa.int32())],
                ["h", "k", "before", "body", "after", "label"])

    found = picked.mapInArrow(label, "h long, k int, before string, body string, after string, label int")
    # the part is hashed anew: among sampled rows h itself is a multiple of the share
    rows = saved(found.withColumn("part", F.pmod(F.xxhash64("h", F.lit(2)), F.lit(4)) == 0), "findings")
    size = {(r.part, r.label): r["count"] for r in rows.groupBy("part", "label").count().collect()}
    if not all(size.get((False, y)) for y in (0, 1)):
        return None
    held = all(size.get((True, y)) for y in (0, 1))
    lots = -(-sum(size.values()) // findings)
    net = CharCNN()
    learned(net, prepared(rows.where("not part"), lots, 3))
    counted(net, prepared(rows.where("part") if held else rows.where("not part"), lots, 11), recall)
    return net


def prepared(rows: DataFrame, lots: int, seed: int) -> DataFrame:
    """Findings as training rows with variants: lot, x (codes) and y as bytes, n, secrets; a row per lot."""
    dealt = rows.withColumn("lot", F.pmod(F.xxhash64("h", "k", F.lit(3)), F.lit(lots)).cast("int")).withColumn("at", F.xxhash64("h", F.lit(1)))
    kept = dealt.repartition(lots, "lot").sortWithinPartitions("lot", "at", "k", "before", "body", "after")

    def run(batches):
        lot, held = None, []

        def ready():
            x, y = varied(held, seed + 1_000_003 * lot)
            yield pa.RecordBatch.from_arrays([pa.array([lot], pa.int32()), pa.array([x.tobytes()], pa.binary()), pa.array([y.astype(np.int8).tobytes()], pa.binary()),
                                              pa.array([len(y)], pa.int64()), pa.array([int(y.sum())], pa.int64())], ["lot", "x", "y", "n", "secrets"])

        for b in batches:
            names = ("lot", "before", "body", "after", "label")
            for nth, *finding in zip(*(column(b, k).to_pylist() for k in names)):
                if nth != lot and held:
                    yield from ready()
                    held = []
                lot = nth
                held.append(tuple(finding))
        if held:
            yield from ready()

    return saved(kept.mapInArrow(run, "lot int, x binary, y binary, n long, secrets long"), "lots")


def of_lot(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    x, y = (column(b, k)[i].as_py() for k in ("x", "y"))
    return np.frombuffer(x, np.int16).reshape(-1, WIDTH), np.frombuffer(y, np.int8).astype(float)


def learned(net: CharCNN, rows: DataFrame) -> None:
    """Train ``net`` on all lots of ``rows``, ``EPOCHS`` rounds; the driver sees one vector a round."""
    spark = rows.sparkSession
    n, secrets = rows.agg(F.sum("n"), F.sum("secrets")).first()
    vector, means = net.vector(), np.zeros(2 * len(net.vector()))
    for nth in range(EPOCHS):
        sent = spark.sparkContext.broadcast((vector, means))

        def run(batches, nth=nth, sent=sent):
            for b in batches:
                for i in range(b.num_rows):
                    x, y = of_lot(b, i)
                    lot = column(b, "lot")[i].as_py()
                    own = CharCNN()
                    own.p = own.named(sent.value[0])
                    weight = np.where(y > 0, 0.5 / max(1, secrets), 0.5 / max(1, n - secrets)) * n
                    after = own.epoch(x, y, weight, nth, sent.value[1], seed=7 + lot)
                    values = np.concatenate([own.vector(), after]) * (len(y) / n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), lot, np.int32)), pa.array(np.arange(len(values), dtype=np.int32)),
                                                      pa.array(values)], ["lot", "at", "value"])

        # added in the order of the lots, so that a run gives the same network each time
        parts = rows.mapInArrow(run, "lot int, at int, value double").groupBy("at").agg(F.sort_array(F.collect_list(F.struct("lot", "value"))).alias("parts"))
        total = parts.select("at", F.aggregate("parts", F.lit(0.0), lambda t, x: t + x["value"]).alias("value"))
        got = np.array([r.value for r in sorted(total.collect())])
        vector, means = got[:len(vector)], got[len(vector):]
    net.p = net.named(vector)


def counted(net: CharCNN, rows: DataFrame, recall: float) -> None:
    """Calibrate ``net`` on all lots of ``rows``; the driver sees counts by label and score."""
    sent = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                x, y = of_lot(b, i)
                for k in range(0, len(x), CHUNK):
                    yield pa.RecordBatch.from_arrays([pa.array(y[k:k + CHUNK].astype(np.int32)), pa.array(sent.value.forward(x[k:k + CHUNK])[0])], ["y", "logit"])

    few = rows.agg(F.sum("n")).first()[0] <= EXACT
    # beyond 40 a score does not change
    key = F.col("logit") if few else F.floor(F.least(F.greatest("logit", F.lit(-40.0)), F.lit(40.0)) * FINE)
    got = (rows.mapInArrow(run, "y int, logit double").groupBy("y", key.alias("key"))
           .agg(F.min("logit").alias("low"), F.max("logit").alias("high"), F.count("*").alias("count")).orderBy("y", "key").collect())
    low, high, count, y = (np.array([r[k] for r in got], float) for k in ("low", "high", "count", "y"))
    net.settle((low + high) / 2, low, high, count, y, recall)


def _scan(src: DataFrame, net: CharCNN | None) -> DataFrame:
    """``src`` (text, ...) with ``found``: array of (start, end, kind, score) in code points, ordered."""
    spark = src.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(net)
    item = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())])
    names = src.columns

    def run(batches):
        model = sent.value
        for b in batches:
            arr = column(b, "text")
            may = flagged(arr)
            out: list[list] = [[] for _ in range(len(arr))]
            waiting = []
            for i in np.flatnonzero(may):
                text = arr[int(i)].as_py() or ""
                base = base_findings(text)
                out[i] = [{"start": s, "end": e, "kind": k, "score": 1.0} for s, e, k in base]
                for s, e in left_over(text, base) if model is not None else ():
                    if e - s <= BODY:
                        waiting.append((i, s, e, codes(text, s, e)))
                    else:
                        out[i] += [{"start": a, "end": b, "kind": "model", "score": p} for a, b, p in model.found_in(text, s, e)]
            for k in range(0, len(waiting), 512):
                part = waiting[k:k + 512]
                for (i, s, e, _), p in zip(part, model.score(np.stack([w[3] for w in part]))):
                    if p >= model.threshold:
                        out[i].append({"start": s, "end": e, "kind": "model", "score": float(p)})
            for i in np.flatnonzero(may):
                out[i].sort(key=lambda x: (x["start"], KINDS.index(x["kind"])))
            yield pa.RecordBatch.from_arrays([column(b, n) for n in names] + [pa.array(out, pa.list_(item))], [*names, "found"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema)
    return src.mapInArrow(run, ddl + ", found array<struct<start:long,end:long,kind:string,score:double>>")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", net: CharCNN | None = None) -> DataFrame:
    """One row per document: id, found (array of start, end, kind, score; code points, end exclusive)."""
    return _scan(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), net).select(
        F.col("id").alias(id_col), "found")


def redact(docs: DataFrame, text_col: str = "text", net: CharCNN | None = None, mark: str = "[SECRET]",
           chars_col: str | None = "n_chars") -> DataFrame:
    """The documents with every finding replaced by ``mark``, same columns; overlapping findings become one mark."""
    columns = docs.columns
    src = docs.select(docs[text_col].alias("text"), F.struct(*[docs[c] for c in columns]).alias("row"))
    # cut points: a finding that begins inside the last one only moves its end
    merged = F.aggregate("found", F.array().cast("array<struct<start:long,end:long>>"), lambda acc, x: F.when(
        (F.size(acc) > 0) & (x["start"] <= F.element_at(acc, -1)["end"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))))
    n = F.size("cuts")
    pieces = F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(
        F.col("text"), F.when(i == 0, F.lit(1)).otherwise((F.get("cuts", i - 1)["end"] + 1).cast("int")),
        (F.when(i == n, F.char_length("text").cast("long")).otherwise(F.get("cuts", i)["start"])
         - F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get("cuts", i - 1)["end"])).cast("int")))
    hit = F.size("found") > 0
    done = (_scan(src, net).withColumn("cuts", F.when(hit, merged).otherwise(F.array().cast("array<struct<start:long,end:long>>")))
            .withColumn("text", F.when(hit, F.array_join(pieces, mark)).otherwise(F.col("text"))))
    out = []
    for c in columns:
        kept = F.col("row")[c]
        if c == text_col:
            kept = F.col("text")
        elif c == chars_col:
            kept = F.when(hit, F.char_length("text").cast(docs.schema[c].dataType)).otherwise(kept)
        out.append(kept.alias(c))
    return done.select(*out)
