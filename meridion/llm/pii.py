"""Personal data: base patterns and a character-level bidirectional LSTM with CRF transitions.

The base patterns find emails, IP addresses, cards and phone numbers. The model
reads every character of every text, in overlapping windows; each window is
decoded by Viterbi over the tags none, email, ip, card, phone and secret (keys
and tokens, which have no base pattern). The overlap is longer than the spans
that are looked for, so each lies whole in a window. The windows' spans are
reconciled over the whole text: those furthest from the edges of their windows
come first, and a span goes if it touches one that came before. What is left is
kept if it holds what its kind needs (see holds()) and touches no base span;
base spans always stay. The network is trained in numpy, by back-propagation
through time and the CRF's likelihood, on generated texts with labelled spans;
it depends on a seed alone and is trained once a process.

Cases: null or empty text has no spans; texts of any length are read whole;
repeated rows and ties give equal spans; a model's span longer than the overlap
may be cut; extra columns stay; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import pickle
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import docs_of, trim

#: The first four have base patterns.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = 4
HIDDEN, CLASSES, TAGS = 10, 40, 6
WINDOW, OVERLAP, BATCH = 640, 96, 512
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# A failing start inside a run of digits fails everywhere in it, so these begin where a run begins.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: list[int]) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d *= 1 + k % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    out = []
    at = text.find("@")
    free = 0
    while at >= 0:
        s = at
        while s > free and text[s - 1] in LOCAL:
            s -= 1
        m = DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append((s, 0, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x) < 256 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = [int(c) for c in m[0] if c.isdigit()]
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


def classes() -> np.ndarray:
    """A class for each code point under 256; the rest are letters."""
    table = np.full(256, 1, np.uint8)
    table[:32] = 2
    table[32], table[10] = 3, 4
    table[48:58] = 5
    for k, c in enumerate("@.-+()_%:;,/#!?'\"|=[]*$&<>{}~^`\\"):
        table[ord(c)] = 6 + k
    table[65:91] = 0
    return table


def codes(text: str, table: np.ndarray) -> np.ndarray:
    """The classes of a text's characters."""
    try:
        return table[np.frombuffer(text.encode("latin-1"), np.uint8)]
    except UnicodeEncodeError:
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return table[np.where(c < 256, c, 97)]


def gate(x: np.ndarray) -> np.ndarray:
    """In place: a line through 1/2, cut at 0 and 1."""
    x *= 0.25
    x += 0.5
    return np.clip(x, 0, 1, out=x)


def run(x: np.ndarray, p: dict, side: str, keep: bool = False):
    """Hidden states (time, batch, hidden) of one direction; x is classes (time, batch)."""
    n, batch = x.shape
    h, c = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
    out, kept, table, u = np.empty((n, batch, HIDDEN), np.float32), [], p["in" + side], p["u" + side]
    z, zh = np.empty((batch, 4 * HIDDEN), np.float32), np.empty((batch, 4 * HIDDEN), np.float32)
    a = 3 * HIDDEN
    for t in range(n) if side == "f" else range(n - 1, -1, -1):
        np.take(table, x[t], axis=0, out=z, mode="clip")
        np.matmul(h, u, out=zh)
        z += zh
        if keep:
            raw = z.copy()
        gate(z[:, :a])
        np.clip(z[:, a:], -1, 1, out=z[:, a:])
        before = c
        c = z[:, :HIDDEN] * c
        c += z[:, HIDDEN : 2 * HIDDEN] * z[:, a:]
        squashed = np.clip(c, -1, 1)
        if keep:
            kept.append((t, raw, z.copy(), before, c, squashed, h))
        h = np.multiply(z[:, 2 * HIDDEN : a], squashed, out=out[t])
    return out, kept


def states(x: np.ndarray, p: dict, side: str) -> np.ndarray:
    """As run(), without what training needs; (time, hidden, batch), so that each gate lies together."""
    n, batch = x.shape
    h, c = np.zeros((HIDDEN, batch), np.float32), np.zeros((HIDDEN, batch), np.float32)
    # The gates' line is folded into the weights.
    line = np.ones((4 * HIDDEN, 1), np.float32)
    line[: 3 * HIDDEN] = 0.25
    table, u = np.ascontiguousarray(p["in" + side].T) * line, np.ascontiguousarray(p["u" + side].T) * line
    table[: 3 * HIDDEN] += 0.5
    low = np.zeros((4 * HIDDEN, 1), np.float32)
    low[3 * HIDDEN :] = -1
    out = np.empty((n, HIDDEN, batch), np.float32)
    z, zx, new = np.empty((4 * HIDDEN, batch), np.float32), np.empty((4 * HIDDEN, batch), np.float32), np.empty((HIDDEN, batch), np.float32)
    a, k = 3 * HIDDEN, 2 * HIDDEN
    for t in range(n) if side == "f" else range(n - 1, -1, -1):
        np.take(table, x[t], axis=1, out=zx, mode="clip")
        np.matmul(u, h, out=z)
        z += zx
        np.minimum(z, 1, out=z)
        np.maximum(z, low, out=z)
        c *= z[:HIDDEN]
        np.multiply(z[HIDDEN:k], z[a:], out=new)
        c += new
        np.minimum(c, 1, out=new)
        np.maximum(new, -1, out=new)
        h = np.multiply(z[k:a], new, out=out[t])
    return out


def emissions(x: np.ndarray, p: dict) -> np.ndarray:
    """(time, tags, batch)"""
    e = np.matmul(p["of"].T, states(x, p, "f"))
    e += np.matmul(p["ob"].T, states(x, p, "b"))
    e += p["bias"][:, None]
    return e


def viterbi(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best tags (time, batch); e is (time, tags, batch). A kind follows itself or none; none follows any."""
    n, _, batch = e.shape
    score = e[0].copy()
    stay = np.empty((n, TAGS - 1, batch), bool)
    best = np.empty((n, batch), np.int8)
    own, enter, leave = np.diag(trans)[1:, None], trans[0, 1:, None], trans[:, 0, None]
    for t in range(1, n):
        to_none = score + leave
        best[t] = np.argmax(to_none, axis=0)
        a, b = score[1:] + own, score[0] + enter
        np.greater(a, b, out=stay[t])
        np.maximum(a, b, out=a)
        score[0] = to_none.max(axis=0)
        score[1:] = a
        score += e[t]
    tags = np.empty((n, batch), np.int8)
    tags[-1] = np.argmax(score, axis=0)
    cols = np.arange(batch)
    for t in range(n - 1, 0, -1):
        now = tags[t]
        kind = np.maximum(now, 1)
        tags[t - 1] = np.where(now == 0, best[t], np.where(stay[t, kind - 1, cols], now, 0))
    return tags


class Reader:
    """Applies a trained network to texts."""

    def __init__(self, p: dict):
        self.p, self.table = p, classes()

    def tag(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """The model's spans as (start, kind, end) for each text."""
        coded = [codes(t, self.table) for t in texts]
        windows = [(i, s) for i, c in enumerate(coded) for s in range(0, max(1, len(c) - OVERLAP), WINDOW - OVERLAP) if len(c)]
        windows.sort(key=lambda w: -min(WINDOW, len(coded[w[0]]) - w[1]))  # lengths alike
        held: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        for a in range(0, len(windows), BATCH):
            part = windows[a : a + BATCH]
            n = min(WINDOW, len(coded[part[0][0]]) - part[0][1])
            x = np.full((len(part), n), 3, np.uint8)
            for row, (i, s) in zip(x, part, strict=True):
                got = coded[i][s : s + n]
                row[: len(got)] = got
            x = np.ascontiguousarray(x.T)
            found = viterbi(emissions(x, self.p), self.p["trans"])
            for k in np.flatnonzero(found.any(axis=0)):
                i, s = part[k]
                stop = min(n, len(coded[i]) - s)
                tag = found[:stop, k]
                edge = np.flatnonzero(np.diff(tag, prepend=0, append=0))
                for at, end in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    if tag[at]:
                        left = at if s else WINDOW
                        right = stop - end if s + stop < len(coded[i]) else WINDOW
                        held[i].append((-min(left, right), s + at, int(tag[at]) - 1, s + end))
        return [reconciled(h) for h in held]


def reconciled(held: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (minus the distance from the window's edges, start, kind, end), the spans that touch none of those that lie deeper in their windows."""
    out: list[tuple[int, int, int]] = []
    for _, s, k, e in sorted(held):
        at = bisect.bisect_left(out, (s, -1, -1))
        if not (at and out[at - 1][2] > s) and not (at < len(out) and out[at][0] < e):
            out.insert(at, (s, k, e))
    return out


# How a written-out address marks its parts.
AT = ("(at)", "[at]", " (at) ", " [at] ", "{at}")
DOT = ("(dot)", "[dot]", " (dot) ", " [dot] ", "{dot}")
MARKED = re.compile(r"@|\s?[(\[{]\s?at\s?[)\]}]\s?")
DOTTED = re.compile(r"\.|\s?[(\[{]\s?dot\s?[)\]}]\s?")
GAP = re.compile(r"\s")
#: The fewest characters of a secret.
SECRET = 16


def holds(text: str, kind: int) -> bool:
    """Whether a model's span has what its kind needs: marks of an address and gaps beside them alone, four numbers up to 255, digits in number (a card's pass Luhn), or letters and digits without a gap."""
    digits = [int(c) for c in text if c in "0123456789"]
    if kind == 0:
        mark = MARKED.search(text)
        return bool(mark and mark.start() and DOTTED.search(text, mark.end()) and not GAP.search(DOTTED.sub("", MARKED.sub("", text))))
    if kind == 1:
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(x) < 4 and int(x) < 256 for x in parts)
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == 3:
        return 9 <= len(digits) <= 15 and 2 * len(digits) > len(text)
    return len(text) >= SECRET and not GAP.search(text) and 3 <= len(digits) < len(text) - 2


def all_spans(text: str, base: list[tuple[int, int, int]], found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out = list(base)
    for s, k, e in found:
        while s < e and text[s].isspace():
            s += 1
        while s < e and (text[e - 1].isspace() or text[e - 1] in ".,;:\"'"):
            e -= 1
        while k == 4 and s < e and text[s] in "\"'":
            s += 1
        if holds(text[s:e], k) and not any(a < e and s < b for a, _, b in base):
            out.append((s, k, e))
    return sorted(out)


def generate(rng: random.Random, length: int = 160) -> tuple[str, np.ndarray]:
    """A text of invented words with labelled spans, and its tags."""
    text, tags = "", []

    def add(s: str, tag: int) -> None:
        nonlocal text
        text += s
        tags.extend([tag] * len(s))

    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(("th", "er", "on", "an", "re", "é", "ie", "ch", "ung", "ö", "ción", "ll", "o", "a", "at", "the", "of", "in", "dot")) for _ in range(rng.randint(1, 4)))
    dense = rng.random() < 0.6
    while len(text) < length:
        what = rng.random() * (1 if dense else 0.72)
        if what < 0.7:
            w = word()
            add((w.capitalize() if rng.random() < 0.15 else w) + rng.choice(("", "", "", "", ".", ",", "!!", "***", "###", " |")), 0)
        elif what < 0.78:
            at, dot = ("@", ".") if rng.random() < 0.5 else (rng.choice(AT), rng.choice(DOT))
            add(word() + rng.choice(("", "." + word(), digits(2))) + at + word() + dot + rng.choice(("com", "org", "example.com".replace(".", dot), "net")), 1)
        elif what < 0.84:
            add(rng.choice((".", ".", ".", "[.]", " . ")).join(str(rng.randint(0, 255)) for _ in range(4)), 2)
        elif what < 0.9:
            n = rng.choice((15, 16, 16, 16))
            d = digits(n - 1)
            d += next(c for c in "0123456789" if luhn([int(x) for x in d + c]))
            by = rng.choice(("", "", " ", "-", ".", "  ", " - "))
            add(by.join(d[i : i + 4] for i in range(0, n, 4)), 3)
        elif what < 0.95:
            head = rng.choice((f"+{digits(1)} ", "", "", "001 "))
            a, b, c, s = digits(3), digits(3), digits(4), rng.choice("-. ")
            add(head + rng.choice((f"({a}) {b}-{c}", f"{a}{s}{b}{s}{c}")), 4)
        elif what < 0.975:
            name, put = rng.choice(("token", "key", "secret", "api_key", "password", word())), rng.choice((" = ", "=", ": ", ":", " "))
            quote, size = rng.choice(('"', '"', "'", "")), rng.choice((20, 24, 32, 40, 40, 48, 64))
            letters = rng.choice(("0123456789abcdef", "0123456789abcdef", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_-"))
            add(name + put + quote, 0)
            add("".join(rng.choice(letters) for _ in range(size)), 5)
            add(quote, 0)
        else:
            add(rng.choice((f"{rng.getrandbits(32):08x}", f"{word()}{digits(2)}", f"{word()}-{word()}_{word()}", f"{word()}{word()}{word()}{word()}", f"{word()} at {word()}", f"{word()} dot {word()}", digits(4), f"{digits(2)}.{digits(2)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"version {digits(1)}.{digits(1)}", digits(9), f"{digits(2)}:{digits(2)}", "@" + word())), 0)
        add(rng.choice((" ", " ", " ", " ", "\n")), 0)
    return text[:length], np.array(tags[:length], np.int64)


def crf_gradient(e: np.ndarray, gold: np.ndarray, trans: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log likelihood a character, and its gradients; e is (time, batch, tags)."""
    n, batch, k = e.shape
    lse = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    for t in range(1, n):
        alpha[t] = lse(alpha[t - 1][:, :, None] + trans, 1) + e[t]
    for t in range(n - 2, -1, -1):
        beta[t] = lse(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    z = lse(alpha[-1], 1)
    ge = np.exp(alpha + beta - z[:, None])
    gt = np.zeros_like(trans)
    for t in range(1, n):
        gt += np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
    ts, bs = np.arange(n)[:, None], np.arange(batch)[None]
    loss = z.sum() - e[ts, bs, gold].sum() - trans[gold[:-1], gold[1:]].sum()
    ge[ts, bs, gold] -= 1
    np.subtract.at(gt, (gold[:-1], gold[1:]), 1)
    return loss / (n * batch), ge / (n * batch), gt / (n * batch)


def backward(x: np.ndarray, p: dict, side: str, kept: list, gh: np.ndarray, g: dict) -> None:
    """Back-propagation through time of one direction."""
    batch, a = x.shape[1], 3 * HIDDEN
    dh, dc = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
    for t, raw, z, before, c, squashed, h in reversed(kept):
        dh = dh + gh[t]
        dz = np.empty_like(z)
        dz[:, 2 * HIDDEN : a] = dh * squashed
        dc = dc + dh * z[:, 2 * HIDDEN : a] * ((c > -1) & (c < 1))
        dz[:, :HIDDEN], dz[:, HIDDEN : 2 * HIDDEN], dz[:, a:] = dc * before, dc * z[:, a:], dc * z[:, HIDDEN : 2 * HIDDEN]
        dz[:, :a] *= 0.25 * ((raw[:, :a] > -2) & (raw[:, :a] < 2)) + 0.005  # a little slope beyond the cuts
        dz[:, a:] *= (raw[:, a:] > -1) & (raw[:, a:] < 1)
        g["in" + side] += np.eye(CLASSES, dtype=np.float32)[x[t]].T @ dz
        g["u" + side] += h.T @ dz
        dh = dz @ p["u" + side].T
        dc = dc * z[:, :HIDDEN]


def train(seed: int = 3, steps: int = 400, batch: int = 40, length: int = 140) -> dict:
    rng, noise, table = random.Random(seed), np.random.default_rng(seed), classes()
    make = lambda *s: (noise.normal(size=s) * 0.3).astype(np.float32)
    p = {"inf": make(CLASSES, 4 * HIDDEN), "inb": make(CLASSES, 4 * HIDDEN), "uf": make(HIDDEN, 4 * HIDDEN), "ub": make(HIDDEN, 4 * HIDDEN), "of": make(HIDDEN, TAGS), "ob": make(HIDDEN, TAGS), "bias": make(TAGS) * 0, "trans": make(TAGS, TAGS) * 0}
    p["inf"][:, :HIDDEN] += 1
    p["inb"][:, :HIDDEN] += 1
    first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, steps + 1):
        made = [generate(rng, length) for _ in range(batch)]
        x = np.array([codes(t, table) for t, _ in made]).T
        gold = np.array([y for _, y in made]).T
        (hf, kf), (hb, kb) = run(x, p, "f", True), run(x, p, "b", True)
        e = (hf @ p["of"] + hb @ p["ob"] + p["bias"]).astype(np.float64)
        _, ge, gt = crf_gradient(e, gold, p["trans"].astype(np.float64))
        ge = ge.astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["bias"], g["trans"] = ge.sum((0, 1)), gt.astype(np.float32)
        for side, h, kept in (("f", hf, kf), ("b", hb, kb)):
            g["o" + side] = np.einsum("tbh,tbk->hk", h, ge)
            backward(x, p, side, kept, ge @ p["o" + side].T, g)
        size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        for k in p:
            d = g[k] * min(1, 0.05 / (size + 1e-9)) * 20
            first[k] = 0.9 * first[k] + 0.1 * d
            second[k] = 0.99 * second[k] + 0.01 * d * d
            p[k] = (p[k] - 0.03 * (1 - 0.8 * step / steps) * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return p


@functools.lru_cache(1)
def trained() -> bytes:
    return pickle.dumps(train())


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def with_spans(docs: DataFrame, fields: list[T.StructField], row, only: list[str] | None = None, chars: int = 1_500_000) -> DataFrame:
    """docs' columns (or those of `only`) and what row(text or None, base, spans) gives for each."""
    weights = trained()
    at = docs.columns.index("text")
    kept = only or docs.columns
    schema = T.StructType([*[docs.schema[c] for c in kept], *fields])
    names = [f.name for f in fields]
    cols = [docs.columns.index(c) for c in kept]

    def apply(batches):
        trim()
        reader = Reader(pickle.loads(weights))
        for b in batches:
            texts = b.column(at).to_pylist()
            i = 0
            while i < len(texts):
                j, n = i, 0
                while j < len(texts) and (j == i or n + len(texts[j] or "") <= chars):
                    n += len(texts[j] or "")
                    j += 1
                part = texts[i:j]
                found = reader.tag([t or "" for t in part])
                rows = []
                for t, f in zip(part, found, strict=True):
                    base = base_spans(t or "")
                    rows.append(row(t, base, all_spans(t or "", base, f)))
                cut = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*[cut.column(c) for c in cols], *[pa.array([r[k] for r in rows], pa.string() if isinstance(f.dataType, T.StringType) else pa.int64()) for k, f in enumerate(fields)]], [*kept, *names])
                i = j
        reader = b = texts = part = found = rows = cut = None
        trim()

    return docs.mapInArrow(apply, schema)


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of text replaced by its kind in brackets, and n_chars, if there, counted anew."""

    def row(text, _, spans):
        if text is None:
            return (None,)
        out, at = [], 0
        for s, k, e in spans:
            if s >= at:
                out += [text[at:s], f"[{KINDS[k].upper()}]"]
            at = max(at, e)
        return ("".join([*out, text[at:]]),)

    from pyspark.sql import functions as F

    name = "redacted_text"
    while name in docs.columns:
        name += "_"
    others = [c for c in docs.columns if c != "text"]
    out = with_spans(docs, [T.StructField(name, T.StringType())], row, others)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(name).isNull(), F.col("n_chars")).otherwise(F.length(name).cast(docs.schema["n_chars"].dataType)))
    return out.select(*[F.col(name).alias("text") if c == "text" else F.col(c) for c in docs.columns])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the base spans' checksum, all spans and their number."""
    long = [*(f"n_{k}" for k in KINDS[:BASE_KINDS]), "n_spans"]
    fields = [*(T.StructField(c, T.LongType()) for c in long[:-1]), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField(long[-1], T.LongType())]

    def row(_, base, spans):
        n = [sum(k == i for _, k, _ in base) for i in range(BASE_KINDS)]
        return (*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans))

    return with_spans(docs.select("doc_id", "text"), fields, row, ["doc_id"])


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(docs_of(spark, sf_dir))
