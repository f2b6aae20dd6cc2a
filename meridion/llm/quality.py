"""Quality classifier from weak labels.

Overlapping heuristic labellers, each on a measure of its own, vote bad (1),
good (0) or abstain (-1) on five defects: symbols, pipes, shouting, repetition
and toxic language. Toxic language is labelled by a word list and by two sets
of word stems, each mined from a half of a bounded sample of labelled documents
(LABELLED rows). The votes of all documents are counted by pattern, and
expectation-maximisation (the naive Bayes model of labeller accuracies)
estimates each labeller's accuracy and each defect's share of the documents
from these counts.

The posterior labels of a bounded sample train two hashed linear scorers, of
junk (any of the first four) and of toxic language. Half of the sample (SAMPLE
rows in all) are the documents with the smallest hash of doc_id; the other half
are those with the smallest hash among documents that the posterior calls bad,
so that rare defects are seen, a half for each scorer. A scorer's bias is the
log odds of its defect's share of all documents. Its features are the words,
their beginnings, the shapes of tokens with their shares, and how many words
and pairs of words differ; no labeller's threshold is among them. Every whole
document is scored, and kept if it scores under 0.5 on both.

Cases: null or empty text counts as empty, on which labellers abstain, and is
kept; null doc_id is scored as any other; repeated rows and ties score alike;
extra columns stay; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from math import exp, log2
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import docs_of, stored, trim

SAMPLE, BITS, ROUNDS = 6000, 18, 12
LABELLED, PRECISION = 8000, 0.8
#: Rows that have a feature, and its z-score, from which a scorer uses it.
LEAST, SIGNIFICANT = 5, 6.0

# Words of abuse.
ABUSE = frozenset(
    "idiot idiots moron morons stupid imbecile cretin dumbass retard loser losers scum trash worthless pathetic "
    "disgusting clown vermin filth filthy bastard bastards bitch whore slut asshole motherfucker fuck fucking fucker "
    "bullshit degenerate parasite parasites subhuman scumbag dimwit dipshit jackass douchebag nitwit".split(" ")
)
AROUND = ".,;:!?#$%&*|\"'()"
STEMS = (4, 5, 8)
RUN = re.compile(r"([#$%&*^~=_<>-])\1{2}")
# The latent classes, each with the labellers that overlap on it.
TASKS = {
    "symbols": ("odd_characters", "runs_of_marks", "marked_tokens"),
    "pipes": ("pipes", "bare_tokens", "unlettered"),
    "shouting": ("capital_words", "bangs", "capital_letters"),
    "repetition": ("few_pairs", "few_words", "same_again"),
    "toxic": ("abuse", "mined_one", "mined_two"),
}
SCORERS = {"junk": ("symbols", "pipes", "shouting", "repetition"), "toxic": ("toxic",)}
MARKS = "#$%&*^~<>{}[]\\"
NO_STEMS: tuple[frozenset, frozenset] = (frozenset(), frozenset())


CHARS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "X" * 26 + "x" * 26 + "9" * 10)
UPPER = dict.fromkeys(map(ord, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
AGAIN = re.compile(r"(.)\1+")
#: Tokens of which a task keeps what it found.
TOKENS = 150_000


def shape_of(token: str) -> str:
    """x, X and 9 for letters and digits, one for each run of them or of a mark."""
    shape = token.translate(CHARS)
    if not shape.isascii():
        shape = "".join("x" if c.islower() else "X" if c.isupper() else c for c in shape)
    return AGAIN.sub(r"\1", shape)[:12]


def distinct_pairs(tokens: list[str], distinct: int) -> float:
    """The share of different ones among pairs of neighbours; 1 where more than half of the tokens differ, as then more than half of the pairs do."""
    if 2 * distinct > len(tokens) + 1:
        return 1.0
    return len(set(zip(tokens, tokens[1:], strict=False))) / max(1, len(tokens) - 1)


#: What is found for most tokens.
LETTERS = ("x", ())


class Words(dict):
    """What make(token) gives for tokens, kept for TOKENS of them."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, token: str):
        if len(self) > TOKENS:
            self.clear()
        self[token] = out = self.make(token)
        return out


class Reader:
    """Reads texts for labellers and scorers."""

    def __init__(self, mined: tuple = NO_STEMS, bits: int = BITS, wanted: set | None = None):
        self.mined, self.mask, self.wanted = mined, (1 << bits) - 1, wanted
        self.signs, self.hashes = Words(self._signs), Words(self._hashes)

    def hash(self, feature: str) -> int:
        return crc32(feature.encode()) & self.mask

    def _signs(self, token: str) -> int:
        """Bits: shouted, ends in a mark, has no letter or digit, a word of abuse, a stem of each mined set."""
        w = token.lower().strip(AROUND)
        out = 8 if w in ABUSE else 0
        if len(w) >= STEMS[0]:
            stems = (w[:4], w[:5], w[:8])
            out |= (0 if self.mined[0].isdisjoint(stems) else 16) | (0 if self.mined[1].isdisjoint(stems) else 32)
        if token.isalpha():
            return out | (len(token) > 1 and token.isupper())
        return out | (len(token) > 1 and token.isupper()) | (2 if token[-1] in MARKS and len(token) > 1 else 0) | (0 if any(map(str.isalnum, token)) else 4)

    def _hashes(self, token: str) -> tuple:
        """The token's shape, and the hashes of the word and of its beginnings (those of `wanted`)."""
        w = token.lower().strip(AROUND)
        shape = "x" if token.isalpha() and token.islower() else shape_of(token)
        mask = self.mask
        every = [crc32(w.encode()) & mask, *[crc32(w[:c].encode(), c) & mask for c in STEMS if len(w) >= c]]  # the length starts the checksum
        held = tuple(every if self.wanted is None else self.wanted.intersection(every))
        return LETTERS if shape == "x" and not held else (shape, held)

    def measures(self, text: str) -> dict[str, float]:
        """What the labellers look at."""
        n = max(1, len(text))
        tokens = text.split()
        k = max(1, len(tokens))
        counts = Counter(tokens)
        signs: dict[int, int] = {}
        kinds: dict[int, int] = {}
        for sign, c in zip(map(self.signs.__getitem__, counts), counts.values(), strict=True):
            if sign:
                signs[sign] = signs.get(sign, 0) + c
                kinds[sign] = kinds.get(sign, 0) + 1
        share = lambda bit: sum([c for x, c in signs.items() if x & bit]) / k
        kind = lambda bit: sum([c for x, c in kinds.items() if x & bit])
        odd = sum(map(text.count, MARKS))
        pipes, bangs = text.count("|"), text.count("!")
        return {
            "tokens": len(tokens),
            "odd": odd / n,
            "runs": len(RUN.findall(text)) / k if odd or "=" in text or "-" in text or "_" in text else 0.0,
            "marked": share(2),
            "pipes": pipes / n,
            "bare": share(4),
            "unlettered": (odd + pipes + bangs + sum(map(text.count, ";:/=+@_"))) / max(1, sum(map(len, tokens))),
            "upper": share(1),
            "bang": bangs / k,
            "capital": (len(text) - len(text.translate(UPPER))) / n,
            "distinct": len(counts) / k,
            "pairs": distinct_pairs(tokens, len(counts)),
            "same": sum(map(eq, tokens, tokens[1:])) / k,
            "hits": kind(8),
            "one": kind(16) if self.mined[0] else -1,
            "two": kind(32) if self.mined[1] else -1,
        }

    def features(self, text: str) -> set[int]:
        """The hashed features of a text: words, their beginnings, shapes with their shares, and how many words and pairs of words differ."""
        tokens = text.split()
        counts = Counter(tokens)
        found = list(map(self.hashes.__getitem__, counts))
        out = set().union(*[h for _, h in found if h])
        if k := len(tokens):
            shapes: dict[str, int] = {}
            for (shape, _), c in zip(found, counts.values(), strict=True):
                shapes[shape] = shapes.get(shape, 0) + c
            pairs = distinct_pairs(tokens, len(counts))
            out.update([self.hash(f"\1{s}{min(7, int(-log2(c / k)))}") for s, c in shapes.items()])
            out.update((self.hash(f"\2{int(len(counts) / k * 20)}"), self.hash(f"\3{int(pairs * 20)}")))
        return out


def votes(m: dict[str, float]) -> tuple[int, ...]:
    """A vote of each labeller, in the order of TASKS."""
    if not m["tokens"]:
        return (-1,) * sum(map(len, TASKS.values()))
    big = m["tokens"] >= 8

    def by(k: str, bad: float, good: float, known: bool = True) -> int:
        return -1 if not known or m[k] < 0 else 1 if m[k] > bad else 0 if m[k] < good else -1

    return (
        by("odd", 0.02, 0.008), by("runs", 0.15, 0.03), by("marked", 0.2, 0.05),
        by("pipes", 0.03, 0.006), by("bare", 0.15, 0.03), by("unlettered", 0.06, 0.02),
        by("upper", 0.3, 0.1, big), by("bang", 0.25, 0.05, big), by("capital", 0.3, 0.15, big),
        -1 if not big else 1 if m["pairs"] < 0.25 else 0 if m["pairs"] > 0.5 else -1,
        1 if m["tokens"] > 30 and m["distinct"] < 0.12 else 0 if m["distinct"] > 0.25 else -1, by("same", 0.15, 0.05, big),
        by("hits", 0, 1), by("one", 0, 1), by("two", 0, 1),
    )


def features(text: str, bits: int = BITS, mined: tuple = NO_STEMS) -> tuple[tuple[int, ...], np.ndarray]:
    """(votes, the distinct hashed features) of a whole text."""
    reader = Reader(mined, bits)
    return votes(reader.measures(text)), np.array(sorted(reader.features(text)), np.int32)


def mine(docs: DataFrame, labels: DataFrame, sample: int = LABELLED) -> tuple[frozenset, frozenset]:
    """Word stems that mark toxic documents, from each half of `sample` labelled ones (those with the smallest hash of doc_id)."""
    some = labels.filter("toxic is not null").select("doc_id", "toxic").orderBy(F.xxhash64(F.lit(13), "doc_id"), "doc_id").limit(sample).withColumn("half", F.pmod(F.xxhash64(F.lit(14), "doc_id"), F.lit(2)).cast("int"))

    def stems(batches):
        for b in batches:
            got = [sorted({w.strip(AROUND)[:c] for w in set((t or "").lower().split()) for c in STEMS if len(w.strip(AROUND)) >= c}) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.list_(pa.string()))], ["half", "toxic", "stems"])

    # `sample` rows at most are broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("half", F.col("toxic").cast("int"), "text").mapInArrow(stems, "half int, toxic int, stems array<string>")
    stem = rows.select("half", "toxic", F.explode("stems").alias("stem")).groupBy("half", "stem").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    found = stem.filter((F.col("bad") >= 4) & (F.col("bad") >= PRECISION * F.col("n"))).orderBy(F.desc("bad"), "stem").limit(10_000).collect()
    return tuple(frozenset(r["stem"] for r in found if r["half"] == k) for k in (0, 1))


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> tuple[float, np.ndarray]:
    """EM over counted vote patterns: share of bad documents, and P(vote | class) as (labellers, class, vote + 1)."""
    if not patterns:
        return 0.1, np.zeros((0, 2, 3))
    v, n = np.array([p for p, _ in patterns]), np.array([c for _, c in patterns], float)
    share = 0.1
    # To begin with, both classes abstain alike.
    table, silent = np.zeros((v.shape[1], 2, 3)), ((v == -1) * n[:, None]).sum(0) / n.sum()
    for c, at_bad in ((0, 0.02), (1, 0.9)):
        table[:, c] = np.stack([silent, (1 - silent) * (1 - at_bad), (1 - silent) * at_bad], axis=1) + 1e-3
    each = np.arange(v.shape[1])
    table[(v == -1).all(axis=0)] = 1 / 3  # a labeller that never votes says nothing
    if (silent < 1).sum() < 2:  # one labeller alone can't be estimated: it is taken at its word
        share = float(np.clip((n * (v == 1).any(axis=1)).sum() / n.sum(), 1e-5, 0.6))
        table[:, 0, 2] = np.minimum(table[:, 0, 2], share / 20)
        return share, table
    for _ in range(rounds):
        post = posterior(v, share, table)
        share = float(np.clip((n * post).sum() / n.sum(), 1e-5, 0.6))
        for c, w in ((0, n * (1 - post)), (1, n * post)):
            for vote in (-1, 0, 1):
                table[:, c, vote + 1] = ((v == vote) * w[:, None]).sum(0) + 0.5
        # A labeller is taken to be better than chance where it votes.
        table /= table.sum(2, keepdims=True)
        table[(v == -1).all(axis=0)] = 1 / 3
        low = table[each, 1, 2] < table[each, 0, 2]
        table[low, 1, 2] = table[low, 0, 2]
    return share, table


def posterior(v: np.ndarray, share: float, table: np.ndarray) -> np.ndarray:
    each = np.arange(v.shape[1])
    odds = np.log(share / (1 - share)) + (np.log(table[each, 1, v + 1]) - np.log(table[each, 0, v + 1])).sum(1)
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def train(rows: list[np.ndarray], target: np.ndarray, share: float | None = None, bits: int = BITS, rounds: int = ROUNDS, l1: float = 1e-4, least: int | None = None, significant: float | None = None) -> tuple[np.ndarray, float]:
    """Logistic regression by AdaGrad with truncation, on features that `least` rows have and whose z-score is `significant`; share is the bad rows' share where the rows come from."""
    least, significant = least or LEAST, significant or SIGNIFICANT
    w, b = np.zeros(1 << bits), 0.0
    if not rows or target.min() > 0.5 or target.max() < 0.5:
        return w, -3.0 if not rows or target.max() < 0.5 else 3.0
    # Only features whose share differs between the classes beyond chance.
    bad = target > 0.5
    n1, n0 = bad.sum(), (~bad).sum()
    c1 = np.bincount(np.concatenate([r for r, x in zip(rows, bad, strict=True) if x]), minlength=1 << bits)
    c0 = np.bincount(np.concatenate([r for r, x in zip(rows, bad, strict=True) if not x]), minlength=1 << bits)
    p = (c1 + c0) / len(rows)
    z = (c1 / n1 - c0 / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
    used = (c1 + c0 >= least) & (np.abs(z) > significant)
    rows = [r[used[r]] for r in rows]
    share = np.clip(target.mean() if share is None else share, 1e-4, 1 - 1e-3)
    b = float(np.log(share / (1 - share)))  # stays, so that a text without evidence scores as the share does
    grad = np.full(1 << bits, 1e-3)
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            r = rows[i]
            g = (1 / (1 + np.exp(-np.clip(w[r].sum() + b, -30, 30))) - target[i])
            grad[r] += g * g
            rate = 0.3 / np.sqrt(grad[r])
            x = w[r] - rate * g
            w[r] = np.sign(x) * np.maximum(0, np.abs(x) - rate * l1 * 10)
    return w, b


def fit(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE, bits: int = BITS) -> dict:
    """The models of both tasks: EM on the votes of all documents, scorers on the sample."""
    mined = mine(docs, labels) if labels is not None else NO_STEMS
    names = [n for t in TASKS.values() for n in t]

    h = F.xxhash64(F.lit(11), "doc_id")

    def vote(batches):
        trim()
        reader = Reader(mined, bits)
        for b in batches:
            got = [",".join(map(str, votes(reader.measures(t or "")))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.string())], ["h", "pattern"])
        reader.signs.clear()
        trim()

    voted = stored(docs.select(h.alias("h"), "text").mapInArrow(vote, "h long, pattern string"), "votes")
    # At most 3 to the power of the number of labellers patterns.
    patterns = sorted((tuple(map(int, r["pattern"].split(","))), r["count"]) for r in voted.groupBy("pattern").count().collect())
    models, at = {}, 0
    for task, own_names in TASKS.items():
        own: Counter = Counter()
        for p, n in patterns:
            own[p[at : at + len(own_names)]] += n
        models[task] = (at, *estimate(sorted(own.items())))
        at += len(own_names)

    def bad(v: np.ndarray) -> dict[str, np.ndarray]:
        """Each scorer's posterior for rows of votes."""
        posts = {t: posterior(v[:, i : i + len(TASKS[t])], share, table) for t, (i, share, table) in models.items()}
        return {s: 1 - np.prod([1 - posts[t] for t in tasks], axis=0) for s, tasks in SCORERS.items()}

    every = np.array([p for p, _ in patterns], np.int64).reshape(len(patterns), len(names))
    weight = np.array([n for _, n in patterns], float)
    shares = {s: float((weight * x).sum() / max(1.0, weight.sum())) for s, x in bad(every).items()}
    # The rows of the sample: by the hash alone (kind 0), and of the patterns that a scorer's posterior calls bad (kinds 1 and 2).
    marked = [[",".join(map(str, patterns[i][0])) for i in np.flatnonzero(x > 0.5)] for x in bad(every).values()]
    parts = [voted.orderBy("h").limit(sample // 2), *(voted.filter(F.col("pattern").isin(m)).orderBy("h").limit(sample // 4) for m in marked)]
    chosen = [(r["h"], k, r["pattern"]) for k, part in enumerate(parts) for r in part.collect()]

    def collect(batches):
        reader = Reader(mined, bits)
        for b in batches:
            got = [sorted(reader.features(t or "")) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.int32()))], ["h", "features"])

    rows = []
    if chosen:
        some = docs.sparkSession.createDataFrame([(x,) for x in sorted({x for x, _, _ in chosen})], "h long")  # 1.5 * `sample` rows at most
        found = docs.select(h.alias("h"), "text").join(F.broadcast(some), "h").mapInArrow(collect, "h long, features array<int>").dropDuplicates(["h"])
        of = {r["h"]: r["features"] for r in found.collect()}
        rows = sorted(({"kind": k, "h": x, "votes": list(map(int, p.split(","))), "features": of[x]} for x, k, p in chosen), key=lambda r: (r["kind"], r["h"], r["votes"]))
    v = np.array([r["votes"] for r in rows], np.int64).reshape(len(rows), len(names))
    f, kind = [np.array(r["features"], np.int32) for r in rows], np.array([r["kind"] for r in rows])
    out: dict = {"mined": mined}
    posts = bad(v) if len(rows) else {s: np.zeros(0) for s in SCORERS}
    for j, (scorer, tasks) in enumerate(SCORERS.items()):
        mine_ = np.flatnonzero((kind == 0) | (kind == j + 1)) if len(rows) else []
        w, b = train([f[i] for i in mine_], posts[scorer][mine_] if len(rows) else np.zeros(0), shares[scorer], bits)
        used = np.flatnonzero(w)
        labellers = {t: {"share": models[t][1], "accuracy": dict(zip(TASKS[t], models[t][2].tolist(), strict=False))} for t in tasks}
        out[scorer] = {"at": used.astype(np.int32), "weight": w[used], "bias": b, "labellers": labellers}
    return out


def score(docs: DataFrame, model: dict, bits: int = BITS, threshold: float = 0.5) -> DataFrame:
    """docs with junk_score, toxic_score (double) and keep (boolean); columns of these names are overwritten."""
    new = ["junk_score", "toxic_score", "keep"]
    docs = docs.drop(*new)
    mined = model["mined"]
    small = {t: (model[t]["at"], model[t]["weight"], model[t]["bias"]) for t in SCORERS}
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(new[0], T.DoubleType()), T.StructField(new[1], T.DoubleType()), T.StructField(new[2], T.BooleanType())])

    def run(batches):
        trim()
        reader = Reader(mined, bits, {int(x) for where, _, _ in small.values() for x in where})
        weights = {t: dict(zip(where.tolist(), weight.tolist(), strict=True)) for t, (where, weight, _) in small.items()}
        for b in batches:
            scores = {t: np.zeros(b.num_rows) for t in small}
            for i, text in enumerate(b.column(at).to_pylist()):
                if not text:
                    continue
                hashed = reader.features(text)
                for t, w in weights.items():
                    total = sum(map(w.__getitem__, hashed & w.keys())) + small[t][2]
                    scores[t][i] = 1 / (1 + exp(-max(-30.0, min(30.0, total))))
            keep = (scores["junk"] < threshold) & (scores["toxic"] < threshold)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores["junk"]), pa.array(scores["toxic"]), pa.array(keep)], [*b.schema.names, *new])
        reader.hashes.clear()
        trim()

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    return score(docs, fit(docs, labels, sample))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(docs_of(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "junk_score", "toxic_score", "keep")
