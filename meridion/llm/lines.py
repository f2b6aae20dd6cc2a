"""Line deduplication by an exact set-similarity join.

A line is the set of its tokens (lower case, cut at white space). Lines of
equal sets are one set, whose place is its first line by doc_id and number.
Tokens are ordered by rarity, counted over all texts in a fixed number of
hashed cells, so any corpus gives a table of the same size; words of one 40-bit
hash and rank are one token. Sets are joined on
the tokens of their prefixes; pairs pass the length and the positional filter
and a filter on 128-bit parity maps of the sets (each token that one set alone
has flips one bit, so sets that differ in more bits than similar sets can have
tokens of their own are not similar); then the Jaccard similarity of the whole
sets is verified. A line is removed if an earlier line has the same set or a
similarity of `threshold` or more.

A set needs one earlier match only, so it is held first against some sets that
share its least hash of a token, as most near copies do: the earliest, the most
frequent and some others. Sets that this leaves open are joined with all earlier
ones, and held first against the closest by parity map; only sets that still
match none are held against the rest. Groups of near copies thus don't make all their pairs. A pair meets at a
token only if the tokens before it in the two prefixes differ, so a run of
shared tokens gives one meeting. Tokens that the corpus holds once join nothing
and are left out. A set is known by a 64-bit sum of its tokens' hashes: sets of
one sum count as equal without a look at their words.

Cases: lines without tokens (null or empty texts, blank lines) are never
removed; rows with a null doc_id take no part and keep their text; of repeated
rows of one doc_id the lines count as equal places, so none removes the other;
texts and lines of any length are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import docs_of, free, mix64, scratch, stored, trim

THRESHOLD, CELLS = 0.8, 1 << 21
#: Steps of an octave in ranks of rarity, which is also the rank of a token that the corpus holds once.
STEPS = ONCE = 6
#: Sets against which a set is held first, besides the earliest and the most frequent of its group.
OTHERS = 6
#: Pairs of a set, the closest by their parity maps, that are verified before its others.
FIRST = 4
#: Removed sets up to this number (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST = 2_000_000
FILTER_WORDS = 1 << 20
BITS = FILTER_WORDS * 64
#: Sets of at most so many tokens hold their parity map folded to 64 bits.
SHORT = 96
#: Cells of a block of counts.
BLOCK = CELLS // 256
#: A token is known by its rank and 40 bits of its hash; 21 others give its cell.
HASH_BITS = 40
HASH = np.uint64((1 << HASH_BITS) - 1)
SLICE = 1 << 16
#: Characters that are handled together, a text at least.
AT_ONCE = 1 << 19
#: White space beyond ASCII.
WIDE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: Hashes of words are polynomials in BASE, modulo 2 ** 64, of a number for each byte.
BASE = 0x9E3779B97F4A7C15
BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


class Powers:
    """Powers of BASE and of its inverse, as many as asked for so far."""

    def __init__(self):
        self.up = self.down = np.empty(0, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.full(n, x, np.uint64)) for x in (BASE, pow(BASE, -1, 1 << 64)))
        return self.up[:n], self.down[:n]


def word_hashes(texts: list[str], powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Counts of words of all lines of texts in lower case, and the hashes of the words."""
    raw = "\n".join(texts)
    if not raw.isascii():
        for c in WIDE:
            if c in raw:
                raw = raw.replace(c, " ")
    data = np.frombuffer(f"{raw}\n".encode(), np.uint8)
    word = np.zeros(len(data) + 1, np.int8)
    word[1:] = ~SPACE[data]
    edges = np.diff(word)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    up, down = powers.of(len(data))
    sums = BYTES[data]
    with np.errstate(over="ignore"):
        sums *= up
        np.cumsum(sums, out=sums)
        hashes = mix64((sums[ends - 1] - sums[starts] + BYTES[data[starts]] * up[starts]) * down[starts])
    return np.diff(np.searchsorted(starts, np.flatnonzero(data == 10)), prepend=0), hashes


def together(texts: list[str | None]):
    """(places, texts in lower case) of texts that are not empty, some AT_ONCE characters at a time."""
    at, held, size = [], [], 0
    for i, text in enumerate(texts):
        if text:
            at.append(i)
            held.append(text.lower())
            size += len(text)
            if size >= AT_ONCE:
                yield at, held
                at, held, size = [], [], 0
    if held:
        yield at, held


def set_keys(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(mix64(tokens & HASH), starts).view(np.int64)


def cell_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(HASH_BITS) & np.uint64(CELLS - 1)).astype(np.int64)


def least_overlap(threshold: float, n):
    """The smallest whole number that is at least threshold * n."""
    return np.ceil(threshold * np.asarray(n) - 1e-9).astype(np.int64)


def rarity(docs: DataFrame) -> np.ndarray:
    """The rank of the tokens of each cell: STEPS times the binary logarithm of their occurrences in all texts plus one."""

    def count(batches):
        trim()
        powers, n = Powers(), np.zeros(CELLS, np.int64)
        for b in batches:
            for _, texts in together(b.column(0).to_pylist()):
                n += np.bincount(cell_of(word_hashes(texts, powers)[1]), minlength=CELLS)
        blocks = [k for k in range(CELLS // BLOCK) if n[k * BLOCK : (k + 1) * BLOCK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([zlib.compress(n[k * BLOCK : (k + 1) * BLOCK].tobytes(), 1) for k in blocks], pa.binary())], ["block", "counts"])
        del n, powers
        trim()

    def add(batches):
        total = {}  # CELLS counts at most
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(zlib.decompress(c), np.int64)
        ranks = [np.minimum(np.floor(np.log2(n + 1) * STEPS + 1e-6), 255).astype(np.uint8).tobytes() for n in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(ranks, pa.binary())], ["block", "ranks"])

    out = np.zeros(CELLS, np.uint8)
    for r in docs.select("text").mapInArrow(count, "block int, counts binary").repartition("block").mapInArrow(add, "block int, ranks binary").toArrow().to_batches():
        for k, x in zip(r.column(0).to_pylist(), r.column(1).to_pylist(), strict=True):  # CELLS bytes at most
            out[k * BLOCK : (k + 1) * BLOCK] = np.frombuffer(x, np.uint8)
    return out


def line_sets(docs: DataFrame, ranks: np.ndarray, threshold: float) -> DataFrame:
    """(doc_id, line, set, n, skip, least, p0, p1, prefix): each line with tokens; least is the least hash of a token.

    prefix holds its first tokens by rarity, without `skip` that the corpus holds once; it is empty where a set can match
    itself only. p0 and p1 are the parity map; of a short set p0 is the exclusive or of both and p1 is 0."""

    def parity(bits, word, starts):
        return np.bitwise_xor.reduceat(np.where(bits >> 6 == word, np.uint64(1) << (bits & 63).astype(np.uint64), np.uint64(0)), starts).view(np.int64)

    def of_slice(ids, line, owner, hashes):
        rank = ranks[cell_of(hashes)].astype(np.uint64)
        token = owner.astype(np.uint64) << np.uint64(48) | rank << np.uint64(HASH_BITS) | hashes & HASH
        token.sort()
        token = token[np.concatenate([[True], token[1:] != token[:-1]])]
        n = np.bincount((token >> np.uint64(48)).astype(np.int64), minlength=len(ids))
        token &= np.uint64((1 << 48) - 1)
        starts = np.cumsum(n) - n
        # No other size has an overlap that is high enough.
        alone = (n - least_overlap(threshold, n) < 1) & (least_overlap(threshold, n + 1) > n)
        p = np.where(alone, 0, n - least_overlap(threshold, n) + 1)
        first = np.arange(len(token)) - np.repeat(starts, n) < np.repeat(p, n)
        keep = first & (token >> np.uint64(HASH_BITS) > ONCE)
        held = np.add.reduceat(keep.astype(np.int64), starts)
        prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(held)]).astype(np.int32)), pa.array(token[keep].view(np.int64)))
        bits = (token & np.uint64(127)).astype(np.int64)
        p0, p1 = parity(bits, 0, starts), parity(bits, 1, starts)
        p0, p1 = np.where(n <= SHORT, p0 ^ p1, p0), np.where(n <= SHORT, 0, p1)
        with np.errstate(over="ignore"):
            least = np.minimum.reduceat((token & HASH) * np.uint64(BASE), starts).view(np.int64)
        columns = [ids, line, set_keys(token, starts), n.astype(np.int32), (p - held).astype(np.int32), least, p0, p1]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), prefix], ["doc_id", "line", "set", "n", "skip", "least", "p0", "p1", "prefix"])

    def run(batches):
        trim()
        powers = Powers()
        for b in batches:
            every = b.column(0).to_numpy()
            for at, texts in together(b.column(1).to_pylist()):
                count = np.array([t.count("\n") + 1 for t in texts])
                ids = np.repeat(every[at], count)
                line = (np.arange(len(ids)) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32)
                held, hashes = word_hashes(texts, powers)
                full = np.flatnonzero(held)
                ids, line, held = ids[full], line[full], held[full]
                ends = np.cumsum(held)
                for k in range(0, len(full), SLICE):
                    h = held[k : k + SLICE]
                    yield of_slice(ids[k : k + SLICE], line[k : k + SLICE], np.repeat(np.arange(len(h)), h), hashes[ends[k] - h[0] : ends[k] - h[0] + h.sum()])
        trim()

    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, line int, set long, n int, skip int, least long, p0 long, p1 long, prefix array<long>")


def cells(rows: DataFrame) -> np.ndarray:
    """A table of BITS bits, of fixed size, with those of rows' column `bit` set."""
    words = rows.select(F.floor(F.col("bit") / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int")).alias("x")).groupBy("word").agg(F.bit_or("x").alias("bits"))
    out = np.zeros(FILTER_WORDS, np.int64)
    for r in words.toArrow().to_batches():
        out[r.column(0).to_numpy()] = r.column(1).to_numpy()
    return out


def is_set(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (words[at // 64] >> (at % 64)) & 1 == 1


def matched(docs: DataFrame, sets: DataFrame, pairs: DataFrame, threshold: float, several: bool = True) -> DataFrame:
    """Of pairs (b, a) of sets, the b (as `set`) of those that are similar. With `several` pairs of a b, they also have d and one.

    d orders a set's pairs: the FIRST of them are held against it before the others, which are left out once one is similar.
    one tells that both sets begin in one document, where a pair counts if the line of a is earlier.
    Lines are taken from the texts by their places; a table of bits of fixed size leaves out most others."""
    with scratch(docs.sparkSession):
        return _matched(docs, sets, stored(pairs, "pairs"), threshold, several)


def _matched(docs: DataFrame, sets: DataFrame, pairs: DataFrame, threshold: float, several: bool) -> DataFrame:
    ids = pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct()
    places = sets.select("set", "first").join(ids, "set", "left_semi")
    if several:
        places = stored(places, "places")
    words = cells(places.select(F.pmod(F.col("first.doc_id").bitwiseXOR(F.shiftleft(F.col("first.line").cast("long"), 17)), F.lit(BITS)).alias("bit")))
    if not words.any():
        return docs.sparkSession.createDataFrame([], "set long")

    def run(batches):
        powers = Powers()
        for b in batches:
            every = b.column(0).to_numpy()
            for place, texts in together(b.column(1).to_pylist()):
                cut = [t.split("\n") for t in texts]
                count = np.array([len(c) for c in cut])
                flat = [line for c in cut for line in c]
                number = np.arange(len(flat)) - np.repeat(np.cumsum(count) - count, count)
                at = (np.repeat(every[place], count) ^ number << 17) % BITS
                held = [" ".join(w) for k in np.flatnonzero(is_set(words, at)) if (w := sorted(set(flat[k].split())))]
                if held:
                    n, hashes = word_hashes(held, powers)
                    token = np.unique(np.repeat(np.arange(len(n), dtype=np.uint64), n) << np.uint64(HASH_BITS) | hashes & HASH)
                    starts = np.flatnonzero(np.diff(token >> np.uint64(HASH_BITS), prepend=np.uint64(1 << 40)))
                    yield pa.RecordBatch.from_arrays([pa.array(set_keys(token, starts)), pa.array(held, pa.string())], ["set", "words"])

    every = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "set long, words string")
    found = stored(every.join(ids, "set", "left_semi").groupBy("set").agg(F.first("words").alias("words")), "words")
    def verify(batches):
        for b in batches:
            hit = []
            for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                x, y = set(x.split()), set(y.split())
                both = len(x & y)
                hit.append(both >= threshold * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(hit, pa.bool_()))], ["set"])

    def similar(those: DataFrame) -> DataFrame:
        both = those.join(found.withColumnsRenamed({"set": "a", "words": "wa"}), "a").join(found.withColumnsRenamed({"set": "b", "words": "wb"}), "b")
        return both.select("b", "wa", "wb").mapInArrow(verify, "set long").distinct()

    if not several:
        return stored(similar(pairs), "matched", outer=True)
    first = lambda c: places.select(F.col("set").alias(c), F.col("first").alias(f"f{c}"))
    late = pairs.filter("one").join(first("a"), "a").join(first("b"), "b").filter("fa >= fb").select("b", "a")
    early = pairs.join(F.broadcast(late) if late.count() <= BROADCAST else late, ["b", "a"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("b").orderBy("d", "a"))
    early = stored(early.select("b", "a", nth.alias("nth")), "ordered")
    hit, more = similar(early.filter(F.col("nth") <= FIRST)), early.filter(F.col("nth") > FIRST)
    if not more.isEmpty():
        hit = stored(hit, "similar")
        hit = hit.unionByName(similar(more.join(hit, more["b"] == hit["set"], "left_anti")))
    return stored(hit, "matched", outer=True)


def differing(x, y) -> Column:
    """Bits in which the parity maps of x and y differ; folded, if one of them is."""
    p0, p1 = x["p0"].bitwiseXOR(y["p0"]), x["p1"].bitwiseXOR(y["p1"])
    return F.when((x["n"] <= SHORT) | (y["n"] <= SHORT), F.bit_count(p0.bitwiseXOR(p1))).otherwise(F.bit_count(p0) + F.bit_count(p1))


def may_match(x, y, threshold: float) -> Column:
    """The length and the parity filter. False where x has a negative n."""
    n, m, t = x["n"], y["n"], F.lit(threshold)
    return (m >= t * n - 1e-9) & (n >= t * m - 1e-9) & (differing(x, y) <= n + m - 2 * needed(n, m, threshold))


def needed(n, m, threshold: float) -> Column:
    """The overlap that similar sets of n and m tokens have at least: t / (1 + t) * (n + m)."""
    return F.ceil(F.lit(threshold) / (1 + F.lit(threshold)) * (n + m) - 1e-9)


def hub_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (b, a) of a set and each of the earlier ones that it is held against first, if they pass the filters."""
    me = [F.col(c) for c in ("first", "set", "n", "p0", "p1")]
    hubs = [F.min(F.struct(*me)).alias("h0"), F.max(F.struct("f", *me)).alias("h1")]
    hubs += [F.min(F.struct(F.xxhash64(F.lit(k), "set"), *me)).alias(f"h{k + 2}") for k in range(OTHERS)]
    rows = sets.filter(F.size("prefix") > 0).select("least", "f", *me)
    groups = rows.groupBy("least").agg(*hubs, F.count("*").alias("many")).filter("many > 1").drop("many")
    own = {c: F.col(c) for c in ("n", "p0", "p1")}
    options = [F.when((F.col(h)["first"] < F.col("first")) & may_match(own, F.col(h), threshold), F.col(h)["set"]) for h in (f"h{k}" for k in range(OTHERS + 2))]
    return rows.join(groups, "least").select(F.col("set").alias("b"), F.array_compact(F.array(*options)).alias("a")).filter(F.size("a") > 0).select("b", F.explode(F.array_distinct("a")).alias("a"))


def token_pairs(sets: DataFrame, marks: DataFrame, threshold: float) -> DataFrame:
    """Pairs (b, a, d, one) of sets that meet at a token of their prefixes and pass the filters, b with a later document and not of marks.

    Two sets of one document are a pair either way. Of the smaller set a shorter prefix is enough, as it shares more than
    a set of its size must share with a smaller one."""
    # Done sets have a negative n.
    state = sets.join(marks, "set", "left").withColumn("n", F.when(F.col("done"), -F.col("n")).otherwise(F.col("n")))
    flat = state.select("set", F.col("first.doc_id").alias("doc"), "n", "skip", "p0", "p1", "prefix", F.posexplode("prefix").alias("i", "token"))
    every = flat.select("token", F.when(F.col("i") > 0, F.get("prefix", F.col("i") - 1)).alias("before"), "set", "doc", "n", (F.col("i") + F.col("skip")).alias("i"), "p0", "p1")
    # Both sides of the join read the same rows, so their exchange is made once: a filter that is not deterministic stays behind it.
    every = every.filter("token is not null and n is not null").repartition("token")
    n = F.abs("n")
    y = every.filter(F.when(F.spark_partition_id() >= 0, n - F.col("i") >= needed(n, n, threshold))).alias("y")
    x = every.alias("x")
    c, d = ({k: F.col(f"{s}.{k}") for k in ("set", "doc", "before", "n", "i", "p0", "p1")} for s in "xy")
    open_c, open_d = c["n"] > 0, d["n"] > 0
    c["n"], d["n"] = F.abs(c["n"]), F.abs(d["n"])
    larger = (c["n"] > d["n"]) | ((c["n"] == d["n"]) & (c["set"] > d["set"]))
    reach = F.least(c["n"] - c["i"], d["n"] - d["i"]) >= needed(c["n"], d["n"], threshold)
    some = F.when(c["doc"] == d["doc"], open_c | open_d).when(c["doc"] > d["doc"], open_c).otherwise(open_d)
    fits = (F.col("x.token") == F.col("y.token")) & larger & reach & may_match(c, d, threshold) & F.coalesce(c["before"] != d["before"], F.lit(True)) & some
    way = lambda later, b, a, is_open: F.when(later & is_open, F.struct(b["set"].alias("b"), a["set"].alias("a")))
    ways = F.array_compact(F.array(way(c["doc"] >= d["doc"], c, d, open_c), way(d["doc"] >= c["doc"], d, c, open_d)))
    return x.join(y, fits).select(F.explode(ways).alias("p"), differing(c, d).alias("d"), (c["doc"] == d["doc"]).alias("one")).select("p.b", "p.a", "d", "one").distinct()


def removed_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, line) of the lines to remove, numbered from 0."""
    lines = stored(line_sets(docs, rarity(docs), threshold), "lines")
    sets = lines.groupBy("set").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("f"), *(F.first(c).alias(c) for c in ("n", "skip", "least", "p0", "p1", "prefix")))
    sets = stored(sets, "line-sets")
    done = matched(docs, sets, hub_pairs(sets, threshold), threshold, several=False)
    marks = done.withColumn("done", F.lit(True))
    if done.count() <= BROADCAST:
        marks = F.broadcast(marks)

    pairs = token_pairs(sets, marks, threshold)
    done = done.unionByName(matched(docs, sets, pairs, threshold)).withColumn("done", F.lit(True))
    known = sets.select("set", "first", "f").join(done, "set", "left").filter("f > 1 or done").drop("f")
    return lines.select("doc_id", "line", "set").join(known, "set").filter(F.col("done") | (F.struct("doc_id", "line") > F.col("first"))).select("doc_id", "line").distinct()


def dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the removed lines; n_chars, if there, counted anew."""
    lost, key = free(docs, "gone", "of_id")
    gone = removed_lines(docs, threshold).groupBy("doc_id").agg(F.collect_set("line").alias(lost)).withColumnRenamed("doc_id", key)
    out = docs.join(gone.hint("shuffle_hash"), docs["doc_id"] == gone[key], "left").drop(key)
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(lost, i)), "\n")
    out = out.withColumn("text", F.when(F.col(lost).isNull(), F.col("text")).otherwise(kept))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(lost).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir).select("doc_id", "text")
    gone = removed_lines(docs).groupBy("doc_id").agg(F.count("*").alias("n_removed"), F.array_join(F.transform(F.array_sort(F.collect_set("line")), lambda x: x.cast("string")), ",").alias("removed"))
    n = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n"))).cast("long")
    return docs.select("doc_id", n.alias("n_lines")).join(gone, "doc_id", "left").select("doc_id", "n_lines", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("removed", F.lit("")).alias("removed"))
