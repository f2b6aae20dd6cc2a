"""N-gram Jaccard join by a MinHash LSH forest.

A text is the set of its five-word shingles (lower case, cut at white space; a
shorter text is one shingle). Texts with equal sets form a class. Each of TREES
trees holds a signature of every class: DEPTH MinHash values, a byte each, the
first on top, so that sorted signatures are a prefix trie and the shared prefix
of neighbours in the order is the depth at which their branches part. Matching
begins at the full depth, and a class's prefix is shortened level by level
while a link that the class may have would be found with less than the target
chance. The levels it takes depend on the least similarity, from the threshold
on, that its number of shingles allows; a class that can have no link enters no
tree. At each level a class is tied to the nearest one before it in the order
that is there at that level.

Tied classes are a part; each part is cut into blocks, and every pair of blocks
is verified exactly in a task of its own, so that neither a group nor its pairs
ever meet in one place. A task returns counts and a spanning forest of its
links instead of the pairs.

Cases: texts without words (null, empty) link to nothing and are classes of
their own; rows with a null doc_id take no part; repeated rows and copies are
one class, whose id is its least doc_id; rows of one doc_id with different
texts are in different classes; texts of any length are read whole; an empty
table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import docs_of, mix64, stored, trim
from .components import components

WORDS, THRESHOLD, TREES, DEPTH, RECALL = 5, 0.8, 32, 8, 0.9999
#: Sizes of sets from which the least similarity is taken to be the threshold.
SIZES = 64
BLOCK = 192
#: Bits, in words of 64, of the table by which a text's set is left out.
FILTER_BITS = 1 << 25
#: Words whose hashes a task keeps.
KNOWN = 100_000
#: Rows of pairs of blocks in a task.
ROWS = 4 * BLOCK
FACTORS = mix64(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)


def least_similarity(n: int, threshold: float = THRESHOLD) -> float | None:
    """The least similarity, from the threshold on, of a set of n shingles and a different one (None: there is no such)."""
    sizes = range(math.ceil(threshold * n - 1e-9), math.floor(n / threshold + 1e-9) + 1)
    every = (o / (n + m - o) for m in sizes for o in range(1, min(n, m) + 1) if o < max(n, m))
    return min((x for x in every if x >= threshold - 1e-9), default=None)


def levels(n: int, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int | None:
    """The depth at which a class of n shingles stops shortening its prefixes: the deepest at which the target recall is reached."""
    x = least_similarity(n, threshold) if n < SIZES else threshold
    if x is None:
        return None
    while depth > 1 and 1 - (1 - x**depth) ** trees < recall:
        depth -= 1
    return depth


class Shingler:
    """Sorted distinct 64-bit hashes of the shingles of a text; hashes of words are kept."""

    def __init__(self, n: int = WORDS):
        import xxhash

        self.n, self.hash, self.known = n, xxhash.xxh64_intdigest, {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > KNOWN:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = self.hash(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(h))
        with np.errstate(over="ignore"):
            out = np.zeros(len(h) - n + 1, np.uint64)
            for k in range(n):
                out += h[k : len(h) - n + 1 + k] * FACTORS[k]
        return np.unique(mix64(out + np.uint64(n)))


@functools.lru_cache(4)
def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(29)
    return rng.integers(0, 2**32, n, np.uint32) | np.uint32(1), rng.integers(0, 2**32, n, np.uint32)


def signatures(shingles: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> np.ndarray:
    """A long for each tree: the low bytes of its MinHash values, the first on top."""
    a, b = permutations(trees * depth)
    low = np.full(trees * depth, 2**32 - 1, np.uint32)
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(h), 256):
        x = np.multiply.outer(h[i : i + 256], a)
        x += b
        np.minimum(low, x.min(axis=0), out=low)
    # The least of multiplicative hashes has its high bits near zero; mixed, its low byte is even.
    part = mix64(low.astype(np.uint64)).astype(np.uint8).reshape(trees, depth)
    return np.ascontiguousarray(np.pad(part, ((0, 0), (0, 8 - depth)))).view(">i8").ravel().astype(np.int64)


def sketched(docs: DataFrame, threshold: float, recall: float) -> DataFrame:
    """doc_id, a 128-bit hash of the set (hi, lo; null without words), the depth to which its prefixes are shortened (null: it can have no link), signatures and the set itself."""
    fields = "doc_id long, hi long, lo long, floor int, signatures array<long>, shingles binary"

    def run(batches):
        trim()
        shingle, floors = Shingler(), {}
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingle(t or "")
                if len(s):
                    n = min(len(s), SIZES)
                    if n not in floors:
                        floors[n] = levels(n, threshold, recall=recall)
                    with np.errstate(over="ignore"):
                        rows.append((i, int(np.bitwise_xor.reduce(mix64(s)).view(np.int64)), int(mix64(s * np.uint64(3) + np.uint64(len(s))).sum(dtype=np.uint64).view(np.int64)), floors[n], signatures(s) if floors[n] else None, s.tobytes()))
                else:
                    rows.append((i, None, None, None, None, b""))
                if len(rows) >= 200:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)
        shingle.known.clear()
        trim()

    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, fields)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "hi", "lo", "floor", "signatures", "shingles"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def forest(classes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """classes (cid, floor, signatures) to ties (a, b, depth): a class and the nearest before it in a tree's order, at each level that both are at.

    A tree's rows are dealt by the shortest prefix that any class may come to, under which all its matches lie."""
    levels_ = classes.agg(F.min("floor")).first()[0]
    lowest = levels_ if levels_ is not None else depth
    rows = classes.select("cid", "floor", F.posexplode("signatures").alias("tree", "signature"))
    cut = lambda c, k: F.shiftrightunsigned(c, 8 * (8 - k)) if k < 8 else c
    order = Window.partitionBy("tree", cut(F.col("signature"), lowest)).orderBy("signature", "cid").rowsBetween(Window.unboundedPreceding, -1)
    ties = []
    for k in range(lowest, depth + 1):
        last = F.last(F.when(F.col("floor") <= k, F.struct("cid", "signature")), ignorenulls=True).over(order)
        meets = (F.col("floor") <= k) & (cut(last["signature"], k) == cut(F.col("signature"), k))
        ties.append(F.when(meets, F.struct(F.col("cid").alias("a"), last["cid"].alias("b"), F.lit(k).alias("depth"))))
    return rows.select(F.array_compact(F.array(*ties)).alias("ties")).select(F.explode("ties").alias("t")).select("t.*")


def overlaps(a: list[np.ndarray], b: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of each set of a with each of b."""
    out = np.zeros((len(a), len(b)), np.int64)
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(flat_a, flat_b)
    if not len(shared):
        return out

    def cells(sets, flat):
        row = np.repeat(np.arange(len(sets)), list(map(len, sets)))
        at = np.minimum(np.searchsorted(shared, flat), len(shared) - 1)
        hit = shared[at] == flat
        order = np.argsort(at[hit], kind="stable")
        return row[hit][order], at[hit][order]

    (ra, ca), (rb, cb) = cells(a, flat_a), cells(b, flat_b)
    for start in range(0, len(shared), width):
        m = []
        for rows, cols, n in ((ra, ca, len(a)), (rb, cb, len(b))):
            x, y = np.searchsorted(cols, [start, start + width])
            d = np.zeros((n, min(width, len(shared) - start)), np.float32)
            d[rows[x:y], cols[x:y] - start] = 1
            m.append(d)
        out += (m[0] @ m[1].T).astype(np.int64)
    return out


def linked(ids_a: list[int], a: list[np.ndarray], ids_b: list[int], b: list[np.ndarray], threshold: float) -> np.ndarray:
    both = overlaps(a, b)
    size = np.array(list(map(len, a)))[:, None] + np.array(list(map(len, b)))[None]
    return (both >= threshold * (size - both) - 1e-9) & (np.array(ids_a)[:, None] != np.array(ids_b)[None])


def verify(rows: DataFrame, threshold: float) -> DataFrame:
    """rows (part, i, j, block, cid, shingles), ordered by part, i, j: (cid, links, root) for each row of each pair of blocks."""

    def flush(i, j, held, out):
        mine = {k: [(c, s) for blk, c, s in held if blk == k] for k in (i, j)}
        (ia, sa), (ib, sb) = (zip(*mine[k], strict=True) if mine[k] else ((), ()) for k in (i, j))
        if not ia or not ib or (i == j and len(ia) < 2):
            return
        hit = linked(ia, sa, ib, sb, threshold)
        # Labels of the pair of blocks, made equal along links.
        la, lb = np.array(ia), np.array(ib)
        while True:
            na = np.minimum(la, np.where(hit, lb[None], np.iinfo(np.int64).max).min(axis=1))
            nb = na if i == j else np.minimum(lb, np.where(hit, na[:, None], np.iinfo(np.int64).max).min(axis=0))
            if (na == la).all() and (nb == lb).all():
                break
            la, lb = na, nb
        out += zip(ia, hit.sum(axis=1).tolist(), la.tolist(), strict=True)
        if i != j:
            out += zip(ib, hit.sum(axis=0).tolist(), lb.tolist(), strict=True)

    def run(batches):
        def each():
            for b in batches:
                yield from zip(*[b.column(k).to_pylist() for k in range(6)], strict=True)

        out: list = []
        for (_, i, j), group in itertools.groupby(each(), key=lambda r: r[:3]):
            flush(i, j, [(r[3], r[4], np.frombuffer(r[5], np.uint64)) for r in group], out)
            if len(out) > 20_000:
                yield _found(out)
                out = []
        if out:
            yield _found(out)

    return rows.select("part", "i", "j", "block", "cid", "shingles").mapInArrow(run, "cid long, links long, root long")


def _found(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["cid", "links", "root"])


def candidates(rows: DataFrame, part: DataFrame) -> DataFrame:
    """Those of rows (cid, ..) whose bit is set in a table of FILTER_BITS, which holds a bit for each cid of part and is broadcast. All cids of part pass."""
    at = F.pmod(F.col("cid"), F.lit(FILTER_BITS))
    words = part.select(F.floor(at / 64).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    kept = rows.withColumn("word", F.floor(at / 64)).join(F.broadcast(words), "word")
    return kept.filter(F.call_function("shiftright", "bits", (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1).select(*rows.columns)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_copies, n_links, group_id): n_copies is the class's rows, n_links its links to other classes, group_id the least doc_id of its linked classes.

    Inside, a class is known by the upper half of its hash (cid)."""
    sets = stored(sketched(docs, threshold, recall), "sets")
    full = sets.filter("hi is not null")
    members = stored(full.groupBy("hi", "lo").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_copies"), F.max("floor").alias("floor")), "classes")
    # Copies have equal signatures, so any one of them stands for its class.
    classes = full.filter("floor is not null").groupBy(F.col("hi").alias("cid")).agg(F.max("floor").alias("floor"), *(F.min_by(c, "doc_id").alias(c) for c in ("signatures",)))
    part = stored(components(forest(classes).select("a", "b").distinct()).select(F.col("node").alias("cid"), F.col("root").alias("part")), "parts")
    size = part.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks"))
    placed = part.join(size, "part").withColumn("block", F.pmod(F.xxhash64(F.lit(5), "cid"), F.col("n_blocks")).cast("int"))
    # A row of the class for each pair of blocks that its own is in.
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select("part", "block", "cid", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    # One row of a class gives its set; a filter of fixed size leaves out most classes without ties before any set is dealt out, the join with pairs the others.
    texts = candidates(full.select(F.col("hi").alias("cid"), "shingles"), part).dropDuplicates(["cid"])
    # Every class meets each block of its part once, so the tasks grow with the rows that they take.
    n = size.agg(F.coalesce(F.sum(F.col("n_blocks") * F.col("n_blocks") * BLOCK), F.lit(0))).first()[0]
    n = int(max(8, docs.sparkSession.sparkContext.defaultParallelism * 2, min(100_000, n // ROWS)))
    rows = texts.join(pairs, "cid").repartition(n, "part", "i", "j").sortWithinPartitions("part", "i", "j")
    found = stored(verify(rows, threshold), "links")
    links = found.groupBy("cid").agg(F.sum("links").alias("n_links"))
    group = components(found.filter("cid <> root").select(F.col("cid").alias("a"), F.col("root").alias("b"))).withColumnsRenamed({"node": "cid", "root": "group"})
    known = members.withColumn("cid", F.col("hi")).join(links, "cid", "left").join(group, "cid", "left")
    known = stored(known.select("hi", "lo", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), "group"), "known")
    named = known.filter("group is not null").groupBy("group").agg(F.min("class_id").alias("group_id"))
    known = known.join(named, "group", "left").select("hi", "lo", "class_id", "n_copies", "n_links", F.coalesce("group_id", "class_id").alias("group_id"))
    out = sets.select("doc_id", "hi", "lo").join(known, ["hi", "lo"], "left")
    alone = lambda c, x: F.coalesce(c, F.lit(x).cast("long") if isinstance(x, int) else F.col(x)).alias(c)
    return out.select("doc_id", alone("class_id", "doc_id"), alone("n_copies", 1), alone("n_links", 0), alone("group_id", "doc_id"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(docs_of(spark, sf_dir))
