"""Approximate nearest neighbours by additive quantisation.

A vector is coded as the sum of one full-dimensional codeword of each codebook.
The codebooks are fitted on a bounded sample (SAMPLE rows, those with the
smallest hash of id): k-means on residuals gives the start, then rounds of
beam-search encoding and least squares over all codebooks. Every row is coded
by beam search and stored as codes, the norm of its reconstruction and its own
norm. Rows of equal vectors share a code; the first k + 1 of them, by id, stand
for all, since no query returns more. Codes and norms alone are dealt out, to
tasks that hold some queries each. A query sums, over lookup tables of query
times codeword, the score of every code, corrected by the stored norms. The
SHORT best codes of a query are then joined to their original vectors and
scored exactly.

Cases: as for the exact search; zero vectors take no part either; a sample
smaller than a codebook gives smaller codebooks; rows of one id, queries or
candidates, each count once; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, stored
from .topk import GROUP_ROWS, best, gathered, ranked, valid

SAMPLE, BOOKS, WORDS, BEAM, ROUNDS, SHORT, BLOCK = 6000, 16, 256, 6, 3, 400, 16_384
#: Queries of a task, which holds their tables (16 KB each) and lists.
HELD = 2048


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (rows, books). The beam keeps the codeword sums nearest to x; distances come from products with x and between codewords."""
    m, k, d = books.shape
    out = np.zeros((len(x), m), np.int64)
    for a in range(0, len(x), 512):
        part = x[a : a + 512].astype(np.float32)
        rows = np.arange(len(part))[:, None]
        codes = np.zeros((len(part), 1, 0), np.int64)
        sums = np.zeros((len(part), 1, d), np.float32)
        cost = np.zeros((len(part), 1), np.float32)
        for j in range(m):
            book = books[j].astype(np.float32)
            # ||x - s - c||^2 = ||x - s||^2 + ||c||^2 - 2 (x - s) c
            more = (book * book).sum(1) - 2 * (part[:, None, :] - sums) @ book.T
            total = (cost[:, :, None] + more).reshape(len(part), -1)
            w = min(beam if j < m - 1 else 1, total.shape[1])
            at = np.argpartition(total, w - 1, axis=1)[:, :w]
            cost = total[rows, at]
            codes = np.concatenate([codes[rows, at // k], (at % k)[:, :, None]], axis=2)
            sums = sums[rows, at // k] + book[at % k]
        out[a : a + 512] = codes[:, 0]
    return out


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[j][codes[:, j]] for j in range(books.shape[0]))


def fit(x: np.ndarray, n_books: int = BOOKS, words: int = WORDS, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = max(1, min(words, len(x)))
    rest, books = x.copy(), []
    for _ in range(n_books):
        c = kmeans(rest, k, rng)
        near = np.argmin((c * c).sum(1) - 2 * rest @ c.T, axis=1)
        rest = rest - c[near]
        books.append(c)
    books = np.array(books)
    for _ in range(rounds):
        codes = encode(x, books)
        cols = codes + np.arange(n_books) * k
        gram, right = np.zeros((n_books * k, n_books * k)), np.zeros((n_books * k, x.shape[1]))
        for i in range(n_books):
            np.add.at(right, cols[:, i], x)
            for j in range(n_books):
                np.add.at(gram, (cols[:, i], cols[:, j]), 1.0)
        fitted = np.linalg.solve(gram + np.eye(len(gram)) * 0.1, right + 0.1 * books.reshape(-1, x.shape[1]))
        books = fitted.reshape(books.shape)
    return books


@functools.lru_cache(4)
def _fit_once(sample: bytes, width: int) -> np.ndarray:
    return fit(np.frombuffer(sample, np.float64).reshape(-1, width))


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, same, code, scale) of rows (id, v): same is a hash of the vector, scale its norm over the norm of its reconstruction."""
    packed = pickle.dumps(books)

    def run(batches):
        cb = pickle.loads(packed)
        for b in batches:
            vs = b.column(2).to_numpy(zero_copy_only=False)
            wide = np.zeros((len(vs), cb.shape[2]))
            for r, v in zip(wide, vs, strict=True):
                r[: len(v)] = v[: len(r)]
            codes = encode(wide, cb)
            norm = np.linalg.norm(decode(codes, cb), axis=1)
            own = np.array([np.linalg.norm(v) for v in vs])
            scale = np.where(norm > 0, own / np.maximum(norm, 1e-30), 1.0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary()), pa.array(scale)], ["id", "same", "code", "scale"])

    return rows.select("id", F.xxhash64("v").alias("same"), "v").mapInArrow(run, "id long, same long, code binary, scale double")


def code_blocks(classes: DataFrame, size: int = BLOCK) -> DataFrame:
    """Classes (id, code, scale) in blocks of ids, codes and scales as binary."""

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, size):
                part = b.slice(a, size)
                ids = part.column(0).to_numpy().astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()]), pa.array([b"".join(part.column(1).to_pylist())]), pa.array([part.column(2).to_numpy().astype(np.float32).tobytes()])], ["ids", "codes", "scales"])

    return classes.select("id", "code", "scale").mapInArrow(run, "ids binary, codes binary, scales binary")


def short_lists(queries: DataFrame, classes: DataFrame, books: np.ndarray, short: int) -> DataFrame:
    """(query_id, id), each once: the `short` best classes of each query by the lookup tables, ties to the smaller id.

    Queries are dealt out by id and hold their lists while the codes pass, so each gives its list once, whatever the number
    of codes. Only queries that are too few to keep all cores busy meet the codes in several tasks."""
    packed, width = pickle.dumps(books), books.shape[2]
    nq, n, tasks = queries.count(), classes.count(), 2 * queries.sparkSession.sparkContext.defaultParallelism
    dealt = max(1, -(-nq // HELD), min(2 * tasks, nq // 32))
    split = max(1, min(-(-tasks // dealt), n // GROUP_ROWS))
    number = lambda c, k: F.pmod(F.xxhash64(F.lit(7), c), F.lit(k)).cast("int")
    q = queries.select("id", "v", number("id", dealt).alias("mine"), F.lit(0).alias("code"))
    q = q.withColumn("group", F.explode(F.sequence(F.col("mine") * split, F.col("mine") * split + (split - 1))))
    c = code_blocks(classes).withColumn("code", F.lit(1))
    c = c.withColumn("group", F.explode(F.transform(F.sequence(F.lit(0), F.lit(dealt - 1)), lambda x: x * split + number("ids", split))))
    columns = ["group", "code", "id", "v", "ids", "codes", "scales"]
    both = q.drop("mine").unionByName(c, allowMissingColumns=True).select(*columns).repartition(dealt * split, "group").sortWithinPartitions("group", "code")

    def tables_of(vectors, cb):
        out = np.zeros((len(vectors), cb.shape[0] * cb.shape[1]), np.float32)
        for a in range(0, len(vectors), 256):
            part = np.zeros((len(vectors[a : a + 256]), width))
            for r, v in zip(part, vectors[a : a + 256], strict=True):
                r[: len(v)] = v[:width]
            out[a : a + 256] = np.einsum("qd,mkd->qmk", part, cb, optimize=True).reshape(len(part), -1)
        return out

    def run(batches):
        cb = pickle.loads(packed)
        group, qids, vectors, tables, lists = None, [], [], None, []

        def out():
            found: dict[int, list] = {}
            for i, (ids, got) in zip(qids, lists, strict=False):
                found.setdefault(i, []).append((ids, got))
            # Rows of one id share a list, in which no id comes twice.
            rows = []
            for i, parts in found.items():
                ids, got = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.lexsort((-got, ids))
                first = order[np.concatenate([[True], ids[order][1:] != ids[order][:-1]])] if len(ids) else order
                rows.append((i, ids[first], got[first].astype(np.float64)))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in gathered(rows)], ["query_id", "vec_id", "score"])

        for b in batches:
            for k in range(b.num_rows):
                at, code = b.column(0)[k].as_py(), b.column(1)[k].as_py()
                if at != group:
                    if lists:
                        yield out()
                    group, qids, vectors, tables, lists = at, [], [], None, []
                if not code:
                    qids.append(b.column(2)[k].as_py())
                    vectors.append(b.column(3)[k].values.to_numpy())
                elif qids:
                    if tables is None:
                        tables, vectors = tables_of(vectors, cb), []
                        lists = [(np.zeros(0, np.int64), np.zeros(0, np.float32))] * len(qids)
                    ids = np.frombuffer(b.column(4)[k].as_py(), np.int64)
                    codes = np.frombuffer(b.column(5)[k].as_py(), np.uint8).reshape(len(ids), cb.shape[0])
                    flat = (codes.astype(np.int64) + np.arange(cb.shape[0]) * cb.shape[1]).T.copy()
                    scale = np.frombuffer(b.column(6)[k].as_py(), np.float32)
                    for j, table in enumerate(tables):
                        found = table[flat[0]]
                        for part in flat[1:]:
                            found += table[part]
                        found *= scale
                        mine, got = lists[j]
                        if len(got) == short:
                            near = np.flatnonzero(found >= got.min())
                            if not len(near):
                                continue
                            mine, got = np.concatenate([mine, ids[near]]), np.concatenate([got, found[near]])
                        else:
                            mine, got = np.concatenate([mine, ids]), np.concatenate([got, found])
                        best_at = best(got, mine, short)
                        lists[j] = mine[best_at], got[best_at]
        if lists:
            yield out()

    found = both.mapInArrow(run, "query_id long, vec_id long, score double")
    if split > 1:
        found = ranked(found, short).dropDuplicates(["query_id", "vec_id"])
    return found.select("query_id", F.col("vec_id").alias("id"))


def inner(pairs: DataFrame) -> DataFrame:
    """pairs (query_id, ids, q, v) to (query_id, vec_id, score), for each of ids but the query's own."""

    def run(batches):
        for b in batches:
            qid, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
            out = []
            for i, those, q, v in zip(qid, ids, b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False), strict=True):
                w = min(len(q), len(v))
                x = float(np.dot(q[:w], v[:w]))
                out += [(i, j, x) for j in those if j != i]
            columns = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    return pairs.select("query_id", "ids", "q", "v").mapInArrow(run, "query_id long, vec_id long, score double")


def ann_search(queries: DataFrame, candidates: DataFrame, k: int = 20, short: int = SHORT, sample: int = SAMPLE) -> DataFrame:
    """Both (id, v); the k nearest found by inner product."""
    got = candidates.orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(sample).collect()
    width = max((len(r["v"]) for r in got), default=1)
    x = np.zeros((len(got), width))
    for row, r in zip(x, got, strict=True):
        row[: len(r["v"])] = r["v"]
    books = _fit_once(x.tobytes(), width) if got else np.zeros((1, 1, 1))
    with scratch(queries.sparkSession):
        index = stored(coded(candidates, books), "codes")
        # A class of equal vectors has k + 1 ids at most, whatever the number of its copies.
        nth = F.row_number().over(Window.partitionBy("same").orderBy("id"))
        first = index.withColumn("nth", nth).filter(F.col("nth") <= k + 1)
        classes = first.groupBy("same").agg(F.min("id").alias("id"), F.array_sort(F.collect_list("id")).alias("ids"), F.min_by("code", "id").alias("code"), F.min_by("scale", "id").alias("scale"))
        classes = stored(classes.select("id", "same", "ids", "code", "scale"), "classes")
        near = short_lists(queries, classes, books, short)
        originals = candidates.select("id", F.xxhash64("v").alias("same"), "v").dropDuplicates(["id", "same"])
        vectors = classes.select("id", "same", "ids").join(originals, ["id", "same"]).drop("same")
        pairs = near.join(vectors, "id").join(queries.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
        return stored(ranked(inner(pairs), k), "nearest", outer=True)


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = valid(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding", "vec_id", not_zero=True)
    return ann_search(rows.filter("id % 20 = 0"), rows)
