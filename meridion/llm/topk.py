"""Exhaustive exact top-k search by term-at-a-time accumulation.

Rows are sparse integer vectors. Candidates are dealt out to groups of blocks;
a group keeps, for each block and term (component), its postings: the rows that
have the term and their weights. The queries, in blocks too, are sent to every
group and stream past its postings. A query row takes its terms one at a time
and scatters query weight times posting weight into a dense score array over
the block. The k best are then partitioned off and merged over the blocks of
the group, and the groups' lists are merged by rank. A task holds the postings
of one group and one block of queries.

Cases: rows with a null id or vector, or null or non-finite components, take
no part; vectors may differ in length (a missing component is zero); ties go
to the smaller id; repeated ids are separate candidates, except that a query
never returns its own id; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a block of candidates or queries, and of the candidates of a task.
BLOCK, QUERY_BLOCK, GROUP_ROWS = 4096, 256, 65_536
#: Types that hold components, the smallest first.
KINDS = ("int8", "int16", "int32", "float64")


def valid(df: DataFrame, vector: str, key: str, not_zero: bool = False) -> DataFrame:
    """key as id (long) and vector as v (array of double), without the rows that take no part."""
    v = F.col(vector).cast("array<double>")
    good = F.col(key).isNotNull() & v.isNotNull() & F.forall(F.coalesce(v, F.array().cast("array<double>")), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if not_zero:
        good &= F.exists(v, lambda x: x != 0)
    return df.filter(good).select(F.col(key).cast("long").alias("id"), v.alias("v"))


def packed(m: np.ndarray) -> tuple[bytes, str]:
    """A matrix in the smallest of KINDS that holds it."""
    top = np.abs(m).max(initial=0)
    whole = top < 2**31 - 1 and (m == np.floor(m)).all()
    kind = next(k for k in KINDS if k == "float64" or whole and top <= np.iinfo(k).max)
    return m.astype(kind).tobytes(), kind


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (id, v) in blocks: ids and a row-major matrix as binary, its width and type. Blocks never join partitions, so none outgrows its size."""

    def run(batches):
        held: list[tuple] = []

        def out():
            ids = np.array([i for i, _ in held], np.int64)
            m = np.zeros((len(held), max((len(v) for _, v in held), default=0)))
            for r, (_, v) in zip(m, held, strict=True):
                r[: len(v)] = v
            order = np.argsort(ids, kind="stable")
            data, kind = packed(m[order])
            return pa.RecordBatch.from_arrays([pa.array([ids[order].tobytes()]), pa.array([data], pa.binary()), pa.array([m.shape[1]], pa.int64()), pa.array([kind])], ["ids", "m", "width", "kind"])

        for b in batches:
            for row in zip(b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False), strict=True):
                held.append(row)
                if len(held) == size:
                    yield out()
                    held = []
        if held:
            yield out()

    return rows.mapInArrow(run, "ids binary, m binary, width long, kind string")


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(row["ids"], np.int64)
    return i, np.frombuffer(row["m"], row["kind"]).reshape(len(i), row["width"]).astype(np.float64)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores, ties to the smaller id, best first."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        over = np.flatnonzero(score > least)
        at = np.flatnonzero(score == least)
        if len(at) > k - len(over):
            at = at[np.argsort(ids[at], kind="stable")][: k - len(over)]
        score_at = np.concatenate([over, at])
    else:
        score_at = np.arange(len(score))
    return score_at[np.lexsort((ids[score_at], -score[score_at]))]


def groups_of(candidates: DataFrame) -> int:
    """Groups of about GROUP_ROWS candidates, and enough of them to keep all cores busy with blocks of some size."""
    n, cores = candidates.count(), candidates.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-n // GROUP_ROWS), min(2 * cores, n // 2048))


def meet(queries: DataFrame, candidates: DataFrame, groups: int, prepare, score, schema: str, names: list[str]) -> DataFrame:
    """Blocks of queries against all blocks of candidates: score(query block, the prepared blocks of a group) gives columns for each block of queries.

    A block of candidates is in one group and is prepared once; each group reads all queries, one block at a time."""
    c = candidates.withColumn("query", F.lit(0)).withColumn("group", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))
    q = queries.withColumn("query", F.lit(1)).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    both = c.unionByName(q, allowMissingColumns=True).repartition(groups, "group").sortWithinPartitions("group", "query")

    def run(batches):
        held, group = [], None
        for b in batches:
            for k in range(b.num_rows):
                row = {n: b.column(i)[k].as_py() for i, n in enumerate(b.schema.names)}
                if row["group"] != group:
                    group, held = row["group"], []
                if not row["query"]:
                    held.append(prepare(row))
                elif held:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in score(row, held)], names)

    return both.mapInArrow(run, schema)


def gathered(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """(query, ids, scores) of many queries as three columns."""
    ids = np.concatenate([r[1] for r in rows]) if rows else np.zeros(0, np.int64)
    return [np.repeat(np.array([r[0] for r in rows], np.int64), [len(r[1]) for r in rows]), ids, np.concatenate([r[2] for r in rows]) if rows else np.zeros(0)]


def ranked(found: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) to the k best of each query with their rank."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def accumulate(query: np.ndarray, postings: list, n: int, dtype) -> np.ndarray:
    """Dense scores of a block's rows, one term of the query at a time."""
    score = np.zeros(n, dtype)
    for term in np.flatnonzero(query[: len(postings)]):
        rows, weights = postings[term]
        if rows is None:  # every row has the term
            score += dtype(query[term]) * weights
        elif len(rows):
            score[rows] += dtype(query[term]) * weights
    return score


def postings_of(m: np.ndarray) -> list[tuple]:
    """(rows, weights) of each term; rows is None where half of all rows have the term, and the weights are then those of all."""
    out = []
    for t in range(m.shape[1]):
        rows = np.flatnonzero(m[:, t])
        out.append((None, m[:, t].copy()) if len(rows) * 2 >= len(m) else (rows, m[rows, t]))
    return out


def taat_search(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """Both (id, v) with whole-number components; scores are exact integers while they fit a long."""

    def prepare(row):
        ids, m = unpack(row)
        top = int(np.abs(m).max(initial=0))
        return ids, postings_of(m.astype(np.int32 if top < 2**31 else np.int64)), top

    def score(row, held):
        qids, qm = unpack(row)
        out = []
        for q, v in zip(qids, qm, strict=True):
            high = np.abs(v).max(initial=0)
            ids, got = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for block, postings, top in held:
                dtype = np.int32 if high * top * max(1, len(v)) < 2**31 else np.int64
                found = accumulate(v, postings, len(block), dtype)
                at = best(found, block, k + int((block == q).sum()))
                at = at[block[at] != q][:k]
                ids, got = np.concatenate([ids, block[at]]), np.concatenate([got, found[at].astype(np.int64)])
            at = best(got, ids, k)
            out.append((int(q), ids[at], got[at]))
        ids = gathered(out)
        return [*ids[:2], ids[2].astype(np.int64)]

    c = blocks(candidates, BLOCK)
    found = meet(blocks(queries, QUERY_BLOCK), c, groups_of(candidates), prepare, score, "query_id long, vec_id long, score long", ["query_id", "vec_id", "score"])
    return ranked(found, k)


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = valid(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding", "vec_id")
    rows = rows.select("id", F.transform("v", lambda x: F.floor(x * 64).cast("double")).alias("v"))
    return taat_search(rows.filter("id % 20 = 0"), rows)


OP6_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20"""
