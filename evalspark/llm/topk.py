"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors are cut into segments; per segment the mean and the deviation are
kept at two resolutions.  Within a segment of length L an inner product is at
most ``L * (mean_q * mean_c + dev_q * dev_c)`` (so a squared distance is at
least ``L * ((mean_q - mean_c)^2 + (dev_q - dev_c)^2)``); summed over the
segments this bounds the score from above.  Candidates that cannot reach a
query's k-th best score so far are dropped by the coarse bound, then by the
fine one, and only the survivors' exact integer scores are computed.

At scale: candidates are dealt by a hash of their id into blocks of about
``BLOCK`` rows, one binary row each, and queries into blocks of their own.
Every query first meets its own block, which gives it a threshold; then each
pair of a query block and a candidate block is one bounded group, dealt over
all tasks.  A pair returns at most k rows per query, and the best k are
ranked per query.  No block depends on how often a vector occurs.

Defined results: vectors that are null or hold a null or non-finite component,
and rows with a null id, take no part; rows that repeat an id are one vector,
the smallest in array order; vectors meet those of their own length only;
equal scores go to the smaller id; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm import common

K = 5
BLOCK = 2048                 # candidates per block, on average
QUERY_BLOCKS = 25            # candidate blocks whose queries make one query block
SEGMENTS = (4, 16)           # segments of the coarse and the fine statistics
FIRST_LOOKS = 4              # times k candidates whose exact scores set a first threshold


def integers(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` per component; null where the vector takes no part."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~odd, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def segment_statistics(m: np.ndarray, segments: int) -> np.ndarray:
    """Rows of means and deviations, weighed so that inner products of rows bound those of the vectors."""
    n = m.shape[1]
    at = np.unique(np.linspace(0, n, min(segments, n) + 1).astype(int))[:-1]
    length = np.diff(np.append(at, n)).astype(np.float64)
    x = m.astype(np.float64)
    mean = np.add.reduceat(x, at, axis=1) / length
    dev = np.sqrt(np.maximum(np.add.reduceat(x * x, at, axis=1) / length - mean * mean, 0.0))
    return np.concatenate([mean, dev], axis=1) * np.sqrt(np.concatenate([length, length]))


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", q, c)


def best_pairs(qids: np.ndarray, q: np.ndarray, floor: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int):
    """``(query index, id, score)`` arrays of the k best candidates of each query that reach its ``floor``."""
    none = np.empty(0, np.int64)
    if not len(qids) or not len(ids):
        return none, none, none
    if q.shape[1]:
        bound = segment_statistics(q, SEGMENTS[0]) @ segment_statistics(c, SEGMENTS[0]).T
        norms = [np.linalg.norm(m.astype(np.float64), axis=1) for m in (q, c)]
        slack = 1e-9 * norms[0] * norms[1].max() + 1e-6          # rounding of the bounds
    else:
        bound, slack = np.zeros((len(q), len(c))), np.zeros(len(q))
    bound = np.where(qids[:, None] == ids[None, :], -np.inf, bound)
    # Exact scores of the candidates with the largest coarse bounds lift the floor.
    look = min(len(ids), FIRST_LOOKS * k)
    first = np.argpartition(-bound, look - 1, axis=1)[:, :look]
    rows = np.repeat(np.arange(len(q)), look)
    scores = _exact(q[rows], c[first.ravel()]).reshape(len(q), look).astype(np.float64)
    scores[np.take_along_axis(bound, first, axis=1) == -np.inf] = -np.inf
    if look >= k:
        floor = np.maximum(floor, -np.partition(-scores, k - 1, axis=1)[:, k - 1])
    i, j = np.nonzero((bound + slack[:, None] >= floor[:, None]) & (bound > -np.inf))
    if q.shape[1] > SEGMENTS[0]:
        fine_q, fine_c = segment_statistics(q, SEGMENTS[1]), segment_statistics(c, SEGMENTS[1])
        keep = np.concatenate([_exact(fine_q[i[a:a + 65536]], fine_c[j[a:a + 65536]]) + slack[i[a:a + 65536]] >= floor[i[a:a + 65536]]
                               for a in range(0, len(i), 65536)] or [np.empty(0, bool)])
        i, j = i[keep], j[keep]
    score = np.concatenate([_exact(q[i[a:a + 65536]], c[j[a:a + 65536]]) for a in range(0, len(i), 65536)] or [none])
    order = np.lexsort((ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    top = rank < k
    return i[top], ids[j[top]], score[top]


_BLOCK_TYPE = "dim int, block long, ids binary, vectors binary, query_ids binary, queries binary, floors binary"


def _pack(every: int, k: int):
    def run(table: pa.Table) -> pa.Table:
        dim, block = table.column("dim")[0].as_py(), table.column("block")[0].as_py()
        ids = table.column("vec_id").to_numpy().astype(np.int64)
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        m = flat.astype(np.int64).reshape(len(ids), dim)
        own = ids % every == 0
        floors = np.full(own.sum(), -np.inf)
        i, _, score = best_pairs(ids[own], m[own], floors, ids, m, k)
        counts = np.bincount(i, minlength=len(floors))
        full = counts >= k
        floors[full] = score[np.cumsum(counts)[full] - 1]
        parts = [ids, m, ids[own], m[own], floors]
        return pa.table([pa.array([dim], pa.int32()), pa.array([block], pa.int64()), *[pa.array([p.tobytes()], pa.binary()) for p in parts]],
                        names=["dim", "block", "ids", "vectors", "query_ids", "queries", "floors"])

    return run


def _gather(table: pa.Table) -> pa.Table:
    names = ["query_ids", "queries", "floors"]
    joined = [pa.array([b"".join(table.column(n).to_pylist())], pa.binary()) for n in names]
    return pa.table([table.column("dim").slice(0, 1).combine_chunks(), table.column("query_block").slice(0, 1).combine_chunks(), *joined],
                    names=["dim", "query_block", *names])


def _search(k: int):
    def run(blocks: pa.Table, queries: pa.Table) -> pa.Table:
        found = ([], [], [])
        for b in blocks.to_pylist():
            for x in queries.to_pylist():
                dim, qids, ids = b["dim"], np.frombuffer(x["query_ids"], np.int64), np.frombuffer(b["ids"], np.int64)
                q = np.frombuffer(x["queries"], np.int64).reshape(len(qids), dim)
                c = np.frombuffer(b["vectors"], np.int64).reshape(len(ids), dim)
                i, to, score = best_pairs(qids, q, np.frombuffer(x["floors"], np.float64), ids, c, k)
                for out, part in zip(found, (qids[i], to, score), strict=True):
                    out.append(part)
        columns = [pa.array(np.concatenate(f) if f else np.empty(0, np.int64), pa.int64()) for f in found]
        return pa.table(columns, names=["query_id", "vec_id", "score"])

    return run


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def search(vectors: DataFrame, every: int, k: int = K, block_rows: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of all rows for each row whose ``vec_id`` is divisible by ``every``.

    ``vectors``: ``vec_id`` and ``v`` (array of longs, null where it takes no part).
    """
    valid = vectors.select("vec_id", "v").filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    once = valid.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("v").alias("v"))
    n_blocks = max(1, -(-valid.count() // block_rows))
    dealt = once.select("vec_id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).alias("block"))
    blocks = common.staged(dealt.groupBy("dim", "block").applyInArrow(_pack(every, k), _BLOCK_TYPE), "vector-blocks")
    n_query_blocks = -(-n_blocks // QUERY_BLOCKS)
    queries = (blocks.select("dim", F.floor(F.col("block") / QUERY_BLOCKS).alias("query_block"), "query_ids", "queries", "floors")
               .filter(F.length("query_ids") > 0).groupBy("dim", "query_block")
               .applyInArrow(_gather, "dim int, query_block long, query_ids binary, queries binary, floors binary"))
    left = blocks.select("dim", "block", "ids", "vectors", F.explode(_numbers(n_query_blocks)).alias("query_block"))
    right = queries.select("*", F.explode(_numbers(n_blocks)).alias("block"))
    key = ("dim", "block", "query_block")
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
