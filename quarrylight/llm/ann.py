"""Approximate nearest neighbours with a permutation index (operator 3).

A bounded sample of the vectors serves as pivots. A vector is represented by its `posted` nearest pivots
in order, and is posted with its position under each of them in the pivots' inverted files. Vectors are dealt into
blocks, each with its own inverted files. A query goes to every block: it reads the files of its own nearest
pivots there, adds up the footrule distance (the sum of differences between positions, where a pivot that isn't
posted has the position after the last), and the `rerank` share of the block's vec_ids (10 k at least) that is nearest by footrule, ties
included, is ranked again by exact cosine. A vec_id stands in one block, with its nearest row, and takes one place. The best of all
blocks are merged.

With pivot positions i and j of a common pivot, the footrule falls by 2 (posted - max(i, j)) from its value for
disjoint lists, so one pass over the files gives it for the whole block. With 64 of 1024 pivots posted, a query reads 4
postings for each row of a block.

Queries meet blocks of vectors in groups of bounded size; neither side is broadcast. The measured recall is in
the README.

Defined results: vectors that are null, zero or have null or non-finite components take no part, nor do those
whose number of components isn't the most frequent one, or whose vec_id is null; rows with the same vec_id as the
query aren't candidates; of rows with one vec_id the best counts; equal cosines go to the smaller vec_id; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.llm.common import cut

PIVOTS, POSTED, RERANK = 1024, 64, 0.12
BLOCK, QUERY_BLOCK = 16_384, 1_024
RESULT = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vec (doubles) of the vectors that take part."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = own.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).filter(F.coalesce(finite, F.lit(False)) & F.exists("vec", lambda x: x != 0))
    sizes = kept.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return kept.filter(F.size("vec") == (sizes["dim"] if sizes else 0))


def choose_pivots(vectors: DataFrame, count: int = PIVOTS) -> np.ndarray:
    """`count` different vectors, the first by a hash of their components, as unit vectors."""
    hashed = vectors.select(F.xxhash64("vec").alias("h"), "vec")
    least = [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(count).collect()]  # only hashes are shuffled
    rows = hashed.filter(F.col("h") <= least[-1]).groupBy("h").agg(F.min("vec").alias("vec")).orderBy("h").collect() if least else []
    pivots = np.array([r["vec"] for r in rows], dtype=np.float64)
    return pivots / np.linalg.norm(pivots, axis=1, keepdims=True) if len(rows) else pivots


def nearest(likeness: np.ndarray, posted: int) -> np.ndarray:
    """The columns of the `posted` largest values of each row, in order; equal ones in the order of columns."""
    kept = np.sort(np.argpartition(-likeness, posted - 1, axis=1)[:, :posted], axis=1)
    order = np.argsort(-np.take_along_axis(likeness, kept, axis=1), axis=1, kind="stable")
    return np.take_along_axis(kept, order, axis=1).astype("<i2")


def permutations(vectors: DataFrame, pivots: np.ndarray, posted: int) -> DataFrame:
    """vec_id, vec and perm: the numbers of the nearest pivots in order (little-endian 16-bit)."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                vec = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                near = nearest(vec @ shared.value.T, posted)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in near], pa.binary())], names=["vec_id", "vec", "perm"])

    return vectors.select("vec_id", "vec").mapInArrow(run, "vec_id long, vec array<double>, perm binary")


def footrule_gains(perms: np.ndarray, queries: np.ndarray, pivots: int):
    """For each query, how far each row's footrule distance is below that of disjoint lists (halved)."""
    n, posted = perms.shape
    order = np.argsort(perms.ravel(), kind="stable")
    file_rows, file_places = (order // posted).astype(np.int32), (order % posted).astype(np.int32)
    bounds = np.searchsorted(perms.ravel()[order], np.arange(pivots + 1))
    for query in queries:
        gain = np.zeros(n, dtype=np.int32)
        for place, pivot in enumerate(query.tolist()):
            part = slice(bounds[pivot], bounds[pivot + 1])  # a row stands once in each file
            gain[file_rows[part]] += posted - np.maximum(file_places[part], place)
        yield gain


def cosines(vectors: np.ndarray, norms: np.ndarray, query: np.ndarray) -> np.ndarray:
    # Row by row, so that equal vectors get equal results wherever they stand.
    return (vectors * query).sum(axis=1) / (norms * np.sqrt((query * query).sum()))


def search(vectors: DataFrame, is_query, k: int = 5, pivots: int = PIVOTS, posted: int = POSTED, rerank: float = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which is_query (a column over vec_id) holds."""
    kept = usable(vectors)
    chosen = choose_pivots(kept, pivots)
    n_pivots = len(chosen)
    indexed = cut(permutations(kept, chosen, min(posted, n_pivots)).withColumn("query", F.coalesce(is_query, F.lit(False))))
    sizes = indexed.agg(F.count("*").alias("n"), F.count_if("query").alias("q")).first()
    blocks, query_blocks = 1 + sizes["n"] // BLOCK, 1 + sizes["q"] // QUERY_BLOCK
    dealt = indexed.withColumn("deal", F.xxhash64("vec_id"))
    rows = dealt.select("vec_id", "vec", "perm", F.lit(False).alias("query"), F.pmod("deal", F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"))
    asked = dealt.filter("query").select("vec_id", "vec", "perm", F.lit(True).alias("query"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod("deal", F.lit(query_blocks)).cast("int").alias("query_block"))

    def find(table: pa.Table) -> pa.Table:
        table = table.sort_by([("vec_id", "ascending")]).combine_chunks()
        is_q = table.column("query").to_numpy()
        ids = table.column("vec_id").to_numpy()
        vec = table.column("vec").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        perm = np.frombuffer(b"".join(table.column("perm").to_pylist()), "<i2").reshape(len(ids), -1)
        own, q_ids, q_vec, q_perm = ids[~is_q], ids[is_q], vec[is_q], perm[is_q]
        out: list[tuple] = []
        if len(own) and len(q_ids):
            vec = np.ascontiguousarray(vec[~is_q])
            norms = np.sqrt((vec * vec).sum(axis=1))
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])  # rows with one vec_id stand together
            wanted = min(len(starts), max(10 * k, int(np.ceil(rerank * len(starts)))))
            for query_id, query, gain in zip(q_ids.tolist(), q_vec, footrule_gains(perm[~is_q], q_perm, n_pivots), strict=True):
                gain[own == query_id] = -1
                best_gain = np.maximum.reduceat(gain, starts)
                edge = np.partition(best_gain, len(starts) - wanted)[len(starts) - wanted]
                near = np.flatnonzero((gain >= edge) & (gain >= 0))
                score = cosines(vec[near], norms[near], query)
                order = np.lexsort((own[near], -score))
                best = order[np.sort(np.unique(own[near][order], return_index=True)[1])[:k]]  # the best row of each vec_id
                out += [(query_id, int(own[near[b]]), float(score[b])) for b in best]
        cols = list(zip(*out, strict=True)) or [()] * 3
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    found = rows.unionByName(asked).groupBy("block", "query_block").applyInArrow(find, RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
