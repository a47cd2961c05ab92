"""Nearest neighbours by vantage-point trees, one per shard of the vectors.

Vectors are scaled to unit length, where Euclidean distance d and cosine c go together: d^2 = 2 - 2c. A node splits its
vectors at the median distance m from a vantage point; a side cannot hold anything nearer than |d(q, vantage) - m|. A side is
skipped when `factor` times that bound exceeds the query's k-th best distance: factor 1 is exact search, larger factors
prune more. Queries walk a tree together, so a node costs one matrix product for all queries that visit it.

Shards hold about `SHARD_ROWS` vectors of one dimension. Each shard's tree is built once and written to the shared folder. A block of about
`BLOCK_QUERIES` queries walks a set of trees one after the other in one task, so that what it has found in one prunes the next; vectors
are not copied for the blocks, and a task holds one tree and one block. Small inputs deal the trees to several tasks for each
block; the k best of each meet in a ranked merge that cuts partitions to k rows before its shuffle.

Defined results: vectors that are null, empty, zero or have null or non-finite components take no part; only vectors of the
query's dimension are candidates; rows that repeat a vec_id count once (the smallest vector); a null vec_id takes no
part; an empty table gives no rows; further columns are not looked at. A score is the cosine of the original vectors in double precision, its products
summed in the order of the dimensions, never rounded; equal scores go to the smaller vec_id, however many they are.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetgraph.llm.jobs import fresh_path, materialise

K = 5
FACTOR = 1.0
LEAF = 128
SHARD_ROWS = 8192
BLOCK_QUERIES = 2048
#: Tasks for each core that small inputs are dealt to.
WAVES = 2
NOISE = 1e-11  # above the rounding of a matrix product
SLACK = 2e-6  # above the root of what equal cosines may differ by
PAIRS = 8192


class Tree:
    """A tree over the distinct vectors; rows of equal vectors, which differ by a power of two at most, are members of one, in ascending order.

    Nodes in depth-first order. Inner: (vantage, median, left, right). Leaf: (start, end) in `order`.
    """

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        scaled = _scaled(vectors)
        _, first, of = np.unique(scaled.view(np.dtype((np.void, scaled.itemsize * scaled.shape[1]))).ravel(), return_index=True, return_inverse=True)
        # distinct vectors are numbered by their smallest row, so that the smaller of two has the smaller row
        self.of = np.argsort(np.argsort(first))[of.ravel()]
        self.scaled = scaled[np.sort(first)]
        self.norm = _norm(self.scaled)
        self.unit = self.scaled / self.norm[:, None]
        self.members = np.argsort(self.of, kind="stable")
        self.ends = np.cumsum(np.bincount(self.of))
        self.order = np.arange(len(self.unit))
        self.nodes: list[tuple] = []
        rng = np.random.default_rng(len(vectors))
        stack = [(0, len(self.unit), None)]
        while stack:
            start, end, parent = stack.pop()
            me = len(self.nodes)
            if parent is not None:
                up, side = parent
                self.nodes[up][2 + side] = me
            rows = self.order[start:end]
            if end - start <= leaf:
                self.nodes.append([None, start, end])
                continue
            vantage = int(rows[rng.integers(len(rows))])
            distance = _distance(self.unit[rows] @ self.unit[vantage])
            middle = len(rows) // 2
            part = np.argpartition(distance, middle)
            self.order[start:end] = rows[part]
            self.nodes.append([vantage, float(distance[part[middle]]), -1, -1])
            stack += [(start + middle, end, (me, 1)), (start, start + middle, (me, 0))]

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float, floor: np.ndarray | None = None) -> np.ndarray:
        """The rows of each query's k nearest, ties by row (-1 where there are fewer); own: the row of the query itself or -1.

        floor: scores that k rows elsewhere reach already; rows below it may be left out.
        """
        exact = _scaled(queries)
        norm = _norm(exact)
        q = exact / norm[:, None]
        most = k + 1  # distinct vectors: the query's own may have no other member
        best = np.full((len(q), most), -np.inf)
        found = np.full((len(q), most), -1)
        least = np.full(len(q), -np.inf) if floor is None else floor

        def visit(node: int, active: np.ndarray) -> None:
            what = self.nodes[node]
            if what[0] is None:
                rows = self.order[what[1] : what[2]]
                sims = q[active] @ self.unit[rows].T
                bar = np.maximum(np.partition(np.concatenate([best[active], sims], axis=1), -most, axis=1)[:, -most], least[active])
                i, j = np.nonzero(sims >= bar[:, None] - NOISE)
                if not len(i):
                    return
                at, names = active[i], rows[j]
                old = np.unique(at)
                kept, slot = np.nonzero(found[old] >= 0)
                kept = old[kept]
                at, names, scores = np.concatenate([kept, at]), np.concatenate([found[kept, slot], names]), np.concatenate([best[kept, slot], _cosine(exact, norm, at, self.scaled, self.norm, names)])
                at, names, scores, rank = _first(at, names, scores, most)
                best[at, rank], found[at, rank] = scores, names
                return
            vantage, median, near, far = what
            d = _distance(q[active] @ self.unit[vantage])
            inside = d < median
            for first, side in ((inside, near), (~inside, far)):
                if first.any():
                    visit(side, active[first])
            bound = np.abs(d - median) * factor
            open_ = bound <= _distance(np.maximum(best[active, -1], least[active])) + SLACK
            for other, side in ((~inside, near), (inside, far)):
                go = other & open_
                if go.any():
                    visit(side, active[go])

        out = np.full((len(q), k), -1)
        if len(self.order) and len(q):
            visit(0, np.arange(len(q)))
            at, slot = np.nonzero(found >= 0)
            direction, scores = found[at, slot], best[at, slot]
            begins = np.concatenate([[0], self.ends[:-1]])
            n = np.minimum(self.ends[direction] - begins[direction], most)
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at, scores, rows = np.repeat(at, n), np.repeat(scores, n), self.members[np.repeat(begins[direction], n) + nth]
            other = rows != own[at]
            at, rows, _, rank = _first(at[other], rows[other], scores[other], k)
            out[at, rank] = rows
        return out


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component near 1: exact, so a cosine stays what it was, and squares stay finite."""
    return np.ascontiguousarray(np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1]) + 0.0)


def _sum(products: np.ndarray) -> np.ndarray:
    """Sums of the columns, one row after the other: the same for a pair whatever stands beside it."""
    total = np.zeros(products.shape[1])
    for row in products:
        total += row
    return total


def _norm(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(_sum((vectors * vectors).T))


def _cosine(a: np.ndarray, a_norm: np.ndarray, i: np.ndarray, b: np.ndarray, b_norm: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The cosine of each pair of rows."""
    parts = []
    for at in range(0, len(i), PAIRS):
        k, m = i[at : at + PAIRS], j[at : at + PAIRS]
        parts.append(_sum((a[k] * b[m]).T) / a_norm[k] / b_norm[m])
    return np.concatenate(parts) if parts else np.zeros(0)


def _first(at: np.ndarray, names: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k entries of each `at` with the highest scores, ties by name, and their ranks from 0."""
    o = np.lexsort((names, -scores, at))
    at, names, scores = at[o], names[o], scores[o]
    rank = np.arange(len(at)) - np.searchsorted(at, at)
    top = rank < k
    return at[top], names[top], scores[top], rank[top]


def _distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * np.maximum(cosine, -1.0), 0))


def _build(uri: str) -> Callable:
    """Writes the tree of a shard's vectors below uri, in a file of a random name; a task that runs again writes another."""

    def run(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        shard = shard.sort_values("vec_id")
        tree = Tree(np.stack(shard["v"].to_numpy()).astype(np.float64))
        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.tree"
        with store.open_output_stream(f"{root}/{name}") as out:
            pickle.dump((shard["vec_id"].to_numpy(), tree), out, protocol=5)
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "file": [name]})

    return run


def _walk(uri: str, files, k: int, factor: float) -> Callable:
    """A block of queries through the trees of its set, with the best of all of them kept. files: a broadcast, by dimension and set."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        names, asked = group["query_id"].to_numpy(), np.stack(group["q"].to_numpy()).astype(np.float64)
        scaled, n = _scaled(asked), len(group)
        norm = _norm(scaled)
        ids, scores, floor = np.full((n, k), -1), np.full((n, k), -np.inf), np.full(n, -np.inf)
        held = np.zeros((n, k), bool)
        store, root = fs.FileSystem.from_uri(uri)
        for file in files.value.get((key[0], key[1]), []):
            with store.open_input_file(f"{root}/{file}") as source:
                own, tree = pickle.loads(source.read())
            at = np.minimum(np.searchsorted(own, names), len(own) - 1)
            found = tree.search(asked, np.where(own[at] == names, at, -1), k, factor, floor)
            row, slot = np.nonzero(found >= 0)
            col = found[row, slot]
            new = _cosine(scaled, norm, row, tree.scaled, tree.norm, tree.of[col])
            old, place = np.nonzero(held)
            at, name, score, rank = _first(np.concatenate([old, row]), np.concatenate([ids[old, place], own[col]]), np.concatenate([scores[old, place], new]), k)
            ids[at, rank], scores[at, rank], held[at, rank] = name, score, True
            floor = np.where(held[:, -1], scores[:, -1], -np.inf)
        row, slot = np.nonzero(held)
        return pd.DataFrame({"query_id": names[row], "vec_id": ids[row, slot], "score": scores[row, slot]})

    return run


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v and dim of the vectors that take part, each vec_id once."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))").where("exists(v, x -> x <> 0)")
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def search(vectors: DataFrame, is_query: Column, k: int = K, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found for each row that is_query (over vec_id) marks."""
    spark, rows = vectors.sparkSession, materialise(usable(vectors), "vectors")
    counts = rows.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    shards, parts = max(1, -(-counts["n"] // shard_rows)), max(1, -(-counts["q"] // block_queries))
    uri = fresh_path(spark, "trees")
    uri = uri if "://" in uri or uri.startswith("file:") else f"file://{uri}"
    sharded = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    trees = materialise(sharded.groupBy("dim", "shard").applyInPandas(_build(uri), "dim int, shard int, file string"), "tree-files")
    # a set of trees for each task; large inputs have blocks enough for one set
    sets = min(shards, max(1, -(-WAVES * spark.sparkContext.defaultParallelism // parts)))
    files: dict[tuple[int, int], list[str]] = {}
    for r in trees.orderBy("dim", "shard").collect():  # a name for each shard of vectors
        files.setdefault((r["dim"], r["shard"] % sets), []).append(r["file"])
    shared = spark.sparkContext.broadcast(files)
    asked = rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "dim", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts)).cast("int").alias("part"))
    blocks = asked.withColumn("set", F.explode(F.sequence(F.lit(0), F.lit(sets - 1)))).repartition(min(10_000, sets * parts), "dim", "set", "part")  # few bytes, much work
    found = blocks.groupBy("dim", "set", "part").applyInPandas(_walk(uri, shared, k, factor), "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_vptree(spark, sf_dir: str) -> DataFrame:
    from assetgraph.llm.jobs import table

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE = f"""
with good as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings where vec_id is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
once as (select vec_id, min(v) as v from good group by 1),
scored as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v) / sqrt(list_inner_product(q.v, q.v)) / sqrt(list_inner_product(c.v, c.v)) as score
  from once q join once c on len(c.v) = len(q.v) and c.vec_id <> q.vec_id where q.vec_id % 50 = 0)
select query_id, cast(rank as int) as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored) where rank <= {K}"""
