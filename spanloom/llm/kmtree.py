"""Nearest neighbours by a hierarchical k-means tree searched best bin first (operator 5)."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

#: Vectors that the tree is fitted on: those of least hash.
SAMPLE = 20_000
#: Children of a node, and sample vectors in a leaf at most.
BRANCH, LEAF = 8, 128
#: Queries of the sample that calibrate the number of leaves to visit, and the recall that they must reach.
CALIBRATE, RECALL = 256, 0.97
#: Vectors, and queries, that meet in one block.
BLOCK_VECTORS, BLOCK_QUERIES = 8192, 4096


class Tree:
    def __init__(self, unit: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, seed: int = 7):
        self.centres: list[np.ndarray | None] = []
        self.children: list[list[int]] = []
        self.leaf_no: list[int] = []
        self.leaves = 0
        self.rng = np.random.default_rng(seed)
        self._grow(unit, branch, leaf)

    def _new(self) -> int:
        self.centres.append(None)
        self.children.append([])
        self.leaf_no.append(-1)
        return len(self.children) - 1

    def _grow(self, unit, branch, leaf) -> None:
        todo = [(self._new(), unit)]
        while todo:
            node, rows = todo.pop()
            parts = self._split(rows, branch) if len(rows) > leaf else None
            if parts is None:
                self.leaf_no[node] = self.leaves
                self.leaves += 1
                continue
            self.centres[node] = np.stack([c for c, _ in parts])
            for _, part in parts:
                self.children[node].append(kid := self._new())
                todo.append((kid, part))

    def _split(self, rows, branch):
        """(centre, rows) of each part; None where all rows are one."""
        start = np.unique(rows[self.rng.permutation(len(rows))[: branch * 8]], axis=0)
        if len(start) < 2:
            start = np.unique(rows, axis=0)
        if len(start) < 2:
            return None
        centres = start[self.rng.permutation(len(start))[:branch]]
        for _ in range(8):
            at = (rows @ centres.T).argmax(1)
            sums = np.zeros_like(centres)
            np.add.at(sums, at, rows)
            long = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(long > 0, sums / np.where(long > 0, long, 1), centres)
        at = (rows @ centres.T).argmax(1)
        parts = [(centres[k], rows[at == k]) for k in range(len(centres)) if (at == k).any()]
        return parts if len(parts) > 1 else None

    def assign(self, unit: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        out = np.zeros(len(unit), np.int64)
        todo = [(0, np.arange(len(unit)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf_no[node]
                continue
            at = (unit[rows] @ self.centres[node].T).argmax(1)
            todo += [(kid, part) for k, kid in enumerate(self.children[node]) if len(part := rows[at == k])]
        return out

    def visit(self, q: np.ndarray, most: int, held: np.ndarray | None = None, want: int = 0) -> list[int]:
        """Leaves in the order of a best-bin-first traversal: ``most``, and more until they hold ``want`` ids."""
        queue, out, n, got = [(0.0, 0, 0)], [], 0, 0
        while queue and (len(out) < most or got < want):
            _, _, node = heapq.heappop(queue)
            if not self.children[node]:
                out.append(self.leaf_no[node])
                got += int(held[out[-1]]) if held is not None else want
                continue
            for kid, near in zip(self.children[node], self.centres[node] @ q):
                heapq.heappush(queue, (-float(near), n := n + 1, kid))
        return out


def calibrate(tree: Tree, unit: np.ndarray, k: int, recall: float = RECALL, queries: int = CALIBRATE) -> int:
    """The number of leaves to visit so that the sample's own queries reach ``recall`` against brute force."""
    if tree.leaves < 2:
        return 1
    leaf = tree.assign(unit)
    rows = np.linspace(0, len(unit) - 1, min(queries, len(unit))).astype(int)
    ranks = []
    for r in rows:
        near = unit @ unit[r]
        near[r] = -np.inf
        best = np.argpartition(-near, min(k, len(near) - 1))[:k]
        place = np.empty(tree.leaves, int)
        place[tree.visit(unit[r], tree.leaves)] = np.arange(tree.leaves)
        ranks.append(place[leaf[best]])
    need = np.sort(np.concatenate(ranks))
    return int(need[min(len(need) - 1, int(np.ceil(recall * len(need))))]) + 1


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).alias("id"), v.alias("v")).where(v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def _unit(rows) -> np.ndarray:
    m = np.stack(rows).astype(np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def fit(vectors: DataFrame, k: int, sample: int = SAMPLE) -> tuple[Tree, int]:
    """The tree and the leaves to visit, from at most ``sample`` usable (id, v) rows, which come to the driver."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
    unit = _unit(rows["v"]) if len(rows) else np.zeros((0, 1))
    tree = Tree(unit)
    return tree, calibrate(tree, unit, k)


def _nearest(k: int):
    def best(key, vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(vectors) or not len(queries):
            return none
        vectors = vectors.sort_values("id")
        ids, m = vectors["id"].to_numpy(), np.stack(vectors["v"]).astype(np.float64)
        norms = np.sqrt(np.einsum("ij,ij->i", m, m))
        out = []
        for at in range(0, len(queries), 256):
            part = queries.iloc[at : at + 256]
            q = np.stack(part["v"]).astype(np.float64)
            near = (q @ m.T) / norms
            for one, qid, row in zip(q, part["id"], near):
                row[ids == qid] = -np.inf
                if (n := min(k, int((row > -np.inf).sum()))) == 0:
                    continue
                least = np.partition(row, -n)[-n]
                may = np.flatnonzero(row >= least - 1e-9 * abs(np.linalg.norm(one)))
                exact = np.einsum("ij,j->i", m[may], one) / (norms[may] * np.sqrt(np.dot(one, one)))
                order = np.lexsort((ids[may], -exact))[:n]
                out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[may][order], "score": exact[order]}))
        return pd.concat(out, ignore_index=True) if out else none

    return best


def search(vectors: DataFrame, k: int, is_query, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row for which column ``is_query`` holds.

    The tree is fitted on a bounded sample, every vector is put into a leaf of it.  A query goes through the
    tree by a priority queue and visits as many leaves as the sample's own queries needed for the wished recall,
    and more while these hold fewer than ``k`` ids besides its own.
    Queries meet vectors leaf by leaf, in blocks: a leaf of many vectors or queries is cut, and each block of
    its queries meets each block of its vectors, so a vector that is repeated very often is split as well.
    Each block keeps k of a query, and the best of all blocks are taken.  Scores are cosines in double
    precision on the vectors as they are; ties go to the smaller id.

    Vectors that are null, zero, or hold a null, NaN or infinity take no part, nor do those of another length than
    most have; rows with the same id are not candidates for each other, and each of them may be found; ids are
    numbers; other columns are not read; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    usable = _usable(vectors, id_col, vec_col).where("id is not null")
    # the length that most vectors have, the smaller one on a tie
    lengths = usable.groupBy(F.size("v").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "length").first()
    usable = usable.where(F.size("v") == (lengths[0] if lengths else 0))
    tree, visits = fit(usable, k, sample)
    shared = spark.sparkContext.broadcast(tree)  # at most `sample` centres

    @F.pandas_udf("long")
    def leaf_of(v: pd.Series) -> pd.Series:
        return pd.Series(shared.value.assign(_unit(v)) if len(v) else [], dtype="int64")

    @F.pandas_udf("array<long>")
    def leaves_of(v: pd.Series) -> pd.Series:
        return pd.Series([shared.value.visit(u, visits, ids.value, k + 1) for u in _unit(v)] if len(v) else [], dtype=object)

    placed = stash(usable.withColumn("leaf", leaf_of("v")), "placed")
    # ids by leaf, each counted in one; as many rows as the tree has leaves
    counts = placed.groupBy("id").agg(F.min("leaf").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n")).toPandas()
    held = np.zeros(max(1, tree.leaves), np.int64)
    held[counts["leaf"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    ids = spark.sparkContext.broadcast(held)
    asked = stash(usable.where(is_query(F.col("id"))).withColumn("leaf", F.explode(leaves_of("v"))), "asked")
    # as many rows as the tree has leaves
    sizes = placed.groupBy("leaf").agg(F.expr(f"cast(ceil(count(*) / {BLOCK_VECTORS}) as int)").alias("vb"))
    turns = asked.groupBy("leaf").agg(F.expr(f"cast(ceil(count(*) / {BLOCK_QUERIES}) as int)").alias("qb"))
    blocks = F.broadcast(sizes.join(turns, "leaf"))
    share = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.join(blocks, "leaf").select("id", "v", "leaf", share("vb").alias("i"), every("qb").alias("j"))
    right = asked.join(blocks, "leaf").select("id", "v", "leaf", every("vb").alias("i"), share("qb").alias("j"))
    key = ("leaf", "i", "j")
    near = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_nearest(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = near.distinct().withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return near.select("query_id", "rank", "vec_id", "score")
