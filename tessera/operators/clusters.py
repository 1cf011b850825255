"""Clusters by average linkage that need no group of all rows.

Two clusters merge only while their average cosine distance is within the limit, so some pair between
them is: no cluster reaches beyond a component of the graph of such pairs.  The graph is built block
by block, its components are found by joins, and each component is clustered on its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.operators.embed import matrix
from tessera.sources import shared

#: Rows of a block of the pair search: two blocks are held at once.
BLOCK = 8192


def similar_pairs(rows: DataFrame, key: str, vector: str, least: float, block: int = BLOCK) -> DataFrame:
    """(a, b, near): pairs of keys, a < b, whose vectors have a cosine of ``least`` or more, exactly.  Vectors
    are packed floats of equal length; every pair of blocks is one task's product of two matrices."""
    n = max(1, -(-rows.count() // block))
    kind, shape = rows.schema[key].dataType.simpleString(), to_arrow_type(rows.schema[key].dataType)
    at = F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    dealt = rows.select(F.col(key).alias("k"), F.col(vector).alias("v"), at.alias("at"))
    # a block meets those from its own on: pair (i, j) with i <= j; both sides need columns of their own
    left = dealt.select(F.col("at").alias("i"), F.explode(F.sequence("at", F.lit(n - 1))).alias("j"), F.col("k").alias("ka"), F.col("v").alias("va"))
    right = dealt.select(F.explode(F.sequence(F.lit(0), F.col("at"))).alias("i"), F.col("at").alias("j"), F.col("k").alias("kb"), F.col("v").alias("vb"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        found_a, found_b, found = [], [], []
        if a.num_rows and b.num_rows:
            theirs = _unit(matrix(b["vb"].combine_chunks()))
            ka, kb = np.array(a["ka"].to_pylist(), object), np.array(b["kb"].to_pylist(), object)
            for low in range(0, a.num_rows, 1024):
                near = _unit(matrix(a.slice(low, 1024)["va"].combine_chunks())) @ theirs.T
                x, y = np.nonzero(near >= least)
                keys_a, keys_b = ka[low + x], kb[y]
                if len(x):
                    swap, other = keys_a > keys_b, keys_a != keys_b
                    if a["i"][0].as_py() == a["j"][0].as_py():
                        other &= ~swap  # inside a block every pair is met twice
                    found_a += np.where(swap, keys_b, keys_a)[other].tolist()
                    found_b += np.where(swap, keys_a, keys_b)[other].tolist()
                    found += near[x, y][other].tolist()
        return pa.table({"a": pa.array(found_a, shape), "b": pa.array(found_b, shape), "near": pa.array(found, pa.float64())})

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(meet, f"a {kind}, b {kind}, near double")


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


def components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, root): every node with the least node of its component.

    Roots hook on the least root next to any of their nodes and ways are halved, so the rounds grow with
    the logarithm of the longest way.  Each round is written to the shared folder, which cuts the plan;
    nothing but a count of changes reaches the driver.
    """
    both = shared.kept(pairs.select("a", "b").unionAll(pairs.select("b", "a")).distinct(), "edges")
    roots = shared.kept(nodes.select(F.col("node"), F.col("node").alias("root")), "roots")
    while True:
        near = both.join(roots, both["b"] == roots["node"]).groupBy("a").agg(F.min("root").alias("m"))
        hooks = near.join(roots, near["a"] == roots["node"]).groupBy(F.col("root").alias("r")).agg(F.min("m").alias("m"))
        hooked = roots.join(hooks, F.col("root") == F.col("r"), "left").select("node", F.least("root", "m").alias("root"))
        on = hooked.select(F.col("node").alias("r"), F.col("root").alias("further"))
        new = shared.kept(hooked.join(on, F.col("root") == F.col("r")).select("node", F.least("root", "further").alias("root")), "roots")
        changed = new.join(roots.withColumnRenamed("root", "old"), "node").where("root <> old").limit(1).count()
        roots = new
        if not changed:
            return roots


def average_linkage(vectors: np.ndarray, limit: float) -> np.ndarray:
    """The number of each row's cluster, numbered by first rows.  A chain of nearest neighbours: clusters
    are kept as the sums of their unit vectors, from which the average distance of two follows, so
    memory is linear in the rows and their distances are never held at once."""
    total, size = _unit(vectors), np.ones(len(vectors))
    label, alive = np.arange(len(vectors)), np.ones(len(vectors), bool)
    chain: list[int] = []
    done = ~alive
    while True:
        if not chain:
            left = np.flatnonzero(alive & ~done)
            if not len(left):
                return np.unique(label, return_inverse=True)[1]
            chain.append(int(left[0]))
        i = chain[-1]
        d = 1 - (total @ total[i]) / (size * size[i])
        d[~alive] = np.inf
        d[i] = np.inf
        j = int(np.argmin(d))
        if len(chain) > 1 and d[chain[-2]] <= d[j]:
            j = chain[-2]
        if not d[j] <= limit:
            done[i] = True  # its nearest is too far, and merging others only takes them farther off
            chain.pop()
        elif len(chain) > 1 and j == chain[-2]:
            chain = chain[:-2]
            i, j = min(i, j), max(i, j)
            total[i] += total[j]
            size[i] += size[j]
            alive[j], total[j] = False, 0
            label[label == j] = i
        else:
            chain.append(j)


def phrase_clusters(phrases: DataFrame, phrase: str, weight: str, vector: str, limit: float = 0.32) -> DataFrame:
    """(cluster, phrase, support): distinct phrases in clusters by average cosine distance, each cluster
    named by its least phrase, with the sum of its weights.

    ``vector``: packed floats (``embed.vectors``).  Phrases of length 0 are far from all.  A task holds one
    component of the graph of pairs within the limit, as sums of vectors; a component's time grows with
    its square.  Phrases without such a pair are clusters of their own and are not grouped.
    """
    rows = shared.kept(phrases.select(F.col(phrase).alias("node"), F.col(weight).cast("long").alias("w"), F.col(vector).alias("v")), "phrases")
    # sums of floats in another order may pass the limit by their last bits
    pairs = similar_pairs(rows.select("node", "v"), "node", "v", 1 - limit - 1e-9)
    linked = components(pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct(), pairs)
    placed = rows.join(linked, "node", "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", kind="stable").reset_index(drop=True)
        label = average_linkage(np.stack([np.frombuffer(v, np.float32) for v in pdf["v"]]), limit)
        by = pd.Series(label)
        return pd.DataFrame({"cluster": pdf["node"].groupby(by).transform("first"), "node": pdf["node"], "support": pdf["w"].groupby(by).transform("sum")})

    kind = rows.schema["node"].dataType.simpleString()
    many = placed.where(F.col("root").isNotNull()).groupBy("root").applyInPandas(run, f"cluster {kind}, node {kind}, support bigint")
    one = placed.where(F.col("root").isNull()).select(F.col("node").alias("cluster"), "node", F.col("w").alias("support"))
    return many.unionAll(one).withColumnRenamed("node", phrase)
