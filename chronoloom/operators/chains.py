"""Chains of rows that each name a later one, followed without running through them in one task.

Rows are cut into chunks of their order key. Each chunk says, for every row in it, where a chain that comes in at
that row goes out of the chunk; over these long steps, pointer doubling finds where the chains really come in
(as many rounds as the number of chunks has binary digits); then each chunk follows its own chain.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import scratch
from .ordered import CHUNK, running_all


def _saved(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _exits(chunk: pd.DataFrame) -> pd.DataFrame:
    """node, exit of a chunk's rows(node, next): the first node behind the chunk that the chain from here reaches."""
    chunk = chunk.sort_values("node")
    node = chunk["node"].to_numpy()
    gone = chunk["next"].isna().to_numpy()
    out = chunk["next"].fillna(0).to_numpy().astype(np.int64)
    at = np.minimum(np.searchsorted(node, out), len(node) - 1)
    inside = ~gone & (node[at] == out)
    for i in np.flatnonzero(inside)[::-1].tolist():
        out[i], gone[i] = out[at[i]], gone[at[i]]
    return pd.DataFrame({"key": chunk["key"].to_numpy(), "node": node, "exit": pd.array([None if g else int(x) for g, x in zip(gone, out)], dtype="Int64")})


def _walk(chunk: pd.DataFrame) -> pd.DataFrame:
    """key, node of the rows that the chain from the chunk's entry takes."""
    chunk = chunk.sort_values("node")
    node = chunk["node"].to_numpy()
    null = chunk["next"].isna().to_numpy()
    nxt = chunk["next"].fillna(0).to_numpy().astype(np.int64)
    where = {n: i for i, n in enumerate(node.tolist())}
    out, i = [], where.get(int(chunk["entry"].iloc[0]))
    while i is not None:
        out.append(int(node[i]))
        i = None if null[i] else where.get(int(nxt[i]))
    return pd.DataFrame({"key": [chunk["key"].iloc[0]] * len(out), "node": out})


def width(nodes: DataFrame, *, most: int = 1 << 18, least: int = CHUNK) -> int:
    """The chunk that fits nodes(key, node): the widest one, by powers of four times `least`, of which none holds more than `most` rows of a key.

    Chunks of `least` numbers are counted once and added up to wider ones; a row per width comes back.
    """
    cells = nodes.groupBy("key", F.floor(F.col("node") / least).alias("cell")).agg(F.count("*").alias("n"))
    cells = cells.select("key", "cell", "n", F.explode(F.sequence(F.lit(0), F.lit(20), F.lit(2))).alias("level"))
    sums = cells.groupBy("key", "level", F.expr("shiftright(cell, level)").alias("cell")).agg(F.sum("n").alias("n"))
    fits = [r["level"] for r in sums.groupBy("level").agg(F.max("n").alias("n")).where(F.col("n") <= most).collect()]
    return least << max(fits, default=0)


def followed(rows: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """key, node of the rows on the chains that begin at each key's rows with root true.

    rows(key, node, next, root): node numbers are unique within a key, next is a larger one of the same key or null. A key has
    at most one root. Chunks are ranges of `chunk` node numbers, so a task holds at most so many rows at once.
    """
    r = _saved(rows.select("key", F.col("node").cast("long").alias("node"), F.col("next").cast("long").alias("next"), F.floor(F.col("node") / chunk).alias("part"), F.coalesce("root", F.lit(False)).alias("root")), "chain-rows")
    exits = r.groupBy("key", "part").applyInPandas(lambda pdf: _exits(pdf), "key string, node long, exit long")
    # Only rows at which something comes into a chunk matter for the long steps.
    crossing = r.where(F.floor(F.col("next") / chunk) > F.col("part")).select("key", F.col("next").alias("node"))
    roots = r.where("root").select("key", "node")
    gates = crossing.unionByName(roots).distinct()
    jump = _saved(exits.join(gates, ["key", "node"]).select("key", "node", F.col("exit").alias("to")), "chain-jumps")
    reached = roots
    while True:
        more = reached.join(jump.where("to IS NOT NULL"), ["key", "node"]).select("key", F.col("to").alias("node"))
        grown = _saved(reached.unionByName(more).distinct(), "chain-reached")
        far = jump.where("to IS NOT NULL").join(jump.select("key", F.col("node").alias("to"), F.col("to").alias("further")), ["key", "to"]).where("further IS NOT NULL")
        jump = _saved(far.select("key", "node", F.col("further").alias("to")), "chain-jumps")
        reached = grown
        if jump.isEmpty():
            break
    entries = reached.select("key", F.floor(F.col("node") / chunk).alias("part"), F.col("node").alias("entry"))
    return r.join(entries, ["key", "part"]).groupBy("key", "part").applyInPandas(lambda pdf: _walk(pdf), "key string, node long")


def first_from(rows: DataFrame, ask: Column, *, chunk: int = CHUNK) -> DataFrame:
    """Adds next to rows(key, node): the key's smallest node that is at least `ask`; null if there is none."""
    both = rows.withColumn("kind", F.lit(1)).withColumn("at", F.col("node")).unionByName(rows.withColumn("kind", F.lit(0)).withColumn("at", ask))
    # Read backwards, the last target before a question is the first one behind it; at equal numbers the target comes first.
    both = both.withColumn("back", -F.col("at")).withColumn("turn", 1 - F.col("kind"))
    both = running_all(both, {"next": ("last", F.when(F.col("kind") == 1, F.col("node")), False)}, order=["back", "turn"], keys=["key"], chunk=chunk)
    return both.where("kind = 0").select(*rows.columns, "next")
