"""Mixing sources to target weights, with DataFrame operations only.

Every row gets a hash-random key. Within a source the key space is cut into equal ranges, so that a
source of any size spreads over many tasks; range totals give each range its offset, and a window
inside the range gives each row its place on the source's running count of words. The mix takes whole
epochs of a source first and then the first rows in key order, up to the exact budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ._spark import save, unused

WORD = r"[^\x20\x09-\x0D]+"
#: Key values are below 2^60: fifteen hexadecimal digits of an MD5.
KEY_BITS = 60


def _name(id_):
    return F.coalesce((F.col(id_) if isinstance(id_, str) else id_).cast("string"), F.lit("null"))


def _key(id_col: str, text_col: str):
    digest = F.md5(F.concat(_name(F.col(f"`{id_col}`")), F.lit(":"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row: id, source, words and the hash-random key."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        _key(id_col, text_col).alias("mix_key"),
    )


def source_targets(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """One row per source: its words, rows and target.

    Sources in code-point order (null last) get the weights in turn. Water filling in closed form:
    in ascending order of cap/weight a source is capped while its cap does not exceed its weighted share
    of what the capped ones before it leave.
    """
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(cycle, (place % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left_size = F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left_size / left_weight)
    per = per.withColumn("capped", F.col("cap") <= F.col("weight") * F.col("level"))
    # The level that the first uncapped source sees holds for all uncapped ones.
    level = F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(whole)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * level)
    return per.select("source", "source_size", "source_rows", target.alias("target"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, rows_per_range: int | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words the mix takes, repeats counted), mix_key.

    Null text counts as empty; a null source is a source of its own; rows repeated exactly are taken like
    separate rows. The result depends on row contents only, so reruns agree. An empty table gives no rows.
    """
    rows = save(sized(docs, id_col, text_col, source_col), "mix-sizes")
    per = save(source_targets(rows, weights, max_epochs), "mix-targets")
    # As many ranges as rows in each: the window over the ranges and those inside them grow with the root of a source.
    rows_of = F.col("source_rows").cast("double")
    spread = F.ceil(F.sqrt(rows_of) if rows_per_range is None else rows_of / rows_per_range)
    a = rows.alias("a").join(per.alias("p"), F.col("a.source").eqNullSafe(F.col("p.source"))).select("a.*", "source_size", "target", spread.alias("ranges"))
    a = a.withColumn("range", F.floor(F.col("mix_key").cast("double") / float(1 << KEY_BITS) * F.col("ranges")).cast("long"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    a = a.withColumn("epochs", epochs)
    a = a.withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    sums = a.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    offsets = sums.select("source", "range", F.coalesce(F.sum("range_size").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("range_start"))
    b = a.alias("a").join(offsets.alias("o"), F.col("a.source").eqNullSafe(F.col("o.source")) & (F.col("a.range") == F.col("o.range"))).select("a.*", "range_start")
    inside = W.partitionBy("source", "range").orderBy("mix_key", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    b = b.withColumn("before", F.col("range_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    cut = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return b.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + cut).cast("long").alias("taken"), "mix_key")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of docs: a document taken k times appears k times.

    The one document of each source on its budget's edge is taken whole if at least half of its part is.
    Documents without words carry no budget and stay once.
    """
    columns = docs.columns
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.lit(1))
    id_, key, nth, total, alike, share, copy = unused(columns, "mix_id", "mix_key", "nth", "copies", "alike", "share", "copy")
    plan = mix(docs, **options).select(_name("doc_id").alias(id_), F.col("mix_key").alias(key), copies.alias(total))
    plan = plan.groupBy(id_, key).agg(F.sum(total).alias(total), F.count("*").alias(alike))
    # Rows are alike by their key, whatever further columns say. Only rows that repeat need numbers.
    keyed = docs.withColumns({id_: _name(F.col(f"`{id_col}`")), key: _key(id_col, text_col)}).join(plan, [id_, key])
    alone = keyed.where(F.col(alike) == 1).withColumn(share, F.col(total).cast("int"))
    # Rows that are equal altogether become one with a count, so a row that makes up much of the table is no hot group.
    many = keyed.where(F.col(alike) > 1).groupBy(*[F.col(f"`{c}`") for c in keyed.columns]).agg(F.count("*").alias(nth))
    order = W.partitionBy(id_, key).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in columns]))
    before = F.coalesce(F.sum(nth).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    many = many.withColumn(copy, before)
    # Rows alike share their copies evenly; the first ones get what is left over.
    extra = F.greatest(F.lit(0), F.least(F.col(nth), F.col(total) % F.col(alike) - F.col(copy)))
    many = many.withColumn(share, (F.col(nth) * F.floor(F.col(total) / F.col(alike)) + extra).cast("int")).drop(nth, copy)
    out = alone.unionByName(many).where(F.col(share) > 0)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(share)))).select(*[F.col(f"`{c}`") for c in columns])
