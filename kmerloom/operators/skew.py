"""Joins and running sums that leave no task with a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: A key is hot when it has more than this share of the left rows, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 1000
#: A key with no more rows than this is no load for a task, whatever its share; so smaller left sides have no hot key.
HOT_ROWS = 10_000
#: Copies of a right row that holds a list.
SALTS = 32
#: Ids whose upper bits agree share a list; it has at most 2 ** LIST_BITS entries.
LIST_BITS = 10


def list_block(ids: Column) -> Column:
    """Which of a key's lists an id goes to: lists of distinct ids have at most 1,024 entries, whatever the key."""
    return F.shiftright(ids.cast("bigint"), LIST_BITS)


def with_sum_before(rows: DataFrame, value: str, order: str, by: tuple[str, ...] = (), name: str = "before", width: int = 4096, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds the sum of ``value`` over the rows of the same ``by`` with a smaller ``order`` (integers; with ``ties`` unique within ``by``).

    Runs of ``width`` orders are summed first, so that a window sees the rows of one run, or one row per run.
    """
    cut = rows.withColumn("__run", F.floor(F.col(order) / width))
    runs = cut.groupBy(*by, "__run").agg(F.sum(value).alias("__n"))
    starts = runs.select(*by, "__run", (F.sum("__n").over(Window.partitionBy(*by).orderBy("__run")) - F.col("__n")).alias("__start"))
    inner = F.sum(value).over(Window.partitionBy(*by, "__run").orderBy(order, *ties)) - F.col(value)
    return cut.withColumn("__inner", inner).join(starts, [*by, "__run"]).select(*rows.columns, (F.col("__start") + F.col("__inner")).alias(name))


def hot_left_join(left: DataFrame, right: DataFrame, key: str, right_key: str, left_rows: int | None = None, hot_share: float = HOT_SHARE, salts: int = 0, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``left`` LEFT JOIN ``right`` ON left.key = right.right_key; ``right_key`` is unique in ``right`` and is dropped.

    A key is hot with more than ``hot_share`` of the left rows and more than ``hot_rows`` of them. Rows of hot keys meet a broadcast of the few right rows they need (at most ``1 / hot_share`` of them, by
    construction), the others are joined by shuffle, so no task receives a hot key's rows. Where right rows hold lists, so
    that even a few may be large, give ``salts``: hot rows are then spread over that many copies of their right row, by
    shuffle. Rows with a null key are kept with nulls. ``left`` is read twice and should be a stored table.
    """
    names = [c for c in right.columns if c != right_key]

    def joined(part: DataFrame, side: DataFrame, how) -> DataFrame:
        side = side.withColumnRenamed(right_key, "__rk")
        return part.join(how(side), part[key] == side["__rk"], "left").select(*left.columns, *names)

    if left_rows is not None and left_rows <= hot_rows:
        return joined(left, right, lambda x: x)
    counts = left.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__hot")).count()
    if left_rows is None:
        counts = counts.join(F.broadcast(counts.agg(F.sum("count").alias("__all"))))  # one row
        hot = counts.where((F.col("count") > max(1, hot_rows)) & (F.col("count") > F.col("__all") * hot_share)).select("__hot")
    else:
        hot = counts.where(F.col("count") > max(1, hot_rows, int(left_rows * hot_share))).select("__hot")
    hot_right = right.join(F.broadcast(hot), right[right_key] == hot["__hot"], "left_semi")
    marked = left.join(F.broadcast(hot), left[key] == hot["__hot"], "left")
    hot_left = marked.where("__hot is not null").drop("__hot")
    if salts:
        copies = hot_right.withColumnRenamed(right_key, "__rk").withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = hot_left.withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
        from_hot = salted.join(copies, (salted[key] == copies["__rk"]) & (salted["__salt"] == copies["__copy"]), "left").select(*left.columns, *names)
    else:
        from_hot = joined(hot_left, hot_right, F.broadcast)
    rest = joined(marked.where("__hot is null").drop("__hot"), right, lambda x: x)
    return rest.unionByName(from_hot)
