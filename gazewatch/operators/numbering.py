"""Consecutive numbers in a given order without sorting a large group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_rank(
    df: DataFrame,
    within: Sequence[str],
    levels: Sequence[str],
    order: Sequence[Column | str],
    rank: str,
    total: str | None = None,
) -> DataFrame:
    """Number rows 0, 1, ... inside each ``within`` group, ordered by ``levels``, then ``order``.

    ``levels`` are columns from coarse to fine that cut a group into bounded
    pieces. Rows are counted per piece before any shuffle, the counts are added
    up level by level, and only a single piece is ever sorted by one task. So a
    group holding a third of all rows costs as much as any other. A null key is a
    value like any other, the lowest: keys are compared inside structs.
    """
    columns_in = df.columns
    wrapped = {c: f"_key_{c}" for c in [*within, *levels]}
    df = df.withColumns({name: F.struct(c) for c, name in wrapped.items()})
    within, levels = [wrapped[c] for c in within], [wrapped[c] for c in levels]
    keys = [within + levels[: i + 1] for i in range(len(levels))]

    sizes = [df.groupBy(*keys[-1]).agg(F.count(F.lit(1)).alias("_n"))]
    for key in reversed(keys[:-1]):
        sizes.insert(0, sizes[0].groupBy(*key).agg(F.sum("_n").alias("_n")))

    offsets = None
    for i, (key, size) in enumerate(zip(keys, sizes)):
        parent = key[:-1]
        earlier = (
            Window.partitionBy(*parent)
            .orderBy(key[-1])
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        here = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
        columns = [*key, "_n", here.alias("_before")]
        if i == 0 and total:
            group = Window.partitionBy(*within)
            columns.append(F.sum("_n").over(group).alias(total))
        step = size.select(*columns)
        if offsets is not None:
            carried = offsets.drop("_n").withColumnRenamed("_before", "_above")
            step = step.join(carried, parent).withColumn("_before", F.col("_before") + F.col("_above"))
            step = step.drop("_above")
        offsets = step

    piece = Window.partitionBy(*keys[-1]).orderBy(*order)
    numbered = df.join(offsets.drop("_n"), keys[-1])
    position = F.col("_before") + F.row_number().over(piece) - 1
    out = [*columns_in, position.cast("bigint").alias(rank)]
    return numbered.select(*out, *([F.col(total).cast("bigint").alias(total)] if total else []))
