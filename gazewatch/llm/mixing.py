"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its shuffled documents, served at a rate in proportion to its
target. An entry's virtual finish time is the number of words its source has served when
the entry ends, divided by the source's target: at time 1 every source has reached its
target. The queues merge into one by sorting all entries by finish time, in ranges of
virtual time, and the merged queue is cut where its words reach the budget. Documents of
more than PACKET words enter in several entries, so that a source misses its target by
about that many words at most. A source whose target exceeds its size is served again,
`repeats` times at most, in the same order.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazewatch.llm.common import BLANK_CLASS, checkpoint_folder, partitions

#: Weights of sources in the order of their names, over and over.
WEIGHTS = (5, 2, 1)
REPEATS = 3
PACKET = 1024
SEED = 12
#: Rows that one task sorts: of a bucket of a source, or of a range of virtual time.
ROWS_PER_PIECE = 16_384


def _written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The same rows, read from the folder that the cluster shares."""
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^" + BLANK_CLASS[1:] + "+")), F.lit(0)).cast("long")


def _before(value: str, *order: Column | str) -> Column:
    """The sum over the rows before this one, of a window still to be partitioned."""
    return F.coalesce(F.sum(value).over(*order), F.lit(0).cast("long"))


def weighed_sources(sized: DataFrame, weights: tuple[int, ...], folder: str) -> DataFrame:
    """source_key, source_size, number (from 0, by name, null last) and weight of every source.

    Names are ranked by ranges of names, so any number of sources is spread over tasks.
    """
    name = F.col("source_key.source")
    sums = sized.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    ranges = _written(
        sums.repartitionByRange(name.asc_nulls_last()).withColumn("part", F.spark_partition_id()), folder, "sources"
    )
    counts = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", _before("n", earlier).alias("earlier"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(name.asc_nulls_last()))
    number = F.col("earlier") + within - 1
    cycle = F.array(*[F.lit(w) for w in weights])
    return ranges.join(counts, "part").select("source_key", "source_size", number.alias("number")).withColumn(
        "weight", F.get(cycle, (F.col("number") % len(weights)).cast("int"))
    )


def with_targets(sources: DataFrame, budget: int, repeats: int) -> DataFrame:
    """Adds each source's target: its share of the budget by weight, `repeats` times its size at most.

    What lies above a limit is shared by weight among the other sources until none is above.
    Each round is one small aggregate; a source once limited stays so, because shares only grow.
    """
    limit = (F.col("source_size") * repeats).cast("double")
    weight = F.col("weight").cast("double")
    rest, shares, limited = float(budget), None, -1
    above = F.lit(False)
    while True:
        found = sources.agg(
            F.count_if(above).alias("limited"),
            F.coalesce(F.sum(F.when(above, F.col("source_size") * repeats)), F.lit(0)).alias("used"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("shares"),
        ).first()
        rest, shares = float(budget - found.used), float(found.shares)
        if found.limited == limited or not shares:
            break
        limited = found.limited
        above = weight * F.lit(rest) / F.lit(shares) > limit
    share = weight * F.lit(rest) / F.lit(shares or 1.0)
    return sources.withColumn("target", F.when(above, limit).otherwise(share))


def _horizon(sources: DataFrame, budget: int, repeats: int, packet: int) -> float:
    """A virtual time by which the budget is served for certain.

    By time v a source has served v times its target, or all it has, but for one entry at
    most. So the entries that begin before v suffice if these sums exceed the budget by an
    entry for each source.
    """
    times = [1 + 2.0**-k for k in range(10, -1, -1)] + [2.0**k for k in range(2, 40)]
    served = [
        F.sum(F.least(F.col("target") * v, (F.col("source_size") * repeats).cast("double"))).alias(f"v{i}")
        for i, v in enumerate(times)
    ]
    found = sources.agg(F.count(F.lit(1)).alias("n"), *served).first()
    enough = [v for i, v in enumerate(times) if (found[f"v{i}"] or 0) >= budget + packet * found.n]
    return enough[0] if enough else math.inf


def queue(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    repeats: int = REPEATS,
    packet: int = PACKET,
    seed: int = SEED,
    rows_per_piece: int = ROWS_PER_PIECE,
) -> tuple[DataFrame, DataFrame]:
    """(every row of docs, the mix).

    The first has a row for each row of docs: doc_id, size, source_size, target, and row_key,
    which tells rows apart. The mix has an entry for each stretch of a document it takes, in
    order: these columns, epoch, first_word and words of the stretch, finish (its virtual
    time), begins (words of the mix before it). Its words add up to the sum of all sizes, if
    `repeats` passes hold so many. It comes sorted in ranges of virtual time.

    Null and blank texts have size 0 and are never taken. Null sources are one source, the
    last. Rows that share a doc_id, and repeated rows, are documents of their own; of equal
    rows it does not matter which is taken. An empty table gives none. Other columns are not
    read. Documents are shuffled by a hash of seed and doc_id, so runs agree.

    The texts are read once; what is exchanged are short rows. Places inside a source come
    from sums over buckets of the hash, so a source with any share of all rows is spread.
    """
    spark = docs.sparkSession
    folder = f"{checkpoint_folder(spark)}/mix-{uuid.uuid4()}"
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    sized = _written(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.struct(F.col(source).cast("string").alias("source")).alias("source_key"),
            word_count(F.col(text)).alias("size"),
            F.substring(F.sha2(key, 256), 1, 16).alias("drawn"),
        ),
        folder,
        "sized",
    )
    totals = sized.agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("words")).first()
    budget = totals.words or 0
    weighed = weighed_sources(sized, weights, folder)
    sources = _written(with_targets(_written(weighed, folder, "weighed"), budget, repeats), folder, "targets")
    horizon = _horizon(sources, budget, repeats, packet)

    digits = max(0, math.ceil(math.log(max(1, totals.rows / rows_per_piece), 16)))
    sized = sized.withColumn("bucket", F.substring("drawn", 1, digits))
    buckets = sized.groupBy("source_key", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("bucket_before", _before("bucket_size", earlier)).join(sources, "source_key")
    inside = Window.partitionBy("source_key", "bucket").orderBy("drawn", "doc_id", "size")
    placed = sized.join(buckets, ["source_key", "bucket"]).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        F.struct("number", "bucket", F.row_number().over(inside).alias("nth")).alias("row_key"),
        (F.col("bucket_before") + _before("size", inside.rowsBetween(Window.unboundedPreceding, -1))).alias("start"),
    )
    return _merged(placed, folder, budget, totals.rows, horizon, repeats, packet, rows_per_piece)


def _merged(placed, folder, budget, n_rows, horizon, repeats, packet, rows_per_piece) -> tuple[DataFrame, DataFrame]:
    """The entries of all sources in one queue, cut at the budget."""
    none = F.lit(0).cast("long")

    def started(epoch: Column) -> Column:
        return F.col("start") + epoch * F.col("source_size")

    limit = F.col("target") * F.lit(horizon)
    epochs = F.filter(F.sequence(none, F.lit(repeats - 1).cast("long")), lambda e: started(e) < limit)
    firsts = F.sequence(none, F.floor((F.col("size") - 1) / packet) * packet, F.lit(packet).cast("long"))
    entries = F.flatten(
        F.transform(epochs, lambda e: F.transform(firsts, lambda f: F.struct(e.alias("epoch"), f.alias("first_word"))))
    )
    # Every row once as itself, with no words and no time; then its entries.
    itself = F.array(F.struct(F.lit(-1).cast("long").alias("epoch"), none.alias("first_word")))
    all_entries = F.when(F.col("size") > 0, F.concat(itself, entries)).otherwise(itself)
    words = F.least(F.lit(packet).cast("long"), F.col("size") - F.col("first_word"))
    begun = started(F.col("epoch")) + F.col("first_word")
    ranges = max(partitions(placed.sparkSession), math.ceil(n_rows / rows_per_piece))
    rows = (
        placed.select("*", F.inline(all_entries))
        .withColumns({"words": F.when(F.col("epoch") < 0, none).otherwise(words), "served": begun})
        .where((F.col("epoch") < 0) | (F.col("served") < limit))
        .withColumn(
            "finish", F.when(F.col("epoch") >= 0, (F.col("served") + F.col("words")).cast("double") / F.col("target"))
        )
        # Sources are served at constant rates: equal ranges of time hold about as many words.
        .withColumn("range", F.floor(F.col("finish") * ranges))
    )
    rows = _written(rows, folder, "entries")
    columns = ["doc_id", "size", "source_size", "target", "row_key"]
    timed = rows.where("epoch >= 0")
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = timed.groupBy("range").agg(F.sum("words").alias("n"))
    sums = sums.select("range", _before("n", earlier).alias("range_before")).where(F.col("range_before") < budget)
    inside = Window.partitionBy("range").orderBy("finish", "row_key.number", "served")
    begins = F.col("range_before") + _before("words", inside.rowsBetween(Window.unboundedPreceding, -1))
    merged = (
        timed.join(F.broadcast(sums) if ranges <= 100_000 else sums, "range")
        .repartitionByRange("range")
        .withColumn("begins", begins)
        .where(F.col("begins") < budget)
        .withColumn("words", F.least(F.col("words"), F.lit(budget) - F.col("begins")))
        .select(*columns, "epoch", "first_word", "words", "finish", "begins")
    )
    return rows.where("epoch < 0").select(*columns), merged


def taken(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken (words in the mix) of every row; see queue()."""
    rows, mixed = queue(docs, **options)
    columns = ["row_key", "doc_id", "size", "source_size", "target"]
    both = rows.select(*columns, F.lit(0).cast("long").alias("words")).unionByName(mixed.select(*columns, "words"))
    return both.groupBy(*columns).agg(F.sum("words").alias("taken")).drop("row_key")
