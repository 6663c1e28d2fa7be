"""Document fingerprints by invertible Bloom lookup sketches.

A sketch has M cells in three tables. Each paragraph digest goes into one cell of each
table, which keeps the sum of their weights (a count over a check) and their XOR. The
cells of two sketches subtract, which leaves the digests that only one text has. A cell
with one digest gives it away; taking it out of its other cells frees more. When no
cell is left, all differing digests are known. If peeling stops earlier, a sketch four
times as large is tried. All of it is Spark expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazewatch.llm.common import checkpointed, partitions
from gazewatch.llm.quality import _let

CELLS = 48
TABLES = 3
#: Lines are paragraphs; longer ones are cut from their start into pieces of this length.
PIECE = 400
GROWTH_BITS = 2
#: Attempts beyond the size at which a sketch has two cells for every digest.
MORE_ATTEMPTS = 4
ROUNDS = 40


def paragraph_digests(text: Column) -> Column:
    """Distinct 64-bit digests of a text's paragraphs; blank lines are none."""
    pieces = F.regexp_extract_all(text, F.lit(f"([^\n]{{1,{PIECE}}})"), F.lit(1))
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def _weight(digest: Column) -> Column:
    """What a digest counts for in a cell: one, and a check of 32 bits below it."""
    return F.xxhash64(digest, F.lit("check")).bitwiseAND(F.lit(0xFFFFFFFF)) + F.lit(1 << 40)


def _entries(digests: Column, share: Column, seed: Column) -> Column:
    """What each digest adds to its three cells: (cell, weight, digest).

    `share` is the number of a table's cells, a power of two.
    """

    def place(hashed: Column, table: int) -> Column:
        bits = F.shiftrightunsigned(hashed, 20 * table).bitwiseAND(share - 1)
        return bits + share * table if table else bits

    hashed = F.transform(
        digests,
        lambda d: F.struct(d.alias("d"), _weight(d).alias("w"), F.xxhash64(d, seed).alias("h")),
    )
    return F.flatten(
        F.transform(
            hashed,
            lambda e: F.array(
                *[
                    F.struct(place(e["h"], t).alias("cell"), e["w"].alias("w"), e["d"].alias("d"))
                    for t in range(TABLES)
                ]
            ),
        )
    )


def _negative(cells: Column) -> Column:
    return F.transform(
        cells, lambda e: F.struct(e["cell"].alias("cell"), (-e["w"]).alias("w"), e["d"].alias("d"))
    )


def _added_up(entries: Column) -> Column:
    """One entry for each cell that is not empty: sort by cell, then fold each run."""

    def fold(first: Column, others: Column) -> Column:
        return F.aggregate(
            others,
            first,
            lambda t, e: F.struct(
                t["cell"].alias("cell"),
                (t["w"] + e["w"]).alias("w"),
                t["d"].bitwiseXOR(e["d"]).alias("d"),
            ),
        )

    def runs(ordered: Column) -> Column:
        begins = F.filter(
            F.sequence(F.lit(0), F.size(ordered) - 1),
            lambda i: (i == 0) | (F.get(ordered, i)["cell"] != F.get(ordered, i - 1)["cell"]),
        )
        return _let(
            begins,
            lambda b: F.transform(
                b,
                lambda start, k: fold(
                    F.get(ordered, start),
                    F.slice(ordered, start + 2, F.coalesce(F.get(b, k + 1), F.size(ordered)) - start - 1),
                ),
            ),
        )

    total = _let(F.sort_array(entries), lambda o: F.when(F.size(o) > 0, runs(o)).otherwise(o))
    return F.filter(total, lambda e: (e["w"] != 0) | (e["d"] != 0))


def sketch(digests: Column, share: Column, seed: Column) -> Column:
    """The cells of a set of digests that are not empty, in order."""
    return _added_up(_entries(digests, share, seed))


def base_sketch(digests: Column) -> Column:
    return sketch(digests, F.lit(CELLS // TABLES).cast("long"), F.lit(0))


def fingerprint(cells: Column) -> Column:
    """A base sketch as text: for each cell its place, sum of weights and XOR of digests, in hex."""
    hexed = F.transform(
        cells,
        lambda e: F.concat_ws(":", F.hex(e["cell"]), F.hex(e["w"]), F.hex(e["d"])),
    )
    return F.concat_ws(",", hexed)


def _peeled(cells: Column, share: Column, seed: Column) -> Column:
    """(number of digests recovered, number of cells left) of a difference of two sketches."""

    def step(state: Column) -> Column:
        pure = F.filter(state["cells"], lambda e: F.abs(e["w"]) == _weight(e["d"]))
        found = F.array_distinct(
            F.transform(pure, lambda e: F.struct(e["d"].alias("d"), (e["w"] > 0).alias("left")))
        )

        def take_out(f: Column) -> Column:
            side = lambda left: F.transform(
                F.filter(f, lambda e: e["left"] if left else ~e["left"]), lambda e: e["d"]
            )
            out = F.concat(
                state["cells"],
                _negative(_entries(side(True), share, seed)),
                _entries(side(False), share, seed),
            )
            return F.struct(
                _added_up(out).alias("cells"),
                (state["found"] + F.size(f)).cast("long").alias("found"),
                (F.size(f) == 0).alias("stuck"),
            )

        return F.when((F.size(state["cells"]) == 0) | state["stuck"], state).otherwise(_let(found, take_out))

    start = F.struct(
        cells.alias("cells"), F.lit(0).cast("long").alias("found"), F.lit(False).alias("stuck")
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, _: step(s))


def _difference(left: Column, right: Column, left_cells: Column, right_cells: Column) -> Column:
    """How many digests only one of two sets has, recovered from subtracted sketches.

    The first sketches are the base ones given; each retry makes those of the two sets
    anew with four times the cells and other places. In the astronomically rare case that
    even far larger ones fail, the sets themselves are compared.
    """
    first = F.lit(CELLS // TABLES).cast("long")
    most = F.size(left) + F.size(right)
    retries = F.greatest(
        F.lit(0), F.ceil(F.ln(F.greatest(most * 2.0, F.lit(1.0)) / CELLS) / math.log(2**GROWTH_BITS))
    ).cast("int")

    def decoded(left_cells: Column, right_cells: Column, share: Column, seed: Column) -> Column:
        ended = _peeled(_added_up(F.concat(left_cells, _negative(right_cells))), share, seed)
        return _let(ended, lambda s: F.when(F.size(s["cells"]) == 0, s["found"]))

    def attempt(number: Column) -> Column:
        return _let(
            F.call_function("shiftleft", first, number * GROWTH_BITS),
            lambda share: decoded(sketch(left, share, number), sketch(right, share, number), share, number),
        )

    tried = F.aggregate(
        F.sequence(F.lit(1), retries + MORE_ATTEMPTS),
        decoded(left_cells, right_cells, first, F.lit(0)),
        lambda done, number: F.when(done.isNotNull(), done).otherwise(attempt(number)),
    )
    plain = F.size(F.array_except(left, right)) + F.size(F.array_except(right, left))
    return F.coalesce(tried, plain.cast("long"))


def likeness(left: Column, right: Column, left_cells: Column, right_cells: Column) -> Column:
    """Shared digests by all digests of two sets: 1 for equal sets, 0 for nothing in common."""
    total = F.size(left) + F.size(right)
    return F.when(total == 0, F.lit(1.0)).otherwise(
        _let(_difference(left, right, left_cells, right_cells), lambda d: (total - d) / (total + d))
    )


def _row_keys(doc_id: str, text: str) -> list[Column]:
    """128 bits that tell rows apart by id and text, null or not."""
    return [
        F.xxhash64(F.col(doc_id), F.col(text)).alias("k1"),
        F.xxhash64(F.lit("row"), F.col(text), F.col(doc_id)).alias("k2"),
    ]


def next_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """k1, k2, n_chars of every distinct row and the keys p1, p2 of the row before it.

    The order is descending doc_id, null ids last, equal ids by key; after the last row
    comes the first. Ranges of ids are ordered by themselves; only their edges, one row for
    each range, meet in one task.
    """
    rows = (
        docs.select(
            F.col(doc_id).alias("id"),
            *_row_keys(doc_id, text),
            F.length(F.coalesce(F.col(text), F.lit(""))).alias("n_chars"),
        )
        .distinct()
        .repartitionByRange(partitions(docs.sparkSession), F.desc_nulls_last("id"), F.asc("k1"))
        .withColumn("range", F.spark_partition_id())
    )
    rows = checkpointed(rows)
    order = [F.desc_nulls_last("id"), F.asc("k1"), F.asc("k2")]
    within = Window.partitionBy("range").orderBy(*order)
    own = F.struct("k1", "k2", "n_chars")
    placed = rows.withColumns({"previous": F.lag(own).over(within), "left": F.count("*").over(within)})
    # The last row of each range comes before the first row of the next range with rows.
    ends = rows.groupBy("range").agg(
        F.max_by(own, F.struct(F.col("id").isNull(), -F.coalesce("id", F.lit(0)), "k1", "k2")).alias("last")
    )
    around = Window.orderBy("range")
    whole = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = ends.select(
        "range", F.coalesce(F.lag("last").over(around), F.last("last").over(whole)).alias("before")
    )
    return placed.join(edges, "range").select(
        "k1",
        "k2",
        F.coalesce("previous", "before")["k1"].alias("p1"),
        F.coalesce("previous", "before")["k2"].alias("p2"),
        F.coalesce("previous", "before")["n_chars"].alias("p_chars"),
    )


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every row's text and edited text, and likenesses, as named below.

    doc_id, n_chars, edited (text), fingerprint, edited_fingerprint, near_edited, near_next and
    next_id, the next row's doc_id.
    The edited text has its last floor(n_chars / 2) characters replaced by the first as many
    of the next row's text. Null texts are empty; identical rows count as one place in the
    order and give equal results. A sole row is its own next one. The texts are shuffled
    once; to the row before it a row sends only the characters that one needs, and its
    digests.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole.alias("text"), *_row_keys(doc_id, text))
    # Both reads of the rows take the same columns, so they share one exchange.
    sent = rows.join(next_rows(docs, doc_id, text), ["k1", "k2"]).select(
        F.col("doc_id").alias("next_id"),
        F.col("p1").alias("k1"),
        F.col("p2").alias("k2"),
        F.substring("text", F.lit(1), F.floor(F.col("p_chars") / 2).cast("int")).alias("head"),
        paragraph_digests(F.col("text")).alias("next_digests"),
    )
    sent = sent.dropDuplicates(["k1", "k2"])
    n = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - F.floor(n / 2).cast("int")), F.col("head"))
    met = rows.join(sent, ["k1", "k2"]).select(
        "doc_id",
        "next_id",
        F.length("text").cast("long").alias("n_chars"),
        edited.alias("edited"),
        paragraph_digests(F.col("text")).alias("digests"),
        paragraph_digests(edited).alias("edited_digests"),
        "next_digests",
    )
    met = met.withColumns(
        {
            "cells": base_sketch(F.col("digests")),
            "edited_cells": base_sketch(F.col("edited_digests")),
            "next_cells": base_sketch(F.col("next_digests")),
        }
    )
    near = lambda other: likeness(*[F.col(c) for c in ("digests", f"{other}_digests", "cells", f"{other}_cells")])
    return met.select(
        "doc_id",
        "n_chars",
        "edited",
        fingerprint(F.col("cells")).alias("fingerprint"),
        fingerprint(F.col("edited_cells")).alias("edited_fingerprint"),
        near("edited").alias("near_edited"),
        near("next").alias("near_next"),
        "next_id",
    )
