"""Paged text: pages of a PDF or members of an archive, assembled in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazewatch.functions import text as X
from gazewatch.functions.rows import where_present
from gazewatch.sources.documents import split_lines

# Pages per piece of a file.
PAGE_TILE = 1024


def filled_pages(pages: DataFrame) -> DataFrame:
    """Stripped pages, blank ones dropped."""
    return where_present(pages, "text", F.nullif(X.strip(F.col("text")), F.lit("")))


def _placed(pages: DataFrame, key: list[str], page: str, size: Column) -> DataFrame:
    """Adds where each page begins in its file (``_begin``), its number from 1 (``_number``) and
    the size of the file (``_total``), given the size of a page.

    Sizes are added up by tiles of pages, so no task holds a file. Keys are compared inside
    a struct, where a null is a value like any other.
    """
    sized = pages.withColumns(
        {"_key": F.struct(*key), "_tile": F.floor(F.col(page) / PAGE_TILE), "_size": size.cast("bigint")}
    )
    none = F.lit(0).cast("bigint")
    tiles = sized.groupBy("_key", "_tile").agg(F.sum("_size").alias("_sizes"), F.count(F.lit(1)).alias("_pages"))
    file = Window.partitionBy("_key")
    earlier = file.orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    tiles = tiles.select(
        "_key",
        "_tile",
        F.coalesce(F.sum("_sizes").over(earlier), none).alias("_sizes_before"),
        F.coalesce(F.sum("_pages").over(earlier), none).alias("_pages_before"),
        F.sum("_sizes").over(file).alias("_total"),
    )
    within = Window.partitionBy("_key", "_tile").orderBy(page)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    return sized.join(tiles, ["_key", "_tile"]).withColumns(
        {
            "_begin": F.col("_sizes_before") + F.coalesce(F.sum("_size").over(before), none),
            "_number": F.col("_pages_before") + F.row_number().over(within),
        }
    )


def assembled_text(pages: DataFrame, key: str, page: str) -> DataFrame:
    """The text of each file in order: its pages with the place where each begins in the whole.

    The whole is the stripped pages with an empty line between them; ``begins`` counts
    characters from its start, so pages are found without building it and no task or cell
    ever holds a file.
    """
    placed = _placed(filled_pages(pages), [key], page, F.length("text") + 2)
    return placed.select(
        key, page, F.col("_number").cast("bigint").alias("n"), F.col("_begin").alias("begins"), "text"
    )


def page_lines(pages: DataFrame, entry_scoped: bool = False) -> DataFrame:
    """Paged text in the common line layout, without ever building a whole file.

    With ``entry_scoped`` each line also tells where its page begins and ends, ``from_line`` and
    ``to_line``; acts then stay inside their page.

    Pages are separated by one empty line, which is put before each page here; the one
    before the first page falls away. Pages are placed by their numbers of lines before
    they are cut, so single lines are neither shuffled nor sorted.
    """
    file = ["file_name", "secao", "edition_date"]
    feeds = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    placed = _placed(filled_pages(pages), file, "page_no", feeds + 2)
    cut = placed.select(
        *file,
        (F.col("_total") - 1).alias("n_lines"),
        "_begin",
        "_size",
        F.posexplode(F.concat(F.array(F.lit("")), split_lines(F.col("text")))).alias("_at", "line"),
    )
    line_no = (F.col("_begin") + F.col("_at") - 1).cast("bigint").alias("line_no")
    limits = [F.col("_begin").cast("bigint").alias("from_line"), (F.col("_begin") + F.col("_size") - 1).cast("bigint").alias("to_line")]
    return cut.select(*file, "n_lines", line_no, "line", *(limits if entry_scoped else [])).where("line_no >= 0")
