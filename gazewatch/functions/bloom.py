"""Bloom filters of row keys, built and probed with built-in functions only.

A filter is a table of blocks of 32,768 bits, each an array of 512 words. A key's hash names
its block and the bits it sets there, so a probe is one join with a small table that every
executor holds. A filter never exceeds MAX_BLOCKS blocks (8 MB), whatever the number of keys:
one that is too small lets more rows pass, and never drops one that it should keep.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 15
WORDS = 1 << (BLOCK_BITS - 6)
MAX_BLOCKS = 2048
BITS_PER_KEY = 16
PROBES = 4


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(key, F.lit(blocks)).cast("int")


def _bits(key: Column) -> list[Column]:
    """The bits of a key inside its block, from parts of a hash of the key."""
    mixed = F.xxhash64(key)
    return [F.shiftrightunsigned(mixed, BLOCK_BITS * i).bitwiseAND((1 << BLOCK_BITS) - 1) for i in range(PROBES)]


def blocks_for(n_keys: int) -> int:
    wanted = -(-n_keys * BITS_PER_KEY // (1 << BLOCK_BITS))
    return max(1, min(MAX_BLOCKS, wanted))


def bloom_filter(keys: DataFrame, key: Column, blocks: int) -> DataFrame:
    """(_block, _words): the filter of all keys. Bits combine before they are exchanged."""
    bits = keys.select(_block(key, blocks).alias("_block"), F.explode(F.array(*_bits(key))).alias("_bit"))
    words = bits.groupBy("_block", F.shiftright("_bit", 6).cast("int").alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_bit & 63 AS INT))")).alias("_value")
    )
    held = F.map_from_entries(F.collect_list(F.struct("_word", "_value")))
    filled = F.transform(
        F.sequence(F.lit(0), F.lit(WORDS - 1)),
        lambda w: F.coalesce(F.try_element_at("_held", w), F.lit(0).cast("bigint")),
    )
    return words.groupBy("_block").agg(held.alias("_held")).select("_block", filled.alias("_words"))


def may_be_in(rows: DataFrame, key: Column, blooms: DataFrame, blocks: int) -> DataFrame:
    """The rows whose key the filter may hold: all that it holds, and few others."""
    columns = rows.columns
    keyed = rows.withColumn("_key", key).withColumn("_block", _block(F.col("_key"), blocks))
    one = F.lit(1).cast("bigint")
    tests = []
    for bit in _bits(F.col("_key")):
        word = F.get("_words", F.shiftright(bit, 6).cast("int"))
        tests.append(F.call_function("shiftrightunsigned", word, bit.bitwiseAND(63).cast("int")).bitwiseAND(one) == one)
    return keyed.join(F.broadcast(blooms), "_block").where(reduce(Column.__and__, tests)).select(*columns)
