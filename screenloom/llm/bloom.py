"""A split-block Bloom filter as a small table, built and asked with DataFrame operations alone.

The hash of a key picks one row (block) of eight words, and one of 32 bits in each word. The table has at most
``MAX_BLOCKS`` rows, about 20 MB: a proven bound, so it may be broadcast. With more keys than it was made for it only
passes more false positives, which an exact join afterwards removes.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenloom.llm.common import fresh

KEYS_A_BLOCK, MAX_BLOCKS = 20, 1 << 18
#: Odd multipliers under 2^31 that pick the bit of each word.
SALTS = [0x47B6137B, 0x44974D91, 0x0824AD5B, 0x22B7289D, 0x705495C7, 0x2DF1424B, 0x1EFC4947, 0x5C6BFB31]


def _bits(key: str) -> list[Column]:
    """The bit of each word that ``key`` sets."""
    low = f"(xxhash64(`{key}`) & 4294967295L)"
    return [F.expr(f"shiftleft(1L, cast(shiftright({low} * {salt}L & 4294967295L, 27) AS int))") for salt in SALTS]


def _block(key: str, blocks: int) -> Column:
    return F.expr(f"shiftrightunsigned(xxhash64(`{key}`), 32) % {blocks}L")


def bloom(keys: DataFrame, key: str = "key") -> tuple[DataFrame, int]:
    """The filter of the column ``key`` as rows ``block, w0 ... w7``, and its number of blocks; a partial aggregate."""
    n = keys.count()
    blocks = min(MAX_BLOCKS, 1 << max(0, math.ceil(math.log2(max(1, n) / KEYS_A_BLOCK))))
    words = [F.bit_or(b).alias(f"w{k}") for k, b in enumerate(_bits(key))]
    return keys.groupBy(_block(key, blocks).alias("block")).agg(*words), blocks


def asked(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, Column]:
    """The rows with the words of their block beside them, and whether all bits are set."""
    filled, blocks = bloom(keys, key)
    word = fresh(rows.columns, "word")
    filled = filled.select(F.col("block").alias(word + "_block"), F.array(*(f"w{k}" for k in range(len(SALTS)))).alias(word))
    hit = reduce(Column.__and__, [F.col(word)[k].bitwiseAND(b) != 0 for k, b in enumerate(_bits(key))])
    return rows.join(F.broadcast(filled), _block(key, blocks) == F.col(word + "_block"), "left"), F.coalesce(hit, F.lit(False))


def possible(rows: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """The rows whose ``key`` may be among ``keys``: all that are, and few others."""
    found, hit = asked(rows, keys, key)
    return found.where(hit).select(*rows.columns)


def impossible(rows: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """The other rows: those whose ``key`` is certainly not among ``keys``, null keys too."""
    found, hit = asked(rows, keys, key)
    return found.where(~hit | F.col(key).isNull()).select(*rows.columns)
