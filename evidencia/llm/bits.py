"""A filter of fixed size for digests that were met in two places or more."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter: 4 MB, whatever the corpus.
BITS = 1 << 25


def words_of(met: DataFrame, column: str) -> np.ndarray:
    """The filter in words of 64 bits: bit ``digest mod BITS`` is set for every digest (bigint) of ``met``.

    Words are put together on the executors; the driver gets BITS / 64 rows at most.
    """
    bit = F.pmod(F.col(column), F.lit(BITS))
    words = met.select(F.shiftright(bit, 6).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod({column}, 64) as int))").alias("bit"))
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return out


def knows(words: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Which digests' bits are set: all that were met, and by chance others."""
    bit = digests % BITS
    return (words[bit >> 6] >> (bit & 63)) & 1 == 1


def known_rows(rows: DataFrame, digest: str, met: DataFrame) -> DataFrame:
    """``rows`` whose ``digest`` (bigint) stands in ``met``, and by chance others, without moving them.

    The filter is joined as a broadcast table of BITS / 64 rows at most, so its size is bounded whatever ``met`` holds.
    """
    bit = F.pmod(F.col(digest), F.lit(BITS))
    words = met.select(F.shiftright(bit, 6).alias("_word"), F.expr(f"shiftleft(1L, cast(pmod({digest}, 64) as int))").alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    tested = rows.withColumn("_word", F.shiftright(bit, 6)).join(F.broadcast(words), "_word")
    return tested.filter(F.expr(f"shiftrightunsigned(_bits, cast(pmod({digest}, 64) as int)) & 1L = 1L")).select(*rows.columns)
