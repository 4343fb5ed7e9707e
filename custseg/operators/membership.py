"""Semi join of a large fact with a key set, behind a Bloom filter of fixed size.

``Customer_Key %in% keys`` over a fact is a semi join; when the key set is too large
to broadcast, every fact row is shuffled although most have no partner.  Here the
keys are first folded into a Bloom filter: ``words`` 64-bit words, each key setting
``HASHES`` bits of one word (``bit_or``, combined map-side).  Its size is a parameter,
not a property of the data: at most ``MAX_WORDS`` words, 2 MB.  The fact is filtered by
the words as a scalar subquery -- a plain predicate, since a semi join would be moved
below a join with a table of words, and the shuffle with it.  A fact row whose bits
are not all set has no partner and leaves before the shuffle; what passes -- the
members and a few false positives -- meets the exact semi join.  More keys than
``keys_bound`` let more false positives pass; the result is exact in any case.

Cases: NULL keys are in no set; repeated keys keep one copy of each fact row; an empty
set gives no row; other columns, whatever their names, pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASHES = 4
BITS_PER_KEY = 16
MAX_WORDS = 1 << 18                 # 2 MB
_EXACT = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.DateType)


def words_for(keys_bound: int, bits_per_key: int = BITS_PER_KEY) -> int:
    return min(max(math.ceil(keys_bound * bits_per_key / 64), 1), MAX_WORDS)


def _word(key: str, words: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key), F.lit(1)), F.lit(words)).cast("int")


def _bits(key: str) -> Column:
    g = F.xxhash64(F.col(key), F.lit(2))
    out = F.lit(0).cast("long")
    for i in range(HASHES):
        place = F.shiftright(g, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return out


def bloom_words(keys: DataFrame, key: str, words: int) -> DataFrame:
    """One row, one array of ``words`` longs."""
    some = keys.filter(F.col(key).isNotNull()).select(_word(key, words).alias("w"), _bits(key).alias("b"))
    every = keys.sparkSession.range(words).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("long").alias("b"))
    full = some.unionByName(every).groupBy("w").agg(F.bit_or("b").alias("b"))
    return full.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("words"))


def may_contain(facts: DataFrame, keys: DataFrame, key: str, keys_bound: int) -> DataFrame:
    """The rows of ``facts`` that pass the filter of ``keys``: all members, few others."""
    _same_type(facts, keys, key)
    words = words_for(keys_bound)
    held = F.get(bloom_words(keys, key, words).scalar(), _word(key, words))
    return facts.filter(F.col(key).isNotNull() & (held.bitwiseAND(_bits(key)) == _bits(key)))


def bloom_semi_join(facts: DataFrame, keys: DataFrame, key: str, keys_bound: int) -> DataFrame:
    """``facts`` left-semi-joined with ``keys`` on ``key``; ``keys_bound`` sizes the filter."""
    return may_contain(facts, keys, key, keys_bound).join(keys.select(key), key, "left_semi").select(
        *[f"`{c}`" for c in facts.columns])


def _same_type(facts: DataFrame, keys: DataFrame, key: str) -> None:
    """Equal values of different types hash differently, so both sides need one exact type."""
    a, b = facts.schema[key].dataType, keys.schema[key].dataType
    if a != b or not isinstance(a, _EXACT):
        raise ValueError(f"{key}: {a.simpleString()} and {b.simpleString()}; one integer, string or date type is needed")
