"""Token hashes, SimHash, bands and name-based UUIDs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import words

#: Name space of DNS names in RFC 4122.
DNS = "6ba7b8109dad11d180b400c04fd430c8"


def token_hash(token: Column) -> Column:
    """The low 64 bits of a token's MD5, as a signed bit pattern."""
    return F.conv(F.substring(F.md5(token), 17, 16), 16, -10).cast("bigint")


def simhash(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, simhash): per bit the sign of the tokens' votes, ties to 1; repeated tokens vote each time.

    Null or empty text gives 0, text without a word all ones. One aggregation by key with partial sums: text of any
    length (up to four thousand million words) is folded as it streams by.
    """
    base = texts.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    votes = base.select(key, F.explode(words(F.col("_t"))).alias("_w")).select(key, token_hash(F.col("_w")).alias("_h"))
    # one sum counts two bits, i and i + 32, in the halves of a long
    pair = F.lit((1 << 32) + 1).cast("bigint")
    sums = votes.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *(F.sum(F.shiftrightunsigned("_h", i).bitwiseAND(pair)).alias(f"_b{i}") for i in range(32)))
    bits = F.lit(0).cast("bigint")
    for i in range(32):
        for at, ones in ((i, F.col(f"_b{i}").bitwiseAND(F.lit((1 << 32) - 1).cast("bigint"))), (i + 32, F.shiftrightunsigned(f"_b{i}", 32))):
            bits = bits.bitwiseOR(F.when(2 * ones >= F.col("_n"), F.shiftleft(F.lit(1).cast("bigint"), at)).otherwise(F.lit(0).cast("bigint")))
    done = sums.select(key, bits.alias("simhash"))
    blank = F.when(F.col("_t") == "", F.lit(0)).otherwise(F.lit(-1)).cast("bigint")
    return base.select(key, blank.alias("_none")).join(done, key, "left").select(key, F.coalesce("simhash", "_none").alias("simhash"))


def band_keys(fingerprint: Column, bits: int = 64, bands: int = 8) -> Column:
    """The bands of a fingerprint, lowest first, as texts ``band<i>:<value>``."""
    size = bits // bands
    mask = F.lit((1 << size) - 1).cast("bigint")
    return F.array(*(F.concat(F.lit(f"band{b}:"), F.shiftrightunsigned(fingerprint, b * size).bitwiseAND(mask).cast("string")) for b in range(bands)))


def uuid5_hex(name: Column, space: str = DNS) -> Column:
    """Version 5 UUID of a name, 32 hex digits without dashes."""
    h = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15))
