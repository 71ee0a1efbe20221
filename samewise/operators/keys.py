"""Keys of a record for the inverted index: one row per (record, tag, key), with its multiplicity tf.

F all skeleton words, sorted and run together (up to 8 words); T skeleton words of two letters and more;
B adjacent skeleton words; G 4-grams of the skeleton; P postal code and a distinctive address word; N number
and distinctive word; A adjacent distinctive words, if there is no number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables
from ..functions.text import shingles, tokens

NAME_TAGS, ADDRESS_TAGS = ("F", "T", "B", "G"), ("P", "N", "A")
#: (words with a postal code, numbers, words with a number) of the wide and the narrow variant.
NARROW, WIDE = (5, 2, 4), (6, 3, 5)


def none() -> Column:
    return F.array().cast("array<string>")


def adjacent(words: Column, joint: str) -> Column:
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(joint), b))
    return F.when(F.size(words) > 1, pairs).otherwise(none())


def sampled(grams: Column) -> Column:
    """A quarter of the grams, the same everywhere: those whose tagged md5 starts with 0, 4, 8 or c."""
    return F.filter(grams, lambda g: F.left(F.md5(F.concat(F.lit("G"), g).cast("binary")), F.lit(1)).isin("0", "4", "8", "c"))


def record_keys(records: DataFrame, wide: bool = False, sample: bool = True, tags: tuple[str, ...] = NAME_TAGS + ADDRESS_TAGS) -> DataFrame:
    """(entity_id, country_key, tag, key, tf) of normalised records (s_name, n_addr, postal), as single_keys has them one by one."""
    return single_keys(records, wide, sample, tags).groupBy("entity_id", "country_key", "tag", "key").agg(F.count("*").alias("tf"))


def single_keys(records: DataFrame, wide: bool = False, sample: bool = True, tags: tuple[str, ...] = NAME_TAGS + ADDRESS_TAGS) -> DataFrame:
    """(entity_id, country_key, tag, key), a row for each time that a record has a key.

    wide: more address keys, all grams once each, short names as a gram. sample keeps a quarter of the grams.
    """
    with_postal, with_number, words_of_number = WIDE if wide else NARROW
    names = tokens(F.col("s_name"))
    address = tokens(F.col("n_addr"))
    numbers = F.filter(address, lambda t: t.rlike("^[0-9]"))
    words = F.filter(address, lambda t: ~t.rlike("^[0-9]") & (F.length(t) >= 3) & ~t.isin(tables.GENERIC_ADDRESS))
    grams = F.array_distinct(shingles(F.col("s_name"), short=True)) if wide else shingles(F.col("s_name"))
    bare = F.filter(F.transform(F.slice(numbers, 1, with_number), lambda n: F.regexp_replace(n, "[a-z]+$", "")), lambda n: n != "")
    own = {
        "F": F.when((F.size(names) > 0) & (F.size(names) <= 8), F.array(F.array_join(F.array_sort(names), ""))).otherwise(none()),
        "T": F.array_distinct(F.filter(names, lambda t: F.length(t) >= 2)),
        "B": adjacent(names, ""),
        "G": grams if wide or not sample else sampled(grams),
        "P": F.when(F.col("postal") != "", F.transform(F.slice(words, 1, with_postal), lambda w: F.concat(F.col("postal"), F.lit("|"), w))).otherwise(none()),
        "N": F.flatten(F.transform(bare, lambda n: F.transform(F.slice(words, 1, words_of_number), lambda w: F.concat(n, F.lit("|"), w)))),
        "A": F.when(F.size(numbers) == 0, adjacent(words, "|")).otherwise(none()),
    }

    def tagged(t: str) -> Column:
        return F.transform(own[t], lambda k: F.struct(F.lit(t).alias("tag"), k.alias("key")))

    every = F.concat(*map(tagged, tags))
    return records.select("entity_id", "country_key", F.explode(every).alias("k")).select("entity_id", "country_key", "k.tag", "k.key")
