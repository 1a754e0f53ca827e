"""J8 for large blacklists: a listed domain covers its hosts, and a Bloom filter thins the join.

The blacklist is written once as its distinct entries, and a Bloom filter of them is built as one
array of 64-bit words (``bit_or`` per word, a scalar subquery where it is read).  Its size is
checked: at most ``MAX_WORDS`` words (4 MB); a blacklist too large for that is joined without one.
The domains' label suffixes pass the filter before the shuffle, so suffixes such as ``com`` that all
domains share don't reach it, and the exact join decides what is left.

Defined results: host and entry are compared in lower case, without user info, port and a final dot;
null or empty entries list nothing; a null domain is not listed; an IPv4 address is covered only by itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.url import join_host
from ..session import materialize

HASHES = 4
BITS_PER_ENTRY = 10
MAX_WORDS = 1 << 19
#: Below this many bits an entry the filter would let too much through to be worth its pass.
MIN_BITS_PER_ENTRY = 4


@dataclass(frozen=True)
class Screen:
    """A prepared blacklist: its distinct entries (column ``listed``), and the Bloom filter's words (one row) if it has one."""
    entries: DataFrame
    bloom: DataFrame | None
    words: int


def _host(domain: Column) -> Column:
    return F.regexp_replace(join_host(domain), r"[.]\z", "")


def label_suffixes(host: Column) -> Column:
    """The host and each of its parent domains; an IPv4 address has none."""
    labels = F.split(host, "[.]")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(host.rlike(r"\A[0-9.]+\z"), F.array(host)).otherwise(parents)


def _bits(key: Column, words: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(64 * words)) for i in range(HASHES)]


def bloom_filter(keys: DataFrame, words: int) -> DataFrame:
    """One row ``(bits)``: the filter of column ``listed`` as an array of ``words`` longs."""
    one = F.lit(1).cast("long")
    bit = keys.select(F.explode(F.array(*_bits(F.col("listed"), words))).alias("bit"))
    set_words = bit.groupBy(F.floor(F.col("bit") / 64).alias("id")).agg(
        F.bit_or(F.call_function("shiftleft", one, (F.col("bit") % 64).cast("int"))).alias("word"))
    every = keys.sparkSession.range(words).join(set_words, "id", "left")
    pairs = F.array_sort(F.collect_list(F.struct("id", F.coalesce("word", F.lit(0).cast("long")).alias("word"))))
    return every.agg(F.transform(pairs, lambda p: p["word"]).alias("bits"))


def might_contain(bloom: DataFrame, words: int, key: Column) -> Column:
    bits, hit = bloom.scalar(), F.lit(True)
    for at in _bits(key, words):
        word = F.get(bits, F.floor(at / 64).cast("int"))
        hit = hit & (F.call_function("shiftright", word, (at % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
    return hit


def screen(blacklist: DataFrame, use_bloom: bool = True) -> Screen:
    """Prepare a blacklist ``(domain)`` once, for any number of batches."""
    listed = blacklist.select(_host(F.col("domain")).alias("listed")).filter("listed <> ''").distinct()
    entries = materialize(listed, "blacklist")
    n = entries.count()
    words = 16
    while words < MAX_WORDS and 64 * words < BITS_PER_ENTRY * n:
        words *= 2
    if not use_bloom or 64 * words < MIN_BITS_PER_ENTRY * n:
        return Screen(entries, None, 0)
    return Screen(entries, materialize(bloom_filter(entries, words), "blacklist_bloom"), words)


def candidates(domains: DataFrame, blacklist: Screen) -> DataFrame:
    """``(domain, listed)``: the distinct domains with those of their suffixes that may be listed."""
    d = domains.select("domain").distinct().select("domain", F.explode(label_suffixes(_host(F.col("domain")))).alias("listed"))
    return d if blacklist.bloom is None else d.filter(might_contain(blacklist.bloom, blacklist.words, F.col("listed")))


def listed_domains(domains: DataFrame, blacklist: Screen) -> DataFrame:
    """The distinct domains that the blacklist covers, by themselves or by a parent."""
    return candidates(domains, blacklist).join(blacklist.entries, "listed").select("domain").distinct()
