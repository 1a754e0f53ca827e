"""MinHash near-duplicate detection with tensored banding.

Two small collections of GROUPS band hashes each (every band hash joins
ROWS min-hashes) are computed per document; the keys of GROUPS**2 tables are
formed by combining each band of the one with each band of the other, so 100
tables of four min-hashes need 40 min-hashes instead of 400.  A pair of
similarity 0.85 misses all tables with probability 5e-6, one of 0.8 with 7e-5.
The threshold is an argument (85 percent unless given).

Candidates are verified on the full shingle sets.  No group is expanded into
all its pairs: equal sets are one class; within a table bucket every member is
first compared with the bucket's leader (the member with the fewest shingles
that occur nowhere else); members that are then in another component than their
leader are paired by a prefix filter (``prefix_pairs``) on their rarest shingles.
So each colliding pair is either verified, proven too different, or already connected.

Defined results: null or empty text has an empty set and no links; texts of
fewer than SHINGLE words have one shingle; rows that repeat are one class; a
null doc_id is never linked (component null, kept); documents that share a
doc_id are one node; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lurescope.llm import common as C
from lurescope.llm.components import components
from lurescope.llm.hashing import WordHashes, mix, shingles

SHINGLE = 5
THRESHOLD = 85  # percent, unless a caller gives its own
GROUPS = 10
ROWS = 2
SEED = 20240229
#: Postings of one item that one task pairs up.
ITEM_ROWS = 2000


def _multipliers() -> np.ndarray:
    rng = np.random.RandomState(SEED)
    return (rng.randint(0, 1 << 62, 2 * GROUPS * ROWS).astype(np.uint64) << np.uint64(1)) | np.uint64(1)


def min_hashes(items: np.ndarray, mult: np.ndarray, block: int = 1 << 15) -> np.ndarray:
    """Minimum of each multiplicative hash over the (already mixed) items."""
    low = np.full(len(mult), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(items), block):
        low = np.minimum(low, np.multiply.outer(mult, items[at:at + block]).min(axis=1))
    return low


def band_hashes(items: np.ndarray, mult: np.ndarray) -> np.ndarray:
    """The 2 * GROUPS band hashes; the first half are one collection, the rest the other."""
    low = mix(min_hashes(items, mult)).reshape(2 * GROUPS, ROWS)
    acc = np.arange(1, 2 * GROUPS + 1, dtype=np.uint64)
    for r in range(ROWS):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + low[:, r])
    return acc


def _sets(batch, words):
    for raw in batch.column("text"):
        raw = raw.as_py()
        yield shingles(words.of(raw.lower().split()), SHINGLE) if raw else np.empty(0, np.uint64)


def _set_key(s: np.ndarray) -> tuple[int, int]:
    """Order-independent 128-bit key of a set."""
    a = mix(s).sum(dtype=np.uint64)
    b = mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


SIGNATURE = "doc_id long, n long, s1 long, s2 long, bands array<long>"


def _signatures(batches):
    words, mult = WordHashes(), _multipliers()
    none = np.zeros(0, np.int64)
    for batch in batches:
        n, s1, s2, bands = [], [], [], []
        for s in _sets(batch, words):
            n.append(len(s))
            k = _set_key(s)
            s1.append(k[0])
            s2.append(k[1])
            bands.append(band_hashes(s, mult).astype(np.int64) if len(s) else none)
        offsets = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([none, *bands])))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(s1, pa.int64()),
                                          pa.array(s2, pa.int64()), lists], ["doc_id", "n", "s1", "s2", "bands"])


def _token_sets(batches):
    words = WordHashes()
    for batch in batches:
        s1, s2, sets = [], [], []
        for s in _sets(batch, words):
            k = _set_key(s)
            s1.append(k[0])
            s2.append(k[1])
            sets.append(s.astype(np.int64))
        offsets = np.concatenate([[0], np.cumsum([len(b) for b in sets])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), lists],
                                         ["doc_id", "s1", "s2", "items"])


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_or_empty(F.col("text")).cast("binary").alias("text"))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, set size, set key and band hashes per document."""
    return _input(docs).mapInArrow(_signatures, SIGNATURE)


def shared_keys(rows: DataFrame, key: str, extra: list[str]) -> DataFrame:
    """The rows whose key occurs in two rows or more (counts combine before the shuffle)."""
    often = rows.groupBy(key).agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    return rows.join(often.select(F.col(key).alias("_k")), F.col(key) == F.col("_k")).select(key, *extra)


def table_buckets(classes: DataFrame) -> DataFrame:
    """(bucket, i, j, rep) of the combined tables (i, j), for buckets of two classes or more.

    A table key can only repeat where both of its bands do, so bands that no
    other class has are dropped before the keys are combined.
    """
    bands = classes.select("rep", F.posexplode("bands").alias("band", "value"))
    bands = shared_keys(bands.select("rep", "band", F.xxhash64("band", "value").alias("bkey"), "value"), "bkey", ["rep", "band", "value"])
    pairs = bands.groupBy("rep").agg(
        F.collect_list(F.when(F.col("band") < GROUPS, F.struct("band", "value"))).alias("a"),
        F.collect_list(F.when(F.col("band") >= GROUPS, F.struct("band", "value"))).alias("b"))  # at most 2 * GROUPS
    keys = pairs.select("rep", F.explode("a").alias("a"), "b").select("rep", "a", F.explode("b").alias("b")) \
                .select("rep", F.col("a.band").cast("byte").alias("i"), F.col("b.band").cast("byte").alias("j"),
                        F.xxhash64("a.band", "a.value", "b.band", "b.value").alias("bucket"))
    return shared_keys(keys, "bucket", ["rep", "i", "j"])


def own_items(sets: DataFrame) -> DataFrame:
    """Per class the number of items that no other candidate class has."""
    items = sets.select("rep", F.explode("items").alias("item"))
    single = items.groupBy("item").agg(F.count(F.lit(1)).alias("c"), F.min("rep").alias("rep")).filter("c = 1")
    return single.groupBy("rep").agg(F.count(F.lit(1)).alias("own"))


def reachable(n1: Column, own1: Column, n2: Column, own2: Column, threshold: int) -> Column:
    """False only if the pair can't reach the threshold: own items are never shared."""
    most = F.least(n1 - own1, n2 - own2)
    return 100 * most >= threshold * (n1 + n2 - most)


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (x, y) whose full sets reach the threshold."""
    left = sets.select(F.col("rep").alias("x"), F.col("items").alias("xs"))
    right = sets.select(F.col("rep").alias("y"), F.col("items").alias("ys"))
    both = F.size(F.array_intersect("xs", "ys"))
    joined = pairs.join(left, "x").join(right, "y")
    return joined.filter(100 * both >= threshold * (F.size("xs") + F.size("ys") - both)).select("x", "y")


def open_classes(led: DataFrame) -> DataFrame:
    """(rep, component, apart) of the classes in buckets whose leader left someone apart."""
    apart = F.col("component") != F.col("lead_component")
    where = led.filter(apart).select(F.col("bucket").alias("b")).distinct()
    return led.join(where, F.col("bucket") == F.col("b"), "left_semi") \
              .groupBy("rep").agg(F.first("component").alias("component"), F.max(apart).alias("apart"))


def prefix_pairs(classes: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs (x, y) of different components that can reach the threshold, x of a class left apart.

    Every set's items are put in one order, the rarest first.  Two sets that reach
    the threshold share an item among the first ``n - ceil(threshold * n) + 1`` of each,
    and what follows the first shared one must be enough for the rest of the overlap.
    So a family whose members differ in rare items pairs up on those items only,
    not within its buckets.  Items that many prefixes have are split over tasks.
    """
    n = F.col("n")
    held = C.materialize(sets.join(classes, "rep").select("rep", "component", "apart", n, F.explode("items").alias("item")), "minhash_open")
    common = held.groupBy("item").agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy("rep").orderBy("c", "item")
    firsts = held.join(common, "item").withColumn("at", F.row_number().over(order)) \
                 .filter((F.col("at") <= n - F.ceil(threshold * n / 100) + 1) & (F.col("c") > 1)).drop("c")
    firsts = C.materialize(firsts, "minhash_prefixes")
    parts = firsts.groupBy("item").agg(F.count(F.lit(1)).alias("c"), F.max("apart").alias("any")).filter("c > 1 and any") \
                  .select(F.col("item").alias("k"), (F.floor(F.col("c") / ITEM_ROWS) + 1).cast("int").alias("parts"))
    firsts = firsts.join(parts, F.col("item") == F.col("k")).drop("k")
    left = firsts.filter("apart").withColumn("part", F.pmod(F.hash("rep"), "parts"))
    right = firsts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))) \
                  .select(*[F.col(c).alias(f"{c}2") for c in ("rep", "component", "apart", "n", "item", "at", "part")])
    most = F.least(n - F.col("at"), F.col("n2") - F.col("at2")) + 1
    pairs = left.join(right, (F.col("item") == F.col("item2")) & (F.col("part") == F.col("part2")) & (F.col("component") != F.col("component2"))
                      & (~F.col("apart2") | (F.col("rep") < F.col("rep2"))) & (100 * most >= threshold * (n + F.col("n2") - most)))
    return pairs.select(F.least("rep", "rep2").alias("x"), F.greatest("rep", "rep2").alias("y")).distinct()


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per document; links from ``threshold`` percent on."""
    sig = C.materialize(signatures(docs), "minhash_signatures")
    real = sig.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = C.materialize(real.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"),
                                                         F.first("bands").alias("bands")), "minhash_classes")
    buckets = C.materialize(table_buckets(classes), "minhash_buckets")
    wanted = C.materialize(classes.join(buckets.select("rep").distinct(), "rep").select("rep", "n", "s1", "s2"), "minhash_wanted")
    # the candidates' sets, from their texts; candidates grow with the corpus, so the texts move (once), not
    # a copy of all candidates to each task
    chosen = _input(docs).join(wanted.select(F.col("rep").alias("r")).distinct().hint("shuffle_hash"),
                               F.col("doc_id") == F.col("r"), "left_semi")
    items = chosen.mapInArrow(_token_sets, "doc_id long, s1 long, s2 long, items array<long>").dropDuplicates(["doc_id", "s1", "s2"])
    sets = C.materialize(wanted.join(items.withColumnRenamed("doc_id", "rep"), ["rep", "s1", "s2"]).select("rep", "n", "items"),
                         "minhash_sets")
    facts = sets.select("rep", "n").join(own_items(sets), "rep", "left") \
                .select("rep", "n", F.coalesce("own", F.lit(0)).alias("own")) \
                .filter(100 * (F.col("n") - F.col("own")) >= threshold * F.col("n"))
    facts = C.materialize(facts, "minhash_facts")
    members = C.materialize(buckets.join(facts, "rep"), "minhash_members")
    lead = members.groupBy("bucket").agg(F.min(F.struct("own", "rep", "n")).alias("lead"))
    led = C.materialize(members.join(lead, "bucket"), "minhash_led")
    first = led.filter(F.col("rep") != F.col("lead.rep")) \
               .filter(reachable(F.col("n"), F.col("own"), F.col("lead.n"), F.col("lead.own"), threshold)) \
               .groupBy("rep").agg(F.min("lead").alias("lead"))
    links = C.materialize(verified(first.select(F.col("rep").alias("x"), F.col("lead.rep").alias("y")), sets, threshold), "minhash_links")
    groups = components(links)
    # what the leaders left apart, once per pair
    of = groups.select(F.col("node").alias("rep"), "component")
    led = led.join(of, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    of_lead = groups.select(F.col("node").alias("lr"), F.col("component").alias("lc"))
    led = led.join(of_lead, F.col("lead.rep") == F.col("lr"), "left") \
             .withColumn("lead_component", F.coalesce("lc", F.col("lead.rep"))).drop("lr", "lc", "lead")
    led = C.materialize(led, "minhash_led")
    rest = prefix_pairs(open_classes(led), sets, threshold)
    more = C.materialize(verified(C.materialize(rest, "minhash_rest"), sets, threshold), "minhash_links")
    final = components(links.union(more)).select("node", "component") if not more.isEmpty() else groups
    named = C.materialize(classes.select("s1", "s2", "rep").join(final, F.col("rep") == F.col("node"), "left")
                          .select("s1", "s2", F.coalesce("component", "rep").alias("component")), "minhash_named")
    out = sig.join(named, ["s1", "s2"], "left")
    cid = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    cid = F.when(F.col("doc_id").isNotNull(), cid)
    return out.select("doc_id", F.col("n").alias("n_shingles"), cid.alias("component_id"),
                      F.coalesce(F.col("doc_id") == cid, F.lit(True)).alias("kept"))


def keep_documents(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One document of each group, with the columns of ``docs``; rows without doc_id stay."""
    ids = near_duplicates(docs, threshold).filter("kept and doc_id is not null").select(F.col("doc_id").alias("_kept")).distinct()
    d = docs.select(C.packed(docs), F.col("doc_id").cast("long").alias("_id"))
    one = Window.partitionBy("_id").orderBy(F.xxhash64("_row"))
    kept = d.join(C.materialize(ids, "minhash_kept"), F.col("_id") == F.col("_kept")) \
            .withColumn("_n", F.row_number().over(one)).filter("_n = 1")
    return C.unpacked(kept.select("_row"), docs).union(C.unpacked(d.filter("_id is null").select("_row"), docs))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.read(spark, sf_dir, "documents"))
