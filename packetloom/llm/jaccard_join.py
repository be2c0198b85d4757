"""N-gram Jaccard join by a size-aware heavy-light scheme, as classes of linked documents.

1. Every text becomes a sorted set of shingle hashes; equal sets are one class.
2. A document in a link lacks at most (100 - share) percent of its shingles in its partner. Of the
   shingles with hashes in a fixed part of the hash range it must therefore share most with some
   other class; one count over that part drops all classes that cannot be linked.
3. Small sets enumerate the subsets of the size that a partner must share; large sets enter
   inverted lists with a prefix of their shingles. The boundary is where enumeration
   begins to cost more than scanning the lists.
4. Lists are resolved by stars: in each list the most central class of each band of sizes, and one drawn
   anew each round, is compared with all others, which is linear. Classes that end in one component
   need no comparison with each other. Pairs across components meet on list and size band, if the
   sizes and the places of the shingle in both orders leave room for a link: the smaller set in its
   shorter prefix, the larger one in its whole prefix. The join holds nothing else.
5. As long as these are many pairs an entry, lists are dealt into random parts, so many that a part has
   few classes outside of the list's main component, and pairs meet inside the parts. Such a round
   has a bounded number of meetings an entry and of pairs a class, and what it links leaves fewer across
   components. Once few are left, or a round has not helped, all that are left are compared, exactly, on the whole sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm.common import fitted, lookup, only, partitions, setting, stored, table, without
from packetloom.llm.graphs import components
from packetloom.llm.words import chunks, gram_hashes, split, word_hashes

SHINGLE, SHARE = 4, 85
#: Near copies in the pipeline.
PIPELINE_SHINGLE, PIPELINE_SHARE = 5, 80
#: Classes up to this many are broadcast to pick their texts; 40 bytes each.
BROADCAST_KEYS = 500_000
#: What hashing and shuffling one subset costs, in entries of a list that is scanned.
ENUMERATE = 10
#: Signatures that a task hands on at once.
HANDED_ON = 200_000
#: Sizes in one band differ by less than this factor.
BAND = 1.05
#: Rounds of stars before pairs across components are compared.
STARS = 2
#: Classes of a part of a list that are not in the list's main component, about.
MINOR = 32
#: Pairs a class that a round in parts compares, on average; which of those that meet is drawn by hash.
DRAWN = 8
#: If whole lists would let no more than so many pairs an entry meet, on average, they do.
FEW = 2
#: A round in parts has helped if it leaves at most this share of the meetings.
HELPED = 0.9
#: Pairs that are compared at once; each has two whole sets.
AT_ONCE = 128
#: What comparing a pair costs, in rows of a few numbers.
PAIR = 16


def overlap(n: int, m: int, share: int) -> int:
    """Least intersection of sets of n and m with a Jaccard similarity of share percent."""
    return -(-share * (n + m) // (100 + share))


def _sets(part: pa.RecordBatch, shingle: int) -> list[np.ndarray]:
    """Sorted shingle hashes, 63 bits each, of every text of a batch."""
    ids, words, count = split(pc.ascii_lower(part.column("text")))
    h = word_hashes(words)[ids]
    ends = np.cumsum(count)
    return [np.unique(gram_hashes(h[e - n:e], min(n, shingle)) >> np.uint64(1)).astype(np.int64) if n else np.zeros(0, np.int64)
            for n, e in zip(count.tolist(), ends.tolist(), strict=True)]


def _key(items: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(items.tobytes(), digest_size=8).digest(), "little", signed=True)


def shingle_sets(docs: DataFrame, shingle: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """doc_id, text_hash, n, key (of the set), low (its hashes in the counted part of the range).

    The part is twice what a document may lack, so that about half of it must be shared.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    edge = 2**63 * min(100, 2 * (100 - share)) // 100
    edge = min(edge, 2**63 - 1)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                found = _sets(part, shingle)
                low = [x[:np.searchsorted(x, edge)] for x in found]
                offsets = np.cumsum([0, *map(len, low)])
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("text_hash"), pa.array([len(x) for x in found], pa.int64()),
                    pa.array([_key(x) for x in found], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(low), pa.int64()))],
                    ["doc_id", "text_hash", "n", "key", "low"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        sets, f"doc_id {kind}, text_hash long, n long, key long, low array<long>")


def linkable(sets: DataFrame, share: int) -> tuple[DataFrame, float]:
    """Classes that may have a link: key, n, apart (share of counted shingles that no other class
    has), text_hash and doc_id of one of its documents; and the mean length of shared lists."""
    one = sets.filter("n > 0").groupBy("key").agg(
        F.min("n").alias("n"), F.min(F.size("low")).alias("k"), F.count("*").alias("copies"),
        F.min(F.struct("text_hash", "doc_id")).alias("of"))
    # both uses read one exchange
    rows = sets.filter("n > 0").select("key", F.explode("low").alias("h")).repartition(partitions(sets.sparkSession), "h")
    shared = rows.groupBy("h").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.count("*").alias("df"))
    hits = rows.join(shared.filter("a != b").select("h", "df").hint("merge"), "h").groupBy("key").agg(
        F.count("*").alias("rows"), F.avg("df").alias("df"))
    # the copies of a class have the same shingles, so each has its share of the rows
    total = sets.count()
    found = stored(fitted(one.join(hits, "key", "left").select(
        "key", "n", "k", F.coalesce(F.col("rows") / F.col("copies"), F.lit(0)).alias("hits"), "df", "of.*"), total), "hits")
    scan = float(found.agg(F.avg("df")).first()[0] or 2.0)
    found = found.filter(F.col("hits") >= F.col("k") - F.floor(F.col("n") * (100 - share) / 100))
    return stored(fitted(found.select("key", "n", (1 - F.col("hits") / F.greatest("k", F.lit(1))).alias("apart"),
                                      "text_hash", "doc_id"), total), "linkable"), scan


def whole_sets(docs: DataFrame, keys: DataFrame, shingle: int) -> DataFrame:
    """key, n, apart, whole (bytes of all hashes) for each of the keys, from one of its texts."""
    few = keys.count() <= BROADCAST_KEYS
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).join(
        F.broadcast(keys.withColumnRenamed("doc_id", "of")) if few else keys.withColumnRenamed("doc_id", "of"),
        (F.col("hash") == F.col("text_hash")) & F.col("doc_id").eqNullSafe(F.col("of")))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                found = [x.tobytes() for x in _sets(part, shingle)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("n"), part.column("apart"), pa.array(found, pa.binary())],
                    ["key", "n", "apart", "whole"])

    found = texts.select("key", "n", "apart", "text").mapInArrow(whole, "key long, n long, apart double, whole binary")
    numbers = keys.agg(F.sum("n")).first()[0] or 0
    return fitted(found.dropDuplicates(["key"]), numbers // 4)  # rows that are repeated whole


def partner_sizes(n: int, share: int) -> range:
    return range(-(-share * n // 100), n * 100 // share + 1)


def subsets(n: int, share: int) -> int:
    """How many subsets a set of n enumerates."""
    return sum(comb(n, k) for k in {overlap(n, m, share) for m in partner_sizes(n, share)} if k <= n)


def boundary(scan: float, share: int) -> int:
    """The largest size up to which enumerating costs no more than scanning lists of that length."""
    n = 1
    while ENUMERATE * subsets(n + 1, share) <= (n + 2 - overlap(n + 1, n + 1, share)) * scan:
        n += 1
    return n


def subset_signatures(own: DataFrame, small: int, share: int) -> DataFrame:
    """key, h: the subsets that a small set and a partner of either kind must have in common."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, found = [], []
            for key, n, whole in zip(b.column("key").to_pylist(), b.column("n").to_pylist(), b.column("whole"), strict=True):
                items = np.frombuffer(whole.as_buffer(), np.int64)
                sizes = {overlap(n, m, share) for m in partner_sizes(n, share) if min(n, m) <= small}
                for k in sorted(x for x in sizes if x <= n):
                    for gone in combinations(range(n), n - k):
                        keys.append(key)
                        found.append(_key(np.delete(items, gone)))
                if len(keys) > HANDED_ON:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.int64())], ["key", "h"])
                    keys, found = [], []
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.int64())], ["key", "h"])

    return own.filter(F.col("n") <= small * 100 // share).select("key", "n", "whole").mapInArrow(lists, "key long, h long")


def prefix_signatures(own: DataFrame, small: int, share: int) -> DataFrame:
    """key, h, at: of each large set the rarest shingles, at least one of which a large partner
    shares, and their places in the order.

    Shingles that no other large set has come first in the order and meet nobody, so only what
    they leave of the prefix is listed.
    """

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column("n").to_numpy()
            items = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column("whole")]
            for k in range(0, len(items), 256):
                yield pa.RecordBatch.from_arrays(
                    [b.column("key")[k:k + 256].take(pa.array(np.repeat(np.arange(len(items[k:k + 256])), size[k:k + 256]))),
                     pa.array(np.concatenate(items[k:k + 256]), pa.int64())], ["key", "h"])

    large = own.filter(F.col("n") > small)
    rows = large.select("key", "n", "whole").mapInArrow(every, "key long, h long").repartition(
        partitions(own.sparkSession), "h")
    shared = rows.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    each = rows.join(shared.hint("merge"), "h").groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("df", "h"))).alias("rarest"))
    prefix = F.col("n") - F.ceil(F.lit(share) * F.col("n") / 100) + 1
    left = (prefix - (F.col("n") - F.size("rarest"))).cast("int")
    return each.join(large.select("key", "n"), "key").withColumn("left", left).filter("left > 0").select(
        "key", (F.col("n") - F.size("rarest")).alias("before"),
        F.posexplode(F.slice("rarest", F.lit(1), F.col("left"))).alias("i", "x")).select(
        "key", "x.h", (F.col("before") + F.col("i")).alias("at"))


def signatures(own: DataFrame, small: int, share: int) -> DataFrame:
    """key, n, apart, h, at: what linked sets have in common, at least one of it."""
    subsets = subset_signatures(own, small, share).withColumn("at", F.lit(0).cast("long"))
    numbers = own.agg(F.sum("n")).first()[0] or 0
    each = stored(fitted(subsets.unionByName(prefix_signatures(own, small, share)), numbers), "signatures")
    twice = each.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1").select("h")
    return fitted(each.join(twice, "h").join(own.select("key", "n", "apart"), "key"), each.count())


def band(size: Column) -> Column:
    return F.floor(F.log(size) / math.log(BAND)).cast("int")


def meets(share: int, n: Column, x: Column, m: Column, y: Column) -> Column:
    """A set of m and one of n, not smaller, may be linked by a shingle at places y and x of their prefixes.

    The first shingle in common is so far ahead in both that enough of them can follow; in the smaller
    set it is in the part that would do for a partner of its own size.
    """
    short = m - F.ceil(F.lit(2 * share) * m / (100 + share))
    return (100 * m >= share * n) & (y <= short) & (F.least(n - x, m - y) * (100 + share) >= share * (n + m))


def either(share: int, n: Column, x: Column, m: Column, y: Column) -> Column:
    return ((n >= m) & meets(share, n, x, m, y)) | ((n <= m) & meets(share, m, y, n, x))


def compare(pairs: DataFrame, own: DataFrame, share: int) -> DataFrame:
    """a, b, differ (size of the symmetric difference), linked, of pairs (a, b)."""
    left = own.select(F.col("key").alias("a"), F.col("whole").alias("left"))
    right = own.select(F.col("key").alias("b"), F.col("whole").alias("right"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            differ, linked = [], []
            for x, y in zip(batch.column("left"), batch.column("right"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                both = np.concatenate([x, y])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                union = len(both) - same
                differ.append(union - same)
                linked.append(100 * same >= share * union)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(differ, pa.int64()), pa.array(linked)], ["a", "b", "differ", "linked"])

    full = pairs.select("a", "b").join(right, "b").join(left, "a")
    with setting(own.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", str(AT_ONCE)):
        found = full.mapInArrow(count, "a long, b long, differ long, linked boolean")
        return stored(fitted(found, PAIR * DRAWN * own.count()), "compared")


def label(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """Adds comp, the component of each key; a key that comps (key, comp) does not have is its own."""
    return rows.join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key"))


def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps (key, comp) once links (a, b) are added, each of which is read once: only those between
    different components are followed further, as one link for each two components."""
    side = lambda end, name: comps.select(F.col("key").alias(end), F.col("comp").alias(name))
    ends = links.select("a", "b").join(side("a", "x"), "a").join(side("b", "y"), "b").filter("x != y").select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    found = components(stored(fitted(ends, links.count()), "ends")).select(F.col("node").alias("comp"), "label")
    return stored(fitted(comps.join(found, "comp", "left").select(
        "key", F.coalesce("label", "comp").alias("comp")), comps.count()), "components")


def mixed(current: DataFrame) -> DataFrame:
    """Lists of several components; one of a single component stays so, since components only grow."""
    sides = current.groupBy("h").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x != y").select("h")
    return current.join(sides, "h")


def star_pairs(live: DataFrame, done: DataFrame | None, share: int, turn: int) -> DataFrame:
    """(a, b) of different components: for each class up to three hubs, less what was compared.

    In each list the hubs of a size band are its most central class and one drawn by hash. Of the hubs that it
    may be linked with a class takes the most central one and two drawn by hash.
    """
    one = F.struct("key", "n", "at", "comp", "apart")
    drawn = lambda salt, *c: F.xxhash64(F.lit(turn), F.lit(salt), *c)
    hubs = live.groupBy("h", band(F.col("n")).alias("band")).agg(
        F.min(F.struct("apart", one.alias("hub"))).alias("central"),
        F.min(F.struct(drawn(0, "key"), one.alias("hub"))).alias("drawn"))
    hubs = hubs.select("h", F.explode(F.array_distinct(F.array("central.hub", "drawn.hub"))).alias("hub")).select(
        F.col("h").alias("g"), F.col("hub.key").alias("hub"), F.col("hub.n").alias("m"), F.col("hub.at").alias("y"),
        F.col("hub.comp").alias("c"), F.col("hub.apart").alias("far"))
    room = either(share, F.col("n"), F.col("at"), F.col("m"), F.col("y"))
    met = live.join(hubs, (F.col("h") == F.col("g")) & (F.col("comp") != F.col("c")) & room).select(
        "key", "hub", "far")
    best = met.groupBy("key").agg(F.array(F.min(F.struct("far", "hub"))["hub"], *[
        F.min(F.struct(drawn(k, "key", "hub").alias("x"), "hub"))["hub"] for k in (1, 2)]).alias("hubs"))
    pairs = best.select("key", F.explode(F.array_distinct("hubs")).alias("hub")).select(
        F.least("hub", "key").alias("a"), F.greatest("hub", "key").alias("b")).distinct()
    return pairs if done is None else pairs.join(done, ["a", "b"], "left_anti")


def across(current: DataFrame) -> DataFrame:
    """Adds to the entries of lists of several components main, the component with most of the list, and
    minor, how many entries are of others; drops all other lists."""
    groups = current.groupBy("h", "comp").agg(F.count("*").alias("size"))
    main = groups.groupBy("h").agg(F.max(F.struct("size", "comp")).alias("most"), F.sum("size").alias("all"),
                                   F.count("*").alias("k")).filter("k > 1").select(
        "h", F.col("most.comp").alias("main"), (F.col("all") - F.col("most.size")).alias("minor"))
    return stored(fitted(current.join(main, "h"), current.count()), "live")


def pairs_across(live: DataFrame, share: int, turn: int | None = None) -> DataFrame:
    """(a, b, parts) of different components that a list and the sizes and places in it let meet, a < b, for each list.

    In each list the main component is left out on one side, so that its members do not meet each
    other. With a turn, pairs only meet inside parts of a list, dealt by hash anew each turn; the sum of
    parts, how many there are, then is how many meetings whole lists have, about.
    """
    parts = F.lit(1) if turn is None else F.ceil(F.col("minor") / MINOR)
    live = live.withColumn("parts", parts.cast("long")).withColumn(
        "part", F.pmod(F.xxhash64(F.lit(turn or 0), "h", "key"), F.col("parts")))
    minor, n, at = live.filter("comp != main"), F.col("n"), F.col("at")
    small = lambda rows: rows.filter(at <= n - F.ceil(F.lit(2 * share) * n / (100 + share))).select(
        F.col("h").alias("g"), F.col("part").alias("q"), band(n).alias("other"), F.col("key").alias("k2"),
        F.col("n").alias("m"), F.col("at").alias("y"), F.col("comp").alias("c"))
    # a larger set meets sizes from its share down to what the place leaves room for
    least, most = F.ceil(F.lit(share) * n / 100), F.least(n, F.floor((n - at) * (100 + share) / share) - n)
    large = lambda rows: rows.filter(most >= least).select(
        "h", "part", "parts", "key", "n", "at", "comp", F.explode(F.sequence(band(least), band(most))).alias("band"))
    room = (F.col("comp") != F.col("c")) & (n >= F.col("m")) & meets(share, n, at, F.col("m"), F.col("y"))
    here = (F.col("h") == F.col("g")) & (F.col("part") == F.col("q")) & (F.col("band") == F.col("other"))

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right, here & room).select(
            F.least("key", "k2").alias("a"), F.greatest("key", "k2").alias("b"), "parts")

    # what is not in the main component meets all, the main component only what is not in it
    return met(large(minor), small(live)).union(met(large(live.filter("comp = main")), small(minor)))


def link_classes(lists: DataFrame, own: DataFrame, share: int) -> DataFrame:
    """key, comp (the smallest key that its links reach) of all classes."""
    done, current = None, lists.withColumn("comp", F.col("key"))
    comps = own.select("key", F.col("key").alias("comp"))
    joined = lambda: stored(fitted(mixed(label(current.drop("comp"), comps)), current.count()), "lists")
    for turn in range(STARS):
        new = compare(star_pairs(current, done, share, turn), own, share)
        done = new if done is None else done.unionByName(new)
        if not new.filter("linked").limit(1).count():
            break
        comps = merged(comps, new.filter("linked"))
        current = joined()
    left, turn = math.inf, 0
    while True:
        live = across(current)
        met = stored(fitted(pairs_across(live, share, turn), MINOR // 4 * live.count()), "met")
        entries, minor, classes = live.agg(F.count("*"), F.max("minor"), F.count_distinct("key")).first()
        meetings = met.agg(F.sum("parts")).first()[0] or 0
        whole = (minor or 0) <= MINOR  # each list is one part
        last = whole or meetings <= FEW * entries or meetings > HELPED * left
        if last and not whole:
            met = pairs_across(live, share)
        pairs = met.select("a", "b").distinct().join(done, ["a", "b"], "left_anti")
        if not last:
            pairs = stored(fitted(pairs, int(meetings)), "pairs")
            part = DRAWN * classes / max(1, pairs.count())
            pairs = pairs.filter(F.pmod(F.xxhash64(F.lit(turn), "a", "b"), F.lit(2**30)) < part * 2**30)
        new = compare(pairs, own, share)
        comps = merged(comps, new.filter("linked"))
        if last:
            return comps
        done = done.unionByName(new)
        current, left, turn = joined(), meetings, turn + 1


def jaccard_join(docs: DataFrame, shingle: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """Classes of documents (doc_id, text) whose shingle sets are linked, directly or over others.

    One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id of the class),
    class (equal for documents that are linked, null for those without shingles), text_hash.

    Two documents are linked when the Jaccard similarity of their sets is at least share percent.
    Words are lower-cased in A-Z; a text of fewer words than a shingle has its whole sequence as
    one; a null, empty or blank text has none and is linked with nothing. Rows that repeat a doc_id
    are judged each; a null doc_id is never the smallest while there is another. An empty table gives
    no rows; other columns are not looked at.
    """
    sets = stored(shingle_sets(docs, shingle, share), "sets")
    keys, scan = linkable(sets, share)
    own = stored(whole_sets(docs, keys, shingle), "linkable-sets")
    lists = stored(signatures(own, boundary(scan, share), share), "lists")
    comps = link_classes(lists, own, share)
    classes = sets.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("size"))
    classes = stored(fitted(label(classes, comps), sets.count()), "classes")
    smallest = classes.groupBy("comp").agg(F.min("first").alias("component_id"))
    facts = classes.select("key", "size", "comp").join(smallest, "comp")
    rows = sets.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "key")
    named = lookup(rows.filter("n_shingles > 0"), facts, "key", F.col("size"), sets.count())
    none = rows.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id")).withColumn(
        "comp", F.lit(None).cast("long"))
    out = named.drop("size").unionByName(none)
    return out.select("doc_id", "n_shingles", "component_id", F.col("comp").alias("class"), "text_hash")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).drop("class", "text_hash")


def keep_representatives(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class the document with the smallest id, and all without shingles.

    Shingles are five words and the similarity is 0.8 or more.
    """
    judged = stored(jaccard_join(docs, PIPELINE_SHINGLE, PIPELINE_SHARE).filter("class IS NOT NULL"), "judged")
    each = judged.groupBy("class", F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(
        F.count("*").alias("rows"))
    best = each.groupBy("class").agg(F.min(F.struct(F.col("id").isNull(), "id", "hash")).alias("best"),
                                     F.count("*").alias("size"))
    named = stored(lookup(each, best, "class", F.col("size"), judged.count()).withColumn(
        "stays", F.col("id").eqNullSafe(F.col("best.id")) & (F.col("hash") == F.col("best.hash"))), "named")
    left = without(docs, stored(named.filter("NOT stays").select("id", "hash"), "lost"))
    again = stored(named.filter("stays AND rows > 1").select("id", "hash"), "again")
    if not again.limit(1).count():
        return left
    return without(left, again).unionByName(only(left, again).dropDuplicates(["doc_id", "text"]))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (
  SELECT doc_id AS d, doc_id AS r FROM w
  UNION
  SELECT d, b FROM reach JOIN links ON a = r)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(r) AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN reach ON d = w.doc_id
GROUP BY ALL
"""
