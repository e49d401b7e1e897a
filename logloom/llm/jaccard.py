"""N-gram Jaccard join with set-relation skipping.

Texts with one shingle set are one class. Classes are indexed by their rarest shingles (a prefix that any linked pair
must share). Relations between sets then save work:

- each index list names a pivot, and classes that share much of their prefix with a pivot form a family. Within a family
  all answers come from one reference set: an overlap follows from the reference's size and the few shingles that a set
  adds or lacks, for blocks of sets at once, and blocks of far set sizes skip each other;
- pairs of an index list are formed only across families, family by family, between neighbouring blocks of set sizes;
  the positions of shared shingles bound what a pair can still share, and only pairs within the bound are checked.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, release, views
from .filters import among, hash_bits
from .tokens import LOWER, mix, windows

#: Counters of shingle frequency, as a power of two: they only order shingles, rare first.
SKETCH_BITS = 22
_PART = 4096
#: Members of one family in an index list from which on others of the list join the family.
CROWD = 32


def shingles(text: np.ndarray | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``size`` lowered words; a shorter text is one run."""
    h = LOWER.hashes(text) if text is not None else np.empty(0, np.uint64)
    return np.unique(windows(h, min(size, len(h)))) if len(h) else h


def signature(own: np.ndarray) -> tuple[int, int]:
    both = np.array([own.sum(dtype=np.uint64) + np.uint64(len(own)), mix(own ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)], np.uint64)
    a, b = mix(both).view(np.int64).tolist()
    return a, b


def _frequencies(df: DataFrame, size: int) -> np.ndarray:
    """Coarse frequency of each slot of shingle hashes over all documents: the bit length of its count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << SKETCH_BITS, np.uint32)
        task = 0
        for batch in batches:
            for view in views(batch.column(0)):
                h = LOWER.hashes(view) if view is not None else ()
                own = windows(h, min(size, len(h))) >> np.uint64(64 - SKETCH_BITS) if len(h) else ()
                if len(own):
                    seen[own.astype(np.int64)] += 1  # once for each slot of a text
                task = (task * 31 + len(own)) % 61
        parts = seen.reshape(-1, _PART)
        some = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), task, np.int32)), pa.array([zlib.compress(parts[i].astype("<u8").tobytes(), 1) for i in some], pa.binary())], names=["part", "salt", "counts"])
        release()

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_PART, np.uint64)
        for batch in batches:
            for x in batch.column(batch.schema.get_field_index("counts")):
                total += np.frombuffer(zlib.decompress(x.as_py()), "<u8")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["part", "counts"])

    first = df.select("t").mapInArrow(count, "part int, salt int, counts binary")
    # two rounds, so that no group grows with the number of tasks alone
    partial = first.groupBy("part", "salt").applyInArrow(add, "part int, counts binary")
    levels = np.zeros((1 << SKETCH_BITS) // _PART * _PART, np.uint8).reshape(-1, _PART)
    for row in partial.groupBy("part").applyInArrow(add, "part int, counts binary").toLocalIterator():
        levels[row.part] = np.ceil(np.log2(np.frombuffer(zlib.decompress(row.counts), "<u8").astype(np.float64) + 1)).astype(np.uint8)
    return levels.ravel()


def prefix_length(n, percent: int):
    """Two linked sets share a shingle among so many first ones of each, in any common order."""
    return n - (percent * n + 99) // 100 + 1


def _prefixes(df: DataFrame, size: int, percent: int, levels) -> DataFrame:
    """For each document: class, number of shingles and the prefix of its rarest ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        for batch in batches:
            a, b, n, at, flat = [], [], [], [0], []
            for view in views(batch.column(1)):
                own = shingles(view, size)
                x, y = signature(own)
                a.append(x)
                b.append(y)
                n.append(len(own))
                keep = prefix_length(len(own), percent) if len(own) else 0
                order = np.argsort(level[(own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")[:keep]
                flat.append(own[order])
                at.append(at[-1] + keep)
            tokens = pa.array((np.concatenate(flat) if flat else np.empty(0, np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int32()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), tokens)], names=["id", "a", "b", "n", "prefix"])

    long = [T.StructField(x, T.LongType()) for x in "ab"]
    return df.select("id", "t").mapInArrow(run, T.StructType([df.schema["id"], *long, T.StructField("n", T.IntegerType()), T.StructField("prefix", T.ArrayType(T.LongType()))]))


def _entries(classes: DataFrame, shared) -> DataFrame:
    """Index entries (token, class, size, position) of prefix shingles that other classes may have too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten().to_numpy().view(np.uint64)
            length = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(length)), length)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
            keep = np.flatnonzero(among(bits, flat))
            take = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays([pa.array(flat[keep].view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(place[keep].astype(np.int32))], names=["t", "c", "n", "pos"])

    return classes.select("c", "n", "prefix").mapInArrow(run, "t long, c long, n int, pos int")


def _sets(df: DataFrame, size: int, shared) -> DataFrame:
    """(a, b, set) of documents whose class may be in the bit map; a task gives a class once while it remembers it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        known: set[tuple[int, int]] = set()
        for batch in batches:
            a, b, at, flat = [], [], [0], []
            for view in views(batch.column(0)):
                own = shingles(view, size)
                c = signature(own)
                if len(own) and c not in known and among(bits, np.array(c[:1], np.int64).view(np.uint64))[0]:
                    if len(known) > 1 << 17:
                        known.clear()
                    known.add(c)
                    a.append(c[0])
                    b.append(c[1])
                    flat.append(own)
                    at.append(at[-1] + len(own))
            tokens = pa.array((np.concatenate(flat) if flat else np.empty(0, np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), tokens)], names=["a", "b", "own"])
        release()

    return df.select("t").mapInArrow(run, "a long, b long, own array<long>")


def _fetch(df: DataFrame, wanted: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """(c, own): the sets of the wanted classes (c), computed again from the texts."""
    named = cut(classes.select("a", "b", "c").join(wanted.distinct(), "c", "left_semi"), "jaccard-wanted")
    shared = df.sparkSession.sparkContext.broadcast(hash_bits(named.select(F.col("a").alias("h"))))
    found = _sets(df, size, shared).groupBy("a", "b").agg(F.first("own").alias("own"))
    return cut(found.join(named, ["a", "b"]).select("c", "own"), "jaccard-sets")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of classes whose sets link, checked on the whole sets."""
    left = pairs.join(sets.select(F.col("c").alias("y"), F.col("own").alias("own_y")), "y")
    both = left.join(sets.select(F.col("c").alias("x"), F.col("own").alias("own_x")), "x")
    common = F.size(F.array_intersect("own_x", "own_y"))
    return both.withColumn("common", common).where(100 * F.col("common") >= percent * (F.size("own_x") + F.size("own_y") - F.col("common"))).select("x", "y")


def _close(n: Column, m: Column, percent: int) -> Column:
    return (100 * F.least(n, m)) >= (percent * F.greatest(n, m))


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(v, root): the least node that each node of an edge list (x, y) is connected with.

    Rounds of taking the least root among the neighbours and then the root's root, each cut in shared storage; only a
    count of changes reaches the driver.
    """
    both = cut(edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), f"{tag}-edges")
    roots = cut(both.groupBy(F.col("x").alias("v")).agg(F.least(F.col("v"), F.min("y")).alias("root")), tag)
    written = roots
    while True:
        near = both.join(roots.select(F.col("v").alias("y"), F.col("root").alias("r")), "y").groupBy(F.col("x").alias("v")).agg(F.min("r").alias("r"))
        stepped = roots.join(near, "v").select("v", F.col("root").alias("old"), F.least("root", "r").alias("root"))
        up = roots.select(F.col("v").alias("root"), F.col("root").alias("above"))
        moved = cut(stepped.join(up, "root", "left").select("v", "old", F.least("root", F.coalesce("above", "root")).alias("root")), tag, written)
        written = moved
        changed = moved.where(F.col("old") != F.col("root")).limit(1).count()
        roots = moved.select("v", "root")
        if not changed:
            return roots


def link_documents(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, percent: int = 85, links: bool = True) -> DataFrame:
    """Per row: key, n_shingles, component_id (least key reachable by links) and, if wanted, n_links.

    Two rows link when their shingle sets have at least ``percent`` of their union in common. A text without words has
    an empty set, links with nothing and is its own component. Rows with equal sets link with each other; repeated rows
    too. A null key takes part; a component of null keys alone has a null id.

    Broadcast: 2^SKETCH_BITS bytes of shingle frequencies, and bit maps of up to 32 MB, sized by counts. Both only save
    work; a corpus that outgrows them has longer index lists, not wrong ones.
    """
    sc = df.sparkSession.sparkContext
    rows = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("t"))
    levels = sc.broadcast(_frequencies(rows, size))
    documents = cut(_prefixes(rows, size, percent, levels), "jaccard-documents")
    grouped = documents.groupBy("a", "b").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("m"), F.min("id").alias("id"), F.first("prefix").alias("prefix"))
    classes = cut(grouped.withColumn("c", F.monotonically_increasing_id()), "jaccard-classes")
    repeated = cut(classes.select(F.explode("prefix").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("h"), "jaccard-repeated")
    shared = cut(_entries(classes, sc.broadcast(hash_bits(repeated))), "jaccard-shared")
    lists = shared.groupBy("t").agg(F.min(F.struct("c", "n", "pos")).alias("p"), F.max(F.struct("c", "n", "pos")).alias("q"), F.count(F.lit(1)).alias("k"))
    lists = cut(lists.where(F.col("k") > 1), "jaccard-index")
    listed = cut(_members(shared, lists, percent), "jaccard-entries")
    entries = listed.drop("p")
    star = listed.where((F.col("p.c") != F.col("c")) & _close(F.col("n"), F.col("p.n"), percent) & _possible(F.col("n"), F.col("pos"), F.col("p.n"), F.col("p.pos"), percent))
    star = star.groupBy(F.col("p.c").alias("x"), F.col("c").alias("y")).agg(F.count(F.lit(1)).alias("s"), F.first(F.least("n", "p.n")).alias("n"))
    needed = lambda n: F.ceil(_prefix(n, percent) / F.lit(4.0))
    near = cut(star.where(F.col("s") >= needed(F.col("n"))).select("x", "y"), "jaccard-star")
    families = components(near, "jaccard-families").withColumnsRenamed({"v": "c", "root": "family"})
    # and once more with the largest family of each list in the pivot's place: its members need not be one another's
    # pivots. Whoever meets CROWD members of a family in one list joins it, since checking them in blocks costs less
    # than pairing them off one by one.
    largest = entries.join(families, "c").groupBy("t", "family").agg(F.count(F.lit(1)).alias("k")).groupBy("t").agg(F.max(F.struct("k", "family")).alias("top")).select("t", F.col("top.family").alias("top"), F.col("top.k").alias("k"))
    owned = entries.join(largest, "t").join(families, "c", "left").where(F.coalesce("family", "c") != F.col("top"))
    joins = owned.groupBy("c", "top").agg(F.count(F.lit(1)).alias("s"), F.first("n").alias("n"), F.max("k").alias("k")).where((F.col("s") >= needed(F.col("n"))) | (F.col("k") >= CROWD))
    families = components(near.unionByName(joins.select(F.col("top").alias("x"), F.col("c").alias("y"))), "jaccard-families")
    families = families.withColumnsRenamed({"v": "c", "root": "family"})
    sets = _fetch(rows, families.select("c"), classes, size)
    within = cut(_within(classes.select("c", "n", "m").join(families, "c"), sets, percent), "jaccard-within")

    placed = entries.join(families, "c", "left").withColumn("family", F.coalesce("family", "c"))
    mixed = placed.groupBy("t").agg(F.min("family").alias("lo"), F.max("family").alias("hi")).where("lo != hi").select("t")
    members = cut(placed.join(mixed, "t").withColumn("block", _block(F.col("n"), percent)), "jaccard-lists")
    groups = members.select("t", "family", "block").distinct()
    first, second = groups.withColumnsRenamed({"family": "f1", "block": "b1"}), groups.withColumnsRenamed({"family": "f2", "block": "b2"})
    across = first.join(second, "t").where((F.col("f1") < F.col("f2")) & (F.abs(F.col("b1") - F.col("b2")) <= 1))
    one = members.select("t", F.col("family").alias("f1"), F.col("block").alias("b1"), F.col("c").alias("x"), F.col("n").alias("n1"), F.col("pos").alias("p1"))
    two = members.select("t", F.col("family").alias("f2"), F.col("block").alias("b2"), F.col("c").alias("y"), F.col("n").alias("n2"), F.col("pos").alias("p2"))
    pairs = across.join(one, ["t", "f1", "b1"]).join(two, ["t", "f2", "b2"]).where(_close(F.col("n1"), F.col("n2"), percent) & _possible(F.col("n1"), F.col("p1"), F.col("n2"), F.col("p2"), percent))
    pairs = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("s"), F.first("n1").alias("n1"), F.first("n2").alias("n2"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    # all shared shingles up to the last shared one are counted, so what lies behind it bounds the rest
    pairs = pairs.where(F.col("s") + F.least(F.col("n1") - F.col("p1"), F.col("n2") - F.col("p2")) - 1 >= _least_common(F.col("n1"), F.col("n2"), percent))
    pairs = cut(pairs.where(F.col("s") >= _least_shared(F.col("n1"), F.col("n2"), percent)).select("x", "y"), "jaccard-pairs")
    ends = pairs.select(F.col("x").alias("c")).unionByName(pairs.select(F.col("y").alias("c"))).distinct()
    crossing = cut(_linked(pairs, sets.unionByName(_fetch(rows, ends.join(sets, "c", "left_anti"), classes, size)), percent), "jaccard-crossing")
    linked = within.where("c != top").select(F.col("c").alias("x"), F.col("top").alias("y")).unionByName(crossing)
    roots = components(linked, "jaccard-roots")

    # a component's least key, from the least key of each class
    homes = classes.select("a", "b", "c", "id", "m").join(roots.withColumnRenamed("v", "c"), "c", "left").select("a", "b", "c", "id", "m", F.coalesce("root", "c").alias("root"))
    if links:
        weights = classes.select("c", "m")
        over = crossing.join(weights.withColumnRenamed("c", "y"), "y").select(F.col("x").alias("c"), F.col("m").alias("k"))
        back = crossing.join(weights.withColumnRenamed("c", "x"), "x").select(F.col("y").alias("c"), F.col("m").alias("k"))
        homes = homes.join(within.select("c", "k").unionByName(over).unionByName(back).groupBy("c").agg(F.sum("k").alias("k")), "c", "left")
    else:
        homes = homes.withColumn("k", F.lit(None).cast("long"))
    tops = homes.groupBy("root").agg(F.min("id").alias("component_id"))
    named = homes.join(tops, "root").select("a", "b", "component_id", (F.coalesce("k", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    out = documents.select("id", "a", "b", "n").join(named, ["a", "b"])
    alone = F.col("n") == 0
    columns = [F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id")]
    return out.select(*columns, *([F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links")] if links else []))


def _least_common(n: Column, m: Column, percent: int) -> Column:
    """Shingles that a linked pair has in common at least."""
    return F.ceil(percent * (n + m) / F.lit(100.0 + percent) - 1e-9)


def _prefix(n: Column, percent: int) -> Column:
    return n - F.ceil(n * percent / F.lit(100.0) - 1e-9) + 1


def _least_shared(n: Column, m: Column, percent: int) -> Column:
    """Shingles that a linked pair has in common in its prefixes at least.

    Up to the end of the prefix that ends first in the common order, both sets are known: what they share beyond lies
    behind that prefix, in the set that it belongs to.
    """
    return _least_common(n, m, percent) - F.greatest(n - _prefix(n, percent), m - _prefix(m, percent))


def _members(shared: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """Index entries with their list's pivot, without lists of two whose pair cannot link.

    Most lists are two long texts that happen to share a shingle. Such a pair shares too little, even if it met in all
    longer lists that either is in.
    """
    longer = shared.join(lists.where("k > 2").select("t", "p"), "t")
    met = longer.groupBy("c").agg(F.count(F.lit(1)).alias("e"))
    two = lists.where(F.col("k") == 2).where(_close(F.col("p.n"), F.col("q.n"), percent) & _possible(F.col("p.n"), F.col("p.pos"), F.col("q.n"), F.col("q.pos"), percent))
    two = two.select("t", "p", "q", F.col("p.c").alias("x"), F.col("q.c").alias("y"))
    pairs = two.groupBy("x", "y").agg(F.count(F.lit(1)).alias("s"), F.first("p.n").alias("n"), F.first("q.n").alias("m"))
    pairs = pairs.join(met.withColumnsRenamed({"c": "x", "e": "ex"}), "x", "left").join(met.withColumnsRenamed({"c": "y", "e": "ey"}), "y", "left")
    most = F.col("s") + F.least(F.coalesce("ex", F.lit(0)), F.coalesce("ey", F.lit(0)))
    kept = two.join(pairs.where(most >= _least_shared(F.col("n"), F.col("m"), percent)).select("x", "y"), ["x", "y"], "left_semi")
    both = kept.select("t", "p", F.explode(F.array("p", "q")).alias("e")).select("t", "e.c", "e.n", "e.pos", "p")
    return longer.select("t", "c", "n", "pos", "p").unionByName(both)


def _possible(n: Column, p: Column, m: Column, q: Column, percent: int) -> Column:
    """Whether a pair can link whose FIRST shared shingle has these positions; later ones pass through other lists."""
    return F.least(n - p, m - q) + F.least(p, q) >= _least_common(n, m, percent)


def _block(n: Column, percent: int) -> Column:
    """Blocks of set sizes: two sizes that can link lie in one block or in neighbours."""
    return F.floor(F.log(n) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")


def _within(members: DataFrame, sets: DataFrame, percent: int, part: int = 512, most: int = 1 << 18) -> DataFrame:
    """(c, k, top): for classes of a family, documents of linked other classes, and a class it is connected with.

    Up to ``part`` classes of ``most`` shingles together are one unit of work. A larger family is dealt by set size, in
    blocks of which only neighbours can link, and by hash within a block; each pair of neighbouring parts is a unit. No
    pairs leave a unit, only counts and one connection for each class.
    """
    totals = members.groupBy("family").agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("all"))
    sized = members.join(totals, "family").withColumn("s", F.when((F.col("g") > part) | (F.col("all") > most), _block(F.col("n"), percent)).otherwise(0))
    parts = sized.groupBy("family", "s").agg(F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(float(part)), F.sum("n") / F.lit(float(most)))).cast("int").alias("parts"))
    after, before = (parts.select("family", (F.col("s") + d).alias("s"), F.col("parts").alias(name)) for d, name in ((-1, "after"), (1, "before")))
    dealt = sized.join(parts, ["family", "s"]).join(after, ["family", "s"], "left").join(before, ["family", "s"], "left")
    dealt = dealt.withColumn("h", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"))
    unit = lambda s1, h1, s2, h2, second: F.struct(s1.alias("s1"), h1.alias("h1"), s2.alias("s2"), h2.alias("h2"), second.alias("second"))
    none = F.array().cast("array<struct<s1:int,h1:int,s2:int,h2:int,second:boolean>>")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = F.transform(upto("parts"), lambda o: unit(F.col("s"), F.least("h", o), F.col("s"), F.greatest("h", o), F.col("h") > o))
    up = F.when(F.col("after").isNotNull(), F.transform(upto("after"), lambda o: unit(F.col("s"), F.col("h"), F.col("s") + 1, o, F.lit(False)))).otherwise(none)
    down = F.when(F.col("before").isNotNull(), F.transform(upto("before"), lambda o: unit(F.col("s") - 1, o, F.col("s"), F.col("h"), F.lit(True)))).otherwise(none)
    units = dealt.select("c", "m", "family", F.explode(F.concat(own, up, down)).alias("u")).select("family", "u.s1", "u.h1", "u.s2", "u.h2", "u.second", "c", "m")
    keys = ["family", "s1", "h1", "s2", "h2"]
    spread = units.join(sets, "c").select(*keys, "second", "c", "m", "own").repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, out = None, [], []

        def settle() -> None:
            if len(held) > 1:
                linked = links_among([x[3] for x in held], percent)
                second = np.array([x[0] for x in held])
                if unit[1:3] != unit[3:5]:  # two parts, of which one may be empty: pairs within one are counted in a unit of their own
                    linked &= second[:, None] != second[None, :]
                top = _connected(linked)
                out.extend(zip((x[1] for x in held), (linked @ np.array([x[2] for x in held], np.float64)).astype(np.int64).tolist(), (held[i][1] for i in top), strict=True))
            held.clear()

        def rows() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], names=["c", "k", "top"])
            out.clear()
            return made

        for batch in batches:
            key = list(zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True))
            second, c, m = (batch.column(i).to_pylist() for i in (5, 6, 7))
            lists = batch.column(8)
            at, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy().view(np.uint64)
            for i in range(len(c)):
                if key[i] != unit:
                    settle()
                    unit = key[i]
                held.append((second[i], c[i], m[i], flat[at[i] : at[i + 1]].copy()))
            if out:
                yield rows()
        settle()
        yield rows()
        release()

    return spread.mapInArrow(run, "c long, k long, top long")


def _connected(linked: np.ndarray) -> np.ndarray:
    """The least row that each row is connected with."""
    n = len(linked)
    top = np.arange(n)
    reach = linked | np.eye(n, dtype=bool)
    while True:
        least = np.where(reach, top[None, :], n).min(1)
        least = np.minimum(least, least[least])
        if (least == top).all():
            return top
        top = least


def links_among(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of sorted sets link, from one reference: common shingles are its size, less what either set lacks of
    it, plus what both lack, plus what both add. Only lacking and added shingles that several sets have are compared."""
    size = np.array([len(s) for s in sets], np.int64)
    reference = sets[int(np.argsort(size, kind="stable")[len(sets) // 2])]  # of middle size, so that no set lacks far more than it has
    lack = [np.setdiff1d(reference, s, assume_unique=True) for s in sets]
    more = [np.setdiff1d(s, reference, assume_unique=True) for s in sets]
    lacking = np.array([len(x) for x in lack], np.int64)
    common = len(reference) - lacking[:, None] - lacking[None, :]
    common = common.astype(np.float64) + _shared(lack) + _shared(more)
    union = size[:, None] + size[None, :] - common
    out = 100 * common >= percent * union
    np.fill_diagonal(out, False)
    return out


def _shared(parts: list[np.ndarray]) -> np.ndarray:
    """Pairwise numbers of common elements, by products of 0/1 blocks over elements that at least two parts have."""
    n = len(parts)
    out = np.zeros((n, n))
    flat = np.concatenate(parts)
    if not len(flat):
        return out
    row = np.repeat(np.arange(n), [len(p) for p in parts])
    values, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.cumsum(times > 1) - 1
    keep = times[column] > 1
    row, column = row[keep], rank[column[keep]]
    width = 4096
    for at in range(0, int(rank[-1]) + 1 if len(rank) else 0, width):
        on = (column >= at) & (column < at + width)
        block = np.zeros((n, width), np.float32)
        block[row[on], column[on] - at] = 1
        out += block @ block.T
    np.fill_diagonal(out, [len(p) for p in parts])
    return out
