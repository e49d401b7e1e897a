"""Substring dedup over a compacted de Bruijn graph of token k-mers.

A window of ``size`` words is an edge of the graph, from the node of its first ``size - 1`` words to that of its last.
Each window has a minimizer, the least hash among its shorter word runs; the consecutive windows of a document that share
one form a piece, a path of edges. Identical pieces anywhere in the corpus are one path with a count. Where different
pieces share a minimizer, at the ends of repeats and at branches, single windows are counted.

Repeated paths are compacted: a path continues another where the node between them has one path in and one path out, and
joins that double the steps bring all paths of a chain to its head. Source coordinates turn chains, paths and windows into
word spans of each document, and the words at those coordinates are compared, by digests of 128 bits, before any is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, cut, keep_columns, release, row_keys, sliced, uncut, views
from .filters import among, hash_bits, parted
from .tokens import PLAIN, mix, powers, windows

_CHUNK = 1 << 18


def path_pieces(words: np.ndarray, size: int, anchor: int, upto: int = 3) -> Iterator[tuple[np.ndarray, ...]]:
    """Path pieces of a document, in chunks: minimizer, content, first window, number of windows, the nodes where they start
    and end, and the window hashes. ``upto``: 1 for minimizers alone, 2 for all but the window hashes."""
    total, span = len(words) - size + 1, size - anchor + 1
    for at in range(0, max(0, total), _CHUNK):
        own = words[at : at + _CHUNK + size - 1]
        n = len(own) - size + 1
        best = windows(own, anchor)
        place = np.arange(len(best), dtype=np.int64)
        width = 1
        while width < span:
            step = min(width, span - width)
            right = best[step:] < best[:-step]
            place = np.where(right, place[step:], place[:-step])
            best = np.where(right, best[step:], best[:-step])
            width += step
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        if upto == 1:
            yield (best[first],)
            continue
        count = np.diff(np.append(first, n))
        up, down = powers(len(own) + 1)
        sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(own * up[: len(own)], out=sums[1:])
        content = mix((sums[first + count + size - 1] - sums[first]) * down[first] + mix((place[first] - first).astype(np.uint64) * np.uint64(1 << 32) + count.astype(np.uint64)))
        last = first + count
        start, end = (mix((sums[x + size - 1] - sums[x]) * down[x]) for x in (first, last))
        found = best[first], content, first + at, count, start, end
        yield (*found, windows(own, size)) if upto == 3 else found


def _hashes(text: np.ndarray, salt: int) -> np.ndarray:
    h = PLAIN.hashes(text)
    return mix(h + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) if salt else h


def _minimizers(df: DataFrame, text: str, size: int, anchor: int, salt: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            held, n = [], 0
            for view in views(batch.column(0)):
                for piece in path_pieces(_hashes(view, salt), size, anchor, 1) if view is not None else ():
                    held.append(piece[0])
                    n += len(piece[0])
                if n > 1 << 20:
                    yield _counted(held)
                    held, n = [], 0
            yield _counted(held)
        release()

    def _counted(held: list[np.ndarray]) -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(held) if held else np.empty(0, np.uint64), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "c"])

    return df.select(F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(run, "h long, c long")


def _pieces(df: DataFrame, size: int, anchor: int, salt: int, shared) -> DataFrame:
    """Rows (k1, k2, h, content, first, n, start, end) of pieces whose minimizer may repeat; df has k1, k2, t."""
    names = ["k1", "k2", "h", "content", "first", "n", "start", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in sliced(batches):
            k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            held: list[tuple] = []
            n = 0
            for i, view in enumerate(views(batch.column(2))):
                for piece in path_pieces(_hashes(view, salt), size, anchor, 2) if view is not None else ():
                    may = among(bits, piece[0])
                    if may.any():
                        held.append((np.full(int(may.sum()), k1[i]), np.full(int(may.sum()), k2[i]), *(x[may] for x in piece)))
                        n += len(held[-1][0])
                if n > 1 << 18:
                    yield rows(held)
                    held, n = [], 0
            if held:
                yield rows(held)
        release()

    def rows(held: list[tuple]) -> pa.RecordBatch:
        a = [np.concatenate(c) for c in zip(*held, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32) if name in ("first", "n") else x.view(np.int64)) for x, name in zip(a, names, strict=True)], names=names)

    return df.mapInArrow(run, "k1 long, k2 long, h long, content long, first int, n int, start long, end long")


def _window_hashes(df: DataFrame, size: int, anchor: int, salt: int, shared) -> DataFrame:
    """(content, w): the window hashes of pieces whose content may be in the bit map, once for what a task remembers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        known: set[int] = set()
        for batch in sliced(batches):
            held: list[tuple] = []
            n = 0
            for view in views(batch.column(0)):
                for _, content, _, count, _, _, w in path_pieces(_hashes(view, salt), size, anchor) if view is not None else ():
                    may = among(bits, content)
                    for i in np.flatnonzero(may).tolist():
                        x = int(content[i])
                        if x in known:
                            may[i] = False
                        known.add(x)
                    if may.any():
                        held.append((content[may], count[may], w[np.repeat(may, count)]))
                        n += len(held[-1][-1])
                if n > 1 << 18:
                    yield rows(held)
                    held, n = [], 0
            if len(known) > 1 << 18:
                known.clear()
            if held:
                yield rows(held)
        known.clear()
        release()

    def rows(held: list[tuple]) -> pa.RecordBatch:
        content, count, w = (np.concatenate(c) for c in zip(*held, strict=True))
        at = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(content.view(np.int64)), pa.ListArray.from_arrays(pa.array(at), pa.array(w.view(np.int64)))], names=["content", "w"])

    return df.select("t").mapInArrow(run, "content long, w array<long>")


def _chains(paths: DataFrame) -> DataFrame:
    """(p, head, offset): the chain of each path (p, n, start, end) by its first path, and the windows before it there.

    A path follows another where it alone starts at the node at which the other alone ends. Each round doubles the steps
    that are taken towards the head, and ends with a written table. Paths of a ring never reach one; they stay alone.
    """
    starts = paths.groupBy("start").agg(F.count(F.lit(1)).alias("d"), F.first("p").alias("p")).where("d = 1").select(F.col("start").alias("node"), "p")
    ends = paths.groupBy("end").agg(F.count(F.lit(1)).alias("d"), F.first("p").alias("up"), F.first("n").alias("n")).where("d = 1").select(F.col("end").alias("node"), "up", "n")
    linked = cut(starts.join(ends, "node").where("p != up").select("p", "up", F.col("n").cast("long").alias("offset"), F.lit(False).alias("done")), "repeat-links")
    # the paths that another follows and that follow none are heads
    left = linked.count()
    while left:
        above = linked.select(F.col("p").alias("up"), F.col("up").alias("next"), F.col("offset").alias("more"), F.col("done").alias("reached"))
        met = linked.join(above, "up", "left")
        linked = cut(met.select("p", F.coalesce("next", "up").alias("up"), (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset"), (F.col("next").isNull() | F.coalesce("reached", F.lit(False))).alias("done")), "repeat-links", linked)
        open_ = linked.where("not done").count()
        if open_ == left:
            break
        left = open_
    return linked.where("done").select("p", F.col("up").alias("head"), "offset")


#: What a row of hits is: a whole chain, a path of a chain that is broken somewhere, or single windows of a piece.
_CHAIN, _PATH, _WINDOWS = 0, 1, 2


def find_repeats(df: DataFrame, text: str = "text", size: int = 35, anchor: int = 10, carry: bool = True, salt: int = 0) -> DataFrame:
    """Adds n_words, removed (array of word spans, end exclusive), n_removed and kept (the words left, one space between).

    A word is removed if a window of ``size`` words that covers it also starts anywhere else, in the same text or
    another. Windows are judged on the input. Null and empty texts, and texts of fewer than ``size`` words, lose
    nothing; repeated rows repeat each other's windows. Made columns replace input columns of their names.

    Candidates are found by hashes of 64 bits. All words that would be removed are then read at their coordinates, and
    where equal hashes stand for different words (which has not been seen) the search starts anew with other hashes, told
    apart by ``salt``.

    Shuffled: a hash and a count for each minimizer (about 2 in 27 words), the pieces with a repeated minimizer, the
    windows of branching pieces, and the texts with repeats once, to meet their spans. Broadcast: bit maps of up to 32 MB;
    as the corpus outgrows them more pieces are shuffled, with the same result. ``carry=False`` leaves the input text out
    of the result.
    """
    spark = df.sparkSession
    anchor = min(max(anchor, size - 61), size)  # a piece has up to size - anchor + 1 windows, kept as bits of one signed long
    counted = cut(_minimizers(df, text, size, anchor, salt).groupBy("h").agg(F.sum("c").alias("c")).where("c > 1").select("h"), "repeat-minimizers")
    shared = spark.sparkContext.broadcast(hash_bits(counted))

    keyed = df.select(*row_keys(df, ("k1", "k2")), F.col(f"`{text}`").cast("string").alias("t"))
    found = cut(_pieces(keyed, size, anchor, salt, shared), "repeat-pieces", counted)

    grouped = found.groupBy("h", "content").agg(F.count(F.lit(1)).alias("c"), *[F.first(x).alias(x) for x in ("n", "start", "end")])
    paths = cut(grouped.withColumn("p", F.monotonically_increasing_id()), "repeat-paths")
    branching = paths.groupBy("h").agg(F.count(F.lit(1)).alias("d")).where("d > 1").select("h")
    branches = cut(paths.join(branching, "h").select("h", "content", "c", "p"), "repeat-branches")
    hashes = _window_hashes(keyed, size, anchor, salt, spark.sparkContext.broadcast(hash_bits(branches, "content")))
    hashes = hashes.groupBy("content").agg(F.first("w").alias("w"))
    edges = cut(branches.join(hashes, "content").select("p", "c", F.posexplode("w").alias("i", "e")), "repeat-edges")
    repeated = edges.groupBy("e").agg(F.sum("c").alias("times")).where("times > 1").select("e")
    partial = cut(edges.join(repeated, "e").groupBy("p").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("mask")), "repeat-partial", edges)
    plain = cut(paths.where("c > 1").join(branches.select("p"), "p", "left_anti").select("p", "n", "start", "end"), "repeat-plain")
    chained = plain.select("p", "n").join(_chains(plain), "p", "left").select("p", "n", F.coalesce("head", "p").alias("head"), F.coalesce("offset", F.lit(0)).alias("offset"))
    chained = cut(chained, "repeat-chained", plain)
    lengths = chained.groupBy("head").agg(F.sum("n").alias("length"))
    placed = chained.join(lengths, "head").select("p", "head", "offset", "length", F.lit(None).cast("long").alias("mask"))
    placed = placed.unionByName(partial.select("p", F.col("p").alias("head"), F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("length"), "mask"))
    named = paths.select("h", "content", "p").join(placed, "p")
    spans = found.select("k1", "k2", "h", "content", "first", "n").join(named, ["h", "content"]).withColumn("at", F.col("first") - F.col("offset"))
    runs = spans.groupBy("k1", "k2", "head", "at").agg(F.first("length").alias("length"), F.collect_set(F.struct("first", "n", "p", "mask")).alias("own"))
    covered = F.aggregate("own", F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    runs = cut(runs.withColumn("whole", (F.col("length") > 0) & (covered == F.col("length"))), "repeat-runs", found)
    for done in (paths, branches, chained, partial):
        uncut(done)
    broken = runs.where("length > 0 and not whole").select("head").distinct().withColumn("broken", F.lit(True))
    chain = F.array(F.struct(F.lit(_CHAIN).alias("kind"), F.col("at").cast("int").alias("first"), F.col("length").cast("int").alias("n"), F.lit(None).cast("long").alias("mask"), F.col("head").alias("unit")))
    single = F.transform("own", lambda x: F.struct(F.when(x["mask"].isNull(), _PATH).otherwise(_WINDOWS).alias("kind"), x["first"].alias("first"), x["n"].alias("n"), x["mask"].alias("mask"), x["p"].alias("unit")))
    listed = runs.join(broken, "head", "left").select("k1", "k2", F.explode(F.when(F.col("whole") & F.col("broken").isNull(), chain).otherwise(single)).alias("hit"))
    hits = cut(listed.groupBy("k1", "k2").agg(F.collect_list("hit").alias("_hits")), "repeat-hits", runs)

    kept = keep_columns(df, ["n_words", "n_removed", "removed", "kept"])
    keyed = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, text])], *row_keys(df))
    untouched, others = parted(keyed, "_k1", hash_bits(hits, "k1"))
    met = cut(others.join(hits.withColumnsRenamed({"k1": "_k1", "k2": "_k2"}), ["_k1", "_k2"], "left"), "repeat-met", hits)
    read = _read(met.where(F.col("_hits").isNotNull()).select(F.col(f"`{text}`").cast("string").alias("t"), "_hits"), size, salt)
    clash = read.groupBy("kind", "unit").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a != b")
    if not clash.isEmpty():
        return find_repeats(df, text, size, anchor, carry, salt + 1)
    both = met.unionByName(untouched.withColumn("_hits", F.lit(None).cast(met.schema["_hits"].dataType)))

    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    made = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", span), T.StructField("kept", T.StringType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for view, hits in zip(views(batch.column(0)), batch.column(1), strict=True):
                own = view.tobytes().split() if view is not None else []
                n = len(own)
                runs: list[dict] = []
                if hits.is_valid:
                    gone = _covered(hits, n, size)
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                    runs = [{"start": a, "end": b} for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True)]
                    for r in reversed(runs):
                        del own[r["start"] : r["end"]]
                for column, v in zip(out, (n, n - len(own), runs, b" ".join(own).decode()), strict=True):
                    column.append(v)
            yield [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(out[3], pa.string())]

    return add_columns(both.drop("_k1", "_k2"), text, made, rows, ("_hits",), without=("_hits",) if carry else ("_hits", text))


def _read(met: DataFrame, size: int, salt: int) -> DataFrame:
    """(kind, unit, digest) of the words at the coordinates of all hits; each once for what a task remembers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], bytes] = {}
        for batch in sliced(batches):
            new: list[tuple[int, int, bytes]] = []

            def add(kind: int, unit: int, words: list[bytes]) -> None:
                digest = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
                if known.get((kind, unit)) != digest:
                    known[kind, unit] = digest
                    new.append((kind, unit, digest))

            for view, hits in zip(views(batch.column(0)), batch.column(1), strict=True):
                own = view.tobytes().split() if view is not None else []
                kind, first, n, mask, unit = (hits.values.field(x).to_pylist() for x in ("kind", "first", "n", "mask", "unit"))
                w = windows(_hashes(view, salt), size).view(np.int64) if _WINDOWS in kind else None
                for i, k in enumerate(kind):
                    if k != _WINDOWS:
                        add(k, unit[i], own[first[i] : first[i] + n[i] + size - 1])
                        continue
                    for j in range(n[i]):
                        if mask[i] >> j & 1:
                            add(k, int(w[first[i] + j]), own[first[i] + j : first[i] + j + size])
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in new], pa.int32()), pa.array([x[1] for x in new], pa.int64()), pa.array([x[2] for x in new], pa.binary())], names=["kind", "unit", "digest"])
            if len(known) > 1 << 17:
                known.clear()
        known.clear()
        release()

    return met.mapInArrow(run, "kind int, unit long, digest binary")


def _covered(hits: pa.Scalar, n: int, size: int) -> np.ndarray:
    """Words inside a repeated window: of chains and paths all windows are repeated, of other pieces those in the mask."""
    values = hits.values
    kind, first, count = (values.field(x).to_numpy() for x in ("kind", "first", "n"))
    step = np.zeros(n + 1, np.int64)
    whole = kind != _WINDOWS
    np.add.at(step, first[whole], 1)
    np.add.at(step, first[whole] + count[whole] + size - 1, -1)
    first, mask = first[~whole], values.field("mask").fill_null(0).to_numpy()[~whole].view(np.uint64)
    for i in range(64):
        on = first[(mask >> np.uint64(i)) & np.uint64(1) == 1] + i
        if len(on):
            np.add.at(step, on, 1)
            np.add.at(step, on + size, -1)
    return np.cumsum(step[:-1]) > 0
