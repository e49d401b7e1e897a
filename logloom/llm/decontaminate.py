"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against training token windows.

What is broadcast is the items' text; the set is built from it in the workers, as sorted arrays of window hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, cut, keep_columns, row_keys, views
from .tokens import ALNUM, windows

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
MADE = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("hit_words", SPAN),
        T.StructField("hit_bytes", SPAN),
    ]
)


#: Words of a benchmark piece; a longer item is dealt out in pieces that overlap by a window less one word.
PIECE = 1 << 16
_EMPTY = np.empty(0, np.uint8)


def pieces(benchmark: DataFrame, size: int) -> DataFrame:
    """(item, text) of all items in pieces of about ``PIECE`` words, which together have just the windows of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = [], []
            for item, body in zip(batch.column(0).to_pylist(), views(batch.column(1)), strict=True):
                _, s, e = ALNUM.hashes_and_bounds(body if body is not None else _EMPTY)
                for at in range(0, max(len(s) - size + 1, min(len(s), 1)), PIECE):
                    end = min(len(s), at + PIECE + size - 1)
                    names.append(item)
                    texts.append(body[s[at] : e[end - 1]].tobytes().decode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["item", "text"])

    return benchmark.mapInArrow(run, "item string, text string")


class Scanner:
    """Finds windows of some items in texts, with sorted arrays: at most 36 bytes a word of the items, beside their text.

    The filter bits only skip work, and equal hashes only name what to compare: every hit is verified by its words.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], size: int):
        bodies = [np.frombuffer((text or "").encode(), np.uint8) for _, text in items]
        self.low = np.concatenate([_FOLD[b] for b in bodies] or [_EMPTY])
        self.names = [name for name, _ in items]
        found: dict[int, list[tuple[np.ndarray, ...]]] = {}
        starts, ends, words, at = [], [], 0, 0
        for i, body in enumerate(bodies):
            h, s, e = ALNUM.hashes_and_bounds(body)
            if len(h):
                w = windows(h, min(size, len(h)))
                found.setdefault(min(size, len(h)), []).append((w, np.arange(words, words + len(w), dtype=np.int32), np.full(len(w), i, np.int32)))
                starts.append((s + at).astype(np.int32))
                ends.append((e + at).astype(np.int32))
            words += len(h)
            at += len(body)
        none = np.empty(0, np.int32)
        self.start, self.end = np.concatenate(starts or [none]), np.concatenate(ends or [none])
        self.tables = {}
        for m, parts in found.items():
            h, word, item = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable").astype(np.int32)
            h = h[order]
            log = max(12, min(24, (len(h) * 64).bit_length()))
            seen = np.zeros(1 << log, bool)
            seen[(h >> np.uint64(64 - log)).astype(np.int64)] = True
            self.tables[m] = (h, word[order], item[order], seen, np.uint64(64 - log))
        self.known: dict[tuple[int, int], list[tuple[bytes, frozenset[str]]]] = {}

    def _words(self, low: np.ndarray, s: np.ndarray, e: np.ndarray) -> bytes:
        own = low[s[0] : e[-1]].tobytes()
        return b" ".join(own[a:b] for a, b in zip((s - s[0]).tolist(), (e - s[0]).tolist(), strict=True))

    def _entries(self, m: int, at: int, end: int) -> list[tuple[bytes, frozenset[str]]]:
        """Window texts of one hash, and the items that each is in; remembered, since passages are hit again and again."""
        known = self.known.get((m, at))
        if known is None:
            _, word, item, _, _ = self.tables[m]
            found: dict[bytes, set[str]] = {}
            for w, i in zip(word[at:end].tolist(), item[at:end].tolist(), strict=True):
                own = found.setdefault(self._words(self.low, self.start[w : w + m], self.end[w : w + m]), set())
                if self.names[i] is not None:
                    own.add(self.names[i])
            if len(self.known) >= 1 << 14:
                self.known.clear()
            self.known[m, at] = known = [(k, frozenset(v)) for k, v in found.items()]
        return known

    def scan(self, text: np.ndarray) -> tuple[int, np.ndarray, set[str], np.ndarray, np.ndarray]:
        """Number of words, a mask of hit words, items met, byte starts and ends of words."""
        h, s, e = ALNUM.hashes_and_bounds(text)
        n = len(h)
        step = np.zeros(n + 1, np.int32)
        met: set[str] = set()
        for m, (hashes, _, _, seen, shift) in self.tables.items():
            w = windows(h, m)
            may = np.flatnonzero(seen[(w >> shift).astype(np.int64)])
            if not len(may):
                continue
            lo, hi = np.searchsorted(hashes, w[may], "left"), np.searchsorted(hashes, w[may], "right")
            some = hi > lo
            for i, at, end in zip(may[some].tolist(), lo[some].tolist(), hi[some].tolist(), strict=True):
                own = self._words(_FOLD[text[s[i] : e[i + m - 1]]], s[i : i + m] - s[i], e[i : i + m] - s[i])
                for key, ids in self._entries(m, at, end):
                    if own == key:
                        step[i] += 1
                        step[i + m] -= 1
                        met |= ids
        return n, np.cumsum(step[:-1]) > 0, met, s, e


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[0::2], edge[1::2]


def find_contamination(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", size: int = 13, block_bytes: int = 8 << 20) -> DataFrame:
    """Adds n_words, n_hit, items (sorted as strings), hit_words and hit_bytes (spans, end exclusive) to each row of ``df``.

    A window is ``size`` consecutive words of an item, or a shorter item's whole sequence. A null or empty text has no
    words; an item without words has no window; equal items are each named; a null item id hits but is not named.
    Repeated rows are judged alike. Made columns replace input columns of their names; other columns stay.

    The benchmark's words are broadcast as text, ``block_bytes`` at once, and each worker builds its sorted table of
    windows from them (some 18 bytes for each byte of text at worst, words of one letter). A larger benchmark is dealt by
    hash into blocks of about that size. Each block is then one scan of the documents of its own, whose hits are written
    before the next begins; so one table is alive at once, at any size. Only in that case documents are shuffled, to meet
    their hits by a 128-bit key of the whole row.
    """
    spark = df.sparkSession
    parts = pieces(benchmark.select(F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{item_text}`").cast("string").alias("text")), size)
    total = parts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    if blocks == 1:
        return _scan(df, spark.sparkContext.broadcast([(r.item, r.text) for r in parts.toLocalIterator()]), size, text)
    parts = cut(parts.withColumn("block", F.pmod(F.xxhash64("text", "item"), F.lit(blocks))), "benchmark-pieces")
    found = None
    for b in range(blocks):
        shared = spark.sparkContext.broadcast([(r.item, r.text) for r in parts.where(F.col("block") == b).toLocalIterator()])
        hits = _scan(df.select(*row_keys(df), F.col(f"`{text}`").cast("string").alias("_t")), shared, size, "_t").where("n_hit > 0")
        hits = cut(hits.select("_k1", "_k2", "items", "hit_words"), "benchmark-hits")
        shared.unpersist()
        found = hits if found is None else found.unionByName(hits)
    met = found.groupBy("_k1", "_k2").agg(F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), F.flatten(F.collect_set("hit_words")).alias("hit_words"))
    kept = [c for c in keep_columns(df, MADE.fieldNames()) if c != text]
    joined = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`"), *row_keys(df)).join(met, ["_k1", "_k2"], "left").drop("_k1", "_k2")
    return _scan(joined, None, size, text).select(*keep_columns(df, MADE.fieldNames()), *MADE.fieldNames())


def _scan(df: DataFrame, shared, size: int, text: str) -> DataFrame:
    """Scans for the windows of the broadcast items; without them, measures the hits that ``df`` brings along."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        scanner = Scanner(shared.value if shared is not None else [], size)
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            earlier = iter(zip(*[batch.column(i).to_pylist() for i in (1, 2)], strict=True)) if shared is None else None
            out: list[list] = [[] for _ in MADE]
            for view in views(batch.column(0)):
                n, mask, met, s, e = scanner.scan(view if view is not None else _EMPTY)
                if earlier is not None:
                    items, spans = next(earlier)
                    met.update(items or ())
                    for x in spans or ():
                        mask[x["start"] : x["end"]] = True
                a, z = _runs(mask)
                spans = [{"start": x, "end": y} for x, y in zip(a.tolist(), z.tolist(), strict=True)]
                cuts = [{"start": int(s[x]), "end": int(e[y - 1])} for x, y in zip(a.tolist(), z.tolist(), strict=True)]
                for column, v in zip(out, (n, int(mask.sum()), sorted(met), spans, cuts), strict=True):
                    column.append(v)
            yield [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.list_(pa.string()), span, span), strict=True)]

    return add_columns(df, text, MADE, rows, ("items", "hit_words") if shared is None else ())


def contaminated(n_hit="n_hit", n_words="n_words"):
    """At least one word in twenty is hit."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * 20 >= F.col(n_words))


def remove_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """Cuts the hit spans out of the text (byte offsets of whole words) and drops the columns that name them."""
    body = F.col(text).cast("binary")
    kept = F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))), F.col("hit_bytes"))
    gaps = F.zip_with(kept, F.concat(F.col("hit_bytes"), F.array(F.struct(F.octet_length(text).alias("start"), F.lit(0).alias("end")))), lambda a, b: F.substring(body, a["end"] + 1, b["start"] - a["end"]).cast("string"))
    return df.withColumn(text, F.when(F.size("hit_bytes") > 0, F.array_join(gaps, "")).otherwise(F.col(text)))
