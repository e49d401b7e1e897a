"""Document fingerprints: invertible Bloom lookup tables over paragraph digests.

A document is a multiset of units: paragraphs (lines), long ones cut at content-defined word boundaries. Two tables of
one size subtract cell by cell; peeling the difference recovers the digests that only one side has. Where peeling
fails, both sides are sketched again twice as large.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep_columns
from .tokens import PLAIN, mix, powers

#: Cells of the fingerprint that is handed out; retries take twice as many each.
CELLS = 12
_LONG, _PIECE = 64, 48


def digests(text: np.ndarray) -> np.ndarray:
    """Distinct 64-bit keys of a text's units; the n-th copy of a unit has a key of its own. Sorted."""
    h, start, end = PLAIN.hashes_and_bounds(text)
    if not len(h):
        return h
    if int((end - start).max()) > _LONG:  # unspaced text: pieces of a fixed length instead of one word
        parts = np.where(end - start > _LONG, -(-(end - start) // _PIECE), 1)
        first = np.repeat(np.cumsum(parts) - parts, parts)
        step = np.arange(len(first)) - first
        s = np.repeat(start, parts) + step * _PIECE
        e = np.where(step == np.repeat(parts, parts) - 1, np.repeat(end, parts), s + _PIECE)
        up, down = powers(len(text) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(PLAIN.values[text] * up[: len(text)])))
        h, start = mix((sums[e] - sums[s]) * down[s]), s
    line = np.searchsorted(np.flatnonzero(text == 10), start)
    new = np.empty(len(h), bool)
    new[0] = True
    new[1:] = (line[1:] != line[:-1]) | (h[:-1] & np.uint64(7) == 0)
    at = np.flatnonzero(new)
    up, down = powers(len(h) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)])))
    unit = np.sort(mix((sums[np.append(at[1:], len(h))] - sums[at]) * down[at]))
    first = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
    copy = np.arange(len(unit)) - np.repeat(first, np.diff(np.append(first, len(unit))))
    return unit if not copy.any() else np.sort(np.where(copy > 0, mix(unit + copy.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)), unit))


class Sketch:
    """An invertible Bloom lookup table of three equal parts; each key has one cell in each."""

    def __init__(self, keys: np.ndarray, spread: np.ndarray, check: np.ndarray, cells: int):
        self.cells, self.n = cells, len(keys)
        self.count, self.key, self.check = np.zeros(cells, np.int64), np.zeros(cells, np.uint64), np.zeros(cells, np.uint64)
        for at in places(spread, cells) if len(keys) else ():
            self.count += np.bincount(at, minlength=cells)
            np.bitwise_xor.at(self.key, at, keys)
            np.bitwise_xor.at(self.check, at, check)

    def text(self) -> str:
        """A printable form; equal multisets of units give equal strings."""
        raw = self.count.astype("<u4").tobytes() + self.key.astype("<u8").tobytes() + (self.check & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()
        return f"{self.n}:{base64.b64encode(raw).decode()}"

    def peel(self, other: Sketch) -> tuple[np.ndarray, np.ndarray] | None:
        """Keys only here, keys only there; None if the difference is too large for this size."""
        count, key, check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        ours, theirs = [], []
        while True:
            pure = np.flatnonzero((count == 1) | (count == -1))
            own = key[pure]
            sums = checks(own)
            good = sums == check[pure]
            if not good.any():
                break
            found, first = np.unique(own[good], return_index=True)
            sign, sums = count[pure[good][first]], sums[good][first]
            ours.append(found[sign > 0])
            theirs.append(found[sign < 0])
            for at in places(mix(found), self.cells):
                np.subtract.at(count, at, sign)
                np.bitwise_xor.at(key, at, found)
                np.bitwise_xor.at(check, at, sums)
        if count.any() or key.any():
            return None
        none = np.empty(0, np.uint64)
        return np.concatenate(ours) if ours else none, np.concatenate(theirs) if theirs else none


_LOW = np.uint64((1 << 21) - 1)


def places(spread: np.ndarray, cells: int) -> list[np.ndarray]:
    """One cell in each third for mixed keys: 21 of their bits, scaled; tables of over 3 x 2^21 cells mix again."""
    part = cells // 3
    if part <= 1 << 21:
        return [((((spread >> np.uint64(21 * j)) & _LOW) * np.uint64(part)) >> np.uint64(21)).astype(np.int64) + j * part for j in range(3)]
    return [(mix(spread + np.uint64(j)) % np.uint64(part)).astype(np.int64) + j * part for j in range(3)]


def checks(keys: np.ndarray) -> np.ndarray:
    return mix(keys + np.uint64(0xA0761D6478BD642F))


class Document:
    """A text with its unit keys and the sketches made of it so far."""

    def __init__(self, text: str):
        self.raw = text.encode()
        self.keys = digests(np.frombuffer(self.raw, np.uint8))
        self.spread, self.check = mix(self.keys), checks(self.keys)
        self.sketches: dict[int, Sketch] = {}

    def sketch(self, cells: int = CELLS) -> Sketch:
        if cells not in self.sketches:
            self.sketches[cells] = Sketch(self.keys, self.spread, self.check, cells)
        return self.sketches[cells]


def difference(a: Document, b: Document, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """Unit keys that only ``a`` and only ``b`` has, by peeling; a failing size is retried twice as large.

    The first size follows an estimate from the least 64 keys of either side; the result does not depend on it.
    """
    wanted = 1.5 * _distance(a.keys, b.keys) + 6
    while cells < wanted:
        cells *= 2
    while (found := a.sketch(cells).peel(b.sketch(cells))) is None:
        cells *= 2
    return found


def _distance(a: np.ndarray, b: np.ndarray, k: int = 64) -> float:
    """Estimated size of the symmetric difference of two sorted key sets."""
    if not len(a) or not len(b):
        return float(len(a) + len(b))
    both = np.concatenate((a[:k], b[:k]))
    both.sort()
    top = min(a[k - 1] if len(a) > k else both[-1], b[k - 1] if len(b) > k else both[-1])
    both = both[both <= top]
    shared = int((both[1:] == both[:-1]).sum())
    j = shared / (len(both) - shared)
    return max(abs(len(a) - len(b)), (len(a) + len(b)) * (1 - j) / (1 + j))


def likeness(a: Document, b: Document) -> float:
    """Shared units by all units, from the recovered difference; two texts without units are alike."""
    ours, theirs = difference(a, b)
    union = len(a.keys) + len(theirs)
    return (len(a.keys) - len(ours)) / union if union else 1.0


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many (or all) first ones of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


MADE = T.StructType(
    [
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
        T.StructField("units", T.LongType()),
        T.StructField("units_only_before", T.LongType()),
        T.StructField("units_only_after", T.LongType()),
    ]
)


def neighbours(df: DataFrame, key: str, text: str, rows_per_bucket: int = 1000, most_buckets: int = 16384) -> DataFrame:
    """Rows sorted by falling key within buckets of a partition, each bucket followed by the first row of the next one.

    Columns: bucket, guest, key, text, and the rest. One shuffle of the rows; splits and first keys come from the keys
    alone. At most ``most_buckets`` of each reach the driver. Keys that are no whole numbers are ordered as strings. A null
    key sorts last, equal keys by falling text.
    """
    number = isinstance(df.schema[key].dataType, T.IntegralType)
    low = -(1 << 63) if number else ""
    own = F.col(f"`{key}`").cast("long") if number else F.concat(F.lit("+"), F.col(f"`{key}`").cast("string"))
    k = F.coalesce(own, F.lit(low))
    kind = "long" if number else "string"
    ids = df.select(k.alias("k"))
    n = ids.count()
    buckets = max(1, min(most_buckets, math.ceil(n / rows_per_bucket)))
    splits: list[int] = []
    if buckets > 1:
        wanted = [i / buckets for i in range(1, buckets)]
        if number:
            got = ids.agg(F.percentile_approx("k", wanted, F.lit(10 * buckets)).alias("p")).first()["p"]
        else:
            got = [r.m for r in ids.repartitionByRange(buckets, "k").groupBy(F.spark_partition_id().alias("p")).agg(F.max("k").alias("m")).collect()]
        splits = sorted(set(got), reverse=True)

    table = F.array(*[F.lit(x).cast(kind) for x in splits]) if splits else F.array().cast(f"array<{kind}>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, len(splits).bit_length())))])

    def bucket_of(c: Column) -> Column:
        """Number of splits above the key: binary search over the falling list."""
        return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= len(splits)) & (F.get(table, at + s - 1) > c), at + s).otherwise(at)) if splits else F.lit(0)

    firsts = {r["b"]: r["m"] for r in ids.select("k", bucket_of(F.col("k")).alias("b")).groupBy("b").agg(F.max("k").alias("m")).collect()}
    used = sorted(firsts)
    before = {b: used[i - 1] for i, b in enumerate(used)}  # the first bucket's first row also follows the last bucket
    b = bucket_of(F.col("_k"))
    first_of = F.array(*[F.lit(firsts.get(i, low)).cast(kind) for i in range(len(splits) + 1)])
    guest_in = F.array(*[F.lit(before.get(i, 0)) for i in range(len(splits) + 1)])
    home = F.struct(F.col("_b").alias("bucket"), F.lit(0).alias("guest"))
    away = F.struct(F.get(guest_in, F.col("_b")).alias("bucket"), F.lit(1).alias("guest"))
    placed = df.select(k.alias("_k"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"), *[F.col(f"`{c}`") for c in df.columns if c != text])
    placed = placed.withColumn("_b", b).withColumn("_at", F.explode(F.when(F.col("_k") == F.get(first_of, F.col("_b")), F.array(home, away)).otherwise(F.array(home))))
    placed = placed.withColumns({"_bucket": F.col("_at.bucket"), "_guest": F.col("_at.guest")}).drop("_b", "_at")
    return placed.repartition(buckets, "_bucket").sortWithinPartitions("_bucket", "_guest", F.desc("_k"), F.desc("_text"))


def fingerprint_versions(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints each text and its edited version, and compares them by peeling.

    The edited version replaces the last half of the code points by the first ones of the next row (falling key; after
    the last row: the first; keys that are no whole numbers are ordered as strings). Null texts count as empty. A single row is its own next. Repeated keys are ordered by
    falling text, null keys come last. Made columns replace input columns of their names; the text is not returned.

    The fingerprint handed out has ``CELLS`` = 12 cells at any length: two of them, subtracted, decode about nine
    different units at best. The likeness beside them comes from larger sketches of both whole texts, which are not kept.
    """
    kept = [c for c in keep_columns(df, MADE.fieldNames()) if c != text]
    schema = T.StructType([df.schema[c] for c in kept] + list(MADE.fields))
    source = neighbours(df.select(*[F.col(f"`{c}`") for c in kept if c != text], F.col(f"`{text}`")), key, text)
    order = ["_bucket", "_guest", "_text", *kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, Document, str, list] | None = None
        for batch in batches:
            bucket, guest, texts = (batch.column(i).to_pylist() for i in range(3))
            rest = [batch.column(3 + i) for i in range(len(kept))]
            carried: list[list] = [[] for _ in kept]
            out: list[list] = [[] for _ in MADE]
            for i, t in enumerate(texts):
                if guest[i] and (held is None or held[0] != bucket[i]):
                    continue
                now = Document(t)
                if held is not None and held[0] == bucket[i]:
                    _, a, own, values = held
                    other = edited(own, t)
                    e = Document(other) if other != own else a
                    ours, theirs = difference(a, e)
                    union = len(a.keys) + len(theirs)
                    made = (len(own), hashlib.sha256(e.raw).hexdigest(), a.sketch().text(), e.sketch().text(), (len(a.keys) - len(ours)) / union if union else 1.0, likeness(a, now), len(a.keys), len(ours), len(theirs))
                    for column, v in zip(out, made, strict=True):
                        column.append(v)
                    for column, v in zip(carried, values, strict=True):
                        column.append(v)
                held = None if guest[i] else (bucket[i], now, t, [c[i] for c in rest])
            types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array([v.as_py() for v in c], f.type) for c, f in zip(carried, (batch.schema.field(3 + j) for j in range(len(kept))), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(c, t) for c, t in zip(out, types, strict=True)], names=[*kept, *MADE.fieldNames()])

    return source.select(*[F.col(f"`{c}`") for c in order]).mapInArrow(run, schema)
