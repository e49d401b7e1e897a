"""LM scoring by a hierarchical Pitman-Yor model.

Tokens are lowered words and an end of text. A token's context is the word before it (the end, at the start of a text);
above that lie the last letter beyond ASCII so far (32 classes, which tells languages apart), and with it whether a
sentence may have just ended. Context restaurants share parents: (word, letter, stop) -> (letter, stop) -> letter ->
root -> base measure. Restaurants of words are tables of one entry for each pair that occurs; each starts with one table
a pair, and pairs that occur more often are seated anew once the levels above are known. Above, the tables of a word
over all contexts are one row, so seating is sampled word by word: a Gibbs sweep draws the numbers of tables given the
parents' predictive probabilities and the restaurants' totals, and the totals of all words are brought up to date
between passes. Scores use predictive probabilities averaged over the kept sweeps.

Pairs are dealt into buckets, by their context so that a bucket holds whole restaurants; only contexts of the very
commonest words are dealt by pair. What a bucket needs of the levels above is broadcast for frequent words and comes by
a join for the others. Documents meet the model in the buckets too: each block of documents asks every bucket for its
pairs, and the buckets answer with sums for each document.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, release, row_keys, uncut
from .packed import CONTEXT_BITS, HASHED, WORD_BITS, Pairs, counted, distinct, doubled, doubles, fixed, numbers, planes, unfixed
from .tokens import LOWER, mix

LETTERS = 32
CONTEXTS = 2 * LETTERS
#: Words (the most frequent ones) whose probabilities are broadcast; all others are joined.
FREQUENT = 1 << WORD_BITS
#: Words whose contexts are dealt by pair: any other context has less than a share of 1 / HEAD of all tokens.
HEAD = 1 << 10
#: Tokens that a block of documents asks for at once, and training tokens of a bucket on average.
BLOCK, BUCKET = 3 << 19, 1 << 20
#: Rounds that documents are scored in, unless they are few: what one sends and gets is removed before the next.
ROUNDS = 2
#: Share of the base measure that words never seen have together; the others share the rest.
FRESH = 0.95
#: Counts up to here have their generalised Stirling numbers in a table; for larger ones they are computed.
EXACT = 64
#: Numbers of tables that are weighed for a large count; they are spaced out where its distribution is wider.
_POINTS = 64

#: Words are told apart by 63 bits, contexts of infrequent words by 57.
END = int(mix(np.array([0x454E44], np.uint64))[0]) | 1 << 63
_STOPS = np.zeros(256, bool)
_STOPS[list(b".!?")] = True


def tokens(text: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a text, the end included, and the context of each."""
    if text is None:
        text = np.empty(0, np.uint8)
    h, start, end = LOWER.hashes_and_bounds(text)
    n = len(h)
    beyond = np.flatnonzero(text >= 128)
    before = np.searchsorted(beyond, np.append(start, len(text)))
    letter = np.zeros(n + 1, np.int64)
    some = before > 0
    letter[some] = 1 + text[beyond[before[some] - 1]].astype(np.int64) % (LETTERS - 1)
    stop = np.ones(n + 1, np.int64)
    stop[1:] = _STOPS[text[end - 1]] if n else 0
    return np.append(h | HASHED, np.uint64(END)), 2 * letter + stop


#: Bytes of texts whose tokens are found at once; a longer text goes alone.
_TEXTS = 1 << 17


def token_runs(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``tokens`` of the texts of a column, of several short ones at once, and how many each text has."""
    if column.null_count:
        column = pa.compute.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    edge = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(edge, edge[i] + _TEXTS, "right")) - 1)
        text = body[edge[i] : edge[j]]
        if len(text) > _TEXTS:
            h, k = tokens(text)
            yield h, k, np.array([len(h)])
        else:
            yield _run(text, edge[i : j + 1].astype(np.int64) - edge[i])
        i = j


def _run(text: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``tokens`` of texts that lie one behind the other, from their edges; and how many each has."""
    word = ~LOWER.sep[text]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    # words end at the edges of texts
    inner = edge[(edge > 0) & (edge < len(text))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    words = np.searchsorted(start, edge)  # before each edge
    size = np.diff(words) + 1
    close = np.cumsum(size) - 1  # places of the ends among the tokens
    own = np.ones(len(start) + len(size), bool)
    own[close] = False
    place = np.flatnonzero(own)
    h = np.full(len(own), END, np.uint64)
    h[place] = LOWER.hashes_at(text, start, end) | HASHED
    stop = np.empty(len(own), np.int64)
    stop[0] = 1
    stop[close[:-1] + 1] = 1
    # a word's mark is for the token after it
    stop[place + 1] = _STOPS[text[end - 1]]
    beyond = np.flatnonzero(text >= 128)
    if not len(beyond):
        return h, stop, size
    at = np.empty(len(own), np.int64)
    at[place], at[close] = start, edge[1:]
    before = np.zeros(len(text) + 1, np.int32)
    np.cumsum(text >= 128, out=before[1:])
    low = np.repeat(before[edge[:-1]], size)
    before = before[at]
    letter = np.where(before > low, 1 + text[beyond[before - 1]].astype(np.int64) % (LETTERS - 1), 0)
    return h, 2 * letter + stop, size


def learned(key: str = "doc_id", folds: int = 5, fold: int = 1) -> Column:
    """Whether a row is learned from: crc32 of its id as text modulo ``folds`` is not ``fold``; a null id never is."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % folds != fold, F.lit(False))


@dataclass
class Codes:
    """Hashes of the frequent words (sorted; a word's number is its place), their counts, the rank of each that is a head
    (else -1), and the number of buckets."""

    top: np.ndarray
    counts: np.ndarray
    rank: np.ndarray
    buckets: int

    def words(self, h: np.ndarray) -> np.ndarray:
        """The code of each word: by the leading bits of its hash, then by search where several words share those."""
        if not len(self.top):
            return h
        slot, shift = self._slots()
        at = slot[((h & ~HASHED) >> shift).astype(np.int64)]
        many = np.flatnonzero(at < -1)
        if len(many):
            at[many] = np.minimum(np.searchsorted(self.top, h[many]), len(self.top) - 1)
        return np.where((at >= 0) & (self.top[at] == h), at.astype(np.uint64), h)

    def _slots(self) -> tuple[np.ndarray, np.uint64]:
        """For each value of the leading bits the word that has them, -1 for none, -2 for several."""
        if "made" not in self.__dict__:
            bits = min(22, len(self.top).bit_length() + 5)
            shift = np.uint64(63 - bits)
            slot = np.full(1 << bits, -1, np.int32)
            own = ((self.top & ~HASHED) >> shift).astype(np.int64)
            slot[own] = np.arange(len(own))
            times = np.bincount(own, minlength=1 << bits)
            slot[times > 1] = -2
            self.made = slot, shift
        return self.made

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "made"}

    def contexts(self, y: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The code of each token's restaurant, from the codes of the tokens of one or more texts and their contexts above."""
        low = np.uint64((1 << CONTEXT_BITS) - 1)
        before = np.concatenate((self.words(np.array([END], np.uint64)), y[:-1]))
        some = np.flatnonzero(before >= HASHED)
        out = before << np.uint64(CONTEXT_BITS)
        out[some] = mix(before[some]) & ~low | HASHED
        out |= k.view(np.uint64)
        return out

    def seeds(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """What random numbers of a pair depend on: words, not whether they have numbers."""
        low = np.uint64((1 << CONTEXT_BITS) - 1)
        x, y = x.copy(), y.copy()
        some = y < HASHED
        y[some] = self.top[y[some].astype(np.int64)]
        some = x < HASHED
        x[some] = mix(self.top[(x[some] >> np.uint64(CONTEXT_BITS)).astype(np.int64)]) & ~low | HASHED | x[some] & low
        return mix(x) + y

    def heads(self, x: np.ndarray) -> np.ndarray:
        """A number below HEAD * CONTEXTS for each restaurant that is dealt by pair, -1 for others."""
        out = np.full(len(x), -1, np.int64)
        small = np.flatnonzero(x < HASHED)
        rank = self.rank[(x[small] >> np.uint64(CONTEXT_BITS)).astype(np.int64)]
        out[small] = np.where(rank < 0, -1, rank * CONTEXTS + (x[small] & np.uint64(CONTEXTS - 1)).astype(np.int64))
        return out

    def deal(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The bucket of each pair."""
        return (mix(x + np.where(self.heads(x) >= 0, mix(y), np.uint64(0))) % np.uint64(self.buckets)).astype(np.int32)


def _words(texts: DataFrame) -> DataFrame:
    """(h, c): the words of all texts and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            h = np.concatenate(held)
            held.clear()
            h, c = np.unique(h, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "c"])

        for batch in batches:
            for h, _, _ in token_runs(batch.column(0)):
                held.append(h)
                n += len(h)
                if n > 3 << 20:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    return texts.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _frequent(words: DataFrame, most: int) -> DataFrame:
    """The most frequent words, at most ``most``; their least count comes from a histogram over logarithms of counts."""
    band = F.floor(F.log2("c") * 8).cast("int")
    room, least = most, 1 << 30
    for row in sorted(words.groupBy(band.alias("b")).count().collect(), key=lambda x: -x.b):
        if row["count"] > room:
            break
        room -= row["count"]
        least = row.b
    return words.where(band >= least)


def _codes(words: DataFrame, n: int, frequent: int, buckets: int | None) -> Codes:
    got = _frequent(words, min(frequent, FREQUENT)).toArrow()
    h = got["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    counts = got["c"].to_numpy()[order]
    first = np.argsort(-counts, kind="stable")[:HEAD]
    rank = np.full(len(h), -1, np.int64)
    rank[first] = np.arange(len(first))
    return Codes(h[order], counts, rank, buckets or max(32, n // BUCKET))


def _train(texts: DataFrame, codes: Codes) -> DataFrame:
    """(bucket, a, b, c, n): the distinct pairs of blocks of texts, and how often each occurs."""
    shared = texts.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            x, y = (np.concatenate(a) for a in zip(*held, strict=True))
            held.clear()
            pairs, c = counted(x, y)
            del x, y
            rows = [(int(b), *part.pack(), planes(c[own])) for b, part, own in _dealt(pairs, shared.value)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 5))], names=["bucket", "a", "b", "c", "n"])

        for batch in batches:
            for h, k, _ in token_runs(batch.column(0)):
                y = shared.value.words(h)
                held.append((shared.value.contexts(y, k), y))
                n += len(y)
                if n > 2 * BLOCK:
                    yield flush()
                    n = 0
                    release()
        if held:
            yield flush()
        release()

    return texts.mapInArrow(run, "bucket int, a binary, b binary, c binary, n binary")


def _dealt(pairs: Pairs, codes: Codes) -> Iterator[tuple[int, Pairs, np.ndarray]]:
    """The pairs of each bucket, and their places."""
    bucket = codes.deal(pairs.x, pairs.y)
    # numbers of two bytes are sorted by radix
    order = np.argsort(bucket.astype(np.uint16) if codes.buckets <= 1 << 16 else bucket, kind="stable")
    edge = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0))) if len(order) else np.empty(0, np.int64)
    for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(order)], strict=True):
        own = order[i:j]
        yield int(bucket[own[0]]), Pairs(pairs.x[own], pairs.y[own], int(np.searchsorted(own, pairs.small))), own


#: Kind of the rows that bring answers about words to a bucket.
_ANSWER = 3


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict], tuple[np.ndarray, ...]]]:
    """For each bucket, from rows sorted by it: the rows with data, and what others bring (h, k, p, m of words; may be empty)."""
    bucket, held, asked = None, [], []

    def settle():
        parts = [(q.y, q.x, doubled(r["d"], len(q.x)), numbers(r["n"])) for r in asked for q in (Pairs.unpack(r["a"], r["b"], r["c"]),)]
        none = [np.empty(0, x) for x in (np.uint64, np.uint64, np.float64, np.uint64)]
        return bucket, held, tuple(np.concatenate(x) for x in zip(none, *parts, strict=True))

    for batch in batches:
        at = batch.column(batch.schema.get_field_index("bucket")).to_numpy()
        edge = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)] if len(at) else [0]
        for i, j in zip(edge, edge[1:], strict=False):
            if at[i] != bucket:
                if bucket is not None:
                    yield settle()
                bucket, held, asked = int(at[i]), [], []
            for row in batch.slice(i, j - i).to_pylist():
                (asked if row.get("kind") == _ANSWER else held).append(row)
    if bucket is not None:
        yield settle()


def _pairs(train: DataFrame) -> DataFrame:
    """(bucket, a, b, c, n, t): one row for each bucket, with one table a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows, _ in _by_bucket(batches):
            parts = [Pairs.unpack(r["a"], r["b"], r["c"]) for r in rows]
            n = np.concatenate([numbers(r["n"]) for r in rows])
            del rows
            pairs, order, at = distinct(np.concatenate([p.x for p in parts]), np.concatenate([p.y for p in parts]))
            n = np.add.reduceat(n[order], at) if len(at) else n
            yield _bucket_row(bucket, pairs, n, np.ones(len(n), np.uint64))
        release()

    return train.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, _BUCKET)


_BUCKET = "bucket int, a binary, b binary, c binary, n binary, t binary"


def _bucket_row(bucket: int, pairs: Pairs, n: np.ndarray, t: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *(pa.array([x], pa.binary()) for x in (*pairs.pack(), planes(n), planes(t)))], names=["bucket", "a", "b", "c", "n", "t"])


#: Words of a part of the dense sums that tasks hand on.
_PART = 1 << 10


def _tables(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(h, k, t): tables of each word in each context above, those of infrequent words in several rows; and the cut that
    they are read from. Frequent words are summed within a task in one array, and handed on in compressed parts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(FREQUENT * CONTEXTS, np.uint32)
        task = 0
        for batch in batches:
            for row in batch.to_pylist():
                task = (task * 31 + row["bucket"]) % 61
                p, t = Pairs.unpack(row["a"], row["b"], row["c"]), numbers(row["t"])
                k = p.x & np.uint64(CONTEXTS - 1)
                small = p.y < HASHED
                dense += np.bincount((p.y[small] * np.uint64(CONTEXTS) + k[small]).astype(np.int64), t[small], len(dense)).astype(np.uint32)
                own, order, at = distinct(k[~small], p.y[~small])
                sums = np.add.reduceat(t[~small][order], at) if len(at) else at
                yield _rows(None, None, own.y.view(np.int64), own.x, sums)
        parts = dense.reshape(-1, _PART * CONTEXTS)
        for i in np.flatnonzero(parts.any(1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([task], pa.int32()), pa.array([planes(parts[i])], pa.binary()), *(pa.array([None], x) for x in (pa.int64(), pa.int16(), pa.int64()))], names=["part", "salt", "sums", "h", "k", "t"])
        release()

    def _rows(part, salt, h: np.ndarray, k: np.ndarray, t: np.ndarray) -> pa.RecordBatch:
        n = len(h)
        return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([salt] * n, pa.int32()), pa.array([None] * n, pa.binary()), pa.array(h), pa.array(k.astype(np.int16)), pa.array(t.astype(np.int64))], names=["part", "salt", "sums", "h", "k", "t"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_PART * CONTEXTS, np.uint64)
        for batch in batches:
            for x in batch.column(batch.schema.get_field_index("sums")):
                total += numbers(x.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([planes(total)], pa.binary())], names=["part", "sums"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                total = numbers(row["sums"])
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(row["part"] * _PART + at // CONTEXTS), pa.array((at % CONTEXTS).astype(np.int16)), pa.array(total[at].view(np.int64))], names=["h", "k", "t"])

    made = cut(pairs.mapInArrow(count, "part int, salt int, sums binary, h long, k short, t long"), "lm-tables")
    # two rounds, so that no group grows with the number of tasks alone
    partial = made.where("part IS NOT NULL").groupBy("part", "salt").applyInArrow(add, "part int, sums binary")
    dense = partial.groupBy("part").applyInArrow(add, "part int, sums binary").mapInArrow(spread, "h long, k short, t long")
    return dense.unionByName(made.where("part IS NULL").select("h", "k", "t")), made


def _heads(pairs: DataFrame, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Customers and tables of the restaurants that are dealt by pair, and last how many pairs occur once and twice."""
    shared = pairs.sparkSession.sparkContext.broadcast(codes)
    size = HEAD * CONTEXTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, t = np.zeros(size + 2), np.zeros(size + 2)
        for batch in batches:
            for row in batch.to_pylist():
                p, n, tables = Pairs.unpack(row["a"], row["b"], row["c"]), numbers(row["n"]), numbers(row["t"])
                x = shared.value.heads(p.x)
                on = x >= 0
                c += np.bincount(x[on], n[on], size + 2)
                t += np.bincount(x[on], tables[on], size + 2)
                c[size:] += (n == 1).sum(), (n == 2).sum()
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(c[at]), pa.array(t[at])], names=["x", "c", "t"])

    c, t = np.zeros(size + 2), np.zeros(size + 2)
    for batch in pairs.mapInArrow(run, "x long, c double, t double").groupBy("x").agg(F.sum("c").alias("c"), F.sum("t").alias("t")).toArrow().to_batches():
        x = batch.column(0).to_numpy()
        c[x], t[x] = batch.column(1).to_numpy(), batch.column(2).to_numpy()
    return c, t


@dataclass
class Upper:
    """What a bucket knows beside its own pairs: frequent words' probabilities in each context above, and the restaurants
    that are dealt by pair."""

    codes: Codes
    p: np.ndarray
    c: np.ndarray
    t: np.ndarray
    discount: float
    strength: float

    def restaurants(self, pairs: Pairs, n: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The restaurants of a bucket's pairs (sorted), with their customers and tables."""
        x, at = np.unique(pairs.x, return_inverse=True)
        return x, np.bincount(at, n, len(x)), np.bincount(at, t, len(x))

    def totals(self, own: tuple[np.ndarray, np.ndarray, np.ndarray], of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of the restaurants ``of``, 0 for unknown ones."""
        x, cu, tu = own
        c, t = np.zeros(len(of)), np.zeros(len(of))
        if len(x):
            at = np.minimum(np.searchsorted(x, of), len(x) - 1)
            hit = x[at] == of
            c[hit], t[hit] = cu[at[hit]], tu[at[hit]]
        head = self.codes.heads(of)
        on = head >= 0
        c[on], t[on] = self.c[head[on]], self.t[head[on]]
        return c, t

    def above(self, pairs: Pairs, asked: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        """The probability of each pair's word in the context above, and its count; ``asked`` brings those of other words."""
        k = (pairs.x & np.uint64(CONTEXTS - 1)).astype(np.int64)
        p, c = np.zeros(len(k)), np.zeros(len(k))
        small = pairs.y < HASHED
        y = pairs.y[small].astype(np.int64)
        p[small], c[small] = self.p[y, k[small]], self.codes.counts[y]
        h, at, given, m = asked
        if len(h):
            known, order, first = distinct(at, h)
            place, hit = known.find(Pairs(k[~small].astype(np.uint64), pairs.y[~small], 0))
            own = order[first][place]
            p[~small], c[~small] = np.where(hit, given[own], 0.0), np.where(hit, m[own], 0)
        return p, c


@dataclass
class Restaurants:
    """Totals of all words: customers and tables at (letter, stop), letter and root; discounts and strengths by level."""

    vocabulary: int
    c2: np.ndarray
    t2: np.ndarray
    t1: np.ndarray
    t0: float
    discounts: tuple[float, float, float]  # root, letter, (letter, stop)
    strength: float = 1.0

    @property
    def c1(self) -> np.ndarray:
        return self.t2.reshape(LETTERS, 2).sum(1)

    @property
    def c0(self) -> float:
        return float(self.t1.sum())

    def back_off(self) -> tuple[float, np.ndarray, np.ndarray]:
        """Mass that the root, each letter and each (letter, stop) passes to what lies above."""
        d0, d1, d2 = self.discounts
        s = self.strength
        return (s + d0 * self.t0) / (s + self.c0), (s + d1 * self.t1) / (s + self.c1), (s + d2 * self.t2) / (s + self.c2)

    def unseen(self) -> float:
        """The root's probability of a word never seen."""
        return self.back_off()[0] * FRESH


def log_stirling(discount: float, size: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t), for 1 <= t <= c <= size."""
    s = np.zeros((size + 1, size + 1))
    s[1, 1] = 1
    t = np.arange(size + 1)
    for c in range(1, size):
        s[c + 1, 1:] = s[c, :-1] + np.maximum(c - discount * t[1:], 0) * s[c, 1:]
    with np.errstate(divide="ignore"):
        return np.log(s)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, to 1e-5 from 2 and 1e-12 from 20 on."""
    y = 1 / (x * x)
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y / 1680))) / x


def log_stirling_of(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """Logarithms of generalised Stirling numbers S(c, t) for counts above ``EXACT``; c broadcasts against t.

    The numbers are an alternating sum over j of binomials (t over j) and ratios of Gamma(c - j d), which is used while no
    more than seven digits cancel out. Where t is large beside c^d they do; there the sum of t Sibuya variables is near
    normal under exponential tilting, and its saddlepoint approximation with one more term is good to 0.003, and to 0.03 for discounts near 1.
    """
    c, t = np.asarray(c, np.float64), np.asarray(t, np.float64)
    shape = np.broadcast_shapes(c.shape, t.shape)
    row = np.broadcast_to(np.arange(c.size).reshape(c.shape), shape).ravel()
    return _log_stirling_at(c.ravel(), row, np.broadcast_to(t, shape).ravel(), d).reshape(shape)


def _log_stirling_at(c: np.ndarray, row: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """``log_stirling_of`` for numbers of tables t that belong to the counts c[row]."""
    whole, scale = _log_gamma(c), np.log(c)
    less = np.exp(-d * scale)
    sums = np.full(len(t), np.nan)
    left = np.flatnonzero(t < c[row])
    of, many = row[left], t[left]
    ratio = less[of]
    product, total, largest = np.ones(len(left)), np.zeros(len(left)), np.zeros(len(left))
    for j in range(1, 161):
        a = j * d
        product *= np.maximum(many - (j - 1), 0)
        product *= ratio / j
        if abs(a - round(a)) < 1e-9:
            continue  # Gamma(-a) has a pole there
        inverse = math.log(abs(math.sin(math.pi * a)) / math.pi) + math.lgamma(a + 1)  # of 1 / |Gamma(-a)|
        factor = (-1) ** (j + math.floor(a) + 1) * np.exp(np.minimum(inverse + _log_gamma(np.maximum(c - a, 2)) - whole + a * scale, 600))
        factor[c - a < 2] = np.nan  # where the series of the logarithm is not good
        term = product * factor[of]
        total += term
        size = np.abs(term)
        np.fmax(largest, size, out=largest)
        ended = size <= 1e-13 * np.abs(total)
        # sums are a few at most, so that terms beyond 1e9 lose all that counts
        out = ended | (largest > 1e9) | np.isnan(term)
        if out.any():
            good = ended & (total > 0) & (largest < 1e7 * total)
            sums[left[good]] = total[good]
            if out.all():
                break
            if 8 * np.count_nonzero(out) > len(out):
                left, of, many, ratio, product, total, largest = (x[~out] for x in (left, of, many, ratio, product, total, largest))
    good = ~np.isnan(sums)
    out = np.zeros(len(t))  # one customer at each table
    out[good] = (whole[row[good]] - _log_gamma(t[good] + 1) - t[good] * math.log(d)) + np.log(sums[good])
    rest = np.flatnonzero(~good & (t < c[row]))
    if len(rest):
        out[rest] = _saddlepoint(c[row[rest]], t[rest], d)
    return out


def _tilt(r: np.ndarray, d: float) -> np.ndarray:
    """How far Sibuya variables are tilted for a mean r: v with d (1 - e^-v) e^(v (1 - d)) / (1 - e^(-d v)) = r."""
    grid = np.linspace(math.log(1e-11), math.log(200), 4096)

    def log_mean(v: np.ndarray) -> np.ndarray:
        return np.log(d * np.expm1(-v) / np.expm1(-d * v)) + (1 - d) * v

    # near 0 the logarithm is (1 - d) v / 2, in which digits do not cancel
    at = np.exp(grid)
    rises = np.log(np.where(at < 1e-6, (1 - d) / 2 * at, log_mean(at)))
    want = np.log(r)
    v = np.exp(np.interp(np.log(want), rises, grid))
    for _ in range(2):
        slope = np.where(v < 1e-4, (1 - d) / 2, 1 / np.expm1(v) + (1 - d) - d / np.expm1(d * v))
        v = np.clip(np.where(v < 1e-6, want * 2 / (1 - d), v - (log_mean(v) - want) / slope), 1e-12, 200)
    return v


def _saddlepoint(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    e = np.exp(-_tilt(c / t, d))
    x, g = 1 - e, -np.expm1(d * np.log(e))
    m1, f2 = x * d * e ** (d - 1) / g, x**2 * d * (1 - d) * e ** (d - 2) / g
    f3, f4 = x**3 * d * (1 - d) * (2 - d) * e ** (d - 3) / g, x**4 * d * (1 - d) * (2 - d) * (3 - d) * e ** (d - 4) / g
    m2, m3, m4 = f2 + m1, f3 + 3 * f2 + m1, f4 + 6 * f3 + 7 * f2 + m1
    k2 = m2 - m1**2
    k3, k4 = m3 - 3 * m2 * m1 + 2 * m1**3, m4 - 4 * m3 * m1 - 3 * m2**2 + 12 * m2 * m1**2 - 6 * m1**4
    more = np.clip((k4 / k2**2 / 8 - 5 * k3**2 / k2**3 / 24) / t, -1, 1)
    return _log_gamma(c + 1) - _log_gamma(t + 1) - t * math.log(d) + t * np.log(g) - c * np.log1p(-e) - 0.5 * np.log(2 * math.pi * t * k2) + more


def draw_tables(c: np.ndarray, weight: np.ndarray, discount: float, stirling: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Numbers of tables for c customers of a dish, each new table having this weight: P(t) ~ S(c, t) weight^t.

    One distribution for all counts: up to ``EXACT`` all t are weighed, above as many as its width asks for.
    """
    t = np.ones(len(c), np.int64)
    some = np.flatnonzero((c > 1) & (c <= EXACT))
    order = some[np.argsort(c[some].astype(np.uint8), kind="stable")]
    edges = np.searchsorted(c[order], np.arange(2, EXACT + 2))
    for i in range(len(edges) - 1):
        rows = order[edges[i] : edges[i + 1]]
        if not len(rows):
            continue
        n = i + 2
        step = np.exp(np.diff(stirling[n, 1 : n + 1]))
        for at in range(0, len(rows), 1 << 14):
            r = rows[at : at + (1 << 14)]
            usual = weight[r] <= 1e3  # for larger ones products may leave the range of numbers
            w = weight[r[usual]]
            p = np.ones((n, len(w)))
            for j in range(1, n):
                np.multiply(p[j - 1], step[j - 1] * w, out=p[j])
            np.cumsum(p, 0, out=p)
            t[r[usual]] = 1 + (p < u[r[usual]] * p[-1]).sum(0)
            r = r[~usual]
            logit = stirling[n, 1 : n + 1] + np.arange(1, n + 1) * np.log(weight[r])[:, None]
            p = np.cumsum(np.exp(logit - logit.max(1, keepdims=True)), 1)
            t[r] = 1 + (p < u[r, None] * p[:, -1:]).sum(1)
    large = np.flatnonzero(c > EXACT)
    if len(large):
        # customers are a tilted compound Poisson sum, of which one table is given: about where its mean count lies
        grid = np.linspace(-60, -1e-6, 4096)
        rate = weight[large] / discount
        e = np.exp(np.interp(np.log(c[large] / np.maximum(weight[large], 1e-300)), (np.log1p(-np.exp(grid)) + (discount - 1) * grid)[::-1], grid[::-1]))
        mean = np.minimum(1 + rate * -np.expm1(discount * np.log(e)), c[large])
        large, mean = (x[np.argsort(mean)] for x in (large, mean))  # alike counts together, so that their sums end alike
        for at in range(0, len(large), 1 << 10):
            r, m = large[at : at + (1 << 10)], mean[at : at + (1 << 10)]
            first = np.maximum(1, np.floor(m - 8 - 7 * np.sqrt(m)))
            last = np.minimum(c[r], np.ceil(m + 8 + 7 * np.sqrt(m)))
            step = np.maximum(1, np.ceil((last - first + 1) / _POINTS))
            points = first[:, None] + step[:, None] * np.arange(_POINTS)
            row, place = np.nonzero(points <= last[:, None])
            at_most = points[row, place]
            logit = np.full(points.shape, -np.inf)
            logit[row, place] = _log_stirling_at(c[r].astype(np.float64), row, at_most, discount) + at_most * np.log(np.maximum(weight[r], 1e-300))[row]
            p = np.cumsum(np.exp(logit - logit.max(1, keepdims=True)), 1)
            on = (p < u[r, None] * p[:, -1:]).sum(1)
            within = np.floor(uniform((u[r] * float(1 << 52)).astype(np.uint64), 5) * step) - (step - 1) // 2
            t[r] = np.clip(points[np.arange(len(r)), on] + within, 1, c[r]).astype(np.int64)
    return t


def uniform(key: np.ndarray, *salt: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the key alone, so that a lost task draws the same again."""
    x = key
    for s in salt:
        x = mix(x + np.uint64((s * 0x9E3779B97F4A7C15 + 1) & (1 << 64) - 1))
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)


class Seating:
    """The seating of some words: entries (word, context, customers), sampled given the restaurants' totals."""

    def __init__(self, key: np.ndarray, word: np.ndarray, context: np.ndarray, customers: np.ndarray, r: Restaurants, salt: int):
        self.r, self.key, self.salt = r, key, salt
        self.word, self.k, self.c2 = word, context, customers
        pair = word * LETTERS + context // 2
        pairs, self.up1 = np.unique(pair, return_inverse=True)
        self.up0, self.letter = pairs // LETTERS, pairs % LETTERS
        self.stirling = [log_stirling(d) for d in r.discounts]
        self.t2 = np.ceil(np.sqrt(self.c2)).astype(np.int64)
        self._fill()
        self.t1 = np.ceil(np.sqrt(self.c1)).astype(np.int64)
        self.c0 = np.bincount(self.up0, self.t1, len(key)).astype(np.int64)
        self.t0 = np.ones(len(key), np.int64)

    def _fill(self) -> None:
        self.c1 = np.bincount(self.up1, self.t2, len(self.up0)).astype(np.int64)

    @property
    def root(self) -> float:
        """What a word's new table at the root weighs."""
        return (self.r.strength + self.r.discounts[0] * self.r.t0) * (1 - FRESH) / max(1, self.r.vocabulary)

    def _above(self) -> tuple[np.ndarray, np.ndarray]:
        r, (d0, d1, _), s = self.r, self.r.discounts, self.r.strength
        p0 = (self.c0 - d0 * self.t0 + self.root) / (s + r.c0)
        return p0, (self.c1 - d1 * self.t1 + (s + d1 * r.t1[self.letter]) * p0[self.up0]) / (s + r.c1[self.letter])

    def predictive(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r, d2, s = self.r, self.r.discounts[2], self.r.strength
        p0, p1 = self._above()
        return p0, p1, (self.c2 - d2 * self.t2 + (s + d2 * r.t2[self.k]) * p1[self.up1]) / (s + r.c2[self.k])

    def sweep(self, n: int) -> None:
        """Draws all table numbers anew, from the leaves to the root, each given its parent as it stands."""
        r, (_, d1, d2), s = self.r, self.r.discounts, self.r.strength
        p0, p1 = self._above()
        self.t2 = self._draw(2, self.c2, lambda on: (s + d2 * r.t2[self.k[on]]) * p1[self.up1[on]], lambda on: self.key[self.word[on]] + self.k[on].astype(np.uint64), n)
        self._fill()
        self.t1 = self._draw(1, self.c1, lambda on: (s + d1 * r.t1[self.letter[on]]) * p0[self.up0[on]], lambda on: self.key[self.up0[on]] + self.letter[on].astype(np.uint64), n)
        self.c0 = np.bincount(self.up0, self.t1, len(self.key)).astype(np.int64)
        self.t0 = self._draw(0, self.c0, lambda on: np.full(len(on), self.root), lambda on: self.key[on], n)

    def _draw(self, level: int, c: np.ndarray, weight: Callable[[np.ndarray], np.ndarray], key: Callable[[np.ndarray], np.ndarray], n: int) -> np.ndarray:
        """Tables of a level; one customer has one table, so nothing is drawn there."""
        t = np.ones(len(c), np.int64)
        on = np.flatnonzero(c > 1)
        t[on] = draw_tables(c[on], weight(on), self.r.discounts[level], self.stirling[level], uniform(key(on), self.salt, n, level))
        return t


#: Entries of the words that are seated at once.
_SEATED = 1 << 18


def _seatings(batches: Iterator[pa.RecordBatch], r: Restaurants, salt: int) -> Iterator[tuple[pa.RecordBatch, Seating]]:
    held: list[pa.RecordBatch] = []

    def seating() -> tuple[pa.RecordBatch, Seating]:
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        ks, cs = batch.column(1), batch.column(2)
        length = np.diff(ks.offsets.to_numpy())
        word = np.repeat(np.arange(len(length)), length)
        return batch, Seating(batch.column(4).to_numpy().view(np.uint64), word, ks.flatten().to_numpy().astype(np.int64), cs.flatten().to_numpy().astype(np.int64), r, salt)

    n = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += len(batch.column(1).flatten())
        if n > _SEATED:
            yield seating()
            held, n = [], 0
    if held:
        yield seating()


def _summed(df: DataFrame, size: int, add: Callable[[np.ndarray, pa.RecordBatch], None]) -> np.ndarray:
    """Sums, over all batches of a frame, of what ``add`` adds to an array of this size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            add(total, batch)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["i", "x"])

    got = np.zeros(size)
    for row in df.mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        got[row.i] = row.x
    return got


def _totals(words: DataFrame, r: Restaurants, salt: int, sweeps: int) -> Restaurants:
    """One pass over all words: new totals, and discounts from how many dishes have one and two customers."""
    spark = words.sparkSession
    shared = spark.sparkContext.broadcast(r)
    size = CONTEXTS + LETTERS + 7

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for _, seating in _seatings(batches, shared.value, salt):
            for n in range(sweeps):
                seating.sweep(n)
            total[:CONTEXTS] += np.bincount(seating.k, seating.t2, CONTEXTS)
            total[CONTEXTS : CONTEXTS + LETTERS] += np.bincount(seating.letter, seating.t1, LETTERS)
            tail = total[CONTEXTS + LETTERS :]
            tail[0] += seating.t0.sum()
            for i, c in enumerate((seating.c0, seating.c1, seating.c2)):
                tail[1 + 2 * i] += (c == 1).sum()
                tail[2 + 2 * i] += (c == 2).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["i", "x"])

    got = np.zeros(size)
    for row in words.select("h", "ks", "cs", "c", "g").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        got[row.i] = row.x
    tail = got[CONTEXTS + LETTERS :]
    discounts = tuple(min(0.95, max(0.05, tail[1 + 2 * i] / max(1.0, tail[1 + 2 * i] + 2 * tail[2 + 2 * i]))) for i in range(3))
    return Restaurants(r.vocabulary, r.c2, got[:CONTEXTS], got[CONTEXTS : CONTEXTS + LETTERS], float(tail[0]), discounts)


@dataclass
class Model:
    """Words with their counts and averaged probabilities (h: the code, c, p0, letters, p1, ks, p2), and the totals; pairs
    with customers and tables, a row for each bucket, and what buckets know beside them."""

    words: DataFrame
    restaurants: Restaurants
    tokens: int
    sums: np.ndarray | None = None  # of each context's averaged probabilities, the unseen word's included
    pairs: DataFrame | None = None
    upper: Upper | None = None

    def normalised(self) -> Model:
        """Totals are those of the pass before, so a context's probabilities add up to nearly 1; ``sums`` tells how nearly."""
        one, two = self.fallback()
        unseen = self.restaurants.unseen()

        def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
            p0, p1, p2 = batch.column(0).to_numpy(), batch.column(2).flatten().to_numpy(), batch.column(4).flatten().to_numpy()
            letter, k = (batch.column(i).flatten().to_numpy().astype(np.int64) for i in (1, 3))
            of, of2 = (np.repeat(np.arange(len(p0)), np.diff(batch.column(i).offsets.to_numpy())) for i in (1, 3))
            up = p1[np.searchsorted(of * LETTERS + letter, of2 * LETTERS + k // 2)]
            total[0] += p0.sum()
            for i, x in enumerate((p1, p0[of])):
                total[1 + i * LETTERS :][:LETTERS] += np.bincount(letter, x, LETTERS)
            for i, x in enumerate((p2, up)):
                total[1 + 2 * LETTERS + i * CONTEXTS :][:CONTEXTS] += np.bincount(k, x, CONTEXTS)

        got = _summed(self.words.select("p0", "letters", "p1", "ks", "p2"), 1 + 2 * LETTERS + 2 * CONTEXTS, add)
        all0, letters, contexts = got[0], got[1:][: 2 * LETTERS].reshape(2, LETTERS).T, got[1 + 2 * LETTERS :].reshape(2, CONTEXTS).T
        at1 = letters[:, 0] + one * (all0 + unseen - letters[:, 1])
        self.sums = contexts[:, 0] + two * (np.repeat(at1, 2) - contexts[:, 1])
        return self

    def fallback(self) -> tuple[np.ndarray, np.ndarray]:
        """Back-off mass of each letter and each context."""
        _, one, two = self.restaurants.back_off()
        return one, two


def fit(texts: DataFrame, passes: int = 3, burn: int = 3, keep: int = 4, frequent: int = FREQUENT, buckets: int | None = None) -> Model:
    """Learns from one text column.

    Pairs start with one table each; the levels above are fitted to those in one pass, pairs that occur more than once are
    seated anew by them, and the levels above are fitted again: ``passes`` passes for the totals, then ``burn`` sweeps and
    ``keep`` averaged ones. Everything gathered from the corpus is a table of one entry for each distinct word, pair or
    restaurant; the driver sees the ``frequent`` words, restaurants of the HEAD commonest, and about a hundred totals. An
    empty corpus gives a model that knows no word.
    """
    spark = texts.sparkSession
    vocabulary = cut(_words(texts), "lm-vocabulary")
    n = vocabulary.agg(F.sum("c")).first()[0] or 0
    codes = _codes(vocabulary, n, frequent, buckets)
    numbered = spark.createDataFrame(pa.table({"h": codes.top.view(np.int64), "id": np.arange(len(codes.top))}), "h long, id long")
    counts = vocabulary.join(F.broadcast(numbered), "h", "left").select(F.coalesce("id", "h").alias("h"), F.col("h").alias("g"), "c")
    pairs = cut(_pairs(_train(texts, codes)), "lm-pairs")
    customers, tables = _heads(pairs, codes)
    one, two = customers[-2:]
    discount, strength = min(0.95, max(0.05, one / max(1.0, one + 2 * two))), Restaurants.strength
    start = _above(pairs, counts, n, 1, burn, 1)
    upper = Upper(codes, _frequent_probabilities(start, codes), customers[:-2], tables[:-2], discount, strength)
    shared = spark.sparkContext.broadcast(upper)

    def many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                p, c = Pairs.unpack(row["a"], row["b"], row["c"]), numbers(row["n"])
                on = (p.y >= HASHED) & (c > 1)
                own, _, _ = distinct(p.x[on] & np.uint64(CONTEXTS - 1), p.y[on])
                yield _asked(np.full(len(own.y), row["bucket"]), own.y, own.x)

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = shared.value
        stirling = log_stirling(discount)
        for bucket, rows, asked in _by_bucket(batches):
            row = rows[0]
            p, c, t = Pairs.unpack(row["a"], row["b"], row["c"]), numbers(row["n"]), numbers(row["t"])
            _, of = upper.totals(upper.restaurants(p, c, t), p.x)
            above, _ = upper.above(p, asked)
            on = np.flatnonzero(c > 1)
            weight = (strength + discount * of[on]) * above[on]
            t[on] = draw_tables(c[on].astype(np.int64), weight, discount, stirling, uniform(upper.codes.seeds(p.x[on], p.y[on]), 7)).astype(np.uint64)
            yield _bucket_row(bucket, p, c, t)
        release()

    answers = _answers(pairs.mapInArrow(many, "bucket int, h long, k short"), start)
    seated = cut(_dealt_again(codes.buckets, pairs, answers).mapInArrow(seat, _BUCKET), "lm-seated", pairs)
    uncut(start.words)
    shared.destroy()  # a file of its size on each executor
    model = _above(seated, counts, n, passes, burn, keep)
    customers, tables = _heads(seated, codes)
    uncut(vocabulary)
    model.pairs = seated
    model.upper = Upper(codes, _frequent_probabilities(model, codes), customers[:-2], tables[:-2], discount, strength)
    return model


def _asked(bucket: np.ndarray, h: np.ndarray, k: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(k.astype(np.int16))], names=["bucket", "h", "k"])


def _answers(asked: DataFrame, model: Model) -> DataFrame:
    """Each asked word's probability in a context above and its count, in one row for a bucket and many words: contexts and
    hashes (a, b, c), counts (n), probabilities (d). Words that are asked for twice are answered once, but for a few."""
    one, two = model.fallback()
    ones, twos, sums = (F.array(*[F.lit(float(x)) for x in a]) for a in (one, two, model.sums))
    met = asked.join(model.words, "h", "left")
    letter = F.shiftright("k", 1)
    at2, at1 = F.array_position("ks", F.col("k")), F.array_position("letters", letter.cast("short"))
    root = F.coalesce("p0", F.lit(model.restaurants.unseen()))
    p1 = F.when(F.coalesce(at1, F.lit(0)) > 0, F.get("p1", (at1 - 1).cast("int"))).otherwise(root * F.get(ones, letter))
    p2 = F.when(F.coalesce(at2, F.lit(0)) > 0, F.get("p2", (at2 - 1).cast("int"))).otherwise(p1 * F.get(twos, F.col("k").cast("int")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            bucket, h, k, p, m = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            own, order, at = distinct(bucket.astype(np.uint64) << np.uint64(CONTEXT_BITS) | k.astype(np.uint64), h.view(np.uint64))
            del bucket, h, k
            order = order[at]
            p, m, of = p[order], m[order], own.x >> np.uint64(CONTEXT_BITS)
            del order, at
            edge = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))).tolist()
            rows = []
            for i, j in zip(edge, [*edge[1:], len(of)], strict=True):
                part = Pairs(own.x[i:j] & np.uint64(CONTEXTS - 1), own.y[i:j], 0)
                rows.append((int(of[i]), _ANSWER, *part.pack(), planes(m[i:j]), doubles(p[i:j])))
            types = (pa.int32(), pa.int32(), *[pa.binary()] * 5)
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["bucket", "kind", "a", "b", "c", "n", "d"])

        for batch in batches:
            if batch.num_rows:
                # copies, since views keep whole batches
                held.append(tuple(batch.column(i).to_numpy().copy() for i in range(5)))
                n += batch.num_rows
            if n > 1 << 20:
                yield flush()
                n = 0
                release()
        if held:
            yield flush()
        release()

    answers = met.select("bucket", "h", "k", (p2 / F.get(sums, F.col("k").cast("int"))).alias("p"), F.coalesce("c", F.lit(0)).cast("long").alias("m"))
    return answers.mapInArrow(pack, "bucket int, kind int, a binary, b binary, c binary, n binary, d binary")


def _dealt_again(buckets: int, *frames: DataFrame) -> DataFrame:
    """Rows of several frames, those of a bucket together. A partition has two buckets on average, since all its rows can
    come to a worker in one batch."""
    both = frames[0]
    for f in frames[1:]:
        both = both.unionByName(f, allowMissingColumns=True)
    return both.repartition(max(1, buckets // 2), "bucket").sortWithinPartitions("bucket")


def _frequent_probabilities(model: Model, codes: Codes) -> np.ndarray:
    """Probabilities of the frequent words in each context above."""
    got = model.words.where("h >= 0").toArrow().combine_chunks()
    one, two = model.fallback()
    word = got["h"].to_numpy()
    p0 = np.zeros(len(codes.top))
    p0[word] = got["p0"].to_numpy()
    part = _one(got["letters"])
    row = np.repeat(word, np.diff(part.offsets.to_numpy()))
    p1 = p0[:, None] * one[None, :]
    p1[row, part.flatten().to_numpy()] = _one(got["p1"]).flatten().to_numpy()
    ks = _one(got["ks"])
    row = np.repeat(word, np.diff(ks.offsets.to_numpy()))
    p2 = np.repeat(p1, 2, axis=1) * two[None, :]
    p2[row, ks.flatten().to_numpy()] = _one(got["p2"]).flatten().to_numpy()
    return p2 / model.sums


def _one(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each word, with its tables by context, from rows (h, k, t, g) sorted by word; one row of a word, of
    context -1, has its count and its hash."""

    def rows(h: np.ndarray, k: np.ndarray, t: np.ndarray, g: np.ndarray) -> pa.RecordBatch:
        h, k, t, g = (x[order] for order in (np.lexsort((k, h)),) for x in (h, k, t, g))
        head = np.flatnonzero(k < 0)
        first = np.concatenate(([True], (h[1:] != h[:-1]) | (k[1:] != k[:-1])))
        first[head] = False
        after = np.zeros(len(h), bool)
        after[1:] = k[:-1] < 0
        at = np.flatnonzero(first | after)
        t2 = t.copy()
        t2[head] = 0
        sums = np.add.reduceat(t2, at) if len(at) else t[:0]
        ends = np.append(np.searchsorted(at, head), len(at)).astype(np.int32)
        lists = (pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (k[at], sums))
        return pa.RecordBatch.from_arrays([pa.array(h[head]), *lists, pa.array(t[head]), pa.array(g[head])], names=["h", "ks", "cs", "c", "g"])

    held, n = [], 0
    for batch in batches:
        held.append((*(batch.column(i).to_numpy() for i in range(3)), pa.compute.fill_null(batch.column(3), 0).to_numpy()))
        n += batch.num_rows
        if n > 1 << 18:
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            edge = int(np.searchsorted(whole[0], whole[0][-1]))
            if edge:
                yield rows(*(x[:edge] for x in whole))
            held = [tuple(x[edge:] for x in whole)]
            n = len(held[0][0])
    if n:
        yield rows(*(np.concatenate(x) for x in zip(*held, strict=True)))
    release()


def _above(pairs: DataFrame, counts: DataFrame, n: int, passes: int, burn: int, keep: int) -> Model:
    """The levels above the restaurants of words, whose customers are the tables of pairs (h, k, t)."""
    tables, read = _tables(pairs)
    known = counts.select("h", F.lit(-1).cast("short").alias("k"), F.col("c").alias("t"), "g")
    both = tables.withColumn("g", F.lit(None).cast("long")).unionByName(known).repartition("h").sortWithinPartitions("h")
    words = cut(both.mapInArrow(_listed, "h long, ks array<short>, cs array<long>, c long, g long"), "lm-words", read)

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        total[:CONTEXTS] += np.bincount(batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy(), CONTEXTS)
        total[CONTEXTS] += batch.num_rows

    got = _summed(words.select("ks", "cs"), CONTEXTS + 1, add)
    c2, vocabulary = got[:CONTEXTS], int(got[CONTEXTS])
    t2 = np.ceil(0.3 * c2)
    t1 = np.ceil(0.5 * t2.reshape(LETTERS, 2).sum(1))
    r = Restaurants(vocabulary, c2, t2, t1, float(vocabulary), (0.5, 0.5, 0.5))
    for i in range(passes):
        r = _totals(words, r, i + 1, burn + 1)
    shared = words.sparkSession.sparkContext.broadcast(r)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, seating in _seatings(batches, shared.value, 99):
            sums = [0.0, 0.0, 0.0]
            for n in range(burn + keep):
                seating.sweep(n)
                if n >= burn:
                    sums = [a + b for a, b in zip(sums, seating.predictive(), strict=True)]
            p0, p1, p2 = (x / keep for x in sums)
            ends = np.searchsorted(seating.up0, np.arange(len(p0) + 1)).astype(np.int32)
            letters = pa.ListArray.from_arrays(pa.array(ends), pa.array(seating.letter.astype(np.int16)))
            at1 = pa.ListArray.from_arrays(pa.array(ends), pa.array(p1.astype(np.float64)))
            at2 = pa.ListArray.from_arrays(pa.array((batch.column(1).offsets.to_numpy() - batch.column(1).offsets[0].as_py()).astype(np.int32)), pa.array(p2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(p0), letters, at1, batch.column(1), at2], names=["h", "c", "p0", "letters", "p1", "ks", "p2"])

    sampled = words.select("h", "ks", "cs", "c", "g").mapInArrow(run, "h long, c long, p0 double, letters array<short>, p1 array<double>, ks array<short>, p2 array<double>")
    return Model(cut(sampled, "lm-model", words), r, n).normalised()


#: Columns of what buckets get from documents: pairs, entries of each pair, copies and document of each entry.
_REQUEST = "bucket int, kind int, block long, a binary, b binary, c binary, n binary, t binary, d binary"
_REPLY = "block long, bucket int, d binary, size binary, known binary, base binary, score binary, keys binary"


def _together(rows: list[dict]) -> Iterator[tuple[list[dict], Pairs, list[np.ndarray]]]:
    """Rows that ask, some at a time: the pairs of all of them (not in order), and where those of each row are."""
    held: list[Pairs] = []
    first = n = 0
    for i, row in enumerate(rows):
        held.append(Pairs.unpack(row["a"], row["b"], row["c"]))
        n += len(held[-1].x)
        if n < 1 << 18 and i + 1 < len(rows):
            continue
        small = sum(p.small for p in held)
        x, y = (np.concatenate([a[: p.small] for p, a in own] + [a[p.small :] for p, a in own]) for own in ([(p, p.x) for p in held], [(p, p.y) for p in held]))
        places, at, rest = [], 0, small
        for p in held:
            more = len(p.x) - p.small
            places.append(np.concatenate((np.arange(at, at + p.small), np.arange(rest, rest + more))))
            at, rest = at + p.small, rest + more
        yield rows[first : i + 1], Pairs(x, y, small), places
        held, n, first = [], 0, i + 1


def score_texts(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds n_tokens, n_known, train_tokens, base_score and score (log10 probabilities of the whole text).

    A null text counts as empty: its only token is the end. Unknown words share one type. Made columns replace input
    columns of their names; the text is not returned. Repeated rows get equal values.

    Documents are told apart by a 128-bit key of the whole row. A block of documents sends each bucket its pairs of that
    bucket, a few bytes each, and gets back four sums for each document with any; sums are added up in the order of
    buckets. Infrequent words meet their probabilities in a join. Documents go through in rounds by their keys, so that not
    all messages lie on disk at once. So the result covers all words and pairs at any size.
    """
    made = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kept = [c for c in df.columns if c != text and c.lower() not in made]
    n, v = model.tokens, model.restaurants.vocabulary
    keyed = df.select(*[F.col(f"`{c}`") for c in kept], *row_keys(df), F.col(f"`{text}`").cast("string").alias("_text"))
    shared = df.sparkSession.sparkContext.broadcast(model.upper)
    # those who ask need no probabilities, which are most of what is broadcast
    numbering = df.sparkSession.sparkContext.broadcast(model.upper.codes)

    def request(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = numbering.value
        serial = TaskContext.get().partitionId() << 32
        held, keys, n = [], [], 0

        def flush() -> pa.RecordBatch:
            x, y, size = (np.concatenate(a) for a in zip(*held, strict=True))
            held.clear()
            pairs, order, at = distinct(x, y)
            del x, y
            doc = np.repeat(np.arange(len(size), dtype=np.int32), size)[order]
            del order
            new = np.ones(len(doc), bool)
            new[1:] = doc[1:] != doc[:-1]
            new[at] = True
            entry = np.flatnonzero(new)
            copies = np.diff(np.append(entry, len(doc))).astype(np.int32)
            start = np.searchsorted(entry, at)
            each = np.diff(np.append(start, len(entry)))
            doc = doc[entry]
            del new, entry, at
            rows = []
            for bucket, part, own in _dealt(pairs, codes):
                e = each[own]
                on = np.repeat(start[own] - np.concatenate(([0], np.cumsum(e)[:-1])), e) + np.arange(e.sum())
                rows.append((bucket, 1, *part.pack(), planes(e), planes(copies[on]), planes(doc[on])))
            rows.append((serial % codes.buckets, 2, None, None, None, None, None, np.concatenate(keys).tobytes()))
            types = (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 6)
            columns = [[r[0] for r in rows], [r[1] for r in rows], [serial] * len(rows), *([r[i] for r in rows] for i in range(2, 8))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["bucket", "kind", "block", "a", "b", "c", "n", "t", "d"])

        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            i = 0
            for h, k, size in token_runs(batch.column(2)):
                y = codes.words(h)
                held.append((codes.contexts(y, k), y, size))
                keys.append(np.stack((k1[i : i + len(size)], k2[i : i + len(size)]), 1))
                i += len(size)
                n += len(y)
                if n > BLOCK:
                    yield flush()
                    keys.clear()
                    n = 0
                    serial += 1
                    release()
        if held:
            yield flush()
        release()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = numbering.value
        xs, ys, n = [], [], 0

        def flush() -> pa.RecordBatch:
            x, y = np.concatenate(xs), np.concatenate(ys)
            xs.clear()
            ys.clear()
            bucket = codes.deal(x, y).astype(np.uint64)
            own, _, _ = distinct(bucket << np.uint64(CONTEXT_BITS) | x & np.uint64(CONTEXTS - 1), y)
            return _asked((own.x >> np.uint64(CONTEXT_BITS)).astype(np.int64), own.y, own.x & np.uint64(CONTEXTS - 1))

        for batch in batches:
            for h, k, _ in token_runs(batch.column(0)):
                y = codes.words(h)
                on = y >= HASHED
                xs.append(codes.contexts(y, k)[on])
                ys.append(y[on])
                n += len(ys[-1])
                if n > 1 << 20:
                    yield flush()
                    n = 0
                    release()
        if xs:
            yield flush()
        release()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = shared.value
        none = np.empty(0, np.uint64)
        for bucket, rows, asked in _by_bucket(batches):
            own, c, t = Pairs(none, none, 0), none, none
            for row in rows:
                if row["kind"] is None:
                    own, c, t = Pairs.unpack(row["a"], row["b"], row["c"]), numbers(row["n"]), numbers(row["t"])
            mine = upper.restaurants(own, c, t)
            out = [(row["block"], bucket, None, None, None, None, None, row["d"]) for row in rows if row["kind"] == 2]
            # the questions of many blocks at once, so that a bucket's own pairs are not gone through block by block
            for part, q, places in _together([row for row in rows if row["kind"] == 1]):
                place, hit = own.find(q)
                keeps = np.zeros(len(q.x))
                keeps[hit] = c[place[hit]] - upper.discount * t[place[hit]]
                cu, tu = upper.totals(mine, q.x)
                above, m = upper.above(q, asked)
                log = np.log10((keeps + (upper.strength + upper.discount * tu) * above) / (upper.strength + cu))
                base = np.log10(m + 0.5)
                for row, on in zip(part, places, strict=True):
                    of = np.repeat(on, numbers(row["n"]).astype(np.int64))
                    copies, doc = numbers(row["t"]).astype(np.float64), numbers(row["d"]).astype(np.int64)
                    size = np.bincount(doc, copies)
                    at = np.flatnonzero(size)
                    known = np.bincount(doc, copies * (m[of] > 0))
                    both = (fixed(np.bincount(doc, copies * a[of])[at]) for a in (base, log))
                    out.append((row["block"], bucket, planes(at, True), planes(size[at]), planes(known[at]), *both, None))
            types = (pa.int64(), pa.int32(), *[pa.binary()] * 6)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["block", "bucket", "d", "size", "known", "base", "score", "keys"])
            del out, rows, asked
            release()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []

        def settle() -> pa.RecordBatch:
            keys = np.frombuffer(next(r["keys"] for r in held if r["keys"] is not None), np.int64).reshape(-1, 2)
            total = np.zeros((4, len(keys)))
            for r in held:
                if r["d"] is not None:
                    at = numbers(r["d"], True).astype(np.int64)
                    total[0, at] += numbers(r["size"])
                    total[1, at] += numbers(r["known"])
                    total[2, at] += unfixed(r["base"])
                    total[3, at] += unfixed(r["score"])
            whole = (pa.array(x.astype(np.int64)) for x in total[:2])
            return pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), *whole, pa.array(total[2]), pa.array(total[3])], names=["_k1", "_k2", "_n", "_known", "_base", "_score"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != block:
                    if held:
                        yield settle()
                    block, held = row["block"], []
                held.append(row)
        if held:
            yield settle()

    texts = keyed.select("_k1", "_k2", "_text")
    rounds = ROUNDS if n > BLOCK else 1
    parts = []
    for i in range(rounds):
        own = texts.where(F.pmod("_k1", F.lit(rounds)) == i)
        answers = _answers(own.select("_text").mapInArrow(ask, "bucket int, h long, k short"), model)
        replies = _dealt_again(model.upper.codes.buckets, own.mapInArrow(request, _REQUEST), model.pairs, answers).mapInArrow(answer, _REPLY)
        made = replies.repartition("block").sortWithinPartitions("block", "bucket").mapInArrow(add, "_k1 long, _k2 long, _n long, _known long, _base double, _score double")
        parts.append(cut(made, "lm-sums"))
        del answers, replies, made
        forget(df.sparkSession)
    shared.destroy()
    numbering.destroy()
    found = reduce(DataFrame.unionByName, parts).groupBy("_k1", "_k2").agg(*[F.min(c).alias(c) for c in ("_n", "_known", "_base", "_score")])
    return keyed.drop("_text").join(found, ["_k1", "_k2"]).select(
        *[F.col(f"`{c}`") for c in kept],
        F.col("_n").alias("n_tokens"),
        F.col("_known").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("_base") - F.col("_n") * F.lit(math.log10(n + 0.5 * (v + 1)))).alias("base_score"),
        F.col("_score").alias("score"),
    )
