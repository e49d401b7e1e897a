"""BPE with word ends as a bounded-lookahead streaming transducer, and an incremental decoder.

The merge list decides how far to the right a merge decision can reach (``sufficient_lookahead``). A long word is
encoded in windows; tokens that end at least that many bytes before a window's end are final and are emitted, and the
next window starts at the last emitted boundary. Short words go through a bounded cache of whole results.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_columns

#: The white space of the normaliser's `\\s`.
SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"
_CUT = re.compile(f"[{SPACES}]")
#: Code points of text handled at once.
CHUNK = 1 << 15
#: Words cached in each worker.
CACHE = 1 << 18


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 as itself, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A tokenizer file: `BPE` with `</w>` ends over byte symbols, after NFC and lower-casing; white space only parts words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        end = spec["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces: list[str | None] = [None] * (max([*vocab.values(), *self.special.values()]) + 1)
        for piece, i in [*vocab.items(), *self.special.items()]:
            self.pieces[i] = piece
        symbols = byte_symbols()
        self.byte = [vocab[s] for s in symbols]
        self.last = [vocab[s + end] for s in symbols]
        self.end = end
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        pairs = []
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in merges):
            left, right = vocab[a], vocab[b]
            self.rank.setdefault(left << 20 | right, len(self.made))
            self.made.append(vocab[a + b])
            pairs.append((left, right))
        self.length = [len(p.removesuffix(end)) if p is not None else 0 for p in self.pieces]
        self.lookahead = self._sufficient_lookahead(pairs)
        self.window = max(1024, 4 * self.lookahead)
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.longest_special = max(map(len, self.special), default=0)

    def _sufficient_lookahead(self, pairs: list[tuple[int, int]]) -> int:
        """Bytes right of a boundary that can decide whether a merge across it happens.

        A merge (a, b) of rank r needs b, and is prevented only if a merge of lower rank takes b's right end first, that
        is a merge whose left side ends b (on the right spine of b). Those merges depend in turn on what follows, with
        falling ranks, so a pass in order of ranks gives the longest such chain.
        """
        right_of = {made: right for (_, right), made in zip(reversed(pairs), reversed(self.made), strict=True)}
        reach: dict[int, int] = {}
        most = 1
        for left, right in pairs:
            spine, follow = right, 0
            while spine is not None:
                follow = max(follow, reach.get(spine, 0))
                spine = right_of.get(spine)
            need = self.length[right] + follow
            reach[left] = max(reach.get(left, 0), need)
            most = max(most, need)
        return most + 1

    def merge(self, ids: list[int]) -> list[int]:
        """Merges the lowest rank first, leftmost first among equals."""
        if len(ids) > 48:
            return self._merge_heap(ids)
        rank = self.rank
        ranks = [rank.get(a << 20 | b, 1 << 30) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == 1 << 30:
                break
            i = ranks.index(least)
            ids[i : i + 2] = [self.made[least]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get(ids[i - 1] << 20 | ids[i], 1 << 30)
            if i < len(ranks):
                ranks[i] = rank.get(ids[i] << 20 | ids[i + 1], 1 << 30)
        return ids

    def _merge_heap(self, ids: list[int]) -> list[int]:
        n, rank = len(ids), self.rank
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = self.made[r], False
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (x := rank.get(ids[i] << 20 | ids[k])) is not None:
                    heapq.heappush(heap, (x, i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (x := rank.get(ids[h] << 20 | ids[i])) is not None:
                heapq.heappush(heap, (x, h, ids[h], ids[i]))
        return [x for x, ok in zip(ids, alive, strict=True) if ok]

    def word(self, word: str) -> list[int]:
        """Ids of one whole pre-token."""
        body = word.encode()
        if len(body) > self.window:
            stream = WordStream(self)
            return [*stream.feed(body), *stream.finish()]
        byte = self.byte
        return self.merge([*(byte[x] for x in body[:-1]), self.last[body[-1]]])


class WordStream:
    """One word fed in pieces: emits tokens once stable, keeps at most a window and the bytes just fed."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.held = vocabulary, bytearray()

    def feed(self, body: bytes) -> list[int]:
        self.held += body
        out, v = [], self.v
        while len(self.held) > v.window:
            # the held bytes may be the word's last ones, so the last symbol stays out of the window
            ids = v.merge([v.byte[x] for x in self.held[: v.window]])
            done, at = [], 0
            for t in ids:
                if at + v.length[t] > v.window - v.lookahead:
                    break
                done.append(t)
                at += v.length[t]
            out += done
            del self.held[:at]
        return out

    def finish(self) -> list[int]:
        body, self.held = self.held, bytearray()
        return self.v.merge([*(self.v.byte[x] for x in body[:-1]), self.v.last[body[-1]]]) if body else []


@lru_cache(maxsize=1)
def _seconds() -> frozenset[str]:
    """Characters that NFC may join to the one before: second in a canonical pair, or a Hangul vowel or final."""
    out = {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}
    for c in range(0xC0, 0x30000):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and parts[0][0] != "<":
            out.add(chr(int(parts[1], 16)))
    return frozenset(out)


def safe_cuts(text: str, size: int = CHUNK) -> Iterator[str]:
    """The text in pieces of about ``size`` code points, cut before white space, else where NFC cannot join the sides."""
    at, n = 0, len(text)
    while n - at > size:
        found = _CUT.search(text, at + size, min(n, at + 2 * size))
        end = found.start() if found else at + size
        while not found and end < n and (text[end] in _seconds() or unicodedata.combining(text[end])):
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


#: Letters that the library lowers and Python does not yet, as first and last one and the step to the lower one.
LATER_LOWER = ((0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, -42343), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, -42561), (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27))
#: Marks that NFC puts in order in Python and that the library, whose tables are older, leaves where they are.
LATER_MARKS = (
    "07FD 0898-089F 08CA-08D3 09FE 0C3C 0D3B-0D3C 0EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070 1133B"
    " 1145E 11839-1183A 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"
)


def _ranges(text: str) -> str:
    return "".join("-".join(f"\\U{int(x, 16):08X}" for x in r.split("-")) for r in text.split())


def _points(text: str) -> frozenset[str]:
    return frozenset(chr(c) for first, last in ((r.split("-")[0], r.split("-")[-1]) for r in text.split()) for c in range(int(first, 16), int(last, 16) + 1))


_LOWER = {c: c + step for first, last, step in LATER_LOWER for c in range(first, last + 1)}
_MARK = regex.compile(f"([{_ranges(LATER_MARKS)}])")
_RARE = _points(LATER_MARKS) | frozenset(map(chr, _LOWER))


def normalise(text: str) -> str:
    """NFC, then lower case letter by letter (no final-sigma rule). White space stays as it is, since no pre-token holds any."""
    if not text.isascii():
        if not _RARE.isdisjoint(text):
            # what lies between such marks is put in order by itself
            text = "".join(unicodedata.normalize("NFC", part) for part in _MARK.split(text)).translate(_LOWER)
        else:
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ")
    return text.lower()


#: Letters and numbers of Unicode versions later than the library's, which are neither to it.
LATER_LETTERS = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A"
    " 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6"
    " 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD"
    " 323B0-33479 3D000-3FC3F"
)
LATER_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"


class Classes:
    """The pre-tokens of the tokenizer file (what matches none of them is dropped), and the runs that they are made of."""

    def __init__(self, letters: str, numbers: str, others: str, compiled: Callable[[str], re.Pattern], flags: str = ""):
        # no other pre-token begins as letters do, so these may be tried first
        self.pretoken = compiled(rf"{flags}{letters}+|{numbers}|'(?:s|t|re|ve|m|ll|d)|{others}+")
        self.letters, self.others = compiled(rf"{flags}{letters}*"), compiled(rf"{flags}{others}*")

    def kind(self, c: str) -> str:
        return "L" if self.letters.match(c).end() else "O" if self.others.match(c).end() else "S"


_ASCII = Classes("[A-Za-z]", "[0-9]", rf"[^{SPACES}A-Za-z0-9]", re.compile)
_USUAL = Classes(r"[\p{L}]", r"[\p{N}]", rf"[^{SPACES}\p{{L}}\p{{N}}]", regex.compile)
_PINNED = Classes(rf"[\p{{L}}--[{_ranges(LATER_LETTERS)}]]", rf"[\p{{N}}--[{_ranges(LATER_NUMBERS)}]]", rf"[[^{SPACES}\p{{L}}\p{{N}}]||[{_ranges(LATER_LETTERS + ' ' + LATER_NUMBERS)}]]", regex.compile, "(?V1)")
_LATER = _points(LATER_LETTERS + " " + LATER_NUMBERS)


def classes(text: str) -> Classes:
    """The classes that hold for this text; the pinned ones are slower, and differ only for letters that hardly occur."""
    return _ASCII if text.isascii() else _USUAL if _LATER.isdisjoint(text) else _PINNED


def _pretokens(text: str) -> list[str]:
    return classes(text).pretoken.findall(text)


class Encoder:
    """Text in, id strings out, piece by piece.

    ``feed`` returns the decimal ids of every pre-token that is certainly complete, as strings of ids joined by a space
    (one for each pre-token or part of one), so that equal words share one object.
    """

    def __init__(self, vocabulary: Vocabulary, cache: dict[str, str] | None = None):
        self.v, self.cache = vocabulary, {} if cache is None else cache
        self.rest, self.raw = "", ""
        self.long: WordStream | None = None
        self.kind = ""

    def _ids(self, word: str) -> str:
        found = self.cache.get(word)
        if found is None:
            found = " ".join(map(str, self.v.word(word)))
            if len(self.cache) < CACHE and len(word) <= 64:
                self.cache[word] = found
        return found

    def _words(self, words: list[str]) -> list[str]:
        out = list(map(self.cache.get, words))
        if None in out:
            for i, x in enumerate(out):
                if x is None:
                    out[i] = self._ids(words[i])
        return out

    def _push(self, text: str, last: bool) -> list[str]:
        """Normalised text; ``last``: nothing follows in this segment."""
        out: list[str] = []
        if self.long is not None:
            stop = 0
            own = classes(text)
            stop = (own.letters if self.kind == "L" else own.others).match(text).end()
            out += map(str, self.long.feed(text[:stop].encode()))
            text = text[stop:]
            if not text and not last:
                return out
            out += map(str, self.long.finish())
            self.long = None
        text = self.rest + text
        self.rest = ""
        own = classes(text)
        pretoken = own.pretoken
        if last:
            return out + self._words(pretoken.findall(text))
        # the last two pre-tokens may still change when more text comes: an apostrophe and its suffix, or a longer run
        if text and text[-1] in SPACES:
            return out + self._words(pretoken.findall(text))
        tail = text[-4 * self.v.window :]
        base = len(text) - len(tail)
        spans = [m.span() for m in pretoken.finditer(tail)]
        if base and (not spans or len(spans) < 4):
            spans = [m.span() for m in pretoken.finditer(text)]
            base = 0
        elif base:
            spans = spans[2:]
        if len(spans) < 3:
            cut = 0
        else:
            cut = base + spans[-2][0]
        if cut:
            # whole pre-tokens before the cut are found from the start: the cut lies between pre-tokens
            out += self._words(pretoken.findall(text[:cut]))
        self.rest = text[cut:]
        if len(self.rest) > 2 * self.v.window:
            # one very long pre-token at the end: stream it
            spans = [m.span() for m in pretoken.finditer(self.rest)]
            a, b = spans[-1]
            if b == len(self.rest) and b - a > self.v.window:
                out += self._words(pretoken.findall(self.rest[:a]))
                self.kind = own.kind(self.rest[a])
                self.long = WordStream(self.v)
                out += map(str, self.long.feed(self.rest[a:].encode()))
                self.rest = ""
        return out

    def feed(self, text: str) -> list[str]:
        """Raw text without special tokens in it, cut where ``safe_cuts`` allows."""
        return self._push(normalise(text), False)

    def close(self) -> list[str]:
        return self._push("", True)


def encode_stream(v: Vocabulary, text: str, cache: dict[str, str] | None = None) -> Iterator[list[str]]:
    """Id strings of a whole text, in lists."""
    cache = {} if cache is None else cache

    def segment(part: str) -> Iterator[list[str]]:
        if len(part) <= CHUNK:
            encoder = Encoder(v, cache)
            yield encoder._words(_pretokens(normalise(part)))
            return
        encoder = Encoder(v, cache)
        for piece in safe_cuts(part):
            yield encoder.feed(piece)
        yield encoder.close()

    if v.split is None or "<" not in text:
        yield from segment(text)
        return
    at = 0
    for m in v.split.finditer(text):
        if m.start() > at:
            yield from segment(text[at : m.start()])
        yield [str(v.special[m[0]])]
        at = m.end()
    if at < len(text):
        yield from segment(text[at:])


class Decoder:
    """Ids in, text out, with constant state.

    ``pieces``: vocabulary entries joined by one space, as a tokenizer file without a decoder prescribes.
    ``text``: bytes of the entries through an incremental UTF-8 decoder, a word end as one space.
    """

    def __init__(self, v: Vocabulary, mode: str = "pieces"):
        self.v, self.mode, self.begun = v, mode, False
        if mode == "text":
            self.byte = {s: b for b, s in enumerate(byte_symbols())}
            self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        table = self.v.pieces
        if self.mode == "pieces":
            found = [table[i] for i in ids]
            if None in found:
                found = [p for p in found if p is not None]
            if not found:
                return ""
            out = (" " if self.begun else "") + " ".join(found)
            self.begun = True
            return out
        out = []
        for i in ids:
            piece = table[i]
            if piece is None:
                continue
            if piece in self.v.special:
                out.append(self.utf8.decode(b"", True) + piece)
                self.utf8.reset()
                continue
            whole = piece.endswith(self.v.end)
            out.append(self.utf8.decode(bytes(self.byte[c] for c in (piece.removesuffix(self.v.end) if whole else piece)), whole))
            if whole:
                self.utf8.reset()
                out.append(" ")
        return "".join(out)

    def close(self) -> str:
        return self.utf8.decode(b"", True) if self.mode == "text" else ""


_loaded: dict[str, tuple[Vocabulary, dict[str, str]]] = {}


def load(path: str) -> tuple[Vocabulary, dict[str, str]]:
    """The vocabulary and word cache of this worker."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path), {}
    return _loaded[path]


def encode_texts(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds ids (array<int>) and n_tokens. A null or empty text has no ids. Made columns replace those of their names."""

    def rows(batches):
        v, cache = load(path)
        for batch in batches:
            out = [[int(i) for part in encode_stream(v, t or "", cache) for s in part for i in s.split()] for t in batch.column(0).to_pylist()]
            yield [pa.array(out, pa.list_(pa.int32())), pa.array(list(map(len, out)), pa.int64())]

    return add_columns(df, text, T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())]), rows)


def decode_ids(df: DataFrame, path: str, ids: str = "ids", mode: str = "pieces") -> DataFrame:
    """Adds decoded (string): see ``Decoder``. Null ids give an empty string; ids outside the vocabulary are skipped."""

    def rows(batches):
        v, _ = load(path)
        for batch in batches:
            out = []
            for row in batch.column(1).to_pylist():
                d = Decoder(v, mode)
                out.append(d.feed(i for i in row or () if i is not None and 0 <= i < len(v.pieces)) + d.close())
            yield [pa.array(out, pa.string())]

    return add_columns(df, ids, T.StructType([T.StructField("decoded", T.StringType())]), rows, (ids,))


def round_trip(df: DataFrame, path: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256, and ids if wanted: each text runs through encoder and decoder.

    Without ids neither the ids nor the decoded text of a document are ever held whole. A null text counts as empty.
    The text itself is not returned; made columns replace input columns of their names.
    """
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    made = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)

    def rows(batches):
        v, cache = load(path)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for t in batch.column(0).to_pylist():
                n, ids_hash, text_hash, decoder, all_ids = 0, hashlib.sha256(), hashlib.sha256(), Decoder(v), []
                for part in encode_stream(v, t or "", cache):
                    if not (joined := " ".join(filter(None, part))):
                        continue
                    ids_hash.update((" " + joined if n else joined).encode())
                    ids = list(map(int, joined.split(" ")))
                    n += len(ids)
                    text_hash.update(decoder.feed(ids).encode())
                    if with_ids:
                        all_ids += ids
                for column, x in zip(out, (n, ids_hash.hexdigest(), text_hash.hexdigest(), pa.array(all_ids, pa.int32()) if with_ids else None), strict=True):
                    column.append(x)
            arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
            yield arrays + [pa.array(out[3], pa.list_(pa.int32()))] * with_ids

    return add_columns(df, text, made, rows, without=(text,))
