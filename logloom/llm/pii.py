"""Personal data by bootstrapped contextual extraction (DataFrame and SQL functions only).

Seed entities (base patterns, and digests that are assigned to a name as secrets) induce lexical patterns: words at
places around the slot, with wildcards. Patterns and the words that fill them form a graph that is scored in rounds: a
pattern by the share of known entities among all that fill it, a word by the mean score of its patterns. Patterns of high
confidence then add whatever fills them, whether or not it looks like a seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, keep_columns, row_keys

KINDS = ("email", "ip", "card", "phone")

#: The base patterns, written so that Java's matcher needs no backtracking over long runs: possessive loops, and starts
#: only where a leftmost match can start (the start of a run, or the end of the last match). A card is a whole chain of
#: digits with single separators; chains of other than 12 to 19 digits would be dropped, so they are not matched at all.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})?"

#: Seeds that are no base kind: a digest of 32 to 64 hexadecimal digits that something is set to.
SECRET = r"(?<=[=:]|[=:][\x20\"']|[=:]\x20[\"'])(?=[a-f0-9]{0,62}[0-9][a-f]|[a-f0-9]{0,62}[a-f][0-9])[a-f0-9]{32,64}(?![A-Za-z0-9])"
ALL = (*KINDS, "secret")

#: Words of contexts: runs of other characters than blanks and these marks, each of which is a word of its own.
MARKS = r"=:;,\"'()<>\[\]{}|"
_MARKS = "=:;,\"'()<>[]{}|"
WORD = rf"[^\x20\x09-\x0D{MARKS}]+|[{MARKS}]"
#: Private characters that stand for the first character of a seed, by kind, and for blanks and brackets inside one.
_KNOWN = "".join(chr(0xE010 + i) for i in range(len(ALL)))
_INNER = "\ue000\ue001\ue002"
_BLOCK = 256
#: Patterns (16 bytes each in a hash table) that are broadcast at most.
BROADCAST = 1 << 20


def located(text: Column, pattern: str) -> Column:
    """All matches as (start, end, match), in code points.

    Positions are sums over the pieces between matches, in blocks, so that a text with very many matches stays cheap.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)

    def build(m: Column, p: Column) -> Column:
        sizes = F.zip_with(m, F.slice(p, 1, F.size(m)), lambda a, b: F.char_length(a) + F.char_length(b))

        def with_sizes(z: Column) -> Column:
            total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
            blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / F.lit(_BLOCK)).cast("int")), lambda b: total(F.slice(z, b * _BLOCK + 1, _BLOCK)))
            starts = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

            def one(x: Column, i: Column, before: Column) -> Column:
                block = F.floor(i / F.lit(_BLOCK)).cast("int")
                start = F.get(before, block) + total(F.slice(z, block * _BLOCK + 1, i - block * _BLOCK)) + F.char_length(F.get(p, i))
                return F.struct(start.alias("start"), (start + F.char_length(x)).alias("end"), x.alias("match"))

            return _let(starts, lambda before: F.transform(m, lambda x, i: one(x, i, before)))

        return _let(sizes, with_sizes)

    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    return _let(found, lambda m: F.when(F.size(m) == 0, none).otherwise(_let(pieces, lambda p: build(m, p))))


def _let(value: Column, body) -> Column:
    """Evaluates ``value`` once and uses it as often as ``body`` likes."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(c: Column) -> Column:
    """The check digit of a card number of digits only."""
    reverse = F.reverse(c)
    doubled = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: _let(F.substr(reverse, i, F.lit(1)).cast("int"), lambda d: F.when(i % 2 == 1, d).when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^(?:{_OCTET})(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """Valid base matches of a kind, leftmost and non-overlapping; failing matches are dropped and not retried."""
    need = _NEEDS[kind]
    has = F.contains(text, F.lit(need)) if need else text.rlike("[0-9](?:[\\x20-]?[0-9]){11}")
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    return F.when(has, F.filter(located(text, BASE[kind]), lambda x: valid(kind, x["match"]))).otherwise(none)


def _as_spans(found: Column, kind: str) -> Column:
    order = F.lit(ALL.index(kind))
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), order.alias("order"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _overlaps(spans: Column, x: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"]))


def marked(text: Column, spans: Column) -> Column:
    """The text with each seed made one word that names its kind, at equal length; overlapping seeds are one."""

    def seed(x: Column, own: Column) -> Column:
        first = F.element_at(F.array(*[F.lit(c) for c in _KNOWN]), x["order"] + 1)
        return F.concat(first, F.translate(F.substr(own, F.lit(2), F.char_length(own)), " ()", _INNER))

    plain = F.translate(text, _KNOWN + _INNER, "\ufffd" * len(_KNOWN + _INNER))
    return _replaced(plain, spans, seed)


def _slots(docs: DataFrame, text: str, *more: str, named: bool) -> DataFrame:
    """One row for each word that is no mark: i (its place), w (as contexts see it) and the hashes p1, p2, p3 of its patterns.

    A pattern names two of three places around the slot, the third is a wildcard: the two words before, the word on
    either side, the second word before with the one after. Contexts see words in lower case, with 0 for each digit; beyond
    the ends of a text there is the mark ^. ``docs`` keeps its columns ``more``. With ``named`` there is the word itself
    too, as token.
    """
    words = lambda c: F.regexp_extract_all(c, F.lit(WORD), F.lit(0))
    own = [words(F.lower(text)).alias("o")] if named else []
    split = docs.select(*more, words(F.translate(F.lower(text), "123456789", "0" * 9)).alias("m"), *own).where(F.size("m") > 0)
    edge = F.array(F.lit("^"))
    places = [F.col("m").alias("w"), F.concat(edge, "m").alias("l1"), F.concat(edge, edge, "m").alias("l2"), F.concat(F.slice("m", 2, F.greatest(F.size("m") - 1, F.lit(1))), edge).alias("r1")]
    places += [F.col("o").alias("token")] if named else []
    each = split.select(*more, F.posexplode(F.arrays_zip(*places)).alias("i", "x")).select(*more, "i", "x.*")
    each = each.where(F.col("w").isNotNull() & (F.position(F.col("w"), F.lit(_MARKS)) == 0))
    patterns = [F.xxhash64(F.lit(n), *c).alias(f"p{n}") for n, c in ((1, ("l2", "l1")), (2, ("l1", "r1")), (3, ("l2", "r1")))]
    return each.select(*more, "i", "w", *(["token"] if named else []), *patterns)


def _filled(each: DataFrame, patterns: DataFrame) -> DataFrame:
    """The slots of each pattern of a table (column pattern, a written one), one row for each slot and pattern.

    Up to ``BROADCAST`` patterns are broadcast, and most words are done with three probes of that table; more of them meet
    the words in a shuffled join.
    """
    kept = [c for c in each.columns if c not in ("p1", "p2", "p3")]
    if patterns.count() > BROADCAST:
        return each.select(*kept, F.explode(F.array("p1", "p2", "p3")).alias("pattern")).join(patterns, "pattern")
    for p in ("p1", "p2", "p3"):
        each = each.join(F.broadcast(patterns.select(F.col("pattern").alias(p), F.col("pattern").alias(f"is_{p}"))), p, "left")
    return each.select(*kept, F.explode(F.array("is_p1", "is_p2", "is_p3")).alias("pattern")).where(F.col("pattern").isNotNull())


def _kind(word: str) -> Column:
    """The kind that a seed's word names; null for other words."""
    at = F.regexp_extract(word, f"[{_KNOWN}]", 0)
    return F.when(at != "", F.element_at(F.create_map(*[F.lit(x) for pair in zip(_KNOWN, ALL, strict=True) for x in pair]), at))


def find_pii(df: DataFrame, text: str = "text", rounds: int = 3, confidence: float = 0.8, support: int = 5, floor: float = 0.2, carry: bool = True) -> DataFrame:
    """Adds base (array of spans), spans (base, secrets and discovered ones) and n_email, n_ip, n_card, n_phone (of the base).

    A span is (start, order, end, kind): code points, end exclusive, sorted by start, then kind as listed. Null text has
    no spans. Repeated rows are scanned alike and get equal spans. Made columns replace input columns of their names.

    A pattern discovers where at least ``support`` distinct known entities of one kind fill it and their scores make up
    ``confidence`` of all different words that fill it; a pattern of which less than ``floor`` of all places hold seeds is
    never looked at further. Discovered spans never overlap seeds; marks of the sentence around a word stay outside.

    The texts are scanned for seeds once, into a written table. Patterns are aggregated before they are shuffled. All
    words of all texts meet the patterns of seeds in a join, whose side of patterns Spark broadcasts while its files are
    small and shuffles beyond. ``carry=False`` leaves the text itself out of the result.
    """
    made = ["base", "spans", *(f"n_{k}" for k in KINDS)]
    kept = [c for c in keep_columns(df, made) if c != text]
    body = F.coalesce(F.col("_t"), F.lit(""))
    source = df.select(*[F.col(f"`{c}`") for c in kept], *row_keys(df), F.col(f"`{text}`").alias("_own"), F.col(f"`{text}`").cast("string").alias("_t"))
    scanned = source.select(
        "*",
        *[base_spans(body, k).alias(f"_{k}") for k in KINDS],
        F.when(body.rlike("[=:][\\x20\"']{0,2}[a-f0-9]{32}"), located(body, SECRET)).alias("_secret"),
    )
    with_base = scanned.withColumn("base", F.array_sort(F.concat(*[_as_spans(F.col(f"_{k}"), k) for k in KINDS])))
    secret = F.filter(_as_spans(F.coalesce("_secret", F.array().cast("array<struct<start:int,end:int,match:string>>")), "secret"), lambda x: ~_overlaps(F.col("base"), x))
    seeded = with_base.withColumn("_seeds", F.array_sort(F.concat("base", secret)))
    words = F.when(F.size("_seeds") > 0, marked(body, F.col("_seeds")))
    read = cut(seeded.select(*[F.col(f"`{c}`") for c in kept], "_own", "_k1", "_k2", "base", "_seeds", words.alias("_marked")), "pii-read")

    added = _discover(read, rounds, confidence, support, floor)
    front = [F.col(f"`{c}`") if c != text else F.col("_own").alias(text) for c in keep_columns(df, made) if carry or c != text]
    counts = [_count("base", k).alias(f"n_{k}") for k in KINDS]
    if added is None:
        return read.select(*front, "base", F.col("_seeds").alias("spans"), *counts)
    met = read.join(added, ["_k1", "_k2"], "left")
    spans = F.when(F.col("_added").isNull(), F.col("_seeds")).otherwise(F.array_sort(F.concat("_seeds", _placed(_words_of(), F.col("_added")))))
    return met.select(*front, "base", spans.alias("spans"), *counts)


def _words_of() -> Column:
    """A row's text as the words of contexts are taken from it."""
    return F.coalesce(F.col("_marked"), F.translate(F.col("_own").cast("string"), _KNOWN + _INNER, "\ufffd" * len(_KNOWN + _INNER)))


def _placed(text: Column, hits: Column) -> Column:
    """Spans of the words of these places (i, found), without sentence marks at their ends; words of marks alone have none."""

    def one(x: Column, found: Column) -> Column:
        lead = F.char_length(F.regexp_extract(x["match"], r"^[.!?*#&$%]*", 0))
        core = F.char_length(F.regexp_replace(x["match"], r"^[.!?*#&$%]++|[.!?*#&$%]++$", ""))
        order = F.element_at(F.create_map(*[y for i, k in enumerate(ALL) for y in (F.lit(k), F.lit(i))]), found)
        return F.struct((x["start"] + lead).alias("start"), order.alias("order"), (x["start"] + lead + core).alias("end"), found.alias("kind"))

    made = _let(located(text, WORD), lambda w: F.transform(hits, lambda h: one(F.get(w, h["i"]), h["found"])))
    return F.filter(made, lambda s: s["end"] > s["start"])


def _discover(read: DataFrame, rounds: int, confidence: float, support: int, floor: float) -> DataFrame | None:
    """(_k1, _k2, _added: places and kinds of discovered words), or None where no pattern can discover any."""
    known = _slots(read.where(F.size("_seeds") > 0), "_marked", named=True).withColumn("kind", _kind("w")).where(F.col("kind").isNotNull())
    seeds = known.select("kind", "token", F.explode(F.array("p1", "p2", "p3")).alias("pattern")).distinct()
    able = cut(seeds.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support).select("pattern").distinct(), "pii-able")
    if able.isEmpty():
        return None
    texts = read.select("_k1", "_k2", _words_of().alias("_text"))
    places = _filled(_slots(texts, "_text", named=False), able).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.count(_kind("w")).alias("k"))
    able = cut(places.where(F.col("k") >= floor * F.col("n")).select("pattern"), "pii-patterns")
    if able.isEmpty():
        return None
    filled = cut(_filled(_slots(texts, "_text", "_k1", "_k2", named=True), able).select("_k1", "_k2", "i", "token", _kind("w").alias("kind"), "pattern"), "pii-filled")
    edges = cut(filled.groupBy("pattern", "token").agg(F.max("kind").alias("kind")), "pii-edges")
    seed_scores = edges.where(F.col("kind").isNotNull()).groupBy("token").agg(F.max("kind").alias("found"), F.lit(1.0).alias("score"))
    scores = seed_scores
    for _ in range(rounds):
        patterns = _score_patterns(edges, scores, confidence, support)
        opened = edges.where(F.col("kind").isNull())
        judged = opened.join(patterns, "pattern", "left").groupBy("token").agg(
            F.max_by("found", "weight").alias("found"), F.sum(F.coalesce("weight", F.lit(0.0))).alias("w"), F.count(F.lit(1)).alias("n")
        )
        accepted = judged.select("token", "found", (F.col("w") / F.col("n")).alias("score")).where(F.col("score") >= confidence)
        scores = cut(seed_scores.unionByName(accepted.join(seed_scores.select("token"), "token", "left_anti")), "pii-scores")
    patterns = cut(_score_patterns(edges, scores, confidence, support), "pii-confident")
    hits = filled.where(F.col("kind").isNull()).join(patterns, "pattern").groupBy("_k1", "_k2", "i").agg(F.max_by("found", F.struct("weight", "found")).alias("found"))
    return cut(hits.groupBy("_k1", "_k2").agg(F.sort_array(F.collect_list(F.struct("i", "found"))).alias("_added")), "pii-added")


def _score_patterns(edges: DataFrame, scores: DataFrame, confidence: float, support: int) -> DataFrame:
    """Patterns with a kind and a weight: known tokens' scores of that kind over all tokens of the pattern."""
    filled = edges.select("pattern", "token").join(scores, "token", "left")
    sums = [F.sum(F.when(F.col("found") == k, F.col("score")).otherwise(0.0)).alias(f"s_{k}") for k in ALL]
    n = [F.sum(F.when(F.col("found") == k, 1).otherwise(0)).alias(f"c_{k}") for k in ALL]
    total = filled.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), *sums, *n)
    best = F.array_max(F.array(*[F.struct(F.col(f"s_{k}").alias("s"), F.lit(k).alias("k"), F.col(f"c_{k}").alias("c")) for k in ALL]))
    rated = total.select("pattern", "n", best.alias("b"))
    return rated.where((F.col("b.c") >= support) & (F.col("b.s") / F.col("n") >= confidence)).select("pattern", F.col("b.k").alias("found"), (F.col("b.s") / F.col("n")).alias("weight"))


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the union is replaced, under the first kind."""
    return _replaced(text, spans, lambda x, own: F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">")))


def _replaced(text: Column, spans: Column, make) -> Column:
    """The text with each union of overlapping spans replaced by what ``make`` gives for it and its own text."""
    start = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["order"].alias("order"), x["kind"].alias("kind"))
    merged = F.aggregate(
        spans,
        F.array().cast("array<struct<start:int,end:int,order:int,kind:string>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["start"] < F.coalesce(F.element_at(acc, -1)["end"], F.lit(0))),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.element_at(acc, -1).withField("end", F.greatest(F.element_at(acc, -1)["end"], x["end"])))),
        ).otherwise(F.concat(acc, F.array(start(x)))),
    )

    def assemble(m: Column) -> Column:
        before = lambda i: F.coalesce(F.get(m, i - 1)["end"], F.lit(0))
        parts = F.transform(m, lambda x, i: F.concat(F.substr(text, before(i) + 1, x["start"] - before(i)), make(x, F.substr(text, x["start"] + 1, x["end"] - x["start"]))))
        return F.concat(F.array_join(parts, ""), F.substr(text, F.get(m, F.size(m) - 1)["end"] + 1, F.char_length(text)))

    return F.when(F.size(spans) > 0, _let(merged, assemble)).otherwise(text)
