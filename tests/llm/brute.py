"""Plain-Python versions of the operators' contracts, for whole small tables."""

import hashlib
import re
import zlib


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fold(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def pii(text) -> list[tuple[int, int, int, str]]:
    text, out = text or "", []
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: card(re.sub("[^0-9]", "", m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    )
    for order, (kind, pattern, good) in enumerate(rules):
        out += [(m.start(), order, m.end(), kind) for m in re.finditer(pattern, text) if good(m[0])]
    return sorted(out)


def card(digits: str) -> bool:
    if not 12 <= len(digits) <= 19:
        return False
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def spans(found) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in found)


def contamination(docs: dict, items: list[tuple[object, str]], size: int = 13) -> dict:
    def toks(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))

    table = {}
    for item, text in items:
        w = toks(text)
        m = min(size, len(w))
        for i in range(len(w) - m + 1) if m else ():
            table.setdefault(tuple(w[i : i + m]), set()).add(str(item))
    lengths = {len(k) for k in table}
    out = {}
    for d, text in docs.items():
        w, hit, met = toks(text), set(), set()
        for m in lengths:
            for i in range(len(w) - m + 1):
                if (ids := table.get(tuple(w[i : i + m]))) is not None:
                    hit.update(range(i, i + m))
                    met |= ids
        out[d] = (len(w), len(hit), len(met), sha(",".join(sorted(met))), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def repeats(docs: dict, size: int = 35) -> dict:
    seen: dict = {}
    split = {d: words(t) for d, t in docs.items()}
    for w in split.values():
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            seen[k] = seen.get(k, 0) + 1
    out = {}
    for d, w in split.items():
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def jaccard(docs: dict, size: int = 4, percent: int = 85) -> dict:
    sets = {}
    for d, t in docs.items():
        w = words(lower(t or ""))
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    index: dict = {}
    for d, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(d)
    parent = {d: d for d in docs}
    links = dict.fromkeys(docs, 0)

    def root(d):
        while parent[d] != d:
            parent[d] = parent[parent[d]]
            d = parent[d]
        return d

    for d, s in sets.items():
        common: dict = {}
        for x in s:
            for e in index[x]:
                if e > d:
                    common[e] = common.get(e, 0) + 1
        for e, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[e]) - n):
                links[d] += 1
                links[e] += 1
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return {d: (len(sets[d]), root(d), links[d]) for d in docs}


KINDS = ("email", "ip", "card", "phone", "secret")


def seeds(text) -> list[tuple[int, int, int, str]]:
    """Base spans, and digests of 32 to 64 hexadecimal digits that something is set to."""
    text = text or ""
    base = pii(text)
    found = []
    for m in re.finditer(r"[a-f0-9]+", text):
        own = m[0]
        if 32 <= len(own) <= 64 and re.search("[0-9]", own) and re.search("[a-f]", own) and not re.match("[A-Za-z0-9]", text[m.end() : m.end() + 1]):
            if re.search(r"""[=:]( ?["']?)$""", text[max(0, m.start() - 3) : m.start()]) and not any(a < m.end() and m.start() < b for a, _, b, _ in base):
                found.append((m.start(), 4, m.end(), "secret"))
    return sorted(base + found)


def discovered(docs: dict, rounds: int = 3, confidence: float = 0.8, support: int = 5, floor: float = 0.2) -> dict:
    """All spans of each text: seeds, and words in places of patterns that known entities fill."""
    slots, out = [], {}
    for d, text in docs.items():
        text = text or ""
        out[d] = found = seeds(text)
        unions: list[list] = []
        for a, o, b, k in found:
            if unions and a < unions[-1][1]:
                unions[-1][1] = max(unions[-1][1], b)
            else:
                unions.append([a, b, k])
        # a seed is one word, with what is joined to it
        inside = {i: k for a, b, k in unions for i in range(a, b)}
        words, at = [], 0
        while at < len(text):
            c = text[at]
            if at not in inside and c in " \t\n\x0b\x0c\r":
                at += 1
                continue
            end = at + 1
            if at in inside or c not in "=:;,\"'()<>[]{}|":
                while end < len(text) and (end in inside or text[end] not in " \t\n\x0b\x0c\r=:;,\"'()<>[]{}|"):
                    end += 1
            words.append((at, end, next((inside[i] for i in range(at, end) if i in inside), None)))
            at = end
        tidy = ["^", "^"] + ["<seed>" if k and b - a > 0 else re.sub("[0-9]", "0", text[a:b].lower()) for a, b, k in words] + ["^"]
        # a seed as context keeps its letters beyond the first, as its word does
        for i, (a, b, k) in enumerate(words):
            if k:
                own = "".join("\0" if j in inside and inside.get(j - 1) is None else text[j] for j in range(a, b))
                tidy[i + 2] = re.sub("[0-9]", "0", own.lower())
        for i, (a, b, k) in enumerate(words):
            if b - a == 1 and not k and text[a] in "=:;,\"'()<>[]{}|":
                continue
            token = text[a:b].lower()
            for p in (("1", tidy[i], tidy[i + 1]), ("2", tidy[i + 1], tidy[i + 3]), ("3", tidy[i], tidy[i + 3])):
                slots.append((p, token[1:] if k else token, k, d, a, b))
    filled: dict = {}
    for p, token, k, *_ in slots:
        if k:
            filled.setdefault((p, k), set()).add(token)
    able = {p for (p, _), tokens in filled.items() if len(tokens) >= support}
    places: dict = {}
    for p, _, k, *_ in slots:
        if p in able:
            n = places.setdefault(p, [0, 0])
            n[0] += 1
            n[1] += k is not None
    able = {p for p, (n, k) in places.items() if k >= floor * n}
    edges: dict = {}
    for p, token, k, *_ in slots:
        if p in able:
            edges[p, token] = max(filter(None, (edges.get((p, token)), k)), default=None)
    known: dict = {}
    for (_, token), k in edges.items():
        if k:
            known[token] = max(known.get(token, k), k)

    def rate(scores: dict) -> dict:
        made = {}
        for p in able:
            fill = [t for q, t in edges if q == p]
            own = {k: [scores[t][1] for t in fill if t in scores and scores[t][0] == k] for k in KINDS}
            weight, k, n = max((sum(v), k, len(v)) for k, v in own.items())
            if n >= support and weight / len(fill) >= confidence:
                made[p] = (weight / len(fill), k)
        return made

    scores = {t: (k, 1.0) for t, k in known.items()}
    for _ in range(rounds):
        good = rate(scores)
        judged: dict = {}
        for (p, t), k in edges.items():
            if k is None:
                judged.setdefault(t, []).append(good.get(p, (0.0, "")))
        scores = {t: (k, 1.0) for t, k in known.items()}
        for t, own in judged.items():
            score = sum(w for w, _ in own) / len(own)
            if score >= confidence and t not in known:
                scores[t] = (max(own)[1], score)
    good = rate(scores)
    hits: dict = {}
    for p, _, k, d, a, b in slots:
        if k is None and p in good:
            hits[d, a, b] = max(hits.get((d, a, b), good[p]), good[p])
    for (d, a, b), (_, k) in hits.items():
        own = docs[d][a:b]
        core = own.strip(".!?*#&$%")
        if core:
            start = a + len(own) - len(own.lstrip(".!?*#&$%"))
            out[d] = sorted([*out[d], (start, KINDS.index(k), start + len(core), k)])
    return out
