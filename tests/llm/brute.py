"""Plain versions of the operators, row by row."""

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    """[(n_shingles, component_id)] of (doc_id, text) rows."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            index[x].append(i)
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in index[x] if j < i)
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [(len(s), least.get(find(i))) for i, s in enumerate(sets)]


def dedupe(rows, k):
    """[(n_words, n_removed, kept_sha256)]."""
    words = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for (doc, _), w in zip(rows, words, strict=True):
        if doc is not None:
            for i in range(len(w) - k + 1):
                key = tuple(w[i : i + k])
                first[key] = min(first.get(key, doc), doc)
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - k + 1) if doc is not None else ():
            if first[tuple(w[i : i + k])] < doc:
                gone |= set(range(i, i + k))
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


def contamination(rows, items, k=13):
    """[(n_words, n_hit, item ids)]."""
    token = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    patterns = defaultdict(set)
    for item, text in items:
        w = token.findall((text or "").translate(LOWER))
        n = min(k, len(w))
        for i in range(len(w) - n + 1 if n and item is not None else 0):
            patterns[tuple(w[i : i + n])].add(str(item))
    sizes = {len(p) for p in patterns}
    out = []
    for _, text in rows:
        w = token.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                p = patterns.get(tuple(w[i : i + n]))
                if p:
                    hit |= set(range(i, i + n))
                    found |= p
        out.append((len(w), len(hit), sorted(found)))
    return out


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def personal(text):
    """Base spans, as kind:start:end."""
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = [int(c) for c in m.group() if c.isdigit() and c.isascii()]
            luhn = sum(x if i % 2 == 0 else (2 * x - 9 if 2 * x > 9 else 2 * x) for i, x in enumerate(reversed(d)))
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 13 <= len(d) <= 19 and luhn % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


class Katz:
    """A bigram model with the vocabulary of all training words."""

    def __init__(self, texts, least=1):
        self.words = [[*WORD.findall((t or "").translate(LOWER)), "</s>"] for t in texts]
        self.raw = Counter(w for t in self.words for w in t)
        self.N, self.V = sum(self.raw.values()), len(self.raw)
        self.kept = {w for w, c in self.raw.items() if c >= least or w == "</s>"}
        self.rare = self.V - len(self.kept) + 1
        d = self.discounts(Counter(self.raw.values()))
        self.p = {w: d.get(self.raw[w], 1) * self.raw[w] / self.N for w in self.kept}
        self.p[None] = 1 - sum(self.p.values())
        pairs = Counter((h, w) for t in self.words for h, w in zip(["<s>", *map(self.known, t[:-1])], map(self.known, t), strict=True))
        d = self.discounts(Counter(pairs.values()))
        count, kept, seen = Counter(), Counter(), Counter()
        for (h, w), c in pairs.items():
            count[h] += c
            kept[h] += d.get(c, 1) * c
            seen[h] += self.p[w]
        full = {h: count[h] if count[h] - kept[h] > 1e-9 * count[h] else count[h] + 1 for h in count}
        self.pair = {(h, w): d.get(c, 1) * c / full[h] for (h, w), c in pairs.items()}
        self.back = {h: (1 - kept[h] / full[h]) / (1 - seen[h]) for h in count}

    def known(self, w):
        return w if w in self.kept else None

    @staticmethod
    def discounts(n, k=5):
        tail, out = (k + 1) * n[k + 1] / n[1] if n[1] else 1, {}
        for r in range(1, k + 1):
            d = ((r + 1) * n[r + 1] / n[r] / r - tail) / (1 - tail) if n[r] and tail < 1 else 0
            out[r] = d if 0 < d < 1 else (r - 0.5) / r
        return out

    def prob(self, h, w):
        return self.pair.get((h, w)) or self.back.get(h, 1) * self.p[w]

    def score(self, text):
        t = [*WORD.findall((text or "").translate(LOWER)), "</s>"]
        ids = [self.known(w) for w in t]
        s = sum(math.log10(self.prob(h, w)) for h, w in zip(["<s>", *ids[:-1]], ids, strict=True)) - ids.count(None) * math.log10(self.rare)
        base = sum(math.log10((self.raw[w] + 0.5) / (self.N + 0.5 * (self.V + 1))) for w in t)
        return len(t), sum(self.raw[w] > 0 for w in t), base, s


def feistel(number, rows, keys, prime):
    """The place of a row number: rounds over pairs, walked on until it lies inside."""
    side = next(s for s in range(1, rows + 2) if s * s >= rows)
    while True:
        left, right = divmod(number, side)
        for a, c in keys:
            x = (right % prime * a + c) % prime
            left, right = right, (left + (x * x + a) % prime) % side
        number = left * side + right
        if number < rows:
            return number


def shards(rows, shards, keys, prime, buckets, seed):
    """[(doc_id, shard, slot)] of (doc_id, crc32, size) rows, numbered by bucket, id, crc32 and size."""

    def bucket(doc):
        k = (-1 if doc is None else doc) % prime
        x = (k * 1103515245 + 12345 + seed % prime) % prime
        return (x * x + k) % prime % buckets

    order = sorted(rows, key=lambda r: (bucket(r[0]), r[0] is not None, r[0] or 0, *r[1:]))
    places = [(r[0], feistel(i, len(rows), keys, prime)) for i, r in enumerate(order)]
    return [(doc, p % shards, p // shards) for doc, p in places]


def transitions(match):
    """Features of a candidate that rest on its characters, by name."""
    kinds = ["lower" if "a" <= c <= "z" else "upper" if "A" <= c <= "Z" else "digit" if "0" <= c <= "9" else "other" for c in match]
    n = max(len(match) - 1, 1)
    out = {f"{a}_{b}": 0.0 for a in ("lower", "upper", "digit", "other") for b in ("lower", "upper", "digit", "other")}
    for a, b in zip(kinds, kinds[1:], strict=False):
        out[f"{a}_{b}"] += 1 / n
    lower = match.lower()
    spoken = sum(a in "bcdfghjklmnpqrstvwxyz" and b in "aeiou" for a, b in zip(lower, lower[1:], strict=False)) / n
    return out | {"length": len(match), "digits": kinds.count("digit") / len(match), "capitals": kinds.count("upper") / len(match), "distinct": len(set(match)) / min(len(match), 64), "hex": float(bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", match))), "spoken": spoken}


def letters(text):
    """Lower-case text with runs of other characters as one blank, blanks at both ends."""
    t = "".join(c if c.isalpha() else " " for c in f" {(text or '').lower()} ")
    return re.sub(" +", " ", t)


def bundle(text, vector, dim):
    """The sum of bound trigram vectors; ``vector`` gives a letter's, a place turns it."""
    t, out = letters(text), [0] * dim
    for a, b, c in zip(t, t[1:], t[2:], strict=False):
        x, y, z = vector(a), vector(b), vector(c)
        for i in range(dim):
            out[i] += x[i] * y[(i - 1) % dim] * z[(i - 2) % dim]
    return out
