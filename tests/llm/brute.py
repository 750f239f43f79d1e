"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def shingles(text, n=5):
    w = words(text)
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else Counter([tuple(w)] if w else [])


def similarity(a, b):
    low = sum((a & b).values())
    high = sum((a | b).values())
    return low / high if high else 1.0


def near_classes(rows, least=0.8):
    """{doc_id: smallest id of its class}; rows of (doc_id, text)."""
    bags = [(i, t, shingles(t)) for i, t in rows if i is not None and t is not None]
    root = {i: i for i, _, _ in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, s, a) in enumerate(bags):
        for j, t, b in bags[k + 1 :]:
            if s == t or (a and b and similarity(a, b) >= least):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in root}


def remove_repeats(rows, window=20):
    """{row index: (words, removed, sha256)} of (doc_id, text) in any order; ids distinct."""
    seen, out = set(), {}
    for k, (_, text) in sorted(enumerate(rows), key=lambda x: (x[1][0] is None, x[1][0])):
        w = words(text)
        gone = [False] * len(w)
        if rows[k][0] is not None:
            for i in range(len(w) - window + 1):
                key = tuple(w[i : i + window])
                if key in seen:
                    gone[i : i + window] = [True] * window
                seen.add(key)
        kept = [x for x, g in zip(w, gone) if not g]
        out[k] = (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def _masked(line):
    return ["<*>" if re.search("[0-9]", t) else t for t in words(line)]


def _fields(t):
    """(lead, fields) of a line's tokens."""
    n = len(t)
    k = n if n <= 2 else min(8, max(2, math.ceil(n / 4)))
    w = max(1, math.ceil((n - k) / 16))
    return tuple(t[:k]), [tuple(t[i : i + w]) for i in range(k, n, w)]


def related(texts):
    """{text: smallest md5 of the texts that share a band of three of its eighteen minima of clause hashes}."""
    digest = {t: hashlib.md5(t.encode()).hexdigest() for t in texts}
    bands, members = {}, defaultdict(list)
    for t in texts:
        h = [int(hashlib.md5(c.encode()).hexdigest()[:15], 16) for c in re.split(r"[.,;:!?\n][ \t\n\r.,;:!?]*", t) if c]
        low = [min((x ^ (k * 0x9E3779B97F4A7C15 & (1 << 60) - 1) for x in h), default=None) for k in range(1, 19)]
        bands[t] = [(k, *low[k : k + 3]) for k in range(0, 18, 3)] if h else []
        for b in bands[t]:
            members[b].append(digest[t])
    return {t: min([digest[t], *(min(members[b]) for b in bands[t])]) for t in texts}


def drop_lines(rows):
    """Texts after line dedup; rows of (doc_id, text)."""
    first = {}
    for doc, text in rows:
        if text is not None:
            first[text] = min(first.get(text, math.inf), math.inf if doc is None else doc)
    lines = [(text, p, _masked(x)) for text in first for p, x in enumerate(text.split("\n")) if words(x)]
    often = Counter()
    for _, _, t in lines:
        lead, fields = _fields(t)
        often.update((len(t), lead, j, f) for j, f in enumerate(fields))
    kin, has = related(first), defaultdict(list)
    for text, p, t in lines:
        lead, fields = _fields(t)
        body = tuple(f if often[len(t), lead, j, f] >= 3 else None for j, f in enumerate(fields))
        said = [x for part in (lead, *filter(None, body)) for x in part if "<*>" not in t or any(c.isalpha() for c in x)]
        if 2 * len(said) >= len(t) and (None not in body or len(said) >= 3):
            has[len(t), lead, body].append((text, p))
    gone = set()
    for found in has.values():
        some = {x for x, _ in found}
        unrelated = len({kin[x] for x in some})
        if unrelated >= 3 and unrelated >= 0.2 * len(some):
            keeper = min(first[x] for x in some)
            gone |= {(x, p) for x, p in found if first[x] > keeper}
    return [None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (t, p) not in gone) for _, t in rows]


def targets(sizes, share=1.5, cap=2, weights=(5, 2, 1)):
    """Targets by source: shares by weight, again and again, until none is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > cap * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def copies(rows, **more):
    """How often each row (doc_id, text, source) is taken."""
    size = [len(words(t)) for _, t, _ in rows]
    sizes = Counter()
    for n, (_, _, s) in zip(size, rows):
        sizes[s] += n
    goal = targets(dict(sizes), **more)
    h = lambda i, t: int(hashlib.md5(((t or "") if i is None else str(i)).encode()).hexdigest()[:15], 16)
    out = [0] * len(rows)
    for s in sizes:
        full = math.floor(goal[s] / sizes[s]) if sizes[s] else 0
        budget, spent = goal[s] - full * sizes[s], 0
        for k in sorted((k for k, r in enumerate(rows) if r[2] == s), key=lambda k: (h(*rows[k][:2]), size[k])):
            out[k] = full + (spent + size[k] / 2 <= budget)
            spent += size[k]
    return out


def _xx(data, seed=42):
    """xxhash64 as Spark has it, of a string or a long, as an unsigned number."""
    raw = data.encode() if isinstance(data, str) else (data & (1 << 64) - 1).to_bytes(8, "little")
    return xxhash.xxh64_intdigest(raw, seed)


def _chain(numbers, seed=42):
    for x in numbers:
        seed = _xx(x, seed)
    return seed


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def imatch(rows, least, most):
    """{doc_id: (n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)}; distinct ids, no nulls."""
    rows = sorted(rows)
    terms = lambda t: sorted({_signed(_xx(w)) for w in words(t.lower())})
    df = Counter(x for _, t in rows for x in terms(t))
    lexicon = {x for x, n in df.items() if max(2, least * len(rows)) <= n <= most * len(rows)}
    short = lambda h: f"{h:016X}"[-6:]

    def hashes(t):
        every = terms(t)
        own = [x for x in every if x in lexicon]
        out = [short(_chain(own or every)) if every else ""]
        for scale in range(1, 9):
            for k in range(8):
                # an int is hashed by its four bytes
                bits = lambda x: xxhash.xxh64_intdigest(k.to_bytes(4, "little"), _xx(x))  # noqa: B023, E731
                some = [x for x in own if bits(x) & (1 << scale) - 1 == 0]
                out.append(short(_chain(some)) if some else "")
        return out

    def like(a, b):
        some = [x == y for x, y in zip(a, b) if x or y]
        return sum(some) / len(some) if some else 1.0

    out = {}
    for i, (doc, t) in enumerate(rows):
        after, half = rows[(i + 1) % len(rows)][1], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = hashes(t), hashes(edited), hashes(after)
        out[doc] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), "-".join(a), "-".join(b), like(a, b), like(a, c))
    return out


_ALL = (1 << 64) - 1


def _mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _ALL
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _ALL
    return x ^ x >> 31


def _stream(seed, k):
    return _mix((k + 1) * 0x9E3779B97F4A7C15 + seed & _ALL)


def quality_features(text):
    """Features of a text's tokens, token pairs and triples of token shapes."""
    tokens = [m.group() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0D]+", (text or "").encode())]
    base = _stream(11, 0) | 1
    h = [_mix(sum(_stream(12, b) * pow(base, i, 1 << 64) for i, b in enumerate(t)) & _ALL) for t in tokens]
    upper = lambda b: 65 <= b <= 90
    kind = lambda t: 1 if re.match(rb"[0-9A-Za-z\x80-\xff]", t) else 2
    shape = [kind(t) + 4 * upper(t[0]) + 8 * upper(t[min(1, len(t) - 1)]) + 16 * (48 <= t[0] <= 57) + 32 * (i > 0 and h[i] == h[i - 1]) + 64 * min(len(t), 12) for i, t in enumerate(tokens)]
    out = h + [_mix(a * 3 + b & _ALL) for a, b in zip(h, h[1:])]
    out += [_mix((a << 40 | b << 20 | c) + 77) for a, b, c in zip(shape, shape[1:], shape[2:])]
    return Counter(x % 65536 for x in out)


def quality(rows, labels):
    """{doc_id: (log_weight, score, keep)}; rows of (doc_id, text)."""
    found = {doc: quality_features(t) for doc, t in rows}
    raw = sum(found.values(), Counter())
    target = sum((found[d] for d, q in labels.items() if q == 1), Counter())
    p = lambda c, x: math.log(c[x] + 1) - math.log(sum(c.values()) + 65536)
    out = {}
    for doc, c in found.items():
        weight = sum(n * (p(target, x) - p(raw, x)) for x, n in c.items())
        u = _mix(_xx("gumbel", _xx(doc))) >> 11
        out[doc] = (weight, weight - math.log(-math.log((u + 0.5) * 2.0**-53)))
    k = round(sum(labels.values()) / len(labels) * len(rows))
    least = sorted((s for _, s in out.values()), reverse=True)[k - 1]
    return {doc: (w, s, s >= least) for doc, (w, s) in out.items()}


def language(model, text):
    """(probabilities, likelihoods) by language, one subword at a time."""
    low = [b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 32 if b in b"\x20\x09\x0a\x0b\x0c\x0d" else b for b in text.encode()]
    two = [a * 257 + b + 0x10000 for a, b in zip(low, low[1:])]
    three = [(x * 65599 + c * 2654435761) % 2**32 for x, c in zip(two, low[2:])]
    total, like, n = [0.0] * len(model.languages), [0.0] * len(model.languages), 0
    for h in low + two + three:
        h = (h ^ h >> 15) * 0x2C1B3C6D % 2**32
        h = (h ^ h >> 12) % len(model.logits)
        n += 1
        for k in range(len(total)):
            total[k] += float(model.logits[h, k])
            like[k] += float(model.likelihood[k, h])
    z = [(x / n + float(b)) / model.temperature for x, b in zip(total, model.bias)]
    e = [math.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e], [x / n for x in like]
