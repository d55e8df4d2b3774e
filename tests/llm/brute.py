"""Plain Python versions of the operators, quadratic where that is simplest."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import regex
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def h64(*values):
    """Spark's xxhash64 over strings and longs."""
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<q", v)
        seed = xxhash.xxh64(raw, seed=seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


# quality -----------------------------------------------------------------------------------


def base_counts(text):
    w = words(text)
    places = defaultdict(list)
    for i in range(len(w) - 7):
        places[tuple(w[i : i + 8])].append(i)
    covered = {j for v in places.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def gram_buckets(text, buckets):
    h = [h64(w) for w in words(text)]
    return [x % buckets for x in h] + [h64(a, b) % buckets for a, b in zip(h, h[1:])]


def quality(docs, trusted, buckets, smoothing, threshold):
    """[(base counts, base_failed, score, kept)] of [(id, text)]."""
    grams = [gram_buckets(t, buckets) for _, t in docs]
    raw = Counter(g for gs in grams for g in gs)
    good = Counter(g for (i, _), gs in zip(docs, grams) if i in trusted for g in gs)
    r, g = sum(raw.values()), sum(good.values())
    ratio = {b: math.log((good[b] + smoothing * g / r) / g) - math.log((raw[b] + smoothing) / r) if g else 0.0 for b in raw}
    out = []
    for (_, t), gs in zip(docs, grams):
        base = base_counts(t)
        failed = base[0] < 20 or 100 * base[4] > 30 * base[0]
        score = sum(ratio[x] for x in gs) / max(1, 2 * base[0] - 1)
        out.append((base, failed, score, not failed and score >= threshold))
    return out


# lines -------------------------------------------------------------------------------------


def word_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def dedup_lines(docs, least=5):
    """[text] of [(id, text)] with distinct ids: equal lines go whatever their length."""
    seen, out = [], {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        if t is None:
            out[i] = None
            continue
        kept = []
        for line in t.split("\n"):
            w = words(line)
            near = lambda o: len(w) >= least <= len(o) and abs(len(w) - len(o)) <= 1 and word_distance(w, o) <= 1  # noqa: E731, B023
            if not w or not any(w == o or near(o) for o in seen):
                kept.append(line)
            if w:
                seen.append(w)
        out[i] = "\n".join(kept)
    return [out[i] for i, _ in docs]


# n-grams -----------------------------------------------------------------------------------


def shingles(text, k):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(docs, k, percent):
    sets = [shingles(t, k) for _, t in docs]
    up = {i: i for i, _ in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, _) in enumerate(docs):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(i), root(docs[b][0])
                up[max(x, y)] = min(x, y)
    return [(i, len(s), root(i)) for (i, _), s in zip(docs, sets)]


# mixing ------------------------------------------------------------------------------------


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """{source: target}, sharing the excess out again until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > most * sizes[s]}
        if not full:
            return out | {s: weight[s] * level for s in free}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= full
    return out


def copies(docs, seed=17):
    """[copies] of [(id, text, source)]."""
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += len(words(t))
    goal, out = targets(sizes), {}
    for s in sizes:
        own = sorted((d for d in docs if d[2] == s), key=lambda d: (-len(words(d[1])), d[0]))
        rate = goal[s] / sizes[s] if sizes[s] else 0.0
        offset = int(hashlib.md5(f"{seed}:{'null' if s is None else 's' + s}".encode()).hexdigest()[:12], 16) / float(1 << 48)
        for n, d in enumerate(own, 1):
            out[d[0]] = min(2, math.floor(n * rate + offset) - math.floor((n - 1) * rate + offset))
    return [out[d[0]] for d in docs]


# personal data -----------------------------------------------------------------------------

KINDS = ("email", "ip", "card", "phone")
EXPRESSIONS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def personal(text):
    out = []
    for kind, expression in enumerate(EXPRESSIONS):
        for m in re.finditer(expression, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")) or kind == 2 and not (14 <= len(digits) <= 19 and luhn(digits)) or kind == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


CANDIDATE = regex.compile(
    r"""(?:(?<=[=:]\x20["'])|(?<=[=:]["']))[^\x20\x09-\x0D"']++|(?<![A-Za-z0-9_-])[A-Z]{2,}+[_-][A-Z0-9_-]++|(?<![A-Za-z0-9_-])[A-Za-z_-]*+[0-9][A-Za-z0-9_-]*+"""
)


def plain_word(w):
    return re.sub("[0-9]+", "0", w.lower())


def context(text, start):
    """The two whole words before a place, or None."""
    left = re.search(r"(?:^|[\x20\x09-\x0D])([^\x20\x09-\x0D]+)[\x20\x09-\x0D]+([^\x20\x09-\x0D]+)[\x20\x09-\x0D]+[\"'`(\[{<=:#]*$", text[:start])
    return (plain_word(left[1]), plain_word(left[2])) if left else None


def identifiers(docs, least_score=0.8, least_seeds=3):
    """[spans] of [(id, text)]: base spans and what contexts add, scored over a graph of plain dicts."""
    found, occurrences = [], Counter()
    for _, t in docs:
        t = t or ""
        w = [plain_word(x) for x in words(t)]
        occurrences.update(zip(w, w[1:-1]))
        base, more = personal(t), []
        for m in CANDIDATE.finditer(t):
            x, lead = m[0], t[max(0, m.start() - 3) : m.start()]
            digits, letters, assigned = len(re.findall("[0-9]", x)), len(re.findall("[A-Za-z]", x)), bool(re.search(r"""[=:]\x20?["']$""", lead))
            if len(x) < 6 or not (digits >= 2 or re.fullmatch("[A-Z]{2,}[_-][A-Z0-9_-]+", x) or assigned) or any(a < m.end() and m.start() < b for a, _, b in base):
                continue
            more.append((m.start(), 4, m.end(), assigned and digits >= 8 and letters >= 8 and bool(re.fullmatch("[A-Za-z0-9+/=_.-]{24,}", x))))
        found.append((base, more))
    edges, seeds = Counter(), set()
    for (_, t), (base, more) in zip(docs, found):
        for start, _, end, seed in [(*b, True) for b in base] + more:
            if c := context(t or "", start):
                instance = (t or "")[start:end].lower()
                edges[c, instance] += 1
                if seed:
                    seeds.add((c, instance))
    instances = defaultdict(set)
    for c, x in edges:
        instances[c].add(x)
    instances = {c: xs for c, xs in instances.items() if len(xs) >= least_seeds and sum(edges[c, x] for x in xs) >= least_score * (occurrences[c] + 0.5)}
    score = {x: float(any((c, x) in seeds for c in instances)) for xs in instances.values() for x in xs}
    sure, done = {x for x, v in score.items() if v}, set()
    while True:
        p = {c: sum(edges[c, x] * score[x] for x in xs) / (occurrences[c] + 0.5) for c, xs in instances.items()}
        now = {c for c in p if p[c] >= least_score and len(instances[c] & sure) >= least_seeds}
        sure |= {x for c in now for x in instances[c]}
        new = {x: max(float(any((c, x) in seeds for c in instances)), 1 - math.prod(1 - min(p[c], 0.999) for c in p if x in instances[c])) for x in score}
        still = max((abs(new[x] - score[x]) for x in score), default=0) < 1e-9
        score = new
        if now == done and still:
            break
        done = now
    return [sorted(base + [m[:3] for m in more if context(t or "", m[0]) in done]) for (_, t), (base, more) in zip(docs, found)]


# language ----------------------------------------------------------------------------------


def grams(text):
    """Buckets of byte bigrams and trigrams of a lower-cased text between blanks, in whole numbers."""
    b, mask = [0x20, *(text or "").lower().encode(), 0x20], (1 << 32) - 1
    two = [(x * 0x9E3779B1 + y * 0x85EBCA6B) & mask for x, y in zip(b, b[1:])]
    three = [(t * 0xC2B2AE35 + z * 0x27D4EB2F) & mask for t, z in zip(two, b[2:])]
    return Counter([(t * 0x2C1B3C6D & mask) >> 19 for t in two] + [(t * 0x297A2D39 & mask) >> 19 for t in three])


def languages(train, docs, smoothing=0.5, buckets=1 << 13):
    """[(language, score, ambiguous)] of texts, learned from [(text, lang)]: exhaustive codes, plain loops."""
    totals = defaultdict(Counter)
    for t, lang in train:
        totals[lang].update(grams(t))
    names = sorted(totals)
    k = len(names)
    code = [[1] * ((1 << (k - 1)) - 1)] + [[1 if m >> j & 1 else -1 for m in range((1 << (k - 1)) - 1)] for j in range(k - 1)]
    share = {n: {b: (totals[n][b] + smoothing) / (sum(totals[n].values()) + smoothing * buckets) for b in range(buckets)} for n in names}
    bits = range(len(code[0]))
    mean = lambda b, j, sign: (lambda v: sum(v) / len(v))([share[n][b] for n, c in zip(names, code) if c[j] == sign])
    weight = [[math.log(mean(b, j, 1)) - math.log(mean(b, j, -1)) for j in bits] for b in range(buckets)]
    margin = [[sum(share[n][b] * weight[b][j] for b in range(buckets)) for j in bits] for n in names]
    scale = [sum(abs(m[j]) for m in margin) / k or 1.0 for j in bits]
    trust = [max(min(m[j] / scale[j] * c[j] for m, c in zip(margin, code)), 1e-3) for j in bits]
    out = []
    for t in docs:
        if not any(x.isalpha() for x in t or ""):
            out.append(("und", 0.0, False))
            continue
        h = grams(t)
        n = sum(h.values())
        f = [sum(c * weight[b][j] for b, c in h.items()) / scale[j] / n for j in bits]
        loss = [sum(trust[j] * math.log1p(math.exp(-2 * c[j] * f[j])) for j in bits) / sum(trust) for c in code]
        p = [math.exp(-4 * (x - min(loss))) for x in loss]
        ranked = sorted(range(k), key=lambda i: (-p[i], i))
        top, second = (p[i] / sum(p) for i in ranked[:2])
        out.append((names[ranked[0]], top, top - second < 0.2))
    return out


def feature(text):
    """What a file's samples say, sample by sample."""
    raw = (text or "").encode()
    x = list(raw + bytes(-len(raw) % 64) if raw else bytes(64))
    crossings = sum((a < 128) != (b < 128) for a, b in zip(x, x[1:]))
    return f"sum={sum(x)};min={min(x)};max={max(x)};energy={sum((v - 128) ** 2 for v in x)};crossings={crossings}"


def payload_row(text):
    raw = (text or "").encode()
    padded = raw + bytes(-len(raw) % 64) if raw else bytes(64)
    return len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])
