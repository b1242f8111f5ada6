"""The contracts of the queries in plain Python, over whole tables held in memory."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def words_of(text):
    return [w for w in BLANK.split(text or "") if w]


def shingles(text, k=5):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = words_of(lower)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1)))


def components(docs):
    """{doc_id: (set size, least id reachable)}; candidates are all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    lists = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            lists[x].append(i)
    common = Counter()
    for own in lists.values():
        for a in range(len(own)):
            for b in range(a):
                common[own[b], own[a]] += 1
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}


def statistics(text):
    w, lines = words_of(text), [x for x in (text or "").split("\n") if words_of(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if seen[x] > 1:
            covered |= {i, i + 1, i + 2}
    n, rep = len(w), len(covered)
    return n, sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), rep, n < 50 or 100 * rep > 50 * n


def sha(data):
    return hashlib.sha256(data).hexdigest()


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def exact(docs):
    same = defaultdict(list)
    for i, t in docs:
        same[t or ""].append(i)
    return {i: (max(same[t or ""]), len(same[t or ""]), i == max(same[t or ""]), sha((t or "").encode())) for i, t in docs}


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.translate({c: c + 32 for c in range(65, 91)}), slash + path


def listed(host, path, rules):
    fit = [(len(h), len(p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[2:] if fit else (None, None)


def hilbert_cells(dims, bits):
    """All cells of a dims-dimensional grid in the order of a Hilbert curve, by walking its recursion."""

    def to_point(index):
        # transpose of the index, then Gray decode and undo the rotations
        x = [0] * dims
        for b in range(bits * dims):
            if index >> (bits * dims - 1 - b) & 1:
                x[b % dims] |= 1 << (bits - 1 - b // dims)
        t = x[-1] >> 1
        for i in range(dims - 1, 0, -1):
            x[i] ^= x[i - 1]
        x[0] ^= t
        q = 2
        while q != 2 << (bits - 1):
            p = q - 1
            for i in range(dims - 1, -1, -1):
                if x[i] & q:
                    x[0] ^= p
                else:
                    t = (x[0] ^ x[i]) & p
                    x[0] ^= t
                    x[i] ^= t
            q <<= 1
        return tuple(x)

    return [to_point(i) for i in range(1 << (bits * dims))]


def phrase_set(data):
    """Phrases of the parse of some bytes."""
    seen, start = set(), 0
    for end in range(1, len(data) + 1):
        if data[start:end] not in seen:
            seen.add(data[start:end])
            start = end
    return seen


def edited_pairs(docs):
    """{doc_id: (text, edited text, next text)} of rows with distinct ids."""
    order = sorted(docs, key=lambda r: -r[0])
    out = {}
    for k, (i, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 3
        out[i] = (text, text[: len(text) - n] + following[:n], following)
    return out
