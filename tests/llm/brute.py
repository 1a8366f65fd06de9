"""Plain versions of the operators, as slow as they are simple."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

LOWER = {c: c + 32 for c in range(65, 91)}


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (text or "").translate(LOWER))


def sha(items) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def repeats(docs, n=200):
    """{doc_id: (n_bytes, n_removed, n_spans, kept_sha256)} of (doc_id, text) rows."""
    data = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(b[k : k + n] for _, b in data for k in range(len(b) - n + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def contamination(docs, items, window=13):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    known = defaultdict(set)
    for i, t in items:
        w = words(t, pattern)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            known[tuple(w[k : k + n])].add(i)
    sizes = {len(k) for k in known}
    out = []
    for i, t in docs:
        w = words(t, pattern)
        hit, found = [0] * len(w), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (own := known.get(tuple(w[k : k + n]))) is not None:
                    hit[k : k + n] = [1] * n
                    found |= own
        h = sum(hit)
        out.append((i, len(w), h, len(found), sha(sorted(map(str, found))), h > 0 and 20 * h >= len(w)))
    return sorted(out, key=str)


def near(docs, shingle=2, percent=80):
    sets = []
    for i, t in docs:
        w = words(t)
        sets.append((i, {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} - {()}))
    above = list(range(len(sets)))

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                above[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, len(s), least[root(k)], i == least[root(k)]) for k, (i, s) in enumerate(sets)), key=str)


def held_out(i, remainder):
    return zlib.crc32(str(i).encode()) % 5 == remainder


def base_scores(docs):
    """{doc_id: (n_tokens, n_known, train_tokens, base_score)}"""
    count = Counter()
    for i, t in docs:
        if not held_out(i, 1):
            count.update(words(t))
            count[None] += 1
    n, v = sum(count.values()), len(count)
    whole = math.log10(n + 0.5 * (v + 1))
    return {i: (len(w), sum(count[x] > 0 for x in w), n, sum(math.log10(count[x] + 0.5) - whole for x in w)) for i, t in docs for w in [[*words(t), None]]}


def class_scores(docs, class_of, classes, prior):
    """{doc_id: score} by class bigrams over the training texts; class_of gives a word's class, None if it was seen once or never."""
    kind = lambda w: 1 if w[-1].isdigit() and w[-1].isascii() else 0 if not w[-1].isascii() or w[-1].isalpha() else 2
    code = lambda w: classes if w is None else classes + 1 + kind(w) if class_of(w) is None else class_of(w)
    texts = [[*words(t), None] for i, t in docs if not held_out(i, 1)]
    count = Counter(w for t in texts for w in t)
    pairs, width = Counter(), classes + 4
    for t in texts:
        codes = [classes, *map(code, t)]
        pairs.update(zip(codes[:-1], codes[1:], strict=True))
    mass = [0.5 * (c > classes) for c in range(width)]
    for w, n in count.items():
        mass[code(w)] += n + 0.5
    whole = max(sum(mass), 0.5)
    before = Counter()
    for (a, _), n in pairs.items():
        before[a] += n
    follow = lambda a, b: max((pairs[a, b] + prior * mass[b] / whole) / (before[a] + prior), 1e-300)
    out = {}
    for i, t in docs:
        tokens = [*words(t), None]
        codes = [classes, *map(code, tokens)]
        out[i] = sum(math.log10(follow(a, b)) + math.log10(count[w] + 0.5) - math.log10(max(mass[b], 0.5)) for a, b, w in zip(codes[:-1], codes[1:], tokens, strict=True))
    return out


def tokens(docs, path):
    """(doc_id, start, n_tokens, ids_crc32) of rows with distinct ids."""
    from tokenizers import Tokenizer

    tool, at, out = Tokenizer.from_file(path), 0, []
    for i, t in sorted(docs):
        ids = [*tool.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((i, at, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        at += len(ids)
    return out


def pipeline(rows, items, known):
    """Rows (doc_id, text, lang, source, n_chars) that stay before the mix; known: ids with a language."""
    rows = [r for r in rows if r[0] in known]
    kept = {r[0] for r in near([(r[0], r[1]) for r in rows], 5) if r[3]}
    rows = [r for r in rows if r[0] in kept]
    dirty = {r[0] for r in contamination([(r[0], r[1]) for r in rows], items) if r[5]}
    return sorted(r for r in rows if r[0] not in dirty)
