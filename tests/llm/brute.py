"""Plain Python versions of the operators' contracts, for small inputs."""

import hashlib
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def base_counts(text):
    found, text = words(text), text or ""
    triples = Counter(zip(found, found[1:], found[2:]))
    inside = {j for i in range(len(found) - 2) if triples[tuple(found[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside))


def simhash(text):
    found = words(lower(text))
    if not found:
        return 0
    shingles = [" ".join(found[i:i + 4]) for i in range(max(1, len(found) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, budget=4):
    """Place of the first linked print for each print."""
    docs = prints
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(docs)):
        for j in range(i):
            if ((prints[i] ^ prints[j]) & (1 << 64) - 1).bit_count() <= budget:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(docs))]


def components(docs):
    """(doc_id, fingerprint, component) per row of (doc_id, text)."""
    prints = [simhash(t) for _, t in docs]
    roots, ids = groups(prints), {}
    for (doc, _), root in zip(docs, roots):
        if doc is not None:
            ids[root] = min(ids.get(root, doc), doc)
    return [(doc, f"{p:016x}", ids.get(root)) for (doc, _), p, root in zip(docs, prints, roots)]


def contamination(docs, items):
    owners, lengths = {}, set()
    for item, text in items:
        found = LETTERS.findall(lower(text))
        for i in range(max(1, len(found) - 12) if found else 0):
            window = tuple(found[i:i + 13])
            owners.setdefault(window, set()).add("" if item is None else str(item))
            lengths.add(len(window))
    out = []
    for doc, text in docs:
        found = LETTERS.findall(lower(text))
        hit, named = set(), set()
        for n in lengths:
            for i in range(len(found) - n + 1):
                window = tuple(found[i:i + n])
                if window in owners:
                    hit |= set(range(i, i + n))
                    named |= owners[window]
        out.append((doc, len(found), len(hit), len(named), sha(",".join(sorted(named)).encode()),
                    bool(hit) and 20 * len(hit) >= len(found)))
    return out


def without_repeated_words(docs, width=13):
    texts = [words(t) for _, t in docs]
    least = {}
    for (doc, _), found in zip(docs, texts):
        for i in range(len(found) - width + 1):
            w = tuple(found[i:i + width])
            least[w] = min(least.get(w, float("inf")), float("inf") if doc is None else doc)
    out = []
    for (doc, _), found in zip(docs, texts):
        own = float("inf") if doc is None else doc
        gone = {j for i in range(len(found) - width + 1) if least[tuple(found[i:i + width])] < own for j in range(i, i + width)}
        out.append((doc, len(found), len(gone), sha(" ".join(w for i, w in enumerate(found) if i not in gone).encode())))
    return out


def without_repeated_bytes(docs, width=200):
    texts = [(t or "").encode() for _, t in docs]
    uses = Counter(t[i:i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for (doc, _), t in zip(docs, texts):
        gone = {j for i in range(len(t) - width + 1) if uses[t[i:i + width]] > 1 for j in range(i, i + width)}
        runs = sum(1 for j in gone if j - 1 not in gone)
        out.append((doc, len(t), len(gone), runs, sha(bytes(b for i, b in enumerate(t) if i not in gone))))
    return out


def mixture_targets(sizes, weights=(1, 2, 3), factor=3):
    """Target per source; ``sizes`` by source, None last."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(factor * sizes[s] for s in full)
        shares = sum(weight[s] for s in order if s not in full)
        above = {s for s in order if s not in full and weight[s] * rest > factor * sizes[s] * shares}
        if not above:
            return {s: float(factor * sizes[s]) if s in full else rest * weight[s] / shares for s in order}
        full |= above


def phrase_counts(docs, longest=4):
    """Occurrences of all phrases per language, of (text, lang)."""
    found = {}
    for text, lang in docs:
        seen = found.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                seen.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    return found


def collocations(docs, least=30, top=2000, longest=4):
    out = []
    for lang, f in phrase_counts(docs, longest).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        often = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        kept = []
        for p, a in often.items():
            inside = any(len(q) > len(p) and 100 * c >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q)))
                         for q, c in often.items())
            if inside:
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), " ".join(p), a, f[p[:k]], f[p[k:]], score))
        for rank, (_, _, _, phrase, a, left, right, score) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase, a, left, right, n, score))
    return out


def spelling(docs, least_length=7):
    """(word, form, root, n, n_near, form_n) per word of (doc_id, text)."""
    import zlib
    seen = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            seen[run] += 1
    words = {w: n for w, n in seen.items() if len(w) >= least_length and n >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))
    out, forms = {}, {}
    for w, n in words.items():
        around = [x for x in words if x != w and abs(len(x) - len(w)) < 2 and near(x, w)]
        best = min(around, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= 10 * n else None
        out[w] = (n, len(around))
    rows = []
    for w, (n, count) in out.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        rows.append((w, forms[w], root, n, count, None if forms[w] is None else words[forms[w]]))
    return rows


def one_of_near_copies(docs, width=5, similarity=0.8):
    """Ids that stay: the smallest of each group connected by pairs of that Jaccard similarity of word shingles."""
    sets = []
    for doc_id, text in sorted(docs):
        w = (text or "").encode().lower().split()
        sets.append((doc_id, frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1)))))
    root = {i: i for i, _ in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    holders = {}
    for i, s in sets:
        met = {j for x in s for j in holders.get(x, ())}
        for j, other in sets:
            if j in met and len(s & other) >= similarity * len(s | other):
                a, b = sorted((top(i), top(j)))
                root[b] = a
        for x in s:
            holders.setdefault(x, []).append(i)
    return sorted(i for i, _ in sets if root[i] == i)
