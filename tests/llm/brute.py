"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import xxhash


def components(ids, linked):
    """Smallest reachable id of each id."""
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


def simhash(text, words):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    grams = [" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_components(docs, words=4, budget=4):
    fp = {i: simhash(t, words) for i, t in docs}
    ids = sorted(fp)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (fp[a] ^ fp[b]).bit_count() <= budget]
    return fp, components(ids, links)


def shingle_set(text, words=5):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {b" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()


def similar(a, b):
    return bool(a and b) and 5 * len(a & b) >= 4 * len(a | b)


def one_of_each(docs):
    """Ids that stay if each component of pairs of a similarity of 0.8 or more keeps its least id; wordless texts stay."""
    sets = {i: shingle_set(t) for i, t in docs}
    at = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            at[g].append(i)
    pairs = {(a, b) for i in at.values() for k, b in enumerate(i) for a in i[:k]}
    comp = components(list(sets), [(a, b) for a, b in pairs if similar(sets[a], sets[b])])
    return sorted(i for i in sets if comp[i] == i or not sets[i])


def decontaminated(docs, items, size=10):
    def words(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    grams = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            grams[tuple(w[k : k + size])].add(str(i))
    out = {}
    for i, t in docs:
        w, hit, seen = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if got := grams.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    seen |= got
        out[i] = (len(w), len(hit), len(seen), hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest(), bool(hit))
    return out


def substrings(docs, length):
    """docs: list of texts -> (n_bytes, n_removed, n_spans, sha) in order."""
    data = [(t or "").encode() for t in docs]
    seen = defaultdict(int)
    for x in data:
        for k in range(len(x) - length + 1):
            seen[x[k : k + length]] += 1
    out = []
    for x in data:
        gone = np.zeros(len(x) + 2, dtype=np.int64)
        for k in range(len(x) - length + 1):
            if seen[x[k : k + length]] > 1:
                gone[k + 1] += 1
                gone[k + length + 1] -= 1
        hit = np.cumsum(gone)[1 : len(x) + 1] > 0
        spans = int((np.diff(np.concatenate(([0], hit.astype(int), [0]))) == 1).sum())
        kept = bytes(np.frombuffer(x, dtype=np.uint8)[~hit]) if len(x) else b""
        out.append((len(x), int(hit.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def pii(text):
    text = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def secrets(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, s, e) for s, _, e, k in sorted(out)]


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def embedding_links(rows, cosine):
    """rows: (id, vector or None, label) -> {id: (links, component)}."""
    good = {}
    for i, v, lab in rows:
        x = None if v is None or lab is None or any(c is None for c in v) else np.array(v, dtype=np.float64)
        if x is not None and len(x) and np.isfinite(x).all() and (x != 0).any():
            good[i] = (x, lab)
    links = []
    ids = sorted(good)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = good[a], good[b]
            if x[1] == y[1] and len(x[0]) == len(y[0]) and x[0] @ y[0] / np.sqrt((x[0] @ x[0]) * (y[0] @ y[0])) >= cosine:
                links.append((a, b))
    n = defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    comp = components([r[0] for r in rows], links)
    return {r[0]: (n[r[0]], comp[r[0]]) for r in rows}
