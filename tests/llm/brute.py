"""Direct Python versions of the contract queries, one document at a time."""

import hashlib
import re
from collections import Counter, defaultdict

from cohortkit.llm.secrets import RULES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}

ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
PEM = re.compile(next(r.pattern for r in RULES if r.kind == "pem").replace("|$)", r"|\Z)"))  # the rule itself, in another engine


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def secrets(text):
    text = text or ""
    found = []
    for rank, (kind, pat, group, least) in enumerate((("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 16),
                                                      ("hex", HEX, 0, 32), ("pem", PEM, 0, 1))):
        found += [(m.start(), rank, kind, m.end()) for m in pat.finditer(text) if len(m.group(group)) >= least]
    found.sort()
    say = lambda fs: ",".join(f"{k}:{a}:{b}" for a, _, k, b in fs)
    n = Counter(f[2] for f in found)
    return (n["assign"], n["access"], n["hex"], sha(say([f for f in found if f[1] < 3])), say(found))


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    grams = defaultdict(list)
    for i in range(len(w) - 4):
        grams[tuple(w[i:i + 5])].append(i)
    inside = {i + j for at in grams.values() if len(at) > 1 for i in at for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            len(inside), len(w) < 10 or 100 * len(inside) > 20 * len(w))


def repeats(rows, k=13):
    """rows: (doc_id, text) -> list of (doc_id, n_words, n_removed, sha of kept words)."""
    first = {}
    split = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - k + 1):
            g = tuple(w[i:i + k])
            if d is not None and (g not in first or d < first[g]):
                first[g] = d
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - k + 1):
            if d is not None and first[tuple(w[i:i + k])] < d:
                gone.update(range(i, i + k))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def contamination(rows, items, k=10):
    tok = lambda t: ALNUM.findall((t or "").translate(ASCII_LOWER))
    index = defaultdict(set)
    for name, text in items:
        w = tok(text)
        n = min(k, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            index[tuple(w[i:i + n])].add(name or "")
    sizes = {len(g) for g in index}
    out = []
    for d, t in rows:
        w = tok(t)
        hit, names = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if got := index.get(tuple(w[i:i + n])):
                    names |= got
                    hit.update(range(i, i + n))
        out.append((d, len(w), len(hit), len(names), sha(",".join(sorted(names))), bool(hit)))
    return out


def shingles(text, k=3):
    w = WORD.findall((text or "").translate(ASCII_LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def components(rows, num=90, k=3):
    """rows: (doc_id, text) -> list of (doc_id, n_shingles, smallest reachable doc_id)."""
    sets = [(d, shingles(t, k)) for d, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= num * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(s), least.get(root(i))) for i, (d, s) in enumerate(sets)]


def mix(rows, weights=(3, 1, 2)):
    """rows: (doc_id, source, text) -> {doc_id: (size, source_size, target, taken)} by repeated resharing."""
    size = {d: len(WORD.findall(t or "")) for d, _, t in rows}
    per = defaultdict(int)
    for d, s, _ in rows:
        per[s] += size[d]
    order = sorted(per, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    full, open_, left = {}, set(order), 1.5 * sum(per.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > 2 * per[s]}
        if not over:
            full |= {s: level * w[s] for s in open_}
            break
        full |= {s: 2.0 * per[s] for s in over}
        left -= sum(2 * per[s] for s in over)
        open_ -= over
    out = {}
    for d, s, t in rows:
        rate = full[s] / per[s] if per[s] else 0
        name = f"mix-1:{d}" if d is not None else "mix-1:text:" + hashlib.md5((t or "").encode()).hexdigest()
        toss = int(hashlib.md5(name.encode()).hexdigest()[:13], 16) / 2 ** 52
        out[d] = (size[d], per[s], full[s], size[d] * (int(rate) + (toss < rate - int(rate))))
    return out
