"""Direct Python versions of the queries on conversations and of SimHash."""

import re
import zlib
from collections import defaultdict
from functools import lru_cache

import xxhash

from tests.llm.brute import ASCII_LOWER, WORD, sha

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
ROLE = {"u": "user", "a": "assistant"}


def damaged(rows):
    """rows: (conv, turn, role, text) -> {conv: rows after damage in order}."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        say = lambda v: " " if v is None else str(v)
        role, text = say(role), say(text)
        fault = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        kept = out[conv]
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        if fault:
            kept += [(turn, role, text)] * (2 if fault == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def cheapest(rows):
    """rows: (role, text, fault) -> (cost, audit, repaired lines); every way is tried, least cost and least audit first."""
    @lru_cache(None)
    def best(i, last, added):
        ways = []
        if i == len(rows) and last in ("", "a"):
            ways.append((0, "", ()))
        if added < 3:
            c, e, t = best(i, NEXT[last], added + 1)
            ways.append((c + 3, "I" + e, (ROLE[NEXT[last]] + ":",) + t))
        if i < len(rows):
            role, text, fault = rows[i]
            c, e, t = best(i + 1, last, 0)
            ways.append((c + 4, "D" + e, t))
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                if role[:1] == NEXT[last] or (role[:1] == "s" and last == ""):
                    c, e, t = best(i + 1, role[:1], 0)
                    ways.append((c + extra, "K" + e, (f"{role}:{text}",) + t))
                c, e, t = best(i + 1, NEXT[last], 0)
                ways.append((c + extra + 3, "R" + e, (f"{ROLE[NEXT[last]]}:{text}",) + t))
        return min(ways, key=lambda w: w[:2]) if ways else (1 << 50, "", ())

    for i in range(len(rows), -1, -1):  # keeps the recursion shallow
        for last in NEXT:
            for added in (3, 2, 1, 0):
                best(i, last, added)
    return best(0, "", 0)


def structure(rows):
    out = []
    for conv, kept in damaged(rows).items():
        seen, marked = set(), []
        for _, role, text in kept:
            solid = text.rstrip(" \t\n\x0b\x0c\r")
            fault = ("blank" if not WORD.search(text) else "duplicate" if (role, text) in seen
                     else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        firsts = [r[:1] for r, _, _ in marked]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:]))
        cost, audit, lines = cheapest(tuple(marked))
        count = lambda f: sum(m[2] == f for m in marked)
        out.append((conv, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, sha("\n".join(lines))))
    return out


def rebuilt(rows):
    """rows: (conv, turn, role, text) -> {conv: ((role, text), ...)} with first turns from the family's first."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    key = lambda r: (r[0], r[1], bytes.fromhex(md5(f"{len(r[2])}:{r[2]}{r[3]}")))
    own = {c: [r[2:] for r in sorted(v, key=key)] for c, v in own.items()}
    out = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = tuple(own.get(c - c % 100, [])[:h] + mine[h:])
    return out


def md5(s):
    import hashlib
    return hashlib.md5(s.encode()).hexdigest()


def trie(rows):
    paths = rebuilt(rows)
    nodes = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes[p[:d]].append(c)
    children, below = defaultdict(int), defaultdict(lambda: [0, 0])
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    for p, who in nodes.items():
        for d in range(len(p) + 1):
            below[p[:d]][0] += not children[p]
            below[p[:d]][1] += (len(who) - 1) * (len(p[-1][1]) if p else 0)
    return [(min(who), len(p), min(nodes[p[:-1]]) if p else None, len(who), children[p], *below[p],
             sha(",".join(map(str, sorted(c for c in who if paths[c] == p))))) for p, who in nodes.items()]


def simhash(rows, k=3, radius=2):
    """rows: (doc_id, text) -> (doc_id, fingerprint, smallest doc_id reachable)."""
    prints = []
    for d, t in rows:
        w = WORD.findall((t or "").translate(ASCII_LOWER))
        grams = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
        hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints.append((d, sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))))
    values = sorted({f for _, f in prints})
    group = {v: v for v in values}

    def root(v):
        while group[v] != v:
            v = group[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= radius:
                group[root(a)] = root(b)
    least = {}
    for d, f in prints:
        if d is not None:
            least[root(f)] = min(least.get(root(f), d), d)
    return [(d, f"{f:016x}", least.get(root(f))) for d, f in prints]
