"""Plain versions of the operators, for small tables, and a table of awkward documents."""

import hashlib
import re
from collections import defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string, text_a string, bucket string, `key` string"
PROSE = "the quick brown fox jumps over a lazy dog while seven wizards quietly brew amber potions near old stone bridges every winter night".split()


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(PROSE[(x >> 8) % len(PROSE)] + str((x >> 16) % 50))
    return " ".join(out)


def awkward() -> list[tuple]:
    """Null and empty texts, null ids, repeated rows, copies, near copies, a very long text, shared passages."""
    shared = prose(1, 70)
    rows = [(1, shared), (2, "Intro words here. " + shared + " and a tail"), (3, None), (4, ""), (5, " \n\t "), (6, prose(6, 120)), (7, prose(6, 120)), (8, prose(6, 120).replace("fox", "cat", 1)),
            (None, prose(9, 60)), (None, None), (10, prose(10, 40)), (10, prose(10, 40)), (11, "one two"), (12, "One TWO"), (13, "x " * 300), (14, prose(14, 30000)), (15, prose(14, 30000)[:-5]),
            (16, "naïve façade — 日本語 текст " * 12), (17, shared.upper()), (18, "12345 !!! 67890"), (19, prose(19, 25) + "\n" + prose(19, 25) + "\n" + prose(19, 25)), (20, prose(6, 120) + " " + prose(20, 30))]
    return [(i, t, "en" if (i or 0) % 3 else None, f"s{(i or 0) % 3}" if (i or 0) % 7 else None, None if t is None else len(t), "x", "y", "z", "b", "k") for i, t in rows]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def removed(docs: list[tuple], window: int = 20) -> list[tuple]:
    """(doc_id, n_words, n_removed, sha256) of each row: windows that also start earlier."""
    least = defaultdict(list)
    rank = lambda i: -1 if i is None else i
    for i, t in docs:
        w = words(t)
        for s in range(len(w) - window + 1):
            least[tuple(w[s: s + window])].append((rank(i), s))
    first = {k: min(v) for k, v in least.items()}
    out = []
    for i, t in docs:
        w, gone = words(t), set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s: s + window])] < (rank(i), s):
                gone.update(range(s, s + window))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return out


def shingles(text, k: int = 5):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i: i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def groups(docs: list[tuple]) -> list[tuple]:
    """(doc_id, n_shingles, component_id) of each row by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in docs]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, t) = sets[a], sets[b]
            if s and t and i is not None and j is not None and 100 * len(s & t) >= 75 * len(s | t):
                up[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return [(i, len(s), None if i is None else least[find(a)]) for a, (i, s) in enumerate(sets)]


def counts(text, k: int = 8) -> tuple:
    w, at = words(text), defaultdict(list)
    for i in range(len(w) - k + 1):
        at[tuple(w[i: i + k])].append(i)
    cover = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + k)}
    lines, seen = 0, set()
    for line in (text or "").split("\n"):
        if words(line):
            lines += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), lines, len(cover)


def best_fit(sizes, sources, clusters, capacity):
    """Tightest compatible bin of all, the one that reached its residual first if equal."""
    bins, out, clock = [], [], 0
    for n, s, c in zip(sizes, sources, clusters):
        fits = [b for b in bins if b["left"] >= n and (s < 0 or s not in b["s"]) and (c < 0 or c not in b["c"])]
        b = min(fits, key=lambda x: (x["left"], x["since"]), default=None)
        if b is None:
            b = {"left": capacity, "s": set(), "c": set(), "no": len(bins)}
            bins.append(b)
        out.append((b["no"], capacity - b["left"]))
        clock += 1
        b["left"] -= n
        b["s"].add(s)
        b["c"].add(c)
        b["since"] = clock
    return out
