"""String comparators that Spark lacks, as one Arrow pass per batch of pairs.

ratio(a, b) = 200 LCS / (|a| + |b|), by bit-parallel LCS on Python integers; two empty strings are 100.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs(a: str, b: str) -> int:
    if len(a) < len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, c in enumerate(b):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(b)) - 1
    s = full
    for c in a:
        u = s & masks.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(b) - s.bit_count()


def ratio(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_x or not only_y):
        return 100.0
    p, q = f"{both} {only_x}".strip(), f"{both} {only_y}".strip()
    return max(ratio(p, q), *([ratio(both, p), ratio(both, q)] if both else [0.0]))


def partial(a: str, b: str) -> float:
    """Best ratio of the shorter string against windows of the longer one of its length."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    return max(ratio(a, b[i : i + len(a)]) for i in range(len(b) - len(a) + 1))


def jaro(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [c for c, u in zip(b, used, strict=True) if u]
    t = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - t) / m) / 3


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    s = jaro(a, b)
    if s <= 0.7:
        return s
    p = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        p += 1
    return s + p * weight * (1 - s)


def postfix(a: str, b: str) -> float:
    n = 0
    while n < min(len(a), len(b)) and a[-1 - n] == b[-1 - n]:
        n += 1
    return n / max(len(a), len(b), 1)


def skeleton(a: str) -> str:
    """First letter and consonants of each word."""
    return " ".join(w[0] + "".join(c for c in w[1:] if c not in "aeiouy") for w in a.split())


def soft_cover(a: str, b: str, at: float = 0.9) -> float:
    """Share of a's words that some word of b resembles (Jaro-Winkler >= at)."""
    x, y = a.split(), b.split()
    return sum(any(jaro_winkler(p, q) >= at for q in y) for p in x) / len(x) if x and y else 0.0


def acronym(a: str, b: str) -> int:
    """1 if one name's initials are a word of the other (three letters or more)."""
    i, j = "".join(w[0] for w in a.split()), "".join(w[0] for w in b.split())
    return int(len(i) >= 3 and i in b.split() or len(j) >= 3 and j in a.split())


KINDS = {"ratio": ratio, "tsort": token_sort, "tset": token_set, "partial": partial, "jw": lambda a, b: 100 * jaro_winkler(a, b), "postfix": postfix, "skeleton": lambda a, b: ratio(skeleton(a), skeleton(b)), "softcov": soft_cover, "acronym": lambda a, b: float(acronym(a, b)), "lcs": lambda a, b: float(lcs(a, b))}


def compare(a: Column, b: Column, kinds: tuple[str, ...] = ("ratio", "tsort", "tset", "partial", "jw")) -> Column:
    """A struct of comparators of two strings (null counts as empty), each distinct pair computed once a batch."""
    schema = ", ".join(f"{k} double" for k in kinds)

    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        known: dict[tuple[str, str], tuple[float, ...]] = {}
        rows = []
        for p in zip(x.fillna(""), y.fillna(""), strict=True):
            if p not in known:
                known[p] = tuple(round(KINDS[k](*p), 6) for k in kinds)
            rows.append(known[p])
        return pd.DataFrame(rows, columns=list(kinds))

    run.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, schema)(a, b)
