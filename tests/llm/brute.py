"""Plain versions of the operators, a row at a time, for small fixtures."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import regex

# The base patterns of personal data and of secrets.
PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]
SECRETS = [
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", r"AKIA[A-Z0-9]+"),
    ("hex", r"[0-9a-f]+"),
]


def luhn(digits: str) -> bool:
    doubled = [2 * int(d) if k % 2 else int(d) for k, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def valid(kind: str, m: re.Match) -> bool:
    digits = re.sub("[^0-9]", "", m[0])
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
        "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 10 <= len(digits) <= 15,
        "assign": lambda: len(m[2]) >= 6,
        "access": lambda: len(m[0]) >= 20,
        "hex": lambda: len(m[0]) >= 24,
    }[kind]()


def spans(text: str | None, patterns: list[tuple[str, str]]) -> list[tuple[int, int, int]]:
    """(start, rank, end) by start, then kind."""
    return sorted((m.start(), rank, m.end()) for rank, (kind, p) in enumerate(patterns) for m in re.finditer(p, text or "") if valid(kind, m))


def named(found: list[tuple[int, int, int]], kinds: list[str]) -> str:
    return ",".join(f"{kinds[r]}:{s}:{e}" for s, r, e in found)


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def terms(docs: list[tuple[int, str | None]], window: int, alpha: float, least: int, remove: float) -> list[list[tuple[int, int, str]]]:
    """Disclosing terms (start, end, action) of each document."""
    space, letters = " \t\n\x0b\f\r", regex.compile(r"\p{L}{3,}")
    near, entities, together, with_term = [], defaultdict(set), defaultdict(set), Counter()
    for k, (_, text) in enumerate(docs):
        text = text or ""
        base = spans(text, PII)
        with_term.update(set(letters.findall(text.lower())))
        own = []
        for s, r, e in base:
            value = text[s:e].lower() if r < 2 else re.sub("[^0-9]", "", text[s:e])
            low, head, tail = max(s - window, 0), 0, text[e : e + window]
            if low:
                head = len(re.match(f"[^{space}]*", text[low:s])[0])
            if len(text) > e + window:
                tail = re.sub(f"[^{space}]*$", "", tail)
            places = [(m.start() + low + head, m.end() + low + head, m[0].lower()) for m in letters.finditer(text[low + head : s])] + [(m.start() + e, m.end() + e, m[0].lower()) for m in letters.finditer(tail)]
            entities[r, value].add(k)
            for a, b, term in places:
                together[r, value, term].add(k)
                own.append((a, b, (r, value), term, any(x < b and y > a for x, _, y in base)))
        near.append(own)
    n = len(docs)
    told = {}
    for (r, value, term), both in together.items():
        if with_term[term] and len(both) >= least and len(entities[r, value]) < n and math.log2(len(both) * n / (with_term[term] * len(entities[r, value]))) >= alpha * math.log2(n / len(entities[r, value])) - 1e-9:
            told[(r, value), term] = "remove" if len(both) / with_term[term] >= remove else "generalise"
    out = []
    for own in near:
        found: dict[tuple[int, int], str] = {}
        for a, b, entity, term, inside in own:
            if not inside and (entity, term) in told:
                found[a, b] = max(found.get((a, b), ""), told[entity, term])
        out.append(sorted((a, b, x) for (a, b), x in found.items()))
    return out


def sanitised(text: str | None, hidden: list[tuple[int, int, str]]) -> str | None:
    base = spans(text, PII)
    if text is None or not base and not hidden:
        return text
    marks = sorted([(s, e, f"[{PII[r][0].upper()}]") for s, r, e in base] + [(a, b, "" if x == "remove" else "[TERM]") for a, b, x in hidden])
    out, at = "", 0
    for s, e, mark in marks:
        if e > at:
            out += text[at : max(s, at)] + (mark if s >= at else "")
            at = e
    return out + text[at:]


def shingle_set(text: str | None, width: int = 5) -> set[tuple[str, ...]]:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} - {()}


def grouped(nodes: list[int], links: set[tuple[int, int]]) -> dict[int, int]:
    """Smallest node reachable from each."""
    parent = {n: n for n in nodes}

    def top(n: int) -> int:
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {n: top(n) for n in nodes}


def near_copies(docs: list[tuple[int, str | None]], percent: int = 85) -> dict[int, tuple[int, int]]:
    """id: (set size, component)."""
    sets = [(i, shingle_set(t)) for i, t in docs]
    links = {(i, j) for k, (i, x) in enumerate(sets) for j, y in sets[:k] if x and y and 100 * len(x & y) >= percent * len(x | y)}
    own = grouped([i for i, _ in docs], links)
    return {i: (len(x), own[i]) for i, x in sets}


def near_vectors(rows: list[tuple[int, list | None, int | None]], least: float = 0.98) -> dict[int, tuple[int, int]]:
    """id: (links, component)."""
    able = [(i, np.array(v, dtype=float), c) for i, v, c in rows if v and c is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {(i, j) for k, (i, v, c) in enumerate(able) for j, w, d in able[:k] if c == d and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= least}
    count = Counter(x for pair in links for x in pair)
    own = grouped([i for i, _, _ in rows], links)
    return {i: (count[i], own[i]) for i, _, _ in rows}
