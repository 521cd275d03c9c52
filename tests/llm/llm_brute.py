"""Plain Python versions of the operators, straight from their definitions."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def edits(docs: list[tuple[int, str]]) -> dict[int, str]:
    ordered = sorted(docs, reverse=True)
    texts = [t or "" for _, t in ordered]
    out = {}
    for i, (doc, _) in enumerate(ordered):
        own, following = texts[i], texts[(i + 1) % len(texts)]
        n = len(own) // 3
        out[doc] = own[:len(own) - n] + following[:n]
    return out


def repeats(texts: list[bytes], least: int) -> list[tuple[int, int, int, str]]:
    seen = Counter(t[i:i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - least + 1):
            if seen[t[i:i + least]] > 1:
                gone[i:i + least] = b"\1" * least
        runs = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        out.append((len(t), sum(gone), runs, sha(bytes(x for x, y in zip(t, gone, strict=True) if not y))))
    return out


def shingles(text: str | None) -> frozenset:
    w = BLANK_WORD.findall((text or "").translate(LOWER))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def groups(docs: list[tuple[int, str]]) -> dict[int, tuple[int, int]]:
    """doc_id: (set size, smallest linked id)."""
    sets = {d: shingles(t) for d, t in docs}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    common: Counter = Counter()
    for ids in holders.values():
        for i, a in enumerate(ids):
            for b in ids[i + 1:]:
                common[a, b] += 1
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


def spellings(docs: list[tuple[int | None, str | None]]) -> dict[str, tuple]:
    """Word -> (form, root, n, n_near, form_n), straight from the contract."""
    seen: Counter[str] = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                spot = h % len(run)
                run = run[:spot] + run[spot + 1:]
            seen[run] += 1
    words = {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}
    by_gap: dict[tuple, set[str]] = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            by_gap[w[:i], w[i + 1:]].add(w)  # one letter replaced
    near: dict[str, set[str]] = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            near[w] |= by_gap[w[:i], w[i + 1:]] - {w}
            if (shorter := w[:i] + w[i + 1:]) in words:
                near[w].add(shorter)
                near[shorter].add(w)
    form = {}
    for w, n in words.items():
        if near[w]:
            best = min(near[w], key=lambda v: (-words[v], v))
            if words[best] >= 2 * n:
                form[w] = best
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None)
    return out


def whole_steps(vectors: list) -> tuple[list[int], np.ndarray]:
    """Positions of the usable vectors, and their whole numbers of the contract."""
    kept = [i for i, v in enumerate(vectors) if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    return kept, np.array([[math.floor(64 * float(c)) + 1_000_000 for c in vectors[i]] for i in kept], dtype=np.int64)


def token_stream(docs: list[tuple[int, str | None]], tokenizer) -> dict[int, tuple[int, int, int]]:
    """Key -> (start, number of ids, CRC-32 of the ids)."""
    out, at = {}, 0
    for doc, text in sorted(docs):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out[doc] = (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
    return out
