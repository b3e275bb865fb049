"""Plain Python versions of the contracts, by the most direct means; for small tables only."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import regex
import xxhash

from sparkwell.llm import quality_rules as rules

SPACES = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def words(text: str | None) -> list[str]:
    return regex.findall(r"[^\x20\x09-\x0D]+", text or "")


def remainder(doc_id, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


def line_dedup(docs: list[tuple]) -> list[tuple]:
    """docs: (doc_id, text); returns (doc_id, n_lines, n_dropped, kept text). Rows without id are one last document."""
    order = lambda d: float("inf") if d is None else d
    holders = defaultdict(set)
    key = lambda line: line.strip(SPACES).translate(LOWER)
    for d, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(order(d))
    out = []
    for d, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= 2 and min(holders[key(x)]) != order(d))]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def fingerprint(text: str | None, size: int = 3) -> int:
    w = words((text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps: list[int], bits: int = 3) -> list[int]:
    """For each fingerprint the index of the first of its component."""
    root = list(range(len(fps)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def repeated(sequences: list, width: int) -> list[list[bool]]:
    """For each sequence which of its places are covered by a window that starts twice or more."""
    seen = Counter()
    name = lambda w: hashlib.blake2b(w if isinstance(w, bytes) else "\0".join(w).encode(), digest_size=12).digest()
    grams = [[name(s[i : i + width]) for i in range(len(s) - width + 1)] for s in sequences]
    for g in grams:
        seen.update(g)
    out = []
    for s, g in zip(sequences, grams):
        gone, until = [False] * len(s), 0
        for i in range(len(s)):
            if i < len(g) and seen[g[i]] > 1:
                until = i + width
            gone[i] = i < until
        out.append(gone)
    return out


def runs(gone: list[bool]) -> int:
    return sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))


def fails(line: str) -> bool:
    """A line that the line rules remove."""
    n = len(words(line))
    chars = len(regex.findall(r"[^ \t\n\x0B\f\r]", line))
    letters = len(regex.findall(r"[\p{L}\p{N}]", line))
    shouts = len(regex.findall(rules.SHOUTS, line))
    bars = len(regex.findall(r"(?:^|[ \t\n\x0B\f\r])[|»›•·>/](?:[ \t\n\x0B\f\r]|$)", line))
    boiler = regex.search(rules.BOILERPLATE.replace("(?i)", ""), line, regex.IGNORECASE | regex.ASCII)
    return n > 0 and (2 * letters < chars or 4 * shouts > n or (bars >= 3 and 5 * bars >= n) or bool(boiler))


def quality(text: str | None) -> dict:
    w = words(text)
    lines = [x for x in (text or "").split("\n")]
    held = [x for x in lines if words(x)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {i + o for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for o in range(5)}
    chars = sum(map(len, w))
    good = [x for x in lines if not fails(x)]
    lost = 1 - sum(len(v) for x in good for v in words(x)) / max(chars, 1) if len(good) < len(lines) else 0
    base = len(w) < 10 or 100 * len(again) > 20 * len(w)
    return {
        "n_words": len(w),
        "word_chars": chars,
        "n_symbols": len(regex.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(held) - len(set(held)),
        "n_repeat_words": len(again),
        "base_failed": base,
        "kept": not base and lost <= rules.MAX_LOST,
        "cleaned": "\n".join(good),
    }


def alignment(item: list[str], text: list[str], match: float, mismatch: float, gap: float) -> float:
    """Smith-Waterman, cell by cell."""
    row, best = [0.0] * (len(text) + 1), 0.0
    for a in item:
        new = [0.0]
        for j, b in enumerate(text):
            new.append(max(0.0, row[j] + (match if a == b else mismatch), row[j + 1] + gap, new[j] + gap))
        row = new
        best = max(best, *row)
    return best
