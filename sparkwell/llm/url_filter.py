"""URL filtering by a bit-parallel wildcard automaton.

All glob rules are packed side by side into words of 64 bits. One Shift-And step per character moves
every rule at once, over a whole batch of URLs: ``D = ((D << 1) | start) & match[char] | (D & star)``.
Shifts carry from word to word, so rules may be of any number and length.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and gets the
method's verdict for an empty url (allow). Very long urls are read whole, in blocks
of urls of like length. Repeated pages are judged one by one; an empty table gives an
empty result; columns besides ``page_id`` and ``url`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwell.llm.common import small_batches

#: Ends the host in the canonical form; lies outside the byte alphabet, so no url can contain it.
HOST_END = 256
STAR = -1
#: Cells of two bytes in the table of urls that are stepped through together.
GRID = 4 << 20


@dataclass(frozen=True)
class Rule:
    """``action`` for urls of ``host`` and its subdomains whose path starts with ``path``."""

    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Hosts that the method itself blocks when no rule fits.
DEFAULT_GLOBS = ("*casino*", "*free-bets*", "*adult-*", "*porn*", "*-pills*", "*payday-loan*", "*spam-*", "*ads-track*")


def symbols_of_rule(rule: Rule) -> list[int]:
    """A rule as a glob over canonical urls: ``*.host<end>path*``."""
    return [STAR, *(f".{rule.host}").encode(), HOST_END, *rule.path.encode(), STAR]


def symbols_of_glob(glob: str) -> list[int]:
    """A glob over hosts, whose only wildcard is ``*``."""
    return [*(STAR if c == "*" else b for c in glob for b in ([0] if c == "*" else c.encode())), HOST_END, STAR]


class Automaton:
    """Shift-And masks of many globs. ``match`` tells, for each url, which globs it fits."""

    def __init__(self, globs: Iterable[list[int]]):
        bits: list[tuple[int, list[int]]] = []
        at = 0
        self.finals: list[int] = []
        start, stars = [], []
        for glob in globs:
            # Bit `at` is the state "nothing read"; each literal adds a state, a star loops on the state before it.
            start.append(at)
            state = at
            for s in glob:
                if s == STAR:
                    stars.append(state)
                else:
                    state += 1
                    bits.append((state, [s]))
            self.finals.append(state)
            at = state + 1
        self.words = max(1, -(-at // 64))
        self.start = self._mask(start)
        self.star = self._mask(stars)
        self.by_symbol = np.zeros((257, self.words), np.uint64)
        for state, syms in bits:
            for s in syms:
                self.by_symbol[s, state // 64] |= np.uint64(1) << np.uint64(state % 64)

    def _mask(self, states: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for s in states:
            out[s // 64] |= np.uint64(1) << np.uint64(s % 64)
        return out

    def match(self, urls: list[np.ndarray]) -> np.ndarray:
        """bool[url, glob]. Urls are taken in order of length, so that no step runs on urls that have ended."""
        order = np.argsort([-len(u) for u in urls], kind="stable")
        found = np.empty((len(urls), len(self.finals)), bool)
        at = 0
        while at < len(order):  # a block of urls takes at most GRID cells, or is one url
            rows = max(1, GRID // max(1, len(urls[order[at]])))
            found[order[at : at + rows]] = self._block([urls[i] for i in order[at : at + rows]])
            at += rows
        return found

    def _block(self, urls: list[np.ndarray]) -> np.ndarray:
        """``match`` of urls that get no longer."""
        lengths = np.array([len(u) for u in urls], np.int64)
        grid = np.zeros((len(urls), int(lengths[0]) if len(urls) else 0), np.int16)
        for r, u in enumerate(urls):
            grid[r, : lengths[r]] = u
        state = np.tile(self.start, (len(urls), 1))
        for j in range(grid.shape[1]):
            live = int(np.searchsorted(-lengths, -j, side="left"))  # urls longer than j come first
            d = state[:live]
            moved = d << np.uint64(1)
            if self.words > 1:
                moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.by_symbol[grid[:live, j]]) | (d & self.star)
        found = np.empty((len(urls), len(self.finals)), bool)
        for g, f in enumerate(self.finals):
            found[:, g] = (state[:, f // 64] >> np.uint64(f % 64)) & np.uint64(1) == 1
        return found


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``: the host up to / ? # or the end, A-Z lower-cased; the path up to ? # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    raw = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(raw, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def filter_urls(pages: DataFrame, rules: list[Rule], globs: Iterable[str] = DEFAULT_GLOBS, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every url: (id, url, host, path, rule, verdict).

    The longest fitting rule decides (of two equally long ones the one with the longer host, then the
    earlier). Where none fits, a url whose host fits one of ``globs`` is blocked and any other gets ``default``.
    """
    small_batches(pages.sparkSession, rows=10_000)
    ranked = sorted(rules, key=lambda r: (-len(r.text), -len(r.host)))
    machine = Automaton([*map(symbols_of_rule, ranked), *map(symbols_of_glob, globs)])
    n = len(ranked)
    host, path = host_and_path(F.col("url"))
    src = pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias("url")).withColumns({"host": host, "path": path})
    schema = src.select(id_col, "url", "host", "path").schema.simpleString()[7:-1] + ",rule:string,verdict:string"

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            urls = [np.concatenate([np.frombuffer(b"." + h.encode(), np.uint8).astype(np.int16), [HOST_END], np.frombuffer(p.encode(), np.uint8)]).astype(np.int16) for h, p in zip(pdf["host"], pdf["path"])]
            hit = machine.match(urls)
            ruled = hit[:, :n].any(1) if n else np.zeros(len(urls), bool)
            first = hit[:, :n].argmax(1) if n else np.zeros(len(urls), int)
            blocked = hit[:, n:].any(1)
            pdf["rule"] = [ranked[i].text if r else None for i, r in zip(first, ruled)]
            pdf["verdict"] = [ranked[i].action if r else "block" if b else default for i, r, b in zip(first, ruled, blocked)]
            yield pdf

    return src.mapInPandas(judge, schema)
