"""URL filter by a bit-parallel wildcard automaton (operator 1).

A rule is a glob over the canonical URL, which is "." + host + path: ``*`` stands for any characters but
"/", ``**`` for any characters, ``?`` for one character but "/". All globs are packed side by side into the
bits of a few 64-bit words, one bit per state. Per character, Shift-And moves every state of every rule at
once: ``D = ((D << 1) & step[c]) | (D & stay[c])``, with the bit that leaves a word carried into the next.
The words of all URLs of a batch are columns of one array.

Most rules end their host in plain labels. Rules are packed together by the last two of these, or by the last one, and
all others in one more automaton, so a URL moves through the rules of its own host's end only, however long the list.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
AT_ONCE = 4096  # URLs that move together
STATE_WORDS = 1 << 18  # of all these URLs
CACHE_WORDS = 1 << 13  # of the automata that a task keeps
PARTS = re.compile(r"([^/?#]*)([^?#]*)", re.DOTALL)


@dataclass(frozen=True)
class Rule:
    glob: str
    verdict: str
    name: str

    @classmethod
    def site(cls, verdict: str, name: str) -> Rule:
        """A host with its subdomains and the paths that begin as ``name`` does after the host: ``example.com/en/``."""
        if re.search(r"[*?]", name) or "/" not in name:
            raise ValueError(f"not a host and a path: {name!r}")
        return cls(f"*.{name}**", verdict, name)


def host_and_path(url: str | None) -> tuple[str, str]:
    """The host with A-Z lower-cased, the path as it is; both empty without ``://``."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    host, path = PARTS.match(url, at + 3).groups()
    return host.encode().lower().decode(), path


class Automaton:
    """Some rules; where several fit, the one with the longest name wins, of equals the first."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        # per state: the byte that leads here (-2: none, -1: the first of any character but "/"), the wildcard that stays
        led: list[int] = []
        stays: list[str] = []
        finals, starts = [], []
        for rule in rules:
            starts.append(len(led))
            led.append(-2)
            stays.append("")
            for token in re.findall(r"\*\*|\*|\?|[^*?]", rule.glob, re.DOTALL):
                if token[0] == "*":
                    stays[-1] = max(stays[-1], token)
                else:
                    steps = [-1] if token == "?" else list(token.encode())
                    led += steps
                    stays += [""] * len(steps)
            finals.append(len(led) - 1)
        self.words = max(1, -(-len(led) // 64))
        self.first = self.packed(np.array(starts, np.int64))
        self.final_bits = np.array(finals, np.int64)
        self.by_name = sorted(range(len(rules)), key=lambda k: -len(rules[k].name))
        byte, wildcard = np.array(led, np.int64), np.array(stays, object)
        any_but, anything = np.flatnonzero(wildcard == "*"), np.flatnonzero(wildcard == "**")
        one = np.flatnonzero(byte == -1)
        # states that stay whatever comes: once only they are on, the rest of a URL changes nothing
        self.steady = self.packed(np.array([f for f in finals if stays[f] == "**"], np.int64))
        # "?" takes the first byte of a character and then stays on the others
        later = np.zeros(256, bool)
        later[0x80:0xC0] = True
        slash = np.arange(256) == 0x2F
        self.step = np.where((~slash & ~later)[:, None], self.packed(one), np.uint64(0))
        plain = np.flatnonzero(byte >= 0)
        np.bitwise_or.at(self.step, (byte[plain], plain // 64), np.uint64(1) << (plain % 64).astype(np.uint64))
        self.stay = self.packed(anything) | np.where(slash[:, None], np.uint64(0), self.packed(any_but)) | np.where(later[:, None], self.packed(one), np.uint64(0))

    def packed(self, bits: np.ndarray) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        np.bitwise_or.at(out, bits // 64, np.uint64(1) << (bits % 64).astype(np.uint64))
        return out

    def states(self, urls: list[bytes]) -> np.ndarray:
        """The states that each URL ends in, ``(urls, words)``."""
        sizes = np.array([len(u) for u in urls], np.int64)
        data = np.frombuffer(b"".join(urls), np.uint8)
        begins = np.cumsum(sizes) - sizes
        state = np.repeat(self.first[None, :], len(urls), axis=0)
        active, at = np.flatnonzero(sizes > 0), 0
        while active.size:
            now, c = state[active], data[begins[active] + at]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[active] = now = (moved & self.step[c]) | (now & self.stay[c])
            at += 1
            active = active[(sizes[active] > at) & (now & ~self.steady).any(axis=1)]
        return state

    def match(self, urls: list[bytes]) -> np.ndarray:
        """For each canonical URL the number of its rule, or -1."""
        out = np.full(len(urls), -1, np.int64)
        at_once = max(1, min(AT_ONCE, STATE_WORDS // self.words))
        for a in range(0, len(urls), at_once):
            state = self.states(urls[a : a + at_once])
            best = out[a : a + at_once]
            for k in self.by_name:
                bit = int(self.final_bits[k])
                on = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) == 1
                best[on & (best < 0)] = k
        return out


class Rules:
    """All rules, by the end of the host that they fit; an automaton is packed when a URL first needs it."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.groups: dict[str, list[int]] = {}
        for k, rule in enumerate(rules):
            if rule.verdict not in (ALLOW, BLOCK):
                raise ValueError(f"verdict of {rule.name!r}: {rule.verdict!r}")
            self.groups.setdefault(self.host_end(rule.glob), []).append(k)
        order = sorted(range(len(rules)), key=lambda k: -len(rules[k].name))
        self.rank = np.empty(len(rules) + 1, np.int64)
        self.rank[order] = np.arange(len(rules))
        self.rank[-1] = len(rules)
        self.by_rank = np.append(np.array(order, np.int64), -1)
        self.cache: dict[str, Automaton] = {}

    def __getstate__(self):
        return {**self.__dict__, "cache": {}}

    @staticmethod
    def host_end(glob: str) -> str:
        """The plain labels, two at most, that a host must end in; "*" if there are none."""
        host, slash, _ = glob.partition("/")
        if not slash or "**" in host:
            return "*"
        labels = host.split(".")[-2:]
        while labels and any(c in labels[0] for c in "*?"):
            labels = labels[1:]
        if not labels or any(c in labels[-1] for c in "*?"):
            return "*"
        # a host that is a single word may have any label before it
        return ".".join(labels) if len(labels) == 2 else labels[0]

    def automaton(self, group: str) -> Automaton:
        if group not in self.cache:
            if sum(a.words for a in self.cache.values()) > CACHE_WORDS:
                self.cache.clear()
            self.cache[group] = Automaton([self.rules[k] for k in self.groups[group]])
        return self.cache[group]

    def match(self, urls: list[tuple[str, str]]) -> list[Rule | None]:
        """For each (host, path) its rule."""
        asked: dict[str, list[int]] = {}
        for i, (host, _) in enumerate(urls):
            labels = f".{host}".split(".")
            for end in {"*", labels[-1], ".".join(labels[-2:])}:
                if end in self.groups:
                    asked.setdefault(end, []).append(i)
        best = np.full(len(urls), len(self.rules), np.int64)
        for group, rows in asked.items():
            found = self.automaton(group).match([".{}{}".format(*urls[i]).encode() for i in rows])
            number = np.append(np.array(self.groups[group], np.int64), len(self.rules))[found]
            best[rows] = np.minimum(best[rows], self.rank[number])
        return [None if k < 0 else self.rules[k] for k in self.by_rank[best].tolist()]


def judged(pages: DataFrame, rules: list[Rule], otherwise: str = ALLOW) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` of each row of ``pages(page_id, url, ..)``.

    ``rule`` is the name of the longest rule that fits, null if none does; then the verdict is
    ``otherwise``. A null url, or one without ``://``, has an empty host and path. Repeated rows keep a row
    each, with or without page_id; other columns are ignored; no rows give no rows; no rules fit nothing.
    """
    shared = pages.sparkSession.sparkContext.broadcast(Rules(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [host_and_path(u) for u in batch.column("url").to_pylist()]
            fitting = shared.value.match(parts)
            columns = [[h for h, _ in parts], [p for _, p in parts], [r and r.name for r in fitting], [r.verdict if r else otherwise for r in fitting]]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *[pa.array(c, pa.string()) for c in columns]], ["page_id", "host", "path", "rule", "verdict"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string").alias("url")).mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")
