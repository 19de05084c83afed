"""Exact pattern matching: overlapping occurrences, natively or by five interchangeable kernels."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import by_slices


def count_overlapping(text: Column, keyword: str) -> Column:
    """Number of occurrences of keyword, overlapping ones too: a look-ahead in the JVM."""
    if not keyword:
        return F.lit(0)
    return F.regexp_count(text, F.lit("(?=" + re.sub(r"([^\w\s])", r"\\\1", keyword) + ")"))


def whole_word(text: Column, keyword: str) -> Column:
    from ..functions.text import TOKEN

    quoted = re.sub(r"([^\w\s])", r"\\\1", keyword)
    return text.rlike(f"(?<!{TOKEN}){quoted}(?!{TOKEN})")


def find_all(text: str, pattern: str) -> list[int]:
    out, at = [], text.find(pattern) if pattern else -1
    while at >= 0:
        out.append(at)
        at = text.find(pattern, at + 1)
    return out


def starts(text: str, c: str) -> list[int]:
    """Places of one character."""
    return [m.start() for m in re.finditer(re.escape(c), text)]


def naive(text: str, pattern: str) -> list[int]:
    """Every place of the first letter is compared."""
    return [i for i in starts(text, pattern[0]) if text.startswith(pattern, i)] if pattern else []


def borders(pattern: str) -> list[int]:
    """For each prefix the length of its longest border."""
    out = [0] * len(pattern)
    for i in range(1, len(pattern)):
        k = out[i - 1]
        while k and pattern[i] != pattern[k]:
            k = out[k - 1]
        out[i] = k + (pattern[i] == pattern[k])
    return out


def kmp(text: str, pattern: str) -> list[int]:
    if not pattern or len(pattern) > len(text):
        return []
    table, k, out, m = borders(pattern), 0, [], len(pattern)
    i = text.find(pattern[0])
    while 0 <= i < len(text):
        c = text[i]
        while k and (k == m or c != pattern[k]):
            k = table[k - 1]
        k += c == pattern[k]
        if k == m:
            out.append(i - k + 1)
        i = i + 1 if k else text.find(pattern[0], i + 1)  # without a prefix the next one starts at its first letter
    return out


#: Characters that are hashed at a time; patterns up to so many letters are hashed at all places at once.
HASHED, SHORT = 1 << 18, 64


def rabin_karp(text: str, pattern: str) -> list[int]:
    base, prime, m = 256, 1_000_000_007, len(pattern)
    if not m or m > len(text):
        return []
    if m <= SHORT:
        want, out = 0, []
        for a in pattern:
            want = (want * base + ord(a)) % prime
        for at in range(0, len(text) - m + 1, HASHED):
            code = np.frombuffer(text[at : at + HASHED + m - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            have = np.zeros(len(code) - m + 1, np.int64)
            for j in range(m):
                have *= base
                have += code[j : j + len(have)]
                have %= prime
            out += [i for i in (np.flatnonzero(have == want) + at).tolist() if text.startswith(pattern, i)]
        return out
    top, want, have = pow(base, m - 1, prime), 0, 0
    for a, b in zip(pattern, text, strict=False):
        want, have = (want * base + ord(a)) % prime, (have * base + ord(b)) % prime
    out = []
    for i in range(len(text) - m + 1):
        if want == have and text.startswith(pattern, i):
            out.append(i)
        if i + m < len(text):
            have = ((have - ord(text[i]) * top) * base + ord(text[i + m])) % prime
    return out


def z_array(text: str) -> list[int]:
    """Only places of the first letter have more than 0."""
    n = len(text)
    z, left, right = [0] * n, 0, 0
    for i in starts(text, text[0])[1:] if n else []:
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and text[k] == text[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    if n:
        z[0] = n
    return z


def z_search(text: str, pattern: str) -> list[int]:
    m = len(pattern)
    if not m or m > len(text):
        return []
    z = z_array(pattern + "￿" + text)
    return [i for i in starts(text, pattern[0]) if z[m + 1 + i] >= m]


class AhoCorasick:
    """All patterns in one pass over a text."""

    def __init__(self, patterns: list[str]):
        self.patterns = [p for p in dict.fromkeys(patterns) if p]
        self.next: list[dict[str, int]] = [{}]
        self.fail, self.out = [0], [[]]
        for p in self.patterns:
            at = 0
            for c in p:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.fail.append(0)
                    self.out.append([])
                at = self.next[at][c]
            self.out[at].append(p)
        self.first = re.compile("[" + "".join(map(re.escape, self.next[0])) + "]") if self.patterns else None
        queue = deque(self.next[0].values())
        while queue:
            at = queue.popleft()
            self.out[at] = self.out[at] + self.out[self.fail[at]]
            for c, to in self.next[at].items():
                back = self.fail[at]
                while back and c not in self.next[back]:
                    back = self.fail[back]
                self.fail[to] = self.next[back].get(c, 0)
                queue.append(to)

    def search_all(self, text: str) -> dict[str, list[int]]:
        """Offsets of each pattern that occurs."""
        found: dict[str, list[int]] = {}
        if not self.patterns:
            return found
        at, upto = 0, 0
        for first in self.first.finditer(text):
            i = first.start()
            if i < upto:  # seen on the way of an earlier one
                continue
            while i < len(text):
                c = text[i]
                while at and c not in self.next[at]:
                    at = self.fail[at]
                at = self.next[at].get(c, 0)
                for p in self.out[at]:
                    found.setdefault(p, []).append(i - len(p) + 1)
                i += 1
                if not at:  # at the root again: on to the next first letter
                    break
            upto = i
        return found

    def count_all(self, text: str) -> dict[str, int]:
        return {p: len(x) for p, x in self.search_all(text).items()}

    def contains_all(self, text: str) -> bool:
        return bool(self.patterns) and len(self.search_all(text)) == len(self.patterns)


class Trie:
    """A prefix tree of words."""

    def __init__(self, words=()):
        self.root: dict = {}
        for w in words:
            self.insert(w)

    def insert(self, word: str) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node[None] = word

    def _at(self, prefix: str) -> dict | None:
        node = self.root
        for c in prefix:
            node = node.get(c)
            if node is None:
                return None
        return node

    def search(self, word: str) -> bool:
        return None in (self._at(word) or {})

    def starts_with(self, prefix: str) -> bool:
        return self._at(prefix) is not None

    def words_with_prefix(self, prefix: str) -> list[str]:
        out, stack = [], [n for n in [self._at(prefix)] if n is not None]
        while stack:
            node = stack.pop()
            out += [v for k, v in node.items() if k is None]
            stack += [v for k, v in node.items() if k is not None]
        return sorted(out)


KERNELS: dict[str, Callable[[str, str], list[int]]] = {
    "naive": naive, "kmp": kmp, "rabinkarp": rabin_karp, "zalgorithm": z_search, "ahocorasick": lambda text, p: AhoCorasick([p]).search_all(text).get(p, []) if p else [], "find": find_all,
}

#: Names of algorithms as requests may write them, without "-", "_" and spaces.
ALIASES = {"kmp": "kmp", "rabinkarp": "rabinkarp", "rk": "rabinkarp", "z": "zalgorithm", "zalgo": "zalgorithm", "zalgorithm": "zalgorithm", "naive": "naive", "aho": "ahocorasick", "ahocorasick": "ahocorasick"}


def resolve_algorithm(name: str | None, keywords: int) -> str:
    key = re.sub(r"[-_ ]", "", name or "").lower()
    if key in ("", "auto"):
        return "kmp" if keywords <= 1 else "ahocorasick"
    return ALIASES.get(key, "kmp")


def positions(text: Column, keyword: str, kernel: str = "find") -> Column:
    """Ascending start offsets of keyword, overlapping ones too."""
    search = KERNELS[kernel]

    @F.arrow_udf("array<int>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from by_slices(lambda t: search(t, keyword), pa.list_(pa.int32()))(texts)

    return run(text)


def all_positions(text: Column, keywords: list[str]) -> Column:
    """map<keyword, offsets> of the keywords that occur, in one pass over the text."""

    @F.arrow_udf("map<string,array<int>>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = AhoCorasick(keywords)
        yield from by_slices(lambda t: list(machine.search_all(t).items()), pa.map_(pa.string(), pa.list_(pa.int32())))(texts)

    return run(text)


def comparison(text: Column, asked: dict[str, list[str]]) -> Column:
    """For each algorithm the number of places of its keywords, or null for a text that doesn't hold all of them."""

    @F.arrow_udf("array<bigint>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machines = {name: AhoCorasick(keywords) for name, keywords in asked.items() if name == "ahocorasick"}

        def count(t: str) -> list[int | None]:
            out = []
            for name, keywords in asked.items():
                if not all(k in t for k in keywords):
                    out.append(None)
                elif name in machines:
                    out.append(sum(machines[name].count_all(t).values()))
                else:
                    out.append(sum(len(KERNELS[name](t, k)) for k in keywords))
            return out

        yield from by_slices(count, pa.list_(pa.int64()))(texts)

    return run(text)
