"""Highlighted snippets: the lines with most keywords, matches in double brackets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import by_slices, searchable
from .match import AhoCorasick

#: Fixed sizes: lines of a snippet, a line's length, context before the first match, length of a plain head.
LINES, WIDTH, BEFORE, HEAD = 3, 240, 80, 200


def head(text: str) -> str:
    text = text.strip()
    return text[:HEAD] + "..." if len(text) > HEAD else text


def _marked(text: str, begin: int, end: int, spans: list[tuple[int, int]]) -> str:
    merged: list[list[int]] = []
    for a, b in spans:
        if begin <= a < end:
            b = min(b, end)
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
    out, at = [], begin
    for a, b in merged:
        out += [text[at:a], "[[", text[a:b], "]]"]
        at = b
    return "".join([*out, text[at:end]])


def build(normalized: str, found: dict[str, list[int]]) -> str:
    """A snippet of the text from the offsets of each keyword."""
    spans = sorted((at, at + len(k), k) for k, places in found.items() for at in places)
    if not spans:
        return head(normalized)
    lines, begin, i = [], 0, 0
    for line in normalized.split("\n"):
        end = begin + len(line)
        own = []
        while i < len(spans) and spans[i][0] <= end:
            own.append(spans[i])
            i += 1
        if own:
            lines.append((-len({k for *_, k in own}), own[0][0], begin, end - line.endswith("\r"), own))
        begin = end + 1
    parts = []
    for _, first, begin, end, own in sorted(sorted(lines)[:LINES], key=lambda x: x[1]):
        start = max(begin, first - BEFORE) if end - begin > WIDTH else begin
        stop = min(end, start + WIDTH)
        parts.append("... " * (start > begin) + _marked(normalized, start, stop, [(a, b) for a, b, _ in own]) + " ..." * (stop < end))
    return "\n".join(parts)


def extract(raw: str, keywords: list[str]) -> str:
    """A snippet of a raw text for raw keywords."""
    import unicodedata

    normalized = unicodedata.normalize("NFC", raw or "")
    return build(normalized, AhoCorasick([searchable(k) for k in keywords]).search_all(searchable(raw)))


def snippet(normalized: Column, searchable_text: Column, keywords: list[str]) -> Column:
    @F.arrow_udf("string")
    def run(texts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        machine = AhoCorasick(keywords)
        yield from by_slices(lambda shown, searched: build(shown, machine.search_all(searched)), pa.string())(texts)

    return run(normalized, searchable_text)


def head_column(text: Column) -> Column:
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(F.length(trimmed) > HEAD, F.concat(F.substring(trimmed, 1, HEAD), F.lit("..."))).otherwise(trimmed)
