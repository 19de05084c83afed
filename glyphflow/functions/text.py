"""Text functions: normal form, case folding, tokens, scripts.

All but NFC and tokens with offsets are JVM expressions; these two work on Arrow batches.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Capital letters below U+0250 and their small letters, one for one.
UPPER = "".join(chr(c) for c in range(0x250) if unicodedata.category(chr(c)) == "Lu")
LOWER = "".join(c.lower()[0] for c in UPPER)
_FOLD = str.maketrans(UPPER, LOWER)

#: A token character: a letter, decimal digit or mark of the basic plane, or a zero-width (non-)joiner.
TOKEN = r"[[\p{L}\p{Nd}\p{M}\x{200C}\x{200D}]&&[\x{0}-\x{FFFF}]]"

#: Blocks of scripts, in the order in which ties are decided.
SCRIPTS = (("telugu", 0x0C00, 0x0C7F), ("hindi", 0x0900, 0x097F), ("tamil", 0x0B80, 0x0BFF), ("bengali", 0x0980, 0x09FF))


@F.arrow_udf(StringType())
def _nfc(texts: pa.Array) -> pa.Array:
    #: Arrow's own utf8_normalize leaves texts decomposed; this is one call in C for each text that isn't null.
    parts = [pa.array([t and unicodedata.normalize("NFC", t) for t in part.to_pylist()], pa.string()) for part in array_slices(texts)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def normalize(text: Column) -> Column:
    """NFC; null is empty.  Texts without a character from U+0300 on are in normal form and stay in the JVM."""
    odd = text.rlike(r"[^\x{0}-\x{2FF}]")
    return F.coalesce(_nfc(F.when(odd, text)), text, F.lit(""))


def fold_case(text: Column) -> Column:
    """Small letters for the capitals below U+0250; the length stays."""
    return F.translate(text, UPPER, LOWER)


def to_searchable(text: Column) -> Column:
    return fold_case(normalize(text))


def fold(text: str) -> str:
    return text.translate(_FOLD)


def searchable(text: str | None) -> str:
    return fold(unicodedata.normalize("NFC", text or ""))


def _is_token_char(c: str) -> bool:
    return ord(c) < 0x10000 and (unicodedata.category(c)[0] in "LM" or unicodedata.category(c) == "Nd" or c in "‌‍")


def tokenize(raw: str | None) -> list[str]:
    """Tokens of a (short) query string."""
    out, word = [], []
    for c in [*searchable(raw), " "]:
        if _is_token_char(c):
            word.append(c)
        elif word:
            out.append("".join(word))
            word = []
    return out


def token_array(text: Column) -> Column:
    """Tokens of a searchable text, in order."""
    return F.regexp_extract_all(text, F.lit(f"({TOKEN}+)"), F.lit(1))


def _token_table() -> np.ndarray:
    table = np.zeros(0x10001, bool)  # the last place stands for all beyond the basic plane
    table[:0x10000] = [_is_token_char(chr(c)) for c in range(0x10000)]
    return table


_TABLE: list[np.ndarray] = []


def token_runs(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All tokens of searchable texts, each with its offset in code points, and n+1 offsets of the texts into them.

    Works on the bytes of the whole column: code points by their leading bytes, runs by a table of characters.
    """
    if not _TABLE:
        _TABLE.append(_token_table())
    texts = pc.fill_null(pa.concat_arrays([texts]), "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    lead = (raw & 0xC0) != 0x80  # the first byte of a character
    place = np.flatnonzero(lead)
    code = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    token = _TABLE[0][np.minimum(code, 0x10000)]
    begins = np.searchsorted(place, at)  # of each text, in characters
    first = token.copy()
    first[1:] &= ~token[:-1]
    starts_text = begins[:-1][begins[:-1] < len(code)]
    first[starts_text] = token[starts_text]
    start = np.flatnonzero(first)
    upto = np.searchsorted(start, begins)
    width = np.diff(np.append(place, len(raw)))
    ends = np.cumsum(np.where(token, width, 0))
    ends = np.concatenate([ends[start] - width[start], ends[-1:]]) if len(start) else np.zeros(1, np.int64)
    kept = raw[np.repeat(token, width)]
    terms = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(kept.tobytes())).cast(pa.string())
    return terms, start - np.repeat(begins[:-1], np.diff(upto)), upto


def tokens(docs: DataFrame, key: str = "id", text: str = "searchable") -> DataFrame:
    """(key, term, start): every token with its offset in code points; no shuffle."""
    kind = docs.schema[key].dataType.simpleString()

    def place(batches):
        for batch in text_slices(batches):
            terms, start, upto = token_runs(batch.column(1))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(upto))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), terms, pa.array(start.astype(np.int32))], names=[key, "term", "start"])

    return docs.select(key, text).mapInArrow(place, f"`{key}` {kind}, term string, start int")


#: Bytes of text that a vectorised function takes at a time; token_runs() takes about fifty times that in numbers.
TEXT_BYTES = 1 << 20


def text_slices(batches, column: int = 1):
    """Record batches cut so that the texts of each have about TEXT_BYTES."""
    for batch in batches:
        rows = max(1, batch.num_rows * TEXT_BYTES // max(1, batch.column(column).nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def array_slices(texts: pa.Array, size: int = TEXT_BYTES):
    """The array cut into slices of about size bytes."""
    rows = max(1, len(texts) * size // max(1, texts.nbytes))
    for at in range(0, len(texts), rows):
        yield texts.slice(at, rows)


def by_slices(function, kind: pa.DataType, size: int = TEXT_BYTES):
    """For an iterator UDF: function of each row's values (null gives null), over slices of about size bytes of the first column.

    What a whole Arrow batch makes as Python objects, its results above all, is never held at once.
    """

    def run(batches):
        for batch in batches:
            columns = batch if isinstance(batch, tuple) else (batch,)
            at = 0
            for part in array_slices(columns[0], size):
                rows = zip(part.to_pylist(), *(c.slice(at, len(part)).to_pylist() for c in columns[1:]), strict=True)
                yield pa.array([None if None in r else function(*r) for r in rows], kind)
                at += len(part)

    return run


def preprocess(text: Column) -> Column:
    """NFC, trimmed, runs of white space made one space."""
    return F.regexp_replace(F.regexp_replace(normalize(text), r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"\s+", " ")


def strip_punctuation(text: Column) -> Column:
    """ASCII punctuation, (double) danda, fullwidth comma and ideographic stop become spaces; runs of space become one."""
    spaced = F.regexp_replace(text, r"[\p{Punct}।॥，。]", " ")
    return F.regexp_replace(F.regexp_replace(spaced, r"\s+", " "), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def detect_script(text: Column) -> Column:
    """The language of the script with most characters; ties go by the order of SCRIPTS, Latin last."""
    counts = [(name, F.regexp_count(text, F.lit(f"[\\x{{{a:04X}}}-\\x{{{b:04X}}}]"))) for name, a, b in SCRIPTS]
    counts.append(("english", F.regexp_count(text, F.lit(r"[\p{L}&&[\x{0}-\x{24F}]]"))))
    most = F.greatest(*[n for _, n in counts])
    out = F.when(most == 0, "unknown")
    for name, n in counts:
        out = out.when(n == most, name)
    return F.coalesce(out, F.lit("unknown"))


def register(spark: SparkSession) -> None:
    """The functions under SQL names: nfc, fold_case, searchable, tokenize, detect_script, strip_punctuation, preprocess, edit_script."""
    from ..operators.fuzzy import edit_script_udf

    spark.udf.register("nfc", _nfc)
    spark.udf.register("edit_script", edit_script_udf)
    upper, lower = UPPER.replace("'", "''"), LOWER.replace("'", "''")
    spark.sql(f"create or replace temporary function fold_case(t string) returns string return translate(t, '{upper}', '{lower}')")
    spark.sql("create or replace temporary function searchable(t string) returns string return fold_case(coalesce(nfc(t), ''))")
    token = TOKEN.replace("\\", "\\\\")
    spark.sql(f"create or replace temporary function tokenize(t string) returns array<string> return regexp_extract_all(searchable(t), '({token}+)', 1)")
