"""Token-id output: flat unsigned integers and 64-bit document offsets, memory-mapped.

A store is a folder of parts.  Part k holds ``ids-k.bin`` (the ids of its documents one after the
other, little-endian, 2 bytes each where the vocabulary has at most 65536 ids, else 4),
``offsets-k.bin`` (unsigned 64-bit: for each of its documents the number of ids before it in the part,
and the total) and ``docs-k.bin`` (signed 64-bit: the doc_ids; those that are null come first and are counted
in the manifest).  Parts cover ascending, disjoint ranges of doc_id.  The manifest has for each part its
first id's place in the whole store, a prefix sum over the parts before it.

Rows with the same doc_id follow each other in the order of their texts' hashes.  Null texts are
empty: one end id.  A null doc_id sorts first.  Other columns are ignored, whatever their names.  Each task writes files of
its own name and only those it reports count, so a task may run again.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import dropped, fresh, written
from .wordhash import slices, word_codes

CACHE_WORDS = 150_000
JOINED = 4096
PART_BYTES, MOST_PARTS = 64 << 20, 1 << 20
RANGE_DOCS = 1 << 16
READ_IDS = 1 << 20
#: Bytes of text encoded at a time: each distinct word of them is looked up once.
SLICE_BYTES = 4 << 20


class WordEncoder:
    """Encodes whole texts through a cache of their words.

    The tokenizer splits at white space before its merges, so the ids of a text are those of its
    runs between ASCII white space, in order; and a run of marks behind a letter is split off too, so
    such an end is made a word of its own.  As the tokenizer lower-cases, A-Z are lower-cased before
    words are told apart, unless the texts might hold a special token.  Words of letters only are
    encoded many at a time, as one text: the library tells which word each id is of.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.dtype = np.dtype("<u4" if self.tokenizer.get_vocab_size() > 1 << 16 else "<u2")

    def _learn(self, words: list[str]) -> None:
        """Fills self.known for words."""
        plain = [w for w in words if w.isalpha()]
        odd = [w for w in words if not w.isalpha()]
        known, width = self.known, self.dtype.itemsize
        for at in range(0, len(plain), JOINED):
            some = plain[at : at + JOINED]
            e = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            of = np.array(e.word_ids, np.int64)
            if len(of) and of[-1] + 1 == len(some):  # words can't grow together, so none was split either
                raw = np.array(e.ids, self.dtype).tobytes()
                cuts = (np.searchsorted(of, np.arange(len(some) + 1)) * width).tolist()
                known.update((w, raw[a:b]) for w, a, b in zip(some, cuts, cuts[1:], strict=False))
            else:
                odd += some
        for at in range(0, len(odd), JOINED):
            some = odd[at : at + JOINED]
            for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                known[w] = np.array(e.ids, self.dtype).tobytes()

    def _looked_up(self, words: list[str]) -> list[bytes]:
        if len(self.known) > CACHE_WORDS:  # what the last words have in common with these is kept
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        new = []
        for w in words:
            if w not in known:
                if w in older:
                    known[w] = older[w]
                else:
                    new.append(w)
        self._learn(new)
        return [known[w] for w in words]

    def _coded(self, texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Ids of the distinct words, each word's place among them, and n+1 offsets of the texts."""
        texts = pc.fill_null(pa.concat_arrays([texts]), "")
        special = pc.any(pc.match_substring(texts, "<|")).as_py()
        if not special:
            texts = pc.replace_substring_regex(texts, r"([A-Za-z])([.,!?;:%&$*]+)([ \t-\r]|$)", r"\1 \2\3")
        coded, index, upto = word_codes(texts, not special)
        return self._looked_up(coded.to_pylist()), index, upto

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text, without an end id."""
        raw, index, upto = self._coded(texts)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // self.dtype.itemsize
        return np.diff(np.concatenate([[0], np.cumsum(sizes[index])])[upto])

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and n+1 offsets."""
        raw, index, upto = self._coded(texts)
        raw.append(np.array([end], self.dtype).tobytes())
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // self.dtype.itemsize
        flat = np.frombuffer(b"".join(raw), self.dtype)
        begin = np.cumsum(sizes) - sizes
        index = np.insert(index, upto[1:], len(raw) - 1)  # the end of a text is a word of its own
        counts = sizes[index]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.arange(total) + np.repeat(begin[index] - ends + counts, counts)]
        return ids, np.concatenate([[0], ends])[upto + np.arange(len(upto))]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def token_lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, length): the number of ids of each text and its end id."""

    def run(batches):
        coder = encoder(tokenizer)
        for batch in slices(batches, SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(coder.lengths(batch.column("text")) + 1)], names=["doc_id", "length"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, length long")


def part_count(docs: DataFrame) -> int:
    """Parts of about PART_BYTES of input by the plan's own estimate, and as many as there are shuffle partitions at least."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, -(-size // PART_BYTES)))


def write_store(docs: DataFrame, tokenizer: str, end: int = 2, parts: int | None = None) -> DataFrame:
    """Encodes docs (doc_id, text) into a new store; returns its manifest: part, name, docs, nulls, ids, width, base, folder."""
    spark = docs.sparkSession
    at = fresh(spark, "token-store")

    def run(batches):
        store, root = fs.FileSystem.from_uri(at)
        store.create_dir(root)
        coder = encoder(tokenizer)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        files, total, docs_here, nulls = None, 0, 0, 0
        for some in slices(batches, SLICE_BYTES):
            if files is None:
                files = [store.open_output_stream(f"{root}/{kind}-{name}.bin") for kind in ("ids", "offsets", "docs")]
            ids, ends = coder.encode(some.column("text"), end)
            files[0].write(ids.tobytes())
            files[1].write((ends[:-1] + total).astype("<u8").tobytes())
            files[2].write(pc.fill_null(some.column("doc_id"), 0).to_numpy().astype("<i8").tobytes())
            total += len(ids)
            docs_here += some.num_rows
            nulls += some.column("doc_id").null_count
        if files is not None:
            files[1].write(np.array([total], "<u8").tobytes())
            for f in files:
                f.close()
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "name": name, "docs": docs_here, "nulls": nulls, "ids": total, "width": coder.dtype.itemsize}])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    made = written(
        rows.repartitionByRange(parts or part_count(rows), *key).sortWithinPartitions(*key).mapInArrow(run, "part long, name string, docs long, nulls long, ids long, width long"),
        "token-parts",
    )
    sums = made.orderBy("part").toArrow()  # a row a partition
    dropped(made)
    ids = sums["ids"].to_numpy()
    base = np.cumsum(ids) - ids
    out = sums.append_column("base", pa.array(base)).append_column("folder", pa.array([at] * len(ids)))
    if not len(ids):
        return spark.createDataFrame([], "part long, name string, docs long, nulls long, ids long, width long, base long, folder string")
    return spark.createDataFrame(out)


class Reader:
    """Ranges of a part's files: memory-mapped where they are local, else read by offset."""

    def __init__(self, store, root: str, name: str):
        self.store, self.at, self.local = store, f"{root}/%s-{name}.bin", isinstance(store, fs.LocalFileSystem)

    def read(self, kind: str, dtype: str, first: int, count: int) -> np.ndarray:
        size = np.dtype(dtype).itemsize
        if not count:
            return np.zeros(0, dtype)
        if self.local:
            return np.memmap(self.at % kind, dtype, "r", first * size, count)
        with self.store.open_input_file(self.at % kind) as f:
            return np.frombuffer(f.read_at(count * size, first * size), dtype)


def read_store(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the memory-mapped files.

    A task reads RANGE_DOCS documents, and of their ids READ_IDS at a time.
    """

    def run(batches):
        for batch in batches:
            for part in batch.to_pylist():
                files, first = Reader(*fs.FileSystem.from_uri(part["folder"]), part["name"]), part["first"]
                n = min(RANGE_DOCS, part["docs"] - first)
                ends = files.read("offsets", "<u8", first, n + 1).astype(np.int64)
                known = first + np.arange(n) >= part["nulls"]  # documents without an id are a part's first
                sums, at = [], 0
                while at < n:
                    upto = max(at + 1, int(np.searchsorted(ends, ends[at] + READ_IDS, "right")) - 1)
                    if upto == at + 1:
                        sums.append(0)
                        for low in range(int(ends[at]), int(ends[upto]), READ_IDS):
                            ids = files.read("ids", f"<u{part['width']}", low, min(READ_IDS, int(ends[upto]) - low))
                            sums[-1] = zlib.crc32(ids.astype("<u4").tobytes(), sums[-1])
                    else:
                        ids = files.read("ids", f"<u{part['width']}", int(ends[at]), int(ends[upto] - ends[at])).astype("<u4")
                        cuts = (ends[at : upto + 1] - ends[at]).tolist()
                        sums += [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]
                    at = upto
                yield pa.RecordBatch.from_arrays(
                    [pa.array(files.read("docs", "<i8", first, n), mask=~known), pa.array(ends[:-1] + part["base"]), pa.array(np.diff(ends)), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    ranges = manifest.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("docs") - 1, F.lit(RANGE_DOCS).cast("long"))).alias("first"))
    return ranges.repartition(max(1, manifest.count())).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
