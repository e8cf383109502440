"""Packing documents into sequences of fixed length: concatenate and cut, by two-pass prefix sums.

Pass one tokenizes each partition's documents in their order, ends each with the closing id, and writes the
ids with the sum of tokens before them in their partition.  Prefix sums over the partitions' totals (one
row a partition) give every token its place in one long stream without moving any text or id.  Pass two
reads the written ids and cuts the stream at multiples of the sequence length.

Every window but the last is full, so padding is below one sequence for the whole table.  Windows that lie
in one task's rows leave it whole; those that reach over its border are given out as boundary records, two a
task at most, and only these are shuffled to be joined.

Defined results: a null or empty text is a document of the closing id alone; repeated rows and null ids are
documents of their own; a very long text is encoded in blocks and cut into as many pieces as it needs; an empty
table has no pieces; further columns of the input are not read, so they cannot clash.  Strings of special
tokens in a text become those tokens, as the tokenizer does by default.  The order is that of the partitions
of the input; a lost executor cannot change it, as ids and places are written before they are used.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidelane.llm.prefix import running_offsets
from tidelane.llm.storage import Scratch, arrow_rows
from tidelane.llm.units import Ragged, UnitTable, byte_level_alphabet, runs_of, unit_slices, units, word_tokenizer

WORD_BPE = "word_bpe_49k.json"
SEQUENCE = 4096
END_ID = 2
PAD_ID = 0
LAST_MARKS = ".,;:!?"
SEPARATORS = "\x1c\x1d\x1e\x1f"
JOINED_CHARS = 1 << 14
#: Partitions (24 bytes each) whose offsets are broadcast at most; beyond, rows meet them by shuffle.
BROADCAST_PARTITIONS = 1_000_000


def words(text: str) -> list[str]:
    """Word BPE drops white space, so its texts are cut there; U+001C to U+001F are white space to Python alone."""
    return units(text) if any(c in text for c in SEPARATORS) else text.split()


class IdsOfTexts:
    """Token ids of texts.  Each distinct word is encoded once.

    Words of European Latin letters, lowered and less a last mark, go to the model alone, as bytes: normalising and
    splitting would not change them.  All others go through the whole tokenizer.
    """

    def __init__(self, tokenizer: str):
        self.tokenizer = word_tokenizer(tokenizer, specials_are_text=False)
        plain = json.loads(self.tokenizer.to_str())
        plain["normalizer"], plain["pre_tokenizer"], plain["added_tokens"] = None, {"type": "WhitespaceSplit"}, []
        self.of_letters = Tokenizer.from_str(json.dumps(plain))
        size = self.tokenizer.get_vocab_size()
        self.closes = np.array([(self.tokenizer.id_to_token(i) or "").endswith(plain["model"]["end_of_word_suffix"]) for i in range(size)])
        self.as_bytes = {b: c for c, b in byte_level_alphabet().items() if b != 0x20}
        self.marks = {m: self._alone(m) for m in LAST_MARKS}
        self.ids = Ragged(np.int32)
        self.table = UnitTable(self._encode, self.ids.clear)

    def _alone(self, unit: str) -> list[int]:
        return self.tokenizer.encode(unit, add_special_tokens=False).ids

    def _encode(self, new: list[str]) -> None:
        letters: dict[str, int] = {}
        others: list[str] = []
        first, second = [], []  # of each word: its place among letters or (negative) others, and its last mark
        for word in new:
            core, mark = (word[:-1], word[-1]) if word[-1] in self.marks else (word, "")
            if core.isalpha() and (core.isascii() or max(core) <= "ſ" and "İ" not in core):
                first.append(letters.setdefault(core.lower(), len(letters)))
                second.append(mark)
            else:
                others.append(word)
                first.append(-len(others))
                second.append("")
        encoded = Ragged(np.int32)
        if letters:
            texts = [" ".join(run).encode().decode("latin-1").translate(self.as_bytes) for run in runs_of([*letters], JOINED_CHARS)]
            ids = np.concatenate([np.array(e.ids, np.int32) for e in self.of_letters.encode_batch_fast(texts, add_special_tokens=False)])
            encoded.extend_flat(ids, np.diff(np.flatnonzero(self.closes[ids]), prepend=-1))
        more = [e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)] + [*self.marks.values()]
        encoded.extend_flat(np.array([i for x in more for i in x], np.int32), np.array([len(x) for x in more]))
        at = {"": -1} | {m: len(letters) + len(others) + i for i, m in enumerate(self.marks)}
        core = np.array(first)
        chosen = np.stack([np.where(core < 0, len(letters) - 1 - core, core), [at[m] for m in second]], 1)
        flat = chosen.ravel()
        flat = flat[flat >= 0]
        lengths = encoded.lengths(chosen[:, 0]) + np.where(chosen[:, 1] >= 0, encoded.lengths(np.maximum(chosen[:, 1], 0)), 0)
        self.ids.extend_flat(encoded.take(flat), lengths)

    def __call__(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each closed by ``end_id``; number of ids of each)"""
        counts, parts = np.zeros(len(texts), np.int64), [np.empty(0, np.int32)]
        for rows, found in unit_slices(texts, cut=words):
            numbers = self.table.numbers(found)
            parts.append(self.ids.take(numbers))
            counts += np.bincount(rows, self.ids.lengths(numbers), len(texts)).astype(np.int64)
        return np.insert(np.concatenate(parts), np.cumsum(counts), end_id), counts + 1


@functools.cache
def ids_of_texts(tokenizer: str) -> IdsOfTexts:
    """One for each Python worker, which keeps it from task to task."""
    return IdsOfTexts(tokenizer)


def _tokenize(tokenizer: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before = ids_of_texts(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, n = encode(batch.column("text").to_pylist(), end_id)
            ends = np.cumsum(n)
            packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], 4 * ends]).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
            columns = [batch.column("doc_id"), pa.array(np.full(len(n), part)), pa.array(before + ends - n), pa.array(n), packed]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "before", "n", "ids"])
            before += int(ends[-1]) if len(ends) else 0

    return run


def token_stream(docs: DataFrame, scratch: Scratch, *, tokenizer: str = WORD_BPE, end_id: int = END_ID, id_col: str = "doc_id", text: Column | None = None) -> DataFrame:
    """Each document's ids (little-endian numbers of 32 bits) and the place ``at`` of its first id in the stream of all documents."""
    text = F.col("text") if text is None else text
    given = docs.select(F.col(id_col).alias("doc_id"), text.cast("string").alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    with arrow_rows(docs.sparkSession, 256):
        rows = scratch.keep(given.mapInArrow(_tokenize(tokenizer, end_id), f"doc_id {kind}, part long, before long, n long, ids binary"), "ids")
    totals = scratch.keep(rows.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("tokens")), "totals")
    offsets = scratch.keep(running_offsets(totals, "part", F.col("tokens"), "offset").drop("tokens"), "offsets")
    if offsets.count() <= BROADCAST_PARTITIONS:
        offsets = F.broadcast(offsets)
    return rows.join(offsets, "part").select("doc_id", (F.col("offset") + F.col("before")).alias("at"), "ids")


def id_edges(packed: pa.Array) -> tuple[np.ndarray, memoryview]:
    """(where each document's ids begin and end, counted in ids; their bytes)"""
    edges = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1] // 4
    return edges.astype(np.int64), memoryview(packed.buffers()[2] or b"")


def _cut(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            edges, raw = id_edges(batch.column("ids"))
            at = batch.column("at").to_numpy()
            n = np.diff(edges)
            pieces = (at + n - 1) // length - at // length + 1
            doc = np.repeat(np.arange(len(n)), pieces)
            sequence = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces) + (at // length)[doc]
            start = np.maximum(sequence * length, at[doc]) - at[doc]
            size = np.minimum((sequence + 1) * length, (at + n)[doc]) - at[doc] - start
            first = edges[:-1][doc] + start
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + size).tolist(), strict=True)]
            columns = {"doc_id": batch.column("doc_id").take(pa.array(doc)), "start": start, "length": size, "ids_crc32": np.array(crc, np.int64), "doc_tokens": n[doc].astype(np.int64), "sequence_id": sequence, "offset": (at[doc] + start) % length}
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns.values()], names=list(columns))

    return run


def pieces(stream: DataFrame, length: int = SEQUENCE) -> DataFrame:
    """One row for each stretch of a document inside one sequence."""
    kind = stream.schema["doc_id"].dataType.simpleString()
    with arrow_rows(stream.sparkSession, 256):
        return stream.mapInArrow(_cut(length), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def _windows(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs of adjacent ids: whole windows, and what lies in windows that this task holds in part."""

    def batch_of(at: np.ndarray, lists: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(at // length), pa.array(at % length), pa.array(lists, pa.list_(pa.int32()))], names=["sequence_id", "offset", "ids"])

    def cut(start: int, run: np.ndarray, whole_only: bool) -> tuple[pa.RecordBatch, int, np.ndarray]:
        end = start + len(run)
        upto = end // length * length if whole_only else end
        marks = np.unique(np.concatenate([[start], np.arange(-(-start // length) * length, upto, length), [max(start, upto)]]))
        lists = [run[a - start : b - start] for a, b in zip(marks[:-1], marks[1:], strict=True)]
        return batch_of(marks[:-1], lists), max(start, upto), run[max(start, upto) - start :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, held = 0, np.empty(0, np.int32)
        for batch in batches:
            for at, ids in zip(batch.column("at").to_pylist(), batch.column("ids"), strict=True):
                ids = np.frombuffer(ids.as_buffer(), "<i4")
                if at != start + len(held):
                    if len(held):
                        yield cut(start, held, False)[0]
                    start, held = at, np.empty(0, np.int32)
                held = np.concatenate([held, ids])
                if len(held) >= 64 * length:
                    out, start, held = cut(start, held, True)
                    yield out
        if len(held):
            yield cut(start, held, False)[0]

    return run


def sequences(stream: DataFrame, length: int = SEQUENCE, pad_id: int = PAD_ID) -> DataFrame:
    """The sequences: ``ids`` padded to ``length`` unless their number is a power of two, ``tokens`` the number before padding."""
    with arrow_rows(stream.sparkSession, 256):
        runs = Scratch(stream.sparkSession, "windows").keep(stream.mapInArrow(_windows(length), "sequence_id long, offset long, ids array<int>"), "runs")
    whole = runs.where(F.size("ids") == length).select("sequence_id", "ids")
    parts = runs.where(F.size("ids") < length).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
    tokens = F.size("ids")
    power = F.expr("(size(ids) & (size(ids) - 1)) = 0")
    padded = F.when(power, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(length) - tokens)))
    return whole.unionByName(joined).select("sequence_id", padded.alias("ids"), tokens.alias("tokens"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens; one row a piece."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pieces(token_stream(docs, Scratch(spark, "packing"))).withColumn("doc_id", F.col("doc_id").cast("long"))
