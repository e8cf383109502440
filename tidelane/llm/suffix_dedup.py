"""Suffix-array dedup with sparse suffixes: passages of ``min_words`` words or more that repeat across documents.

1.  Suffixes are kept at minimiser positions only: of every window of 20 successive 12-word runs the
    one with the least hash.  A passage of 51 words holds such a place among its first 20 positions,
    the same in every copy, so at least its next 32 words lie inside the passage.
2.  Sparse suffixes are sorted by the hash of these 32 words; neighbours that agree and come from
    different documents survive.  All others, which is most of them, are gone after this exchange.
3.  Each survivor is extended: left to every passage start whose minimiser it is, right to the full
    length of the passage.  Extended suffixes are sorted again, and neighbours that agree are
    repeats; overlapping ones unite to spans, so a span is as long as the match.

A word is in a span if and only if it lies in a run of ``min_words`` words that another document holds
too.  Words and extended suffixes are compared by 64-bit hashes; only the first exchange, which decides what
is extended, sends 48 bits of a hash.  Among n extended suffixes n^2 / 2^65 false matches are to be expected,
one from about 6 * 10^9 on.

Defined results: null and short texts have no spans; repeats inside one document, and rows that
repeat a doc_id, are no repeats across documents; rows without a doc_id (null in the result, too) are
told apart by their texts; very long texts are read whole; among ties the least document is the
partner; an empty table gives no rows; extra columns are ignored, whatever their names.
``remove_repeats`` keeps them, and leaves rows without a doc_id whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm.seeding import PACKED, bucket_entries, chunked, known_id, minimizers, own_id, pack_entries, run_hashes, settle_chunk, settle_shard
from tidelane.llm.storage import Scratch, arrow_rows, shard_count
from tidelane.llm.textkernel import U64, TextKernel, text_slices

RUN = 12
SPREAD = 20


def _sparse_suffixes(h: np.ndarray, first: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage starts, the minimiser of each, hash by position of the words from a minimiser on)."""
    starts, anchors = minimizers(h, first, RUN, SPREAD)
    ends = np.repeat(first[1:], np.diff(first))
    fits = starts + min_words <= ends[starts]
    return starts[fits], anchors[fits], ends


def settled(entries: DataFrame, shards: int, scratch: Scratch, name: str) -> DataFrame:
    """Rows (shard: bucket of documents, docs, pos, partners) of the entries whose key another document holds."""
    rows = scratch.keep(entries, name)
    met = rows.where("shard >= 0").groupBy("shard").applyInArrow(lambda t: settle_shard(t, shards), PACKED)
    return rows.where("shard < 0").unionByName(met).select("shard", "docs", "pos", "partners")


def _marks(table: pa.Table) -> pa.Table:
    """(doc_id, marks) of a bucket: the surviving positions of each document."""
    doc, pos, _ = bucket_entries(table)
    start = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    ends = np.concatenate([start[1:], [len(doc)]])
    return pa.table({"doc_id": doc[start], "marks": pa.array([pos[a:b].astype(np.uint32).tobytes() for a, b in zip(start, ends)], pa.binary())})


def repeated_spans(docs: DataFrame, *, min_words: int = 51) -> DataFrame:
    """(doc_id, start_word, end_word, other_doc_id) of every maximal repeated span, words from 0.

    ``other_doc_id`` is the least other document that shares a part of the span, whatever the partitions.
    """
    if min_words < SPREAD + RUN:
        raise ValueError(f"min_words is {SPREAD + RUN} at least")
    spark = docs.sparkSession
    scratch, shards = Scratch(spark, "suffix"), shard_count(docs)
    tail = min_words - SPREAD + 1
    base = docs.select(own_id(F.col("doc_id"), F.col("text")).alias("doc_id"), "text")

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = TextKernel("space")

        def pieces() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for batch in batches:
                ids = batch.column("doc_id").to_numpy()
                for a, _, buf, offsets in text_slices(batch.column("text")):
                    words = kernel.cut(buf, offsets)
                    h = kernel.word_hashes(words)
                    _, anchors, _ = _sparse_suffixes(h, words.first, min_words)
                    at = np.unique(anchors)
                    place, key = run_hashes(h, words.first, tail)
                    doc = words.doc[at]
                    yield key[np.searchsorted(place, at)], ids[a + doc], at - words.first[doc]

        yield from chunked(pieces(), lambda k, d, p: settle_chunk(k, d, p, shards))

    def extensions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = TextKernel("space")

        def pieces() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for batch in batches:
                ids, marks = batch.column("doc_id").to_numpy(), batch.column("marks")
                for a, b, buf, offsets in text_slices(batch.column("text")):
                    words = kernel.cut(buf, offsets)
                    h = kernel.word_hashes(words)
                    alive = np.zeros(len(h) + 1, bool)
                    for i in range(a, b):
                        at = np.frombuffer(marks[i].as_py(), np.uint32) + words.first[i - a]
                        alive[at[at < words.first[i - a + 1]]] = True
                    starts, anchors, _ = _sparse_suffixes(h, words.first, min_words)
                    starts = starts[alive[anchors]]
                    place, key = run_hashes(h, words.first, min_words)
                    doc = words.doc[starts]
                    yield key[np.searchsorted(place, starts)], ids[a + doc], starts - words.first[doc]

        # none is settled in its chunk: partners are the least documents of all chunks
        yield from chunked(pieces(), lambda k, d, p: pack_entries(k, d, p, np.zeros(len(k), bool), shards, cut=0))

    def united(table: pa.Table) -> pa.Table:
        doc, pos, partner = bucket_entries(table)
        new = np.ones(len(pos), bool)
        new[1:] = (pos[1:] > pos[:-1] + min_words) | (doc[1:] != doc[:-1])
        start = np.flatnonzero(new)
        last = np.concatenate([start[1:], [len(pos)]]) - 1
        return pa.table({"doc_id": doc[start], "start_word": pos[start], "end_word": pos[last] + min_words, "other_doc_id": np.minimum.reduceat(partner, start)})

    with arrow_rows(spark, 2000):
        alive = settled(base.mapInArrow(suffixes, PACKED), shards, scratch, "suffixes")
        marks = scratch.keep(alive.groupBy("shard").applyInArrow(_marks, "doc_id long, marks binary"), "marks")
        scratch.drop("suffixes")
        found = settled(base.join(marks, "doc_id").mapInArrow(extensions, PACKED), shards, scratch, "extensions")
        spans = scratch.keep(found.groupBy("shard").applyInArrow(united, "doc_id long, start_word long, end_word long, other_doc_id long"), "spans")
        return spans.withColumns({c: known_id(F.col(c)) for c in ("doc_id", "other_doc_id")})


def remove_repeats(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` without the words of spans that a document with a smaller id holds too; separators stay."""
    cut = spans.where("other_doc_id < doc_id").groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    text, held = F.col("d.row.text"), F.col("c.spans")
    pieces = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"), F.lit(0))
    leading = F.rlike(text, F.lit(r"\A[^\x20\x09-\x0D]")).cast("int")
    inside = lambda n: F.exists(held, lambda s: (n >= s["start_word"]) & (n < s["end_word"]))
    kept = F.filter(pieces, lambda x, i: ~(((i + leading) % 2 == 1) & inside(F.floor((i + 1 + leading) / 2) - 1)))
    joined = docs.select(F.struct("*").alias("row")).alias("d").join(cut.alias("c"), F.col("d.row.doc_id") == F.col("c.id"), "left")
    clean = F.when(held.isNull(), text).otherwise(F.array_join(kept, ""))
    return joined.select(*[(clean if c == "text" else F.col(f"d.row.`{c}`")).alias(c) for c in docs.columns])


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that repeat across all documents."""
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
