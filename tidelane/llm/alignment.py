"""Alignment of two tokenizers' tokens over the same bytes.

Inside ``mapInArrow`` (the form of mapInPandas that keeps null ids exact) the cumulative byte ends of both
tokenizers' tokens are merged; wherever both end, a group is complete, and all tokens of one
side in it are linked with all of the other.  Each distinct unit of text is merged once.  A row keeps
its distinct pairs of ids and how often each is linked.  Spark then counts the rows that hold each pair,
takes each side's largest count, and joins both back to the rows.

Counts follow Zipf's law, so the join back is dealt by frequency: the most frequent pairs, as many as a
broadcast may hold, meet the rows where they lie; all others are joined by shuffle, where no pair has more rows
than the frequent pairs have at least.  Rows are summed before they are shuffled.

Defined results: null and empty texts, and texts that one side's tokens do not give back exactly (U+2581 is
such a case), have no tokens, zeros and an empty digest; repeated rows and null ids count as rows of their own;
very long texts are read whole, in blocks; an empty table gives no rows; further columns are not read, so
they cannot clash.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm.storage import Scratch, arrow_rows
from tidelane.llm.units import TABLE_UNITS, Ragged, UnitTable, byte_level_alphabet, runs_of, tokenizer_file, unit_slices, word_tokenizer

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"
#: Pairs (24 bytes each) that a broadcast holds at most.
FREQUENT_PAIRS = 2_000_000
#: First-side ids whose largest counts are broadcast at most; a vocabulary is smaller.
BROADCAST_IDS = 1_000_000

#: Links of one group that are listed by occurrences.
PAIRS_OF_GROUP = 1 << 12
JOINED_CHARS = 1 << 13


def common_ends(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Where both of two ascending lists of ends have one: the two pointers of a merge, moved for all ends at once."""
    pointer = np.searchsorted(a_ends, b_ends)
    met = pointer < len(a_ends)
    met[met] = a_ends[pointer[met]] == b_ends[met]
    return b_ends[met]


def group_links(a_ids: np.ndarray, a_first: np.ndarray, b_ids: np.ndarray, b_first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair key, times) of all links; group g has the tokens from ``first[g]`` to ``first[g + 1]`` of each side.

    Occurrence pairs of small groups are given one by one, those of large ones by distinct ids.
    """
    na, nb = np.diff(a_first), np.diff(b_first)
    small = na * nb <= PAIRS_OF_GROUP
    n = np.where(small, na * nb, 0)
    group = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
    a, b = a_ids[a_first[group] + nth // nb[group]], b_ids[b_first[group] + nth % nb[group]]
    parts = [(group, a << 32 | b, np.ones(len(group), np.int64))]
    for g in np.flatnonzero(~small).tolist():
        x, n_x = np.unique(a_ids[a_first[g] : a_first[g + 1]], return_counts=True)
        y, n_y = np.unique(b_ids[b_first[g] : b_first[g + 1]], return_counts=True)
        parts.append((np.full(len(x) * len(y), g), (x[:, None] << 32 | y).ravel(), (n_x[:, None] * n_y).ravel()))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))  # type: ignore[return-value]


class Sides:
    """Both tokenizers, with the bytes of each of their ids."""

    def __init__(self, byte_bpe: str, piece_bpe: str):
        import sentencepiece

        self.a = word_tokenizer(byte_bpe, specials_are_text=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(piece_bpe))
        alphabet = byte_level_alphabet()
        a_names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t in a_names]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.a_size, self.b_size = np.array([*map(len, self.a_bytes)]), np.array([*map(len, self.b_bytes)])

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Both sides' ids of each text, the leading space of which sentencepiece adds itself."""
        return [(a.ids, b) for a, b in zip(self.a.encode_batch_fast(texts, add_special_tokens=False), self.b.encode([t[1:] for t in texts], num_threads=1), strict=True)]

    def whole(self, text: str, a: list[int], b: list[int]) -> bool:
        want = text.encode()
        return b"".join([self.a_bytes[i] for i in a]) == want == b"".join([self.b_bytes[i] for i in b])


class UnitGroups:
    """Figures, digest texts and pairs of units, each distinct unit encoded and merged once."""

    def __init__(self, sides: Sides):
        self.sides = sides
        self.table = UnitTable(self._encode, self._reset, TABLE_UNITS // 2)
        self.digits = [b",%d" % i for i in range(max(len(sides.a_bytes), len(sides.b_bytes)))]
        self.opens, self.bars = [b";" + d[1:] for d in self.digits], [b"|" + d[1:] for d in self.digits]
        self.digit_size = np.array([*map(len, self.digits)])
        self._reset()

    def _reset(self) -> None:
        self.text: list[bytes] = []
        self.figures = np.zeros((0, 5), np.int64)
        self.keys, self.times = Ragged(), Ragged()

    def _encode(self, new: list[str]) -> None:
        a_ids: list[int] = []
        b_ids: list[int] = []
        bad = np.zeros(len(new), bool)
        at = 0
        runs = [*runs_of(new, JOINED_CHARS)]
        for run, (a, b) in zip(runs, self.sides.encode(["".join([" " + u for u in run]) for run in runs]), strict=True):
            if self.sides.whole("".join([" " + u for u in run]), a, b):
                a_ids += a
                b_ids += b
            else:  # some unit of this run does not come back: each is encoded alone
                for i, (u, (a, b)) in enumerate(zip(run, self.sides.encode([" " + u for u in run]), strict=True), at):
                    bad[i] = not self.sides.whole(" " + u, a, b)
                    a_ids += [] if bad[i] else a
                    b_ids += [] if bad[i] else b
            at += len(run)
        sizes = np.where(bad, 0, [1 + len(u) if u.isascii() else 1 + len(u.encode()) for u in new])
        self._merge(np.array(a_ids, np.int64), np.array(b_ids, np.int64), sizes, bad)

    def _merge(self, a_ids: np.ndarray, b_ids: np.ndarray, sizes: np.ndarray, bad: np.ndarray) -> None:
        unit_ends = np.cumsum(sizes)
        a_ends, b_ends = np.cumsum(self.sides.a_size[a_ids]), np.cumsum(self.sides.b_size[b_ids])
        ends = common_ends(a_ends, b_ends)
        unit = np.searchsorted(unit_ends, ends)  # of each group
        a_group, b_group = np.searchsorted(ends, a_ends), np.searchsorted(ends, b_ends)
        a_first, b_first = np.searchsorted(a_group, np.arange(len(ends) + 1)), np.searchsorted(b_group, np.arange(len(ends) + 1))
        na, nb, n = np.diff(a_first), np.diff(b_first), len(sizes)
        per_unit = lambda c: np.bincount(unit, c, n).astype(np.int64)
        self.figures = np.vstack([self.figures, np.stack([bad, per_unit(na), per_unit(nb), np.bincount(unit, minlength=n), per_unit(na * nb)], 1)])
        group, keys, times = group_links(a_ids, a_first, b_ids, b_first)
        order = np.argsort(unit[group], kind="stable")
        lengths = np.bincount(unit[group], minlength=n)
        self.keys.extend_flat(keys[order], lengths)
        self.times.extend_flat(times[order], lengths)
        # the digest text of all units at once, then cut: each token's number behind its mark
        place = np.concatenate([np.arange(len(a_ids)) + b_first[a_group], np.arange(len(b_ids)) + a_first[b_group + 1]])
        marks = np.full(len(place), 0)
        marks[np.arange(len(a_ids))[a_first[:-1]]] = 1
        marks[len(a_ids) + np.arange(len(b_ids))[b_first[:-1]]] = 2
        order = np.argsort(place)
        ids, marks = np.concatenate([a_ids, b_ids])[order], marks[order]
        tables = (self.digits, self.opens, self.bars)
        joined = b"".join([tables[m][i] for m, i in zip(marks.tolist(), ids.tolist(), strict=True)])
        of_unit = unit[np.concatenate([a_group, b_group])[order]]
        cuts = np.concatenate([[0], np.cumsum(np.bincount(of_unit, self.digit_size[ids], n))]).astype(np.int64).tolist()
        self.text += [joined[x + 1 : y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


@functools.cache
def unit_groups(byte_bpe: str, piece_bpe: str) -> UnitGroups:
    """One for each Python worker, which keeps it from task to task."""
    return UnitGroups(Sides(byte_bpe, piece_bpe))


FIGURES = ["n_a", "n_b", "n_groups", "n_links"]


def align_batch(known: UnitGroups, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(four figures of each text, digests, first pair of each text, pair keys, times linked)"""
    figures, digests = np.zeros((len(texts), 5), np.int64), [None] * len(texts)
    rows, keys, times = [], [], []
    for row, found in unit_slices(texts):
        numbers = known.table.numbers(found)
        edges = np.flatnonzero(np.diff(row, prepend=-1, append=len(texts)))
        figures[row[edges[:-1]]] += np.add.reduceat(known.figures[numbers], edges[:-1])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            part = b";".join([known.text[n] for n in numbers[a:b].tolist()])
            if (held := digests[row[a]]) is None:
                digests[row[a]] = held = hashlib.sha256()
            else:
                part = b";" + part
            held.update(part)
        same, often = np.unique(row * len(known.text) + numbers, return_counts=True)
        unit = same % len(known.text)
        n = known.keys.lengths(unit)
        rows.append(np.repeat(same // len(known.text), n))
        keys.append(known.keys.take(unit))
        times.append(known.times.take(unit) * np.repeat(often, n))
    rows, keys, times = (np.concatenate([*x, np.empty(0, np.int64)]) for x in (rows, keys, times))
    good = figures[:, 0] == 0
    figures[~good] = 0
    rows, keys, times = (x[good[rows]] for x in (rows, keys, times))
    order = np.lexsort((keys, rows))
    rows, keys, times = rows[order], keys[order], times[order]
    first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])][: len(rows)])
    times = np.add.reduceat(times, first) if len(first) else times
    rows, keys = rows[first], keys[first]
    return figures[:, 1:], [d.hexdigest() if d and ok else "" for d, ok in zip(digests, good, strict=True)], np.searchsorted(rows, np.arange(len(texts) + 1)), keys, times


def _align(byte_bpe: str, piece_bpe: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = unit_groups(byte_bpe, piece_bpe), TaskContext.get().partitionId() << 33
        for batch in batches:
            figures, digests, first, keys, times = align_batch(known, batch.column("text").to_pylist())
            n = batch.num_rows
            lists = [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (keys >> 32, keys & 0xFFFFFFFF)]
            lists.append(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(times)))
            columns = [batch.column("doc_id"), pa.array(number + np.arange(n)), *(pa.array(np.ascontiguousarray(c)) for c in figures.T), pa.array(digests, pa.string()), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", *FIGURES, "groups_sha256", "a", "b", "times"])
            number += n

    return run


def aligned_rows(docs: DataFrame, scratch: Scratch, *, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Figures of each row, and its distinct linked pairs as arrays ``a``, ``b`` and ``times``."""
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    with arrow_rows(docs.sparkSession, 256):
        rows = given.mapInArrow(_align(byte_bpe, piece_bpe), f"doc_id {kind}, row long, {', '.join(f'{c} long' for c in FIGURES)}, groups_sha256 string, a array<int>, b array<int>, times array<long>")
        return scratch.keep(rows, "rows")


def pair_counts(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Each linked pair with the number of rows that hold it and each side's largest such number."""
    counts = scratch.keep(rows.select(F.explode(F.arrays_zip("a", "b")).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("docs")), "counts")
    for side in ("a", "b"):
        most = counts.groupBy(side).agg(F.max("docs").alias(f"{side}_most"))
        counts = counts.join(F.broadcast(most) if most.count() <= BROADCAST_IDS else most, side)
    return counts.select("a", "b", "docs", "a_most", "b_most")


def frequent_from(counts: DataFrame, most: int) -> int:
    """The least power of two such that at most ``most`` pairs are in so many rows or more."""
    levels = counts.groupBy(F.floor(F.log2("docs")).alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()  # 64 rows at most
    left = 0
    for level, n in sorted(((r.level, r.n) for r in levels), reverse=True):
        left += n
        if left > most:
            return 1 << (level + 1)
    return 0


def align(docs: DataFrame, *, frequent_pairs: int = FREQUENT_PAIRS, **options: str) -> DataFrame:
    """One row a document: its figures, and what the corpus-wide counts say about its links."""
    scratch = Scratch(docs.sparkSession, "alignment")
    rows = aligned_rows(docs, scratch, **options)
    counts = scratch.keep(pair_counts(rows, scratch).select("a", "b", "docs", (F.col("docs") == F.col("a_most")).alias("best")), "best")
    scratch.drop("counts")
    base = ["row", "doc_id", *FIGURES, "groups_sha256"]
    exploded = rows.select(*base, F.explode_outer(F.arrays_zip("a", "b", "times")).alias("p")).select(*base, "p.a", "p.b", "p.times")
    sums = [F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum")]
    limit = frequent_from(counts, frequent_pairs)
    met = exploded.join(F.broadcast(counts.where(F.col("docs") >= limit)), ["a", "b"], "left")
    found = met.groupBy(*base).agg(*sums)
    if limit:
        left = met.where(F.col("docs").isNull() & F.col("a").isNotNull()).drop("docs", "best")
        rare = left.join(counts.where(F.col("docs") < limit).hint("merge"), ["a", "b"]).groupBy(*base).agg(*sums)
        found = found.unionByName(rare).groupBy(*base).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return found.select("doc_id", *FIGURES, *zero, "groups_sha256")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' byte-level BPE tokens aligned with their sentencepiece tokens."""
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("doc_id", F.col("doc_id").cast("long"))
