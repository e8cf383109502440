"""Quality rules with suffix-array repetition.

Base figures of each whole text are counted on its bytes.  The method's verdict comes from a suffix
array over the words of each text, sparse at first (only suffixes whose first five words occur twice
in the text), sorted by prefix doubling.  Adjacent suffixes' longest common prefixes bound the LCP
intervals, whose substrings are the maximal repeats; every occurrence's longest repeat is the larger
of its two neighbours' prefixes.  The spans of repeats of ``min_repeat`` words or more are united; a
text is rejected when they cover more than ``max_covered`` of it or when one repeat is longer than
``max_longest`` words.  (Words of these spans are repeated words of the base rule, too, so ``max_covered``
decides below that rule's share of a fifth.)

A map over Arrow batches: no shuffle, memory bounded by a slice of texts or one text.  Defined
results: null or blank texts have zeros everywhere and fail the base rule; repeated rows are judged
each; repeats that tie in length all count; very long texts are judged whole; an empty table gives no
rows; columns of the input that clash with results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidelane.llm.textkernel import TextKernel, Words, covered, dense_ranks, mix64, sums_by_text, text_slices, window_hashes

SYMBOLS = b"#*$%&|<>"
RESULTS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "covered_words": "long", "longest_repeat": "long"}


@dataclass(frozen=True)
class RepetitionLimits:
    min_repeat: int = 10
    max_covered: float = 0.1
    max_longest: int = 50


def dup_lines(kernel: TextKernel, words: Words) -> np.ndarray:
    """Lines with a word that equal an earlier line, by text."""
    breaks = np.flatnonzero(words.buf == 0x0A)
    size = len(words.buf)
    edges = np.unique(np.concatenate([words.offsets, breaks, breaks + 1]))
    start, end = edges[:-1], edges[1:]
    full = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end = start[full], end[full]
    n = len(words.offsets) - 1
    if not size or not len(start):
        return np.zeros(n, np.int64)
    doc = np.searchsorted(words.offsets, start, "right") - 1
    ranks, counts = dense_ranks(doc, kernel.span_hashes(words.buf, start, end))
    once = np.zeros(len(counts), np.int64)
    once[ranks] = doc
    return np.bincount(doc, minlength=n) - np.bincount(once, minlength=n)


def longest_repeats(h: np.ndarray, words: Words, seeds: np.ndarray, k: int) -> np.ndarray:
    """For each suffix at ``seeds`` the length in words of its longest repeat in the same text.

    ``seeds`` are all positions whose window of k words occurs twice in its text.
    """
    doc, ends = words.doc, np.repeat(words.first[1:], np.diff(words.first))
    after = seeds + k
    after = after[(after < len(h)) & (ends[np.minimum(after, len(h) - 1)] == ends[seeds])]
    at = np.union1d(seeds, after)
    padded = np.concatenate([h, np.zeros(k, h.dtype)])
    keys = [np.where(at + j < ends[at], padded[at + j], 0) for j in range(k)]
    rank, counts = dense_ranks(doc[at], *keys)
    index = np.full(len(h) + 1, -1)
    index[at] = np.arange(len(at))
    levels, step = [rank], k
    while (counts > 1).any():
        to = at + step
        inside = to < ends[at]
        nxt = np.full(len(at), -1)
        found = index[np.where(inside, to, len(h))]
        nxt[found >= 0] = rank[found[found >= 0]]
        refined, counts2 = dense_ranks(rank, nxt)
        # a suffix that ends, or whose rest is in no repeat, shares no class beyond this level
        lone = (found < 0) & (counts2[refined] > 1)
        if lone.any():
            refined, counts2 = dense_ranks(refined, np.where(lone, np.arange(len(at)), -1))
        if len(counts2) == len(counts):
            break
        rank, counts, step = refined, counts2, step * 2
        levels.append(rank)
    order = np.argsort(rank, kind="stable")
    a, b = at[order[:-1]], at[order[1:]]
    lcp, live = np.zeros(len(a), np.int64), doc[a] == doc[b]
    for level in range(len(levels) - 1, -1, -1):
        width = k << level
        i, j = index[np.minimum(a + lcp, len(h))], index[np.minimum(b + lcp, len(h))]
        same = live & (i >= 0) & (j >= 0) & (a + lcp < ends[a]) & (b + lcp < ends[b])
        same &= levels[level][i] == levels[level][j]
        lcp += width * same
    for _ in range(k - 1):
        i, j = np.minimum(a + lcp, len(h) - 1), np.minimum(b + lcp, len(h) - 1)
        lcp += live & (a + lcp < ends[a]) & (b + lcp < ends[b]) & (h[i] == h[j])
        live = live & (h[i] == h[j])
    best = np.zeros(len(at), np.int64)
    np.maximum.at(best, order[:-1], lcp)
    np.maximum.at(best, order[1:], lcp)
    return best[index[seeds]]


def rule_figures(kernel: TextKernel, buf: np.ndarray, offsets: np.ndarray, limits: RepetitionLimits) -> dict[str, np.ndarray]:
    """All result columns for a slice of texts."""
    words = kernel.cut(buf, offsets)
    n_docs, n_words = len(offsets) - 1, np.diff(words.first)
    symbols = np.zeros(256, bool)
    symbols[list(SYMBOLS)] = True
    chars = ~kernel.separators[words.buf] & ((words.buf & 0xC0) != 0x80)
    h, doc = kernel.word_hashes(words), words.doc
    at, g = window_hashes(h, words.first, 5)
    g ^= mix64(doc[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(g)
    s = g[order]
    twice = np.zeros(len(s), bool)
    twice[1:] = s[1:] == s[:-1]
    twice[:-1] |= twice[1:]
    seeds = np.sort(at[order[twice]])
    repeat_words = sums_by_text(covered(seeds, 5, len(h)), words.first)
    longest, cover = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
    if len(seeds):
        length = longest_repeats(h, words, seeds, 5)
        np.maximum.at(longest, doc[seeds], length)
        long = length >= limits.min_repeat
        cover = sums_by_text(covered(seeds[long], length[long], len(h)), words.first)
    failed = (n_words < 10) | (100 * repeat_words > 20 * n_words)
    fine = (cover <= limits.max_covered * n_words) & (longest <= limits.max_longest)
    return {
        "n_words": n_words, "word_chars": sums_by_text(chars, offsets), "n_symbols": sums_by_text(symbols[words.buf], offsets), "n_dup_lines": dup_lines(kernel, words),
        "n_repeat_words": repeat_words, "base_failed": failed, "kept": ~failed & fine, "covered_words": cover, "longest_repeat": longest,
    }


def apply_quality_rules(docs: DataFrame, limits: RepetitionLimits = RepetitionLimits(), *, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Add the rule figures and the verdict ``kept`` to every row."""
    passed = [f for f in docs.schema.fields if f.name not in RESULTS and (keep_text or f.name != text_col)]
    names = [f.name for f in passed]
    kinds = {"long": T.LongType(), "boolean": T.BooleanType()}
    schema = T.StructType(passed + [T.StructField(k, kinds[v]) for k, v in RESULTS.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = TextKernel("space")
        for batch in batches:
            for a, b, buf, offsets in text_slices(batch.column(text_col)):
                found = rule_figures(kernel, buf, offsets, limits)
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([rows.column(n) for n in names] + [pa.array(found[k]) for k in RESULTS], names=names + list(RESULTS))

    columns = names if text_col in names else [*names, text_col]
    return docs.select(*columns).mapInArrow(run, schema)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdicts of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return apply_quality_rules(docs, keep_text=False).select("doc_id", *RESULTS)
