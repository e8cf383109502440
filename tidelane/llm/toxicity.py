"""Toxicity by subword-bag embeddings under a linear softmax.

A word is the bag of its hashed character n-grams (3 to 6 bytes, with word edges) and itself, so an
unseen misspelling shares most vectors with the word it distorts.  A passage of ``width`` words is
the average of all its subword vectors; a linear softmax over that average gives the classes.  The
embeddings and the softmax are trained jointly in numpy, the embeddings by plain steps and the softmax by
AdaGrad.  A text is as toxic as its most
toxic passage; in training, each round picks every text's most suspicious passage under the model so
far, so labels of whole texts suffice.

Training texts are a bounded sample (``max_train_docs`` rows and ``max_train_bytes`` of text, by a hash
of the id) of labelled rows; texts above a sixteenth of these bytes are passed over, and if that leaves none, ``ValueError`` says so.  Scoring is a map over all rows without a shuffle.  As the model is linear in subword vectors, scoring
keeps one number for each bucket.

Defined results: null, empty and wordless texts get the score of an empty bag (the bias alone) and
are never predicted toxic; repeated rows score alike; without both labels all scores are the labelled
share (0 without labels); of texts that share an id the one with the least hash is learned from; very
long texts are scored whole; columns of the input that clash with results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelane.llm.storage import give_back, memory_returned
from tidelane.llm.textkernel import U64, TextKernel, Words, mix64, text_slices

MAX_TRAIN_DOCS = 4000
MAX_TRAIN_BYTES = 64 << 20
#: A text larger than this part of the bytes is not learned from.
TEXT_SHARE = 16


@dataclass(frozen=True)
class BagSettings:
    buckets: int = 1 << 18
    dim: int = 8
    shortest: int = 3
    longest: int = 6
    width: int = 6
    stride: int = 3
    rounds: int = 14
    rate: float = 0.5
    batch: int = 128
    min_docs: int = 3
    decay: float = 0.003
    scale: float = 300.0
    dropout: float = 0.5
    seed: int = 11


@dataclass
class ToxicModel:
    """Per bucket, the difference of the softmax's class weights along its vector; and the bias."""

    settings: BagSettings
    weight: np.ndarray
    bias: float


def subwords(kernel: TextKernel, words: Words, pick: np.ndarray, settings: BagSettings) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index into ``pick``) of all subwords of the picked words."""
    size = words.end[pick] - words.start[pick]
    padded = size + 2
    at = np.concatenate([[0], np.cumsum(padded)])
    buf = np.full(int(at[-1]), 0x3C, np.uint8)
    buf[at[1:] - 1] = 0x3E
    place = np.arange(int(size.sum())) + np.repeat(2 * np.arange(len(pick)) + 1, size)
    source = np.arange(int(size.sum())) + np.repeat(words.start[pick] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    buf[place] = words.buf[source]
    owner = np.repeat(np.arange(len(pick)), padded)
    ends = np.repeat(at[1:], padded)
    buckets, owners = [], []
    code = kernel.codes[buf]
    h = np.zeros(len(buf), U64)
    for n in range(1, settings.longest + 1):
        if n > len(buf):
            break
        h = (h[: len(buf) - n + 1] ^ code[n - 1 :]) * U64(0x9FB21C651E98DF25)
        h ^= h >> U64(31)
        if n >= settings.shortest:
            ok = np.flatnonzero(np.arange(len(h)) + n <= ends[: len(h)])
            buckets.append(mix64(h[ok] + U64(n)) % U64(settings.buckets))
            owners.append(owner[ok])
    buckets.append(mix64(kernel.span_hashes(words.buf, words.start[pick], words.end[pick])) % U64(settings.buckets))
    owners.append(np.arange(len(pick)))
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


def word_bags(kernel: TextKernel, words: Words, settings: BagSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct word of each word, buckets, distinct word of each bucket)."""
    _, first, inverse = np.unique(kernel.word_hashes(words), return_index=True, return_inverse=True)
    return inverse, *subwords(kernel, words, first, settings)


def passages(first: np.ndarray, width: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, last word + 1) of overlapping passages; each text with a word has one at least."""
    n = np.diff(first)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - width) // stride)), 0)
    doc = np.repeat(np.arange(len(n)), count)
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    start = first[:-1][doc] + np.minimum(nth * stride, np.maximum(0, n[doc] - width))
    return doc, start, np.minimum(start + width, first[1:][doc])


def best_passages(doc: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Index of each text's first passage with the highest score."""
    order = np.lexsort((np.arange(len(doc)), -score, doc))
    new = np.ones(len(order), bool)
    new[1:] = doc[order[1:]] != doc[order[:-1]]
    return order[new]


def train(texts: pa.Array, labels: np.ndarray, settings: BagSettings = BagSettings()) -> ToxicModel:
    """Fit embeddings and softmax to texts labelled 0 or 1."""
    share = float(labels.mean()) if len(labels) else 0.0
    if not 0 < share < 1:
        odds = -20.0 if share == 0 else 20.0
        return ToxicModel(settings, np.zeros(settings.buckets, np.float32), odds)
    kernel = TextKernel("symbol", lower=True)
    hashes, counts, known, bags, sizes_of = [], [], np.zeros(0, U64), [], []
    for _, _, buf, offsets in text_slices(texts):  # subwords are kept once for each distinct word
        words = kernel.cut(buf, offsets)
        h = kernel.word_hashes(words)
        hashes.append(h)
        counts.append(np.diff(words.first))
        value, first_at = np.unique(h, return_index=True)
        new = ~np.isin(value, known)
        b, owner = subwords(kernel, words, first_at[new], settings)
        order = np.argsort(owner, kind="stable")
        bags.append(b[order].astype(np.int32))
        sizes_of.append(np.bincount(owner, minlength=int(new.sum())))
        known = np.concatenate([known, value[new]])
    rank = np.argsort(known)
    inverse = rank[np.searchsorted(known, np.concatenate(hashes), sorter=rank)].astype(np.int32)
    del hashes
    n_words = np.concatenate(counts)
    first = np.concatenate([[0], np.cumsum(n_words)])
    bucket = np.concatenate(bags)
    per_word = np.concatenate(sizes_of).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(per_word)])
    runs = [(a, min(a + 50_000, len(per_word))) for a in range(0, len(per_word), 50_000)]  # of distinct words, to bound memory
    doc, start, end = passages(first, settings.width, settings.stride)
    sums = lambda x: np.concatenate([[0.0], np.cumsum(x[inverse])])
    sizes = sums(per_word)
    size = sizes[end] - sizes[start]
    # the first round's passages: words that stand in more texts of class 1 than chance has it
    pairs = np.unique(inverse * np.int64(len(labels)) + np.repeat(np.arange(len(labels)), n_words))
    seen, by = pairs // len(labels), labels[pairs % len(labels)] == 1
    hits, texts_with = np.bincount(seen[by], minlength=len(per_word)), np.bincount(seen, minlength=len(per_word))
    excess = (hits - share * texts_with) / np.sqrt(share * texts_with + 1)
    total = sums(np.maximum(excess, 0) ** 2)
    score = total[end] - total[start]
    rng = np.random.default_rng(settings.seed)
    # subwords of fewer than min_docs texts tell nothing about others; their vectors stay 0
    in_texts = np.zeros(settings.buckets)
    for a, b in runs:
        in_texts += np.bincount(bucket[begin[a] : begin[b]], np.repeat(texts_with[a:b], per_word[a:b]), settings.buckets)
    common = in_texts >= settings.min_docs
    emb = (rng.random((settings.buckets, settings.dim)) - 0.5) / settings.dim * common[:, None]
    soft, bias = rng.normal(0, 0.5, (settings.dim, 2)), np.log(np.array([1 - share, share]))
    g_soft, g_bias = np.full((settings.dim, 2), 1e-8), np.full(2, 1e-8)
    for _ in range(settings.rounds):
        chosen = best_passages(doc, score)
        negatives = chosen[labels[doc[chosen]] == 0]
        spare = rng.choice(len(doc), min(len(doc), len(negatives) // 2), replace=False)
        chosen = rng.permutation(np.concatenate([chosen, spare[labels[doc[spare]] == 0]]))
        for i in range(0, len(chosen), settings.batch):
            rows = chosen[i : i + settings.batch]
            length = end[rows] - start[rows]
            word = inverse[np.arange(int(length.sum())) + np.repeat(start[rows] - (np.cumsum(length) - length), length)]
            count = per_word[word]
            b = bucket[np.arange(int(count.sum())) + np.repeat(begin[word] - (np.cumsum(count) - count), count)]
            owner_row = np.repeat(np.repeat(np.arange(len(rows)), length), count)
            left = rng.random(len(b)) >= settings.dropout
            b, owner_row = b[left], owner_row[left]
            used, local = np.unique(b, return_inverse=True)
            n = np.maximum(1, np.bincount(owner_row, minlength=len(rows)))
            vectors = emb[used]
            mean = np.stack([np.bincount(owner_row, vectors[local, d], len(rows)) for d in range(settings.dim)], 1) / n[:, None]
            logits = mean @ soft + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), labels[doc[rows]]] -= 1
            d_mean = (p @ soft.T) / n[:, None]
            d_soft, d_bias = mean.T @ p / len(rows), p.mean(0)
            d_emb = np.stack([np.bincount(local, d_mean[owner_row, d], len(used)) for d in range(settings.dim)], 1)
            emb[used] -= settings.rate * (settings.scale * d_emb + settings.decay * vectors) * common[used, None]
            g_soft += d_soft**2
            soft -= 0.1 * settings.rate * d_soft / np.sqrt(g_soft)
            g_bias += d_bias**2
            bias -= 0.1 * settings.rate * d_bias / np.sqrt(g_bias)
        line = emb @ (soft[:, 1] - soft[:, 0])
        total = sums(np.concatenate([np.add.reduceat(line[bucket[begin[a] : begin[b]]], begin[a:b] - begin[a]) for a, b in runs]))
        score = (total[end] - total[start]) / size
    return ToxicModel(settings, line.astype(np.float32), float(bias[1] - bias[0]))


def score_texts(kernel: TextKernel, model: ToxicModel, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The probability of class 1 of each text of a slice."""
    s, words = model.settings, kernel.cut(buf, offsets)
    logit = np.full(len(offsets) - 1, min(model.bias, -1e-9) if abs(model.bias) < 20 else model.bias)
    if len(words.start):
        inverse, bucket, owner = word_bags(kernel, words, s)
        n = int(inverse.max()) + 1
        total = np.concatenate([[0.0], np.cumsum(np.bincount(owner, model.weight[bucket], n)[inverse])])
        sizes = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n)[inverse])])
        doc, start, end = passages(words.first, s.width, s.stride)
        value = np.round((total[end] - total[start]) / (sizes[end] - sizes[start]), 6) + model.bias
        best = np.full(len(offsets) - 1, -np.inf)
        np.maximum.at(best, doc, value)
        logit = np.where(np.isfinite(best), best, logit)
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def in_training(doc_id: Column) -> Column:
    """Rows whose label may be learned: crc32 of the id as text, modulo 5, is not 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 != 0


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, max_train_docs: int = MAX_TRAIN_DOCS, max_train_bytes: int = MAX_TRAIN_BYTES, settings: BagSettings = BagSettings()) -> ToxicModel:
    """Train on labelled rows outside the held-out fifth, in the order of a hash of the id, up to the bounds."""
    known = labels.where("toxic is not null and doc_id is not null").where(in_training(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_docs)
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    heads = texts.select("doc_id", "h", "size").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("h", "size")).alias("x"), F.max("toxic").alias("toxic"))
    fitting = heads.where(F.col("x.size") * TEXT_SHARE <= max_train_bytes).select("doc_id", "x.h", "x.size", "toxic")
    upto = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # max_train_docs narrow rows at most
    taken = fitting.withColumn("upto", upto).where(F.col("upto") <= max_train_bytes).select("doc_id", "h", "toxic")
    rows = texts.join(F.broadcast(taken), ["doc_id", "h"]).groupBy("doc_id").agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    table = rows.orderBy("doc_id").select("text", "toxic").toArrow()
    if not table.num_rows and heads.limit(1).count():
        raise ValueError(f"labelled texts exist, but none is of max_train_bytes / {TEXT_SHARE} at most")
    give_back(at_once=1 << 20)
    model = train(table.column("text").combine_chunks(), table.column("toxic").to_numpy().astype(np.int64), settings)
    del table
    give_back()  # training runs at the driver, on a bounded sample
    return model


def add_toxicity(docs: DataFrame, model: ToxicModel, *, text_col: str = "text", score_col: str = "score", keep_text: bool = True) -> DataFrame:
    """Add the score to every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model.weight)  # 4 bytes a bucket
    settings, bias = model.settings, model.bias
    passed = [f for f in docs.schema.fields if f.name != score_col and (keep_text or f.name != text_col)]
    names = [f.name for f in passed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel, held = TextKernel("symbol", lower=True), ToxicModel(settings, shared.value, bias)
        for batch in batches:
            for a, b, buf, offsets in text_slices(batch.column(text_col)):
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([rows.column(n) for n in names] + [pa.array(score_texts(kernel, held, buf, offsets))], names=[*names, score_col])

    columns = names if text_col in names else [*names, text_col]
    return docs.select(*columns).mapInArrow(memory_returned(run), T.StructType([*passed, T.StructField(score_col, T.DoubleType())]))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, **options) -> DataFrame:
    """``docs`` without the rows scored at or above ``threshold``."""
    score = "__score"
    while score in docs.columns:
        score += "_"
    return add_toxicity(docs, fit_toxicity(docs, labels, **options), score_col=score).where(F.col(score) < threshold).drop(score)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents for toxicity."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = add_toxicity(docs, model, keep_text=False)
    return scored.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
