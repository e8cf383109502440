"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is of order 5 over the bytes of UTF-8 text, all 256 of them.  No table of it is ever collected
or broadcast; what a scoring run gathers grows with the distinct n-grams of the corpus.

1.  Map tasks count the n-grams of trusted documents (all but every fifth, which is kept for the
    thresholds); counts are summed in shards by n-gram.
2.  Modified Kneser-Ney statistics are sharded joins of count tables: discounts from counts of counts,
    an n-gram's discounted share by joining its context's total, interpolation by joining the probability of its
    rest, continuation counts for the lower orders.  A context has 256 continuations at most, an
    n-gram 256 predecessors, so no group of these joins is hot.
3.  The texts of one file split form a chunk.  A chunk asks for each of its distinct n-grams once, however
    often it has it; questions travel as packed sorted blobs to the shard of the n-gram, meet
    the sharded tables there, and the answers go back to the chunk, where they are summed for each document.
4.  A document is kept when its perplexity is between a low and a high quantile of the trusted
    documents of its language that the model has not seen (with a margin); languages without such
    documents use those of all languages.  The low bound does not hold for texts that the model was trained on, nor
    for their copies, as their own counts lower their perplexity.

Defined results: null texts and texts of fewer than five bytes have no perplexity and are not kept;
a null language is a language of its own; rows without a doc_id are scored but never trusted; repeated
rows score alike; very long texts are scored whole; without trusted text every scorable document is kept; an
empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm.storage import Scratch, arrow_rows, has_files, shard_count
from tidelane.llm.textkernel import text_slices

ORDER = 5
#: A key is an n-gram's bytes with its order above them.
ORDER_AT = 8 * ORDER
#: Raw bytes of a file split that form one chunk.
CHUNK_BYTES = 16 << 20
#: Trusted ids (8 bytes each) that are broadcast at most; beyond, they meet their texts by shuffle.
BROADCAST_IDS = 2_000_000
FOLDS = 5


@dataclass(frozen=True)
class Limits:
    low: float = 0.005
    high: float = 0.99
    margin: float = 0.05


def byte_runs(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all runs of ``ORDER`` bytes inside one text, the text of each)."""
    n = len(buf) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.zeros(n, np.int64)
    for j in range(ORDER):
        code <<= 8
        code |= buf[j : j + n]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = doc[:n] == doc[ORDER - 1 :]
    return code[inside], doc[:n][inside]


def merged(parts: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)


def lower_orders(codes: np.ndarray) -> list[np.ndarray]:
    """The distinct n-grams of order 0 to ``ORDER`` that the full ones contain."""
    tables = [codes]
    for k in range(ORDER - 1, -1, -1):
        tables.append(merged([tables[-1] >> 8, tables[-1] & ((1 << 8 * k) - 1)]))
    return tables[::-1]


def shards_of(keys: np.ndarray, shards: int) -> list[np.ndarray]:
    """Where the keys of each shard are."""
    shard = keys % shards
    order = np.argsort(shard, kind="stable")
    return np.split(order, np.searchsorted(shard[order], np.arange(1, shards)))


def keyed(tables: list[np.ndarray]) -> np.ndarray:
    """The keys of the n-grams of all orders, ascending."""
    return np.concatenate([t | k << ORDER_AT for k, t in enumerate(tables)])


def count_runs(trusted: DataFrame) -> DataFrame:
    """(code, c) of all n-grams of the trusted texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for _, _, buf, offsets in text_slices(batch.column("text")):
                value, n = np.unique(byte_runs(buf, offsets)[0], return_counts=True)
                codes, back = np.unique(np.concatenate([codes, value]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([counts, n]), len(codes)).astype(np.int64)
        for a in range(0, len(codes), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(codes[a : a + 100_000]), pa.array(counts[a : a + 100_000])], names=["code", "c"])

    return trusted.select("text").mapInArrow(run, "code long, c long").groupBy("code").agg(F.sum("c").alias("c"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """D1, D2 and D3+ from the counts of counts (Chen and Goodman); plain values where those are too few."""
    n1, n2, n3, n4 = counts.agg(*[F.coalesce(F.sum((F.col("c") == k).cast("long")), F.lit(0)) for k in (1, 2, 3, 4)]).first()
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d1, d2 = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else 0.9
    return tuple(float(min(max(d, 0.05), k)) for d, k in ((d1, 1), (d2, 2), (d3, 3)))  # type: ignore[return-value]


def low_bits(code: Column, order: int) -> Column:
    return code.bitwiseAND(F.lit((1 << 8 * order) - 1))


def kneser_ney(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, p, gamma): the probability of each seen n-gram's last byte after the others, and the mass that
    its continuations leave for the lower order (null where it has none)."""
    by_order = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: in how many different contexts the rest was seen
        rest = low_bits(F.col("code"), k)
        by_order[k] = scratch.keep(by_order[k + 1].groupBy(rest.alias("code")).agg(F.count(F.lit(1)).alias("c")), f"counts{k}")
    lower, model = None, None
    for k in range(1, ORDER + 1):
        d1, d2, d3 = discounts(by_order[k])
        cut = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        context = F.shiftright("code", 8)
        totals = scratch.keep(by_order[k].groupBy(context.alias("ctx")).agg(F.sum("c").alias("total"), (F.sum(cut) / F.sum("c")).alias("gamma")), f"totals{k}")
        shares = by_order[k].join(totals, context == F.col("ctx")).select("code", "gamma", ((F.col("c") - cut) / F.col("total")).alias("alpha"))
        if lower is None:
            p = shares.select("code", (F.col("alpha") + F.col("gamma") / 256).alias("p"))
            model = totals.select(F.lit(0).cast("long").alias("key"), F.lit(None).cast("double").alias("p"), "gamma")
        else:
            p = shares.join(lower.select(F.col("code").alias("rest"), F.col("p").alias("q")), low_bits(F.col("code"), k - 1) == F.col("rest"))
            p = p.select("code", (F.col("alpha") + F.col("gamma") * F.col("q")).alias("p"))
            known = lower.join(totals.select(F.col("ctx").alias("code"), "gamma"), "code", "left")
            model = model.unionByName(known.select((F.col("code") + (k - 1 << ORDER_AT)).alias("key"), "p", "gamma"))
        lower = scratch.keep(p, f"p{k}")
    return model.unionByName(lower.select((F.col("code") + (ORDER << ORDER_AT)).alias("key"), "p", F.lit(None).cast("double").alias("gamma")))


def _answers(questions: pa.Table, model: pa.Table) -> pa.Table:
    """For each question (a chunk's sorted keys in the shard) the probabilities and masses, as bytes; those unknown are NaN."""
    key = model.column("key").to_numpy()
    order = np.argsort(key)
    key = key[order]
    values = [np.concatenate([model.column(c).to_numpy(zero_copy_only=False)[order].astype(np.float32), [np.float32(np.nan)]]) for c in ("p", "gamma")]
    rows: list[list[bytes]] = [[], []]
    for blob in questions.column("keys"):
        asked = np.frombuffer(blob.as_buffer(), np.int64)
        at = np.searchsorted(key, asked)
        at[at < len(key)] = np.where(key[at[at < len(key)]] == asked[at < len(key)], at[at < len(key)], len(key))
        for out, v in zip(rows, values):
            out.append(v[at].tobytes())
    return pa.table({"chunk": questions.column("chunk"), "shard": questions.column("shard"), "p": pa.array(rows[0], pa.binary()), "gamma": pa.array(rows[1], pa.binary())})


def _chunk_codes(texts: pa.ChunkedArray) -> np.ndarray:
    held: list[np.ndarray] = []
    for _, _, buf, offsets in text_slices(texts):
        held.append(np.unique(byte_runs(buf, offsets)[0]))
        if len(held) == 16:
            held = [merged(held)]
    return merged(held)


def log_probabilities(tables: list[np.ndarray], p: np.ndarray, gamma: np.ndarray) -> np.ndarray:
    """Natural log probability of each full n-gram, from the answers for the keys of all orders (NaN: unknown)."""
    begin = np.cumsum([0, *[len(t) for t in tables]])
    part = lambda v, k: v[begin[k] : begin[k + 1]].astype(np.float64)
    below = np.full(1, 1 / 256)
    for k in range(1, len(tables)):
        mass = part(gamma, k - 1)[np.searchsorted(tables[k - 1], tables[k] >> 8)]
        rest = below[np.searchsorted(tables[k - 1], tables[k] & ((1 << 8 * (k - 1)) - 1))]
        seen = part(p, k)
        below = np.where(np.isnan(seen), np.where(np.isnan(mass), 1.0, mass) * rest, seen)
    return np.log(below)


def _scores(docs: pa.Table, answers: pa.Table, shards: int) -> pa.Table:
    """(doc_id, lang, h, n: n-grams, ll: sum of log probabilities) of the documents of a chunk."""
    codes = _chunk_codes(docs.column("text"))
    tables = lower_orders(codes)
    keys = keyed(tables) if len(codes) else np.zeros(0, np.int64)
    p, gamma = np.full(len(keys), np.nan, np.float32), np.full(len(keys), np.nan, np.float32)
    where = shards_of(keys, shards)
    for shard, *blobs in zip(*(answers.column(c).to_pylist() for c in ("shard", "p", "gamma"))):
        for out, blob in zip((p, gamma), blobs):
            out[where[shard]] = np.frombuffer(blob, np.float32)
    log_p = np.round(log_probabilities(tables, p, gamma), 6) if len(codes) else np.zeros(0)
    n, ll = [], []
    for a, b, buf, offsets in text_slices(docs.column("text")):
        code, doc = byte_runs(buf, offsets)
        n.append(np.bincount(doc, minlength=b - a))
        ll.append(np.bincount(doc, log_p[np.searchsorted(codes, code)], b - a))
    return pa.table({"doc_id": docs.column("doc_id"), "lang": docs.column("lang"), "h": docs.column("h"), "n": pa.array(np.concatenate(n) if n else [], pa.int64()), "ll": pa.array(np.concatenate(ll) if ll else [], pa.float64())})


def add_log_likelihood(docs: DataFrame, model: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, lang, h, n, ll) of every row of ``docs`` (doc_id, lang, text); ``h`` is a hash of the text."""
    spark = docs.sparkSession
    if not has_files(docs):
        docs = scratch.keep(docs, "docs")  # chunks need rows that stay where they are
    shards = shard_count(docs) | 1  # odd: keys of all shapes spread
    split_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    parts = max(1, split_bytes // CHUNK_BYTES)
    chunk = F.xxhash64(F.input_file_name(), F.input_file_block_start(), F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts))).alias("chunk")
    rows = docs.select("doc_id", "lang", "text", F.xxhash64("text").alias("h"), chunk)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            ids = batch.column("chunk").to_numpy()
            for c in np.unique(ids).tolist():
                mine = held.setdefault(c, [])
                mine.append(_chunk_codes(batch.column("text").filter(pa.array(ids == c))))
                if len(mine) == 16:
                    held[c] = [merged(mine)]
        for c in list(held):
            codes = merged(held.pop(c))
            if len(codes):
                keys = keyed(lower_orders(codes))
                where = shards_of(keys, shards)
                asked = [i for i in range(shards) if len(where[i])]
                yield pa.RecordBatch.from_arrays([pa.array([i for i in asked], pa.int32()), pa.array([c] * len(asked), pa.int64()), pa.array([keys[where[i]].tobytes() for i in asked], pa.binary())], names=["shard", "chunk", "keys"])

    questions = rows.select("doc_id", "text", "chunk").mapInArrow(ask, "shard int, chunk long, keys binary")
    sharded = model.withColumn("shard", F.pmod("key", F.lit(shards)).cast("int"))
    none = pa.table({"chunk": pa.array([], pa.int64()), "shard": pa.array([], pa.int32()), "p": pa.array([], pa.binary()), "gamma": pa.array([], pa.binary())})
    meet = lambda q, m: _answers(q, m) if q.num_rows else none
    answers = questions.groupBy("shard").cogroup(sharded.groupBy("shard")).applyInArrow(meet, "chunk long, shard int, p binary, gamma binary")
    scored = rows.groupBy("chunk").cogroup(scratch.keep(answers, "answers").groupBy("chunk"))
    scored = scratch.keep(scored.applyInArrow(lambda d, a: _scores(d, a, shards), "doc_id long, lang string, h long, n long, ll double"), "scored")
    scratch.drop("answers")
    return scored


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def for_thresholds(doc_id: Column) -> Column:
    """Trusted documents that set the thresholds instead of training."""
    return F.pmod(F.xxhash64(F.lit("fold"), doc_id), F.lit(FOLDS)) == 0


def classify(docs: DataFrame, trusted: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(doc_id, lang, n_grams, perplexity, low, high, kept) of every row; ``trusted`` has the ids of trusted documents."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    trusted = scratch.keep(trusted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "trusted")
    small = (lambda t: F.broadcast(t)) if trusted.count() <= BROADCAST_IDS else (lambda t: t)
    train = docs.select("doc_id", "text").join(small(trusted.where(~for_thresholds(F.col("doc_id")))), "doc_id", "left_semi")
    with arrow_rows(spark, 2000):
        counts = scratch.keep(count_runs(train), f"counts{ORDER}")
        scored = add_log_likelihood(docs, kneser_ney(counts, scratch), scratch)
    scratch.drop(*[f"{name}{k}" for name in ("counts", "totals", "p") for k in range(1, ORDER + 1)])
    scored = scored.withColumn("perplexity", F.when(F.col("n") > 0, F.exp(-F.col("ll") / F.col("n"))))
    known = scratch.keep(scored.join(small(trusted.where(for_thresholds(F.col("doc_id")))), "doc_id", "left_semi").where("n > 0"), "known")
    ends = F.percentile_approx("perplexity", F.array(F.lit(limits.low), F.lit(limits.high)), F.lit(10_000))
    bounds = scratch.keep(known.groupBy(F.col("lang").alias("b_lang")).agg(ends.alias("ends")), "bounds")
    low, high = known.agg(ends.alias("ends")).first()[0] or (0.0, float("inf"))
    joined = scored.join(F.broadcast(bounds) if bounds.count() <= BROADCAST_IDS // 10 else bounds, F.col("lang").eqNullSafe(F.col("b_lang")), "left")
    at = lambda i, other, f: (F.coalesce(F.element_at("ends", i), F.lit(other)) * f)
    joined = joined.withColumns({"low": at(1, low, 1 - limits.margin), "high": at(2, high, 1 + limits.margin)})
    learned = scratch.keep(train.select(F.xxhash64("text").alias("h")).distinct().withColumn("learned", F.lit(True)), "learned")
    joined = joined.join(small(learned) if learned.count() <= BROADCAST_IDS else learned, "h", "left")
    above = (F.col("perplexity") >= F.col("low")) | F.coalesce("learned", F.lit(False))
    kept = F.coalesce((F.col("perplexity") <= F.col("high")) & above, F.lit(False))
    return joined.select("doc_id", "lang", F.col("n").alias("n_grams"), "perplexity", "low", "high", kept.alias("kept"))


def op5_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and verdict of all documents, under a model of those labelled good."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    return classify(docs, trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet")))
