"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Every source gets a target size: the budget (100 % of all sizes) shared by weight, no target above
``max_epochs`` times its source's size, the excess reshared by weight until none is above.  Complete
epochs come first: each document is taken floor(target / source size) times.  The fraction that is
left is filled by weighted sampling without replacement: documents are ordered by -ln(u) / quality
weight, with u a seeded hash of the id, and the prefix whose total comes nearest to the rest is taken.

The prefix is found by a radix select over the keys' leading 24 bits, 8 bits at a time, so a source
that holds a third of all rows never meets in one task: each level aggregates at most 256 sums a
source, and only documents that share all 24 bits with the cut are ordered by a window.

Defined results: a null text has size 0; a null source is a source of its own, after all others;
documents with equal ids share their key and are taken together; sources of size 0 get target 0; an
empty table gives no rows; extra columns travel with ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelane.llm.prefix import numbered
from tidelane.llm.storage import Scratch

WORD = r"[^\x20\x09-\x0D]+"
SEED = 17
MAX_EPOCHS = 3
LEVELS = (16, 8, 0)
#: Rows of a side table (sources, quality weights; about 100 bytes each) that are broadcast at most.
BROADCAST_ROWS = 500_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sampling_key(doc_id: Column, weight: Column, seed: int = SEED) -> Column:
    """-ln(u) / weight with u in (0, 1) from 52 bits of a seeded MD5 of the id as text."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), doc_id)), 1, 13), 16, 10).cast("long")
    return -F.ln((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / weight


def cycle_weights(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Give the sources, by code point and null last, the weights in turn.  One row a source."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int")))


def water_level(sources: DataFrame, budget: int, max_epochs: int) -> float:
    """The level L with sum(least(L * weight, max_epochs * source_size)) = budget."""
    cap = F.col("source_size") * max_epochs
    level, capped = 0.0, -1
    while True:
        over = cap < F.lit(level) * F.col("weight") if capped >= 0 else F.lit(False)
        n, caps, free = sources.agg(F.coalesce(F.sum(F.when(over, 1)), F.lit(0)), F.coalesce(F.sum(F.when(over, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        if n == capped or not free:
            return level
        level, capped = (budget - caps) / free, n


def plan_mix(keyed: DataFrame, scratch: Scratch, *, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row a source: its size, target, complete epochs and where the sampled prefix ends.

    ``keyed`` has source, id, tie, size, key and k24 (leading bits of the key's distribution function).
    The prefix ends with ``last_taken`` of the ``last_of`` equal documents (end_key, end_id, end_tie).
    """
    sources = scratch.keep(cycle_weights(keyed.groupBy("source").agg(F.sum("size").alias("source_size")), weights), "sources")
    budget = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level = water_level(sources, budget, max_epochs)
    target = F.least(F.lit(level) * F.col("weight"), (F.col("source_size") * max_epochs).cast("double"))
    state = sources.withColumn("target", target).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    state = state.withColumns({"rest": F.col("target") - F.col("epochs") * F.col("source_size"), "prefix": F.lit(0).cast("long")})
    state = scratch.keep(state, "state0")
    for level_no, shift in enumerate(LEVELS):
        s = state.select(F.col("source").alias("s_source"), "rest", "prefix").where("rest > 0")
        inside = keyed.join(s, F.col("source").eqNullSafe(F.col("s_source")) & (F.shiftright("k24", shift + 8) == F.col("prefix")))
        sums = inside.groupBy("s_source", "rest", F.shiftright("k24", shift).alias("digit")).agg(F.sum("size").alias("n"))
        w = Window.partitionBy("s_source").orderBy("digit")
        sums = sums.withColumn("upto", F.sum("n").over(w))
        cut = sums.where("upto >= rest and upto - n < rest").select("s_source", F.col("digit").alias("cut"), (F.col("rest") - F.col("upto") + F.col("n")).alias("left"))
        state = state.join(cut, F.col("source").eqNullSafe(F.col("s_source")), "left").drop("s_source")
        state = state.withColumns({"prefix": F.coalesce("cut", F.lit(-1)), "rest": F.when(F.col("cut").isNotNull(), F.col("left")).otherwise(F.lit(0.0))}).drop("cut", "left")
        state = scratch.keep(state, f"state{level_no + 1}")
    s = state.select(F.col("source").alias("s_source"), "rest", "prefix").where("rest > 0")
    last = keyed.join(s, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("k24") == F.col("prefix")))
    last = last.groupBy("s_source", "rest", "key", "id", "tie", "size").agg(F.count(F.lit(1)).alias("of"))
    order = Window.partitionBy("s_source").orderBy("key", "id", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("before", F.coalesce(F.sum(F.col("size") * F.col("of")).over(order), F.lit(0)))
    fits = F.floor((F.col("rest") - F.col("before") - F.col("size") / 2) / F.col("size")) + 1
    last = last.withColumn("taken", F.when(F.col("size") > 0, F.least("of", fits)).when(F.col("before") <= F.col("rest"), F.col("of"))).where("taken > 0")
    ends = last.groupBy("s_source").agg(F.max(F.struct("key", "id", "tie", "taken", "of")).alias("end"))
    state = state.join(ends, F.col("source").eqNullSafe(F.col("s_source")), "left").drop("s_source")
    end = [F.col(f"end.{c}").alias(n) for c, n in (("key", "end_key"), ("id", "end_id"), ("tie", "end_tie"), ("taken", "last_taken"), ("of", "last_of"))]
    return scratch.keep(state.select("source", "source_size", "target", "epochs", F.col("prefix").alias("cut"), *end), "mix")


def _small(table: DataFrame) -> DataFrame:
    """``table`` with a broadcast hint where its rows are few enough."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _placed(docs: DataFrame, row: Column, quality: DataFrame | None, weights: tuple[int, ...], max_epochs: int, seed: int) -> DataFrame:
    """(row, size, source_size, target, copies) of every document."""
    scratch = Scratch(docs.sparkSession, "mix")
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit("")))))
    rows = docs.select(row.alias("row"), F.col("source").alias("source"), F.col("doc_id").cast("long").alias("doc"), name.alias("name"), F.xxhash64("text").alias("tie"), word_count(F.col("text")).alias("size"))
    if quality is None:
        rows = rows.withColumn("q", F.lit(1.0))
    else:
        q = scratch.keep(quality.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("q_doc")).agg(F.max("quality_weight").cast("double").alias("q")), "quality")
        rows = rows.join(_small(q), F.col("doc") == F.col("q_doc"), "left").drop("q_doc").fillna(1.0, ["q"])
    rows = rows.withColumn("key", sampling_key(F.col("name"), F.col("q"), seed)).drop("q", "name")
    rows = rows.withColumns({"id": F.coalesce("doc", F.lit(-1)), "k24": F.least(F.floor((1 - F.exp(-F.col("key"))) * (1 << 24)), F.lit((1 << 24) - 1))})
    narrow = scratch.keep(rows.select("source", "id", "tie", "size", "key", "k24"), "narrow")
    plan = plan_mix(narrow, scratch, weights=weights, max_epochs=max_epochs)
    placed = rows.alias("d").join(_small(plan).alias("m"), F.col("d.source").eqNullSafe(F.col("m.source")), "left")
    here, end = (F.struct(*(F.col(c).alias(n) for c, n in zip(x, "kit"))) for x in (("key", "id", "tie"), ("end_key", "end_id", "end_tie")))
    inside = F.coalesce((F.col("k24") < F.col("cut")) | ((F.col("k24") == F.col("cut")) & (here <= end)), F.lit(False))
    result = lambda d, sampled: d.select("row", "size", "source_size", "target", (F.col("epochs") + sampled.cast("long")).alias("copies"))
    if plan.where("last_taken < last_of").isEmpty():
        return result(placed, inside)
    parted = F.coalesce((here == end) & (F.col("last_taken") < F.col("last_of")), F.lit(False))
    ends = placed.where(parted).select("row", F.col("m.source").alias("source"), "size", "source_size", "target", "epochs", "last_taken")
    ends = numbered(ends, ["source"], "nth", scratch, "ends")
    return result(placed.where(~parted), inside).unionByName(result(ends, F.col("nth") < F.col("last_taken")))


def mix(docs: DataFrame, *, quality: DataFrame | None = None, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS, seed: int = SEED, carry: list[str] | None = None, keep_text: bool = True) -> DataFrame:
    """Add size, source_size, target, copies and taken to every document.

    ``quality`` (doc_id, quality_weight > 0) scales the sampling keys; documents without a weight
    have 1.  ``carry`` names the columns to keep beside doc_id and source (default: all); those that clash with
    a result get the prefix ``__own_``.
    """
    carry = [c for c in docs.columns if c not in ("doc_id", "source", "text")] if carry is None else carry
    kept = ["doc_id", "source", *(["text"] if keep_text else []), *carry]
    placed = _placed(docs, F.struct(*[F.col(f"`{c}`") for c in kept]), quality, weights, max_epochs, seed)
    results = ["size", "source_size", "target", "copies", "taken"]
    placed = placed.withColumn("taken", F.col("size") * F.col("copies"))
    return placed.select(*[F.col(f"row.`{c}`").alias(f"__own_{c}" if c in results else c) for c in kept], *results)


def repeat_rows(docs: DataFrame, *, quality: DataFrame | None = None, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """Every row of ``docs`` as often as the mix takes it, with the columns of ``docs``."""
    placed = _placed(docs, F.struct("*"), quality, weights, max_epochs, seed).where("copies > 0")
    repeated = placed.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def label_weights(labels: DataFrame) -> DataFrame:
    """Quality weights from labels: 2 for good documents, a half for bad ones."""
    return labels.where("quality is not null").select("doc_id", F.when(F.col("quality") == 1, 2.0).otherwise(0.5).alias("quality_weight"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents: weights 1, 2, 3 in turn, at most three epochs of a source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    mixed = mix(docs, quality=label_weights(spark.read.parquet(f"{sf_dir}/labels.parquet")), carry=[], keep_text=False)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('17:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS bits
  FROM documents),
q AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END) AS w FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
k AS (SELECT d.*, -ln((bits + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / coalesce(w, 1.0::DOUBLE) AS key FROM d LEFT JOIN q USING (doc_id)),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
b AS (SELECT CAST(sum(source_size) AS BIGINT) AS budget FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY source_size * 3.0::DOUBLE / weight, source NULLS LAST) AS r FROM s),
l AS (
  SELECT r, source_size * 3.0::DOUBLE / weight AS ratio,
         (budget - coalesce(CAST(sum(source_size * 3) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
         / CAST(sum(weight) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM o, b),
v AS (SELECT min_by(level, r) AS level FROM l WHERE level <= ratio),
t AS (SELECT source, source_size, least(level * weight, source_size * 3.0::DOUBLE) AS target FROM s, v),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
p AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         e.target - e.epochs * e.source_size AS rest
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN rest > 0 AND before + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM p
"""
