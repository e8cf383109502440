"""Benchmark decontamination in DataFrame operations only.

Benchmark texts are cut into windows of 13 consecutive normalised words (a shorter text is one
window).  The distinct windows are broadcast in a hash table keyed by the hash of the whole window; the
scan hashes every window of the training texts, looks it up and verifies a hit by its length and a
second, independent hash of its words (128 bits in all), so no words travel with a window.  Hit words are the
union of the occurrences.  A benchmark above ``BROADCAST_BYTES`` is dealt into slices by the
hash, each broadcast to a scan of its own; the work grows with their number and nothing else changes.

Defined results: a null or wordless text has no words and no hits; repeated rows each get their own
row; a null item id contaminates but is not counted among the items; an empty benchmark hits nothing;
very long texts are scanned whole; equal windows of several items count for each of them; extra columns
are ignored by the report, and kept by ``decontaminate`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm.storage import Scratch

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 13
#: The separators of words in text that is not lower-cased yet, as a character class.
BETWEEN = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
#: Bytes of windows, their hashes and item ids that one scan gets by broadcast.
BROADCAST_BYTES = 64 << 20
#: Contaminated documents that are broadcast at most.
BROADCAST_ROWS = 500_000


def normal_words(text: Column) -> Column:
    """Lower-cased (A-Z only) words of whole texts; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def hash_levels(df: DataFrame, name: str, window: int) -> DataFrame:
    """Add columns ``name``1, 2, 4 ...: hashes of the windows of so many words from each place of ``words`` on.

    Each level is made from two places of the level below, so a window costs a few hashes of numbers whatever its
    length; places too near the end hold nothing of use.  The name is the seed.
    """
    df = df.withColumn(f"{name}1", F.transform("words", lambda w: F.xxhash64(F.lit(name), w)))
    k = 1
    while 2 * k <= window:
        below = F.col(f"{name}{k}")
        rest = F.slice(below, k + 1, F.greatest(F.size(below), F.lit(1)))
        df = df.withColumn(f"{name}{2 * k}", F.zip_with(below, rest, lambda x, y: F.xxhash64(x, y)))
        k *= 2
    return df


def window_hashes(name: str, length: int) -> Column:
    """The hashes of all windows of ``length`` words, from the levels whose sum it is."""
    held, at = None, 0
    for bit in reversed(range(length.bit_length())):
        if length >> bit & 1:
            level = F.col(f"{name}{1 << bit}")
            part = level if not at else F.slice(level, at + 1, F.greatest(F.size(level), F.lit(1)))
            held = part if held is None else F.zip_with(held, part, lambda x, y: F.xxhash64(x, y))
            at += 1 << bit
    return F.slice(held, 1, F.greatest(F.size("words") - (length - 1), F.lit(0)))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows of the benchmark: their length, two hashes of the words, and the ids of the items that hold them."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), normal_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(window))
    wins = items.select("item", "words", length.alias("len"), F.explode(F.sequence(F.lit(1), F.size("words") - length + 1)).alias("pos"))
    wins = wins.select("item", F.slice("words", F.col("pos"), F.col("len")).alias("words"))
    wins = wins.groupBy("words").agg(F.collect_set("item").alias("items"))
    for name in ("h", "g"):
        own = F.lit(None).cast("long")
        for k in range(1, window + 1):
            own = F.when(F.size("words") == k, F.try_element_at(window_hashes(name, k), F.lit(1))).otherwise(own)
        wins = hash_levels(wins, name, window).withColumn(f"b_{name}", own)
    return wins.select(F.size("words").alias("b_len"), "items", "b_h", "b_g")


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document: doc_id, text_hash, n_words, hits (sorted spans of words, 1-based) and items."""
    wins = Scratch(docs.sparkSession, "windows").keep(benchmark_windows(benchmark, window), "windows")
    size = F.octet_length(F.array_join("items", " ")) + 100
    total, lengths = wins.agg(F.coalesce(F.sum(size), F.lit(0)), F.collect_set("b_len")).first()
    slices = max(1, -(-total // broadcast_bytes))
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), normal_words(F.col("text")).alias("words"))
    for name in ("h", "g"):
        base = hash_levels(base, name, max(lengths, default=1))
    none = F.lit(None).cast("long")
    found = None
    for k in range(slices):
        marker = [F.array(F.struct(F.lit(0).alias("pos"), F.lit(0).alias("len"), none.alias("h"), none.alias("g")))] if k == 0 else []
        both = lambda n: F.zip_with(window_hashes("h", n), window_hashes("g", n), lambda h, g: F.struct(h.alias("h"), g.alias("g")))
        spot = lambda n: F.transform(both(n), lambda x, i: F.struct((i + 1).alias("pos"), F.lit(n).alias("len"), x["h"].alias("h"), x["g"].alias("g")))
        spots = F.concat(*marker, *[spot(n) for n in sorted(lengths)]).alias("spots")
        # the words end here: a row for each window must not carry those of its document
        rows = base.select("doc_id", "text_hash", F.size("words").alias("n"), spots).select("doc_id", "text_hash", "n", F.explode_outer("spots").alias("s"))
        rows = rows.select("doc_id", "text_hash", "n", "s.pos", "s.len", "s.h", "s.g")
        due = wins if slices == 1 else wins.where(F.pmod("b_h", F.lit(slices)) == k)
        verified = (F.col("h") == F.col("b_h")) & (F.col("g").bitwiseXOR(F.col("b_g")) == 0) & (F.col("len") == F.col("b_len"))
        hits = rows.join(F.broadcast(due), verified, "left").where((F.col("pos") == 0) | F.col("b_h").isNotNull())
        hits = hits.select("doc_id", "text_hash", F.when(F.col("pos") == 0, F.col("n")).alias("n"), "pos", "len", "items")
        found = hits if found is None else found.unionByName(hits)
    per = found.groupBy("doc_id", "text_hash").agg(
        F.max("n").alias("n_words"),
        F.sum((F.col("pos") == 0).cast("long")).alias("rows"),
        F.array_sort(F.collect_set(F.when(F.col("pos") > 0, F.struct("pos", (F.col("pos") + F.col("len")).alias("end"))))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    return per.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int")))).drop("copy", "rows")


def covered_words(spans: Column) -> Column:
    """Words in the union of sorted [pos, end) spans."""
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, x: F.struct(F.greatest(acc["upto"], x["end"]).alias("upto"), (acc["n"] + F.greatest(x["end"] - F.greatest(x["pos"], acc["upto"]), F.lit(0))).alias("n"))
    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def contamination_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Digest columns of ``find_contamination``, and the verdict."""
    found = find_contamination(docs, benchmark, **options)
    n_hit = covered_words(F.col("spans"))
    joined = F.array_join(F.array_sort("items"), ",")
    out = found.select("doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words"), n_hit.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), "spans")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _small(table: DataFrame) -> DataFrame:
    """``table`` (a hash and an id, or the spans of a document, each row) with a broadcast hint where its rows are few enough."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, remove: str = "documents", **options) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) without the hit words; separators stay."""
    scratch = Scratch(docs.sparkSession, "contamination")
    report = contamination_report(docs, benchmark, **options)
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("hash")).alias("d")
    on = F.col("d.row.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.hash") == F.col("c.text_hash"))
    if remove == "documents":
        bad = scratch.keep(report.where("contaminated").select("doc_id", "text_hash").distinct(), "documents")
        left = rows.join(_small(bad).alias("c"), on, "left_anti")
        return left.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    places = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["pos"], s["end"] - 1))))
    hit = scratch.keep(report.where("n_hit > 0").select("doc_id", "text_hash", places.alias("places")).dropDuplicates(["doc_id", "text_hash"]), "spans")
    joined = rows.join(_small(hit).alias("c"), on, "left")
    text, held = F.col("d.row.text"), F.col("c.places")
    pieces = F.regexp_extract_all(text, F.lit(rf"[^{BETWEEN}]+|[{BETWEEN}]+"), F.lit(0))
    leading = F.rlike(text, F.lit(rf"\A[^{BETWEEN}]")).cast("int")
    kept = F.filter(pieces, lambda x, i: ~(((i + leading) % 2 == 1) & F.array_contains(held, F.floor((i + 1 + leading) / 2).cast("int"))))
    clean = F.when(held.isNull(), text).otherwise(F.array_join(kept, ""))
    return joined.select(*[(clean if c == "text" else F.col(f"d.row.`{c}`")).alias(c) for c in docs.columns])


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of all documents by all benchmark items."""
    report = contamination_report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return report.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(words), 13) AS n, list_slice(words, pos, pos + least(len(words), 13) - 1) AS win
  FROM (SELECT *, unnest(generate_series(1, len(words) - least(len(words), 13) + 1)) AS pos FROM b WHERE len(words) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT rid, pos, n, list_slice(words, pos, pos + n - 1) AS win
  FROM (SELECT rid, words, n, unnest(generate_series(1, len(words) - n + 1)) AS pos FROM d, lens WHERE len(words) >= n)),
h AS (SELECT rid, pos, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
hw AS (SELECT rid, count(DISTINCT w) AS n_hit FROM (SELECT rid, unnest(generate_series(pos, pos + n - 1)) AS w FROM h) GROUP BY rid),
hi AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
"""
