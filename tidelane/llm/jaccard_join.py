"""N-gram Jaccard join by T-occurrence search, as in DivideSkip, laid out for a cluster.

Two documents link when the Jaccard similarity of their sets of five-word shingles is at least 3/4.

1.  Documents with the same set form one class; all further work is on classes.
2.  Shingles get one global order: those frequent in a bounded sample of classes last, the rest by
    hash (any order gives the same links, this one keeps lists short).  If a set of n shingles must
    share o = ceil(3n/4) with a partner, then its first n - o + l shingles share at least
    T = min(l, l') with the partner's first ones.  Inverted lists are built over these prefixes:
    postings go to list shards as packed sorted blobs, one for each map task and shard.
3.  Lists with the same members are one list with a weight.  A class whose lists weigh less than the
    smallest possible T is done.  Every other class is first compared with one pivot, the member that
    leads most of its lists; what links there forms components, and two members of one component need
    no further comparison.  A group of near copies so costs a multiple of its size, not its square.
4.  Short lists (at most ``SHORT`` members) are merged: common weight by pair of components' members;
    the long lists both stand in are added as a bound, and pairs that can reach T are candidates.
    Every candidate is verified on whole sets by binary probes of the shorter set into the longer.
5.  A pair without a common short list must reach T on long lists alone, so only members whose long
    lists weigh T matter there.  Where such members are outside the largest component of their family,
    they ask all members of other components, in blocks of ``BLOCK_BYTES``: bit maps of the sets bound
    their difference from below, which leaves few pairs to be probed on whole sets.  A family that fits
    one block is not copied; a block gives spanning links only, never all pairs.

Defined results: null, empty and wordless texts have no shingles and link with nothing; a text of
fewer than five words is one shingle; repeated rows are copies of one class; an empty table gives no
rows; very long texts are read whole; extra columns are ignored, whatever their names.  Sets are compared by
64-bit hashes of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelane.llm.components import connected_components
from tidelane.llm.storage import Scratch, arrow_rows, memory_returned, shard_count
from tidelane.llm.textkernel import U64, TextKernel, mix64, text_slices, window_hashes

SHINGLE = 5
SHORT = 32
SAMPLE_CLASSES = 4096
HOT_IN_SAMPLE = 8
CHUNK_TOKENS = 1_500_000
#: Bytes of sets that one task compares with as many others.
BLOCK_BYTES = 16 << 20
MAP_BITS = 1024
#: Representatives (16 bytes each) that are broadcast at most; beyond, they meet their texts by shuffle.
BROADCAST_REPS = 1_000_000
#: Ids of dropped documents (8 bytes each) that are broadcast at most; beyond, they meet their texts by shuffle.
BROADCAST_IDS = 2_000_000


def shingle_sets(kernel: TextKernel, buf: np.ndarray, offsets: np.ndarray, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of a slice of texts in (text, hot last, hash) order.

    Returns the hashes, the text of each, the number of shingles and the class of each text.
    """
    words = kernel.cut(buf, offsets)
    h, count = kernel.word_hashes(words), np.diff(words.first)
    at, g = window_hashes(h, words.first, SHINGLE)
    doc = words.doc[at]
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):
        whole = np.zeros(len(short), U64)
        for j in range(SHINGLE):
            has = count[short] > j
            x = np.where(has, h[np.minimum(words.first[short] + j, len(h) - 1)], U64(j + 1))
            whole = mix64((whole ^ x) * U64(0x9FB21C651E98DF25) + U64(1))
        g, doc = np.concatenate([g, whole]), np.concatenate([doc, short])
    late = np.zeros(len(g), bool)
    if hot is not None and len(hot):
        near = np.minimum(np.searchsorted(hot, g), len(hot) - 1)
        late = hot[near] == g
    order = np.lexsort((g, late, doc)) if hot is not None and len(hot) else np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    g, doc = g[new], doc[new]
    n = np.bincount(doc, minlength=len(offsets) - 1)
    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix64(g))])
    upto = np.concatenate([[0], np.cumsum(n)])
    digest = mix64((total[upto[1:]] - total[upto[:-1]]) + n.astype(U64) * U64(0xD6E8FEB86659FD93)).view(np.int64)
    return g, doc, n, digest


def needed(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(prefix length, l) of sets of n shingles."""
    ell = np.maximum(1, -(-n // 4))
    return n - -(-3 * n // 4) + ell, ell


def t_of(n: Column) -> Column:
    return F.ceil(n / 4)


def t_least(n: Column) -> Column:
    """The smallest T of a set with any partner: partners have 3n/4 shingles at least."""
    return F.ceil(F.ceil(n * 3 / 4) / 4)


def read_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, n, class) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = TextKernel("space", lower=True)
        for batch in batches:
            for a, b, buf, offsets in text_slices(batch.column("text")):
                _, _, n, digest = shingle_sets(kernel, buf, offsets)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(n), pa.array(digest)], names=["doc_id", "n", "class"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(memory_returned(run), "doc_id long, n long, class long")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, tokens: sorted hashes as bytes) of the documents ``wanted`` (rep, class).

    A class whose documents all lack an id (null rep) is met by its shingles instead.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = TextKernel("space", lower=True)
        for batch in batches:
            for a, b, buf, offsets in text_slices(batch.column("text")):
                g, _, n, digest = shingle_sets(kernel, buf, offsets)
                upto = np.concatenate([[0], np.cumsum(n)])
                due = batch.column("class").slice(a, b - a).fill_null(0).to_numpy(zero_copy_only=False)
                nameless = batch.column("class").slice(a, b - a).is_null().to_numpy(zero_copy_only=False)
                rows = np.flatnonzero((due == digest) | ((n > 0) & nameless))
                tokens = [g[upto[i] : upto[i + 1]].tobytes() for i in rows]
                yield pa.RecordBatch.from_arrays([pa.array(digest[rows]), pa.array(tokens, pa.binary())], names=["class", "tokens"])

    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted.select("rep", "class"), F.col("doc_id") == F.col("rep"))
    sets = joined.select("text", "class").mapInArrow(memory_returned(run), "class long, tokens binary")
    unnamed = wanted.where("rep is null").select("class")
    if unnamed.isEmpty():
        return sets
    nameless = docs.where("doc_id is null").select("text", F.lit(None).cast("long").alias("class")).mapInArrow(memory_returned(run), "class long, tokens binary")
    return sets.unionByName(nameless.join(unnamed, "class", "left_semi").dropDuplicates(["class"]))


def frequent_shingles(docs: DataFrame, classes: DataFrame) -> np.ndarray:
    """Shingles of at least ``HOT_IN_SAMPLE`` classes in a sample of about ``SAMPLE_CLASSES``; they only set the order."""
    n = classes.count()
    step = max(1, n // SAMPLE_CLASSES)
    chosen = classes.where(F.pmod(F.xxhash64("class"), F.lit(step)) == 0).limit(2 * SAMPLE_CLASSES)
    rows = sets_of(docs, F.broadcast(chosen)).dropDuplicates(["class"]).select("tokens").toArrow()
    tokens = np.frombuffer(b"".join(x.as_py() for x in rows.column("tokens")), U64)
    value, count = np.unique(tokens, return_counts=True)
    return value[count >= HOT_IN_SAMPLE]


def _packed(token: np.ndarray, owner: np.ndarray, cls: np.ndarray, size: np.ndarray, shards: int) -> pa.RecordBatch:
    """One row a shard: 48-bit tokens as deltas, and the classes by a local number."""
    order = np.argsort(token)
    token, owner = token[order], owner[order]
    shard = ((token >> U64(32)) * U64(shards)) >> U64(32)
    value = (token >> U64(16)).astype(np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(token)]])
    rows: dict[str, list] = {k: [] for k in ("shard", "tokens", "owners", "classes", "sizes")}
    for a, b in zip(cuts[:-1], cuts[1:]):
        if a == b:
            continue
        used, local = np.unique(owner[a:b], return_inverse=True)
        step = np.diff(value[a:b], prepend=0)
        rows["shard"].append(int(shard[a]))
        rows["tokens"].append(value[a : a + 1].tobytes() + step[1:].astype(np.uint32 if step[1:].max(initial=0) < 1 << 32 else np.int64).tobytes())
        rows["owners"].append(local.astype(np.uint16 if len(used) < 1 << 16 else np.uint32).tobytes())
        rows["classes"].append(cls[used].tobytes())
        rows["sizes"].append(size[used].astype(np.uint32).tobytes())
    return pa.RecordBatch.from_arrays([pa.array(rows["shard"], pa.int32()), *[pa.array(rows[k], pa.binary()) for k in ("tokens", "owners", "classes", "sizes")]], names=list(rows))


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, class, size of the class) of every posting of a shard."""
    token, cls, size = [], [], []
    for t, o, c, s in zip(*(table.column(k) for k in ("tokens", "owners", "classes", "sizes"))):
        t, c, s = t.as_py(), np.frombuffer(c.as_py(), np.int64), np.frombuffer(s.as_py(), np.uint32)
        o = o.as_py()
        local = np.frombuffer(o, np.uint16 if len(c) < 1 << 16 else np.uint32)
        first = np.frombuffer(t[:8], np.int64)
        step = np.frombuffer(t[8:], np.uint32 if len(t) - 8 == 4 * (len(local) - 1) else np.int64)
        token.append(np.cumsum(np.concatenate([first, step.astype(np.int64)])))
        cls.append(c[local])
        size.append(s[local])
    return np.concatenate(token), np.concatenate(cls), np.concatenate(size)


def _lists(table: pa.Table) -> pa.Table:
    """The inverted lists of a shard with two classes or more, equal lists merged into one with a weight."""
    token, cls, size = _unpacked(table)
    order = np.lexsort((cls, token))
    token, cls, size = token[order], cls[order], size[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
    token, cls, size = token[new], cls[new], size[new]
    start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    members = np.diff(np.concatenate([start, [len(token)]]))
    label = np.add.reduceat(mix64(cls.view(U64)), start).view(np.int64)
    many = np.flatnonzero(members > 1)
    name, first, weight = np.unique(label[many], return_index=True, return_counts=True)
    picked = many[first]
    m = members[picked]
    at = np.arange(int(m.sum())) + np.repeat(start[picked] - (np.cumsum(m) - m), m)
    columns = {"list": np.repeat(name, m), "class": cls[at], "n": size[at].astype(np.int32), "w": np.repeat(weight, m).astype(np.int32)}
    return pa.table(columns)


def inverted_lists(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """(list, class, n, w) of the prefix postings of all documents."""
    spark = docs.sparkSession
    shards = shard_count(docs)
    shared = spark.sparkContext.broadcast(hot)  # at most the tokens of the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = TextKernel("space", lower=True)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            base = np.cumsum([0, *[len(x[2]) for x in held]])
            token, owner = np.concatenate([x[0] for x in held]), np.concatenate([x[1] + b for x, b in zip(held, base)])
            cls, n = np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])
            first = np.zeros(len(cls), bool)
            first[np.unique(cls, return_index=True)[1]] = True  # copies within the chunk
            keep = first[owner]
            held.clear()
            return _packed(token[keep], owner[keep], cls, n, shards)

        for batch in batches:
            for _, _, buf, offsets in text_slices(batch.column("text")):
                g, doc, n, digest = shingle_sets(kernel, buf, offsets, shared.value)
                upto = np.cumsum(n) - n
                keep = np.arange(len(g)) - upto[doc] < needed(n)[0][doc]
                held.append((g[keep], doc[keep], digest, n))
                size += int(keep.sum())
                if size >= CHUNK_TOKENS:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    packed = docs.select("text").mapInArrow(memory_returned(run), "shard int, tokens binary, owners binary, classes binary, sizes binary")
    lists = packed.groupBy("shard").applyInArrow(_lists, "list long, class long, n int, w int")
    return lists.groupBy("list", "class").agg(F.max("n").alias("n"), F.sum("w").cast("int").alias("w"))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the similarity: the smaller one's shingles are probed in the larger one."""
    if len(a) > len(b):
        a, b = b, a
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * common >= 75 * (len(a) + len(b) - common)


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = ([np.frombuffer(v.as_buffer(), U64) for v in batch.column(k)] for k in ("ta", "tb"))
        linked = pa.array([similar(a, b) for a, b in zip(x, y)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(linked) for k in ("a", "b")], names=["a", "b"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets reach the similarity."""
    a = sets.select(F.col("class").alias("ca"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("class").alias("cb"), F.col("tokens").alias("tb"))
    joined = pairs.join(a, F.col("a") == F.col("ca")).join(b, F.col("b") == F.col("cb"))
    return joined.select("a", "b", "ta", "tb").mapInArrow(memory_returned(_overlaps), "a long, b long")


def best_pivots(lists: DataFrame, scratch: Scratch) -> DataFrame:
    """For each class the pivot (the least member by hash) that most of its lists, by weight, have."""
    pivots = scratch.keep(lists.groupBy("list").agg(F.min(F.struct(F.xxhash64("class").alias("h"), F.col("class").alias("p"), F.col("n").alias("pn"))).alias("top")).select(F.col("list").alias("l"), "top.p", "top.pn"), "pivots")
    met = lists.join(pivots, F.col("list") == F.col("l")).where((F.col("class") != F.col("p")) & (4 * F.least("n", "pn") >= 3 * F.greatest("n", "pn")))
    weights = met.groupBy("class", "p").agg(F.sum("w").alias("w"))
    top = weights.groupBy("class").agg(F.max(F.struct("w", "p")).alias("top"))
    return top.select(F.least("class", "top.p").alias("a"), F.greatest("class", "top.p").alias("b")).distinct()


def bit_maps(sets: list[np.ndarray]) -> np.ndarray:
    """A map of ``MAP_BITS`` bits of each set; sets whose maps differ in k bits differ in k shingles at least."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    bit = np.concatenate(sets) % U64(MAP_BITS)
    maps = np.zeros((len(sets), MAP_BITS // 64), U64)
    np.bitwise_or.at(maps, (owner, (bit >> U64(6)).astype(np.int64)), U64(1) << (bit & U64(63)))
    return maps


def _probe(table: pa.Table) -> pa.Table:
    """Links that span those between the outsiders and the members of a block."""
    asks = table.column("asks").to_numpy()
    cls, comp = table.column("class").to_numpy(), table.column("comp").to_numpy()
    sets = [np.frombuffer(x.as_buffer(), U64) for x in table.column("tokens")]
    up: dict[int, int] = {}
    out: list[tuple[int, int]] = []

    def root(c: int) -> int:
        while up.get(c, c) != c:
            up[c] = up.get(up[c], up[c])
            c = up[c]
        return c

    if asks.any() and not asks.all():
        maps, size = bit_maps(sets), np.array([len(x) for x in sets])
        members = np.flatnonzero(~asks)
        members = members[np.argsort(size[members], kind="stable")]
        sizes = size[members]
        for q in np.flatnonzero(asks).tolist():
            lo, hi = np.searchsorted(sizes, -(-3 * size[q] // 4)), np.searchsorted(sizes, 4 * size[q] // 3, "right")
            near = members[lo:hi]
            apart = np.bitwise_count(maps[near] ^ maps[q]).sum(1, dtype=np.int64)
            for m in near[(7 * apart <= size[near] + size[q]) & (comp[near] != comp[q])].tolist():
                one, two = root(int(comp[q])), root(int(comp[m]))
                if one != two and similar(sets[q], sets[m]):  # a link that the block's other links do not imply
                    up[one] = two
                    out.append((int(cls[q]), int(cls[m])))
    links = np.array(out, np.int64).reshape(-1, 2)
    return pa.table({"a": links[:, 0], "b": links[:, 1]})


def long_list_links(members: DataFrame, families: DataFrame, roots: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Links between classes that share long lists only.

    Families are what long lists connect.  In each, the members outside the family's largest
    component are compared with all members of other components, both in blocks of ``BLOCK_BYTES``.
    """
    placed = members.join(families, F.col("class") == F.col("node"), "left").select("class", F.coalesce("root", "class").alias("family"))
    placed = placed.join(roots, F.col("class") == F.col("node"), "left").select("class", "family", F.coalesce("root", "class").alias("comp"))
    placed = scratch.keep(placed.join(sets.dropDuplicates(["class"]), "class"), "in_component")
    sizes = placed.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum(F.octet_length("tokens")).alias("bytes"))
    sizes = sizes.groupBy("family").agg(F.max(F.struct("c", "comp", "bytes")).alias("top"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    blocks = lambda n: F.ceil(n / BLOCK_BYTES).cast("int")
    sizes = sizes.select(F.col("family").alias("f"), F.col("top.comp").alias("top"), blocks(F.col("bytes") - F.col("top.bytes")).alias("asking"), blocks(F.col("bytes")).alias("asked"))
    open_ = placed.join(scratch.keep(sizes, "families"), F.col("family") == F.col("f"))
    dealt = lambda n: F.pmod(F.xxhash64("class"), F.col(n)).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = open_.where(F.col("comp") != F.col("top")).withColumn("i", dealt("asking")).withColumn("j", numbers("asked")).withColumn("asks", F.lit(True))
    asked = open_.withColumn("j", dealt("asked")).withColumn("i", numbers("asking")).withColumn("asks", F.lit(False))
    both = asks.unionByName(asked).select("family", "i", "j", "asks", "class", "comp", "tokens")
    return both.groupBy("family", "i", "j").applyInArrow(_probe, "a long, b long")


def linked_classes(docs: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of all classes that a chain of similar pairs connects, but those that are their own root."""
    spark = docs.sparkSession
    with arrow_rows(spark, 2000):
        hot = frequent_shingles(docs, classes)
        lists = scratch.keep(inverted_lists(docs, hot), "lists0")
    scratch.release()
    for again in range(2):
        alive = lists.groupBy("class").agg(F.sum("w").alias("weight"), F.max("n").alias("n")).where(F.col("weight") >= t_least(F.col("n"))).select("class")
        lists = lists.join(scratch.keep(alive, f"alive{again}"), "class", "left_semi")
        members = scratch.keep(lists.groupBy("list").agg(F.count(F.lit(1)).cast("int").alias("m")).where("m > 1"), f"members{again}")
        lists = scratch.keep(lists.join(members, "list"), f"lists{again + 1}").select("list", "class", "n", "w", *(["m"] if again else []))
        scratch.drop(f"lists{again}")
    reps = scratch.keep(classes.join(scratch.keep(lists.select("class").distinct(), "listed"), "class", "left_semi"), "reps")
    with arrow_rows(spark, 2000):
        sets = scratch.keep(sets_of(docs, F.broadcast(reps) if reps.count() <= BROADCAST_REPS else reps), "sets")
    with arrow_rows(spark, 256):
        links = scratch.keep(verified(scratch.keep(best_pivots(lists, scratch), "pivot_pairs"), sets), "pivot_links")
    roots = connected_components(links, scratch, "cc0")
    scratch.release()
    # members of one component need no comparison
    open_lists = scratch.keep(lists.join(roots, F.col("class") == F.col("node"), "left").select("list", "class", "n", "w", "m", F.coalesce("root", "class").alias("comp")), "lists_by_root")
    scratch.drop("lists2")
    unsettled = open_lists.groupBy("list").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("list")
    open_lists = scratch.keep(open_lists.join(scratch.keep(unsettled, "unsettled"), "list", "left_semi"), "open_lists")
    scratch.drop("lists_by_root")
    long_weight = scratch.keep(open_lists.where(F.col("m") > SHORT).groupBy("class").agg(F.sum("w").alias("lw"), F.max("n").alias("n")), "long_weight")
    short = open_lists.where(F.col("m") <= SHORT)
    x, y = (short.select("list", F.col("class").alias(c), F.col("n").alias(f"n{c}"), F.col("comp").alias(f"comp{c}"), *(["w"] if c == "a" else [])) for c in "ab")
    pairs = x.join(y, "list").where((F.col("a") < F.col("b")) & (F.col("compa") != F.col("compb")) & (4 * F.least("na", "nb") >= 3 * F.greatest("na", "nb")))
    pairs = scratch.keep(pairs.groupBy("a", "b", "na", "nb").agg(F.sum("w").alias("w")), "merged")
    lw = lambda c: long_weight.select(F.col("class").alias(f"c{c}"), F.col("lw").alias(f"lw{c}"))
    pairs = pairs.join(lw("a"), F.col("a") == F.col("ca"), "left").join(lw("b"), F.col("b") == F.col("cb"), "left")
    bound = F.col("w") + F.least(F.coalesce("lwa", F.lit(0)), F.coalesce("lwb", F.lit(0)))
    pairs = scratch.keep(pairs.where(bound >= F.least(t_of(F.col("na")), t_of(F.col("nb")))).select("a", "b"), "pairs")
    with arrow_rows(spark, 256):
        links = scratch.keep(links.unionByName(verified(pairs, sets)), "short_links")
    roots = connected_components(links, scratch, "cc1")
    heavy = scratch.keep(long_weight.where(F.col("lw") >= t_least(F.col("n"))).select("class"), "heavy")
    long_lists = scratch.keep(open_lists.where(F.col("m") > SHORT).select("list", "class").join(heavy, "class", "left_semi"), "long_lists")
    scratch.drop("open_lists", "merged")
    scratch.release()
    if long_lists.isEmpty():
        return roots
    heads = scratch.keep(long_lists.groupBy(F.col("list").alias("l")).agg(F.min("class").alias("head")), "heads_of_lists")
    families = connected_components(long_lists.join(heads, F.col("list") == F.col("l")).select(F.col("class").alias("a"), F.col("head").alias("b")), scratch, "families")
    with arrow_rows(spark, 256):
        more = scratch.keep(long_list_links(heavy, families, roots, sets, scratch), "long_links")
    return roots if more.isEmpty() else connected_components(links.unionByName(more), scratch, "cc2")


def _rooted_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, root: the component's least class) of every row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    with arrow_rows(docs.sparkSession, 2000):
        heads = scratch.keep(read_sets(docs), "heads")
    classes = scratch.keep(heads.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("rep")), "classes")
    roots = linked_classes(docs, classes, scratch)
    placed = classes.join(roots, F.col("class") == F.col("node"), "left").select("class", "rep", F.coalesce("root", "class").alias("comp"))
    placed = scratch.keep(placed, "placed")
    least = scratch.keep(placed.groupBy("comp").agg(F.min("rep").alias("component_id")), "least")
    named = scratch.keep(placed.join(least, "comp").select(F.col("class").alias("c"), "component_id", F.col("comp").alias("root")), "named")
    joined = heads.join(named, F.col("class") == F.col("c"), "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.col("class").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"), "root")


def similar_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of every row of ``docs``."""
    return _rooted_groups(docs).drop("root")


def _with_class(docs: DataFrame) -> DataFrame:
    """(row, doc, cls: the class of its text) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = TextKernel("space", lower=True)
        for batch in batches:
            for a, b, buf, offsets in text_slices(batch.column("text")):
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([rows.column("row"), rows.column("doc"), pa.array(shingle_sets(kernel, buf, offsets)[3])], names=["row", "doc", "cls"])

    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc"), F.col("text").alias("text"))
    return rows.mapInArrow(memory_returned(run), T.StructType([*rows.schema.fields[:2], T.StructField("cls", T.LongType())]))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of linked documents, of its smallest doc_id (null only where the group has no other).

    Rows without shingles stay once for each doc_id.  Rows that share a doc_id, or lack one, are told
    apart by their texts.  All columns of ``docs`` are kept, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "first")
    groups = scratch.keep(_rooted_groups(docs), "groups")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "class_id"))
    linked = groups.where("n_shingles > 0").groupBy("root").agg(least.alias("first")).select("first.doc_id", "first.class_id")
    blank = groups.where("n_shingles = 0").select("doc_id", "class_id").distinct()
    first = scratch.keep(linked.unionByName(blank).select(F.col("doc_id").alias("k_id"), F.col("class_id").alias("k_class")), "first")
    ids = groups.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    repeated = scratch.keep(ids.where("n > 1").select("doc_id"), "repeated")
    dropped = groups.where("doc_id is not null").join(first, F.col("doc_id") == F.col("k_id"), "left_anti").select("doc_id")
    dropped = scratch.keep(dropped.unionByName(repeated).distinct(), "dropped")
    doc = F.col("d.doc_id").cast("long")
    told = docs.where(F.col("doc_id").isNull())
    kept = docs.where(F.col("doc_id").isNotNull()).alias("d").join(_small(dropped).alias("x"), doc == F.col("x.doc_id"), "left_anti")
    if not repeated.isEmpty():
        told = told.unionByName(docs.alias("d").join(_small(repeated).alias("x"), doc == F.col("x.doc_id"), "left_semi"))
    elif first.where("k_id is null").isEmpty():
        return kept
    own = _with_class(told).join(first, F.col("doc").eqNullSafe(F.col("k_id")) & (F.col("cls") == F.col("k_class")), "left_semi")
    own = own.dropDuplicates(["doc", "cls"]).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    return kept.unionByName(own)


def _small(ids: DataFrame) -> DataFrame:
    """``ids`` with a broadcast hint where they are few enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of linked documents over all documents."""
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, pos, pos + 4), ' ')) AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS pos FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 75 * (x.n + y.n - k)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT u.b, r.root FROM r JOIN u ON r.doc_id = u.a WHERE r.root < u.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.root) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY ALL
"""
