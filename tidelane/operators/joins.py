"""As-of, range, nearest and rule joins, expressed by windows and equi joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a dimension that is broadcast at most; a larger one meets its partner by shuffle.
BROADCAST_ROWS = 100_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count proves it small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, values: list[str]) -> DataFrame:
    """For each left row the last right row with right_on <= left_on: one sort of the union, no range join."""
    kinds = {f.name: f.dataType for f in right.schema.fields}
    mine = left.select("*", *[F.lit(None).cast(kinds[v]).alias(f"__{v}") for v in values], F.col(left_on).alias("__t"), F.lit(1).alias("__side"))
    rest = [c for c in left.columns if c not in by]
    kinds_left = {f.name: f.dataType for f in left.schema.fields}
    theirs = right.select(*by, *[F.lit(None).cast(kinds_left[c]).alias(c) for c in rest], *[F.col(v).alias(f"__{v}") for v in values], F.col(right_on).alias("__t"), F.lit(0).alias("__side"))
    both = mine.unionByName(theirs)
    w = Window.partitionBy(*by).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    packed = F.when(F.col("__side") == 0, F.struct(*[F.col(f"__{v}").alias(v) for v in values]))
    found = both.withColumn("__m", F.last(packed, ignorenulls=True).over(w)).where("__side = 1")
    return found.select(*left.columns, *[F.col(f"__m.{v}").alias(v) for v in values])


def region_lookup(rows: DataFrame, regions: DataFrame, by: list[str], position: str, start: str, end: str, values: list[str], cell: int) -> DataFrame:
    """The disjoint half-open region that holds a position; a position that only equals a region's end takes that region.

    Regions are dealt into cells of ``cell`` positions, each into all cells that it touches, and met by equality of the
    cell: two hash joins without a sort of ``rows`` while the regions are few, two shuffle joins beyond.  Choose ``cell`` near a
    region's usual length.
    """
    own, at = [F.col(c).alias(f"__{c}") for c in by], lambda c: F.floor(F.col(c) / cell)
    spans = regions.select(*own, F.col(start).alias("__s"), F.col(end).alias("__e"), F.struct(*values).alias("__v"))
    inside = small_side(spans.withColumn("__cell", F.explode(F.sequence(at("__s"), F.greatest(at("__s"), F.floor((F.col("__e") - 1) / cell))))))
    ends = small_side(spans.select(*[f"__{c}" for c in by], F.col("__e").alias("__at"), F.col("__v").alias("__w")))
    same = [F.col(c) == F.col(f"__{c}") for c in by]

    def join(left: DataFrame, right: DataFrame, *tests: Column) -> DataFrame:
        on = F.lit(True)
        for t in (*same, *tests):
            on = on & t
        return left.join(right, on, "left").drop(*[f"__{c}" for c in by])

    found = join(rows, inside, at(position) == F.col("__cell"), F.col(position) >= F.col("__s"), F.col(position) < F.col("__e")).drop("__s", "__e", "__cell")
    found = join(found, ends, F.col("__v").isNull() & (F.col(position) == F.col("__at"))).withColumn("__v", F.coalesce("__v", "__w"))
    return found.select(*rows.columns, *[F.col(f"__v.{v}").alias(v) for v in values])


def first_match(candidates: DataFrame, key: list[str], rank: list[Column]) -> DataFrame:
    """The best-ranked row of each key; ``rank`` must be a total order."""
    return candidates.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*rank))).where("__r = 1").drop("__r")


def most_specific(rows: DataFrame, rules: DataFrame, pairs: list[tuple[str, str]], rule_order: str, values: list[str]) -> DataFrame:
    """The rule whose given fields all match, by the number and weight of given fields, then first given.

    A null field of a rule matches anything; field i weighs 2**i.  Rules with the same fields given are one
    equality join (at most 2**fields of them, each broadcast while a count proves its rules few); rules that give
    no field are one row.  No row meets more than one rule of a join, so nothing is ranked.
    """
    given = F.lit(0)
    for i, (_, rule) in enumerate(pairs):
        given = given + F.when(F.col(rule).isNotNull(), 1 << i).otherwise(0)
    marked = rules.withColumn("__given", given)
    found, out = [], rows
    for mask in sorted((r[0] for r in marked.select("__given").distinct().collect()), reverse=True):
        used = [(column, rule) for i, (column, rule) in enumerate(pairs) if mask >> i & 1]
        mine = marked.where(F.col("__given") == mask)
        pick = F.min_by(F.struct(*values), rule_order).alias(f"__u{mask}")
        mine = mine.groupBy(*[F.col(rule).alias(f"__r_{rule}") for _, rule in used]).agg(pick) if used else mine.agg(pick)
        on = F.lit(True)
        for column, rule in used:
            on = on & (F.col(column) == F.col(f"__r_{rule}"))
        out = (out.join(small_side(mine), on, "left") if used else out.crossJoin(F.broadcast(mine))).drop(*[f"__r_{rule}" for _, rule in used])
        found.append(f"__u{mask}")
    best = F.coalesce(*found) if found else None
    return out.select(*rows.columns, *[(best[v] if found else F.lit(None)).alias(v) for v in values])


def nearest_preferred(rows: DataFrame, by: list[str], ident: str, position: str, wanted: Column, takes: Column, same: str) -> DataFrame:
    """Fallback of each row that ``wanted`` selects among rows that ``takes`` selects, within ``by``.

    Order of preference: nearest earlier with the same value of ``same``, nearest later with it, nearest
    earlier, nearest later.  Four as-of windows replace the self join.
    """
    here = rows.withColumn("__ok", takes)
    pick = F.when(F.col("__ok"), F.col(ident))
    before, after = (Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)
    w_same, w_any = Window.partitionBy(*by, same).orderBy(position), Window.partitionBy(*by).orderBy(position)
    found = F.coalesce(F.last(pick, True).over(w_same.rowsBetween(*before)), F.first(pick, True).over(w_same.rowsBetween(*after)), F.last(pick, True).over(w_any.rowsBetween(*before)), F.first(pick, True).over(w_any.rowsBetween(*after)))
    return here.withColumn("fallback", F.when(wanted, found)).drop("__ok")


def merge_left_wins(main: DataFrame, other: DataFrame, key: list[str], value: str) -> DataFrame:
    """Full outer merge: ``main``'s value where it has one."""
    return main.alias("m").join(other.alias("o"), key, "full").select(*key, F.coalesce(F.col(f"m.{value}"), F.col(f"o.{value}")).alias(value))


def upsert_tags(old: DataFrame, new: DataFrame, key: list[str], value: str, *, overwrite: bool, drop_missing: Column | None = None) -> DataFrame:
    """Merge tag tables; with ``drop_missing`` old tags that it selects and the new table lacks are removed first."""
    if drop_missing is not None:
        gone = old.where(drop_missing).join(new, key, "left_anti").select(*key)
        old = old.join(gone, key, "left_anti")
    return merge_left_wins(*((new, old) if overwrite else (old, new)), key, value)


def symmetric_difference(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys that only one side has, with the side."""
    return a.join(b, key, "left_anti").select(*key, F.lit("left").alias("side")).unionByName(b.join(a, key, "left_anti").select(*key, F.lit("right").alias("side")))


def zip_by_position(a: DataFrame, b: DataFrame, by: list[str], order_a: list[str], order_b: list[str]) -> DataFrame:
    """Join the i-th rows of both sides within ``by``."""
    number = lambda d, o: d.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(*o)))
    return number(a, order_a).join(number(b, order_b), [*by, "pos"])
