"""Selection, grouping, ranking and plan rules over track-like tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]


def run_steps(df: DataFrame, steps: list[Step]) -> DataFrame:
    """An ordered action pipeline."""
    for step in steps:
        df = df.transform(step)
    return df


def main_of_group(df: DataFrame, group: list[str], order: list[str], is_main: Column, eligible: Column) -> DataFrame:
    """Flag one row of each group: nothing new where a main row exists, else the first eligible one."""
    marked = df.withColumns({"__has": F.max(is_main.cast("int")).over(Window.partitionBy(*group)), "__e": eligible})
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("__e").desc(), *order))
    return marked.withColumn("chosen", (F.col("__has") == 0) & F.col("__e") & (rank == 1)).drop("__has", "__e")


def first_of_kind(df: DataFrame, by: list[str], order: list[Column], out: str = "enabled") -> DataFrame:
    """Enable only the first row of each kind."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1)


def top_with_fallback(df: DataFrame, by: list[str], exact: Column, order: list[str], k_exact: int, k_else: int) -> DataFrame:
    """Exact matches up to ``k_exact``; where there is none, the first ``k_else`` rows."""
    marked = df.withColumn("__x", exact)
    marked = marked.withColumn("__any", F.max(F.col("__x").cast("int")).over(Window.partitionBy(*by)))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("__x").desc(), *order))
    keep = F.when(F.col("__any") == 1, F.col("__x") & (F.col("__r") <= k_exact)).otherwise(F.col("__r") <= k_else)
    return marked.withColumn("__r", rank).where(keep).withColumn("rank", F.col("__r").cast("long")).drop("__x", "__any", "__r")


def recent_first(df: DataFrame, by: list[str], key: Column, time: str, ident: str, cap: int) -> DataFrame:
    """Most recently used list: the newest row of each key, newest first, at most ``cap``."""
    newest = df.withColumn("__k", key)
    newest = newest.withColumn("__n", F.row_number().over(Window.partitionBy(*by, "__k").orderBy(F.col(time).desc(), F.col(ident).desc()))).where("__n = 1")
    ranked = newest.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(time).desc(), F.col(ident).desc())).cast("long"))
    return ranked.where(F.col("place") <= cap).drop("__k", "__n")


def expand_plan(df: DataFrame, order: str, by: list[str], expands: Column, first_action: str, second_action: str) -> DataFrame:
    """Tracks that ``expands`` selects become two, the conversion before the original; positions are numbered anew."""
    parts = F.when(expands, F.array(F.struct(F.lit(0).alias("part"), F.lit(first_action).alias("action")), F.struct(F.lit(1).alias("part"), F.lit(second_action).alias("action")))).otherwise(F.array(F.struct(F.lit(0).alias("part"), F.lit("passthrough").alias("action"))))
    opened = df.withColumn("__p", F.explode(parts)).select("*", "__p.part", "__p.action").drop("__p")
    return opened.withColumn("new_pos", F.row_number().over(Window.partitionBy(*by).orderBy(order, "part")).cast("long"))


#: Actions that make two tracks of one, and what then happens to the track itself.
PAIR_ACTIONS = {"aac_plus_passthrough": "passthrough", "aac_plus_ac3": "ac3"}


def audio_pairs(tracks: DataFrame, by: list[str], order: str) -> DataFrame:
    """Tracks whose action asks for a pair get an AAC track before them, which takes over their state; they fall back on it.

    ``tracks``: by, order, action, enabled, is_default, alt_group and others, which the new track shares.  The track itself is
    disabled and copied or converted, both stand in its group (group 1 without one), and ``fallback`` is the
    new track's place.  Adds ``new_pos`` from 1.
    """
    paired = F.coalesce(F.col("action").isin(*PAIR_ACTIONS), F.lit(False))
    after = F.coalesce(*[F.when(F.col("action") == asked, then) for asked, then in PAIR_ACTIONS.items()], "action")
    opened = tracks.withColumns({"__pair": paired, "part": F.explode(F.when(paired, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1))))})
    new, old = F.col("__pair") & (F.col("part") == 0), F.col("__pair") & (F.col("part") == 1)
    state = opened.withColumns({
        "is_default": F.when(new, F.col("is_default") | F.col("enabled")).when(old, False).otherwise(F.col("is_default")), "enabled": F.when(old, False).otherwise(F.col("enabled")),
        "alt_group": F.when(F.col("__pair"), F.when(F.col("alt_group") > 0, F.col("alt_group")).otherwise(1)).otherwise(F.col("alt_group")), "action": F.when(new, "aac").when(old, after).otherwise(F.col("action")),
    })
    numbered = state.withColumn("new_pos", F.row_number().over(Window.partitionBy(*by).orderBy(order, "part")).cast("long"))
    return numbered.withColumn("fallback", F.when(old, F.col("new_pos") - 1)).drop("__pair", "part")


def parse_id_list(text: str) -> list[tuple[int, int]]:
    """``"1,3-5"`` as ranges; blanks are allowed, an inverted or malformed range is an error."""
    found = []
    for part in filter(None, (x.strip() for x in text.split(","))):
        lo, dash, hi = part.partition("-")
        a, b = int(lo), int(hi) if dash else int(lo)
        if b < a:
            raise ValueError(f"inverted range {part!r}")
        found.append((a, b))
    return found


def in_id_list(column: Column, text: str) -> Column:
    """Predicate of an id list; ranges stay ranges, so a wide one costs nothing."""
    test = F.lit(False)
    for a, b in parse_id_list(text):
        test = test | column.between(a, b)
    return test


def missing_ids(df: DataFrame, ident: str, wanted: DataFrame) -> DataFrame:
    """The distinct ids of ``wanted``'s first column that the table lacks."""
    asked = wanted.select(F.col(f"`{wanted.columns[0]}`").alias(ident)).where(F.col(ident).isNotNull()).distinct()
    return asked.join(df.select(ident), ident, "left_anti")


def require_ids(df: DataFrame, ident: str, wanted: list[int]) -> None:
    """Raise for wanted ids (a list that a caller typed) that the table lacks."""
    asked = df.sparkSession.createDataFrame([(i,) for i in wanted], f"{ident} long")
    if missing := sorted(r[0] for r in missing_ids(df, ident, asked).collect()):
        raise KeyError(f"no track with id {missing}")


def rate_limited(df: DataFrame, by: list[str], time: str, ident: str, permits: int, window: int) -> DataFrame:
    """Flag requests that find fewer than ``permits`` others within ``window`` before them."""
    nth = F.lag(time, permits).over(Window.partitionBy(*by).orderBy(time, ident))
    return df.withColumn("admitted", nth.isNull() | (F.col(time) - nth >= window))


def delayed_requests(df: DataFrame, by: list[str], time: str, ident: str, permits: int, window: int) -> DataFrame:
    """Add ``admitted_at``: requests in order of time wait until fewer than ``permits`` were admitted within ``window``.

    A request waits for the one ``permits`` places before it, so each residue of the place is a chain of its own,
    and its admission is a running maximum of times less ``window`` for each step.
    """
    place = F.row_number().over(Window.partitionBy(*by).orderBy(time, ident)) - 1
    chained = df.withColumn("__k", place).withColumns({"__r": F.col("__k") % permits, "__m": F.floor(F.col("__k") / permits) * window})
    w = Window.partitionBy(*by, "__r").orderBy("__k").rowsBetween(Window.unboundedPreceding, 0)
    return chained.withColumn("admitted_at", F.max(F.col(time) - F.col("__m")).over(w) + F.col("__m")).drop("__k", "__r", "__m")


def fresh_entries(df: DataFrame, key: list[str], written: str, ident: str, now: int, max_age: int) -> DataFrame:
    """The latest entry of each key, if it is not older than ``max_age``."""
    latest = df.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(written).desc(), F.col(ident).desc()))).where("__r = 1").drop("__r")
    return latest.where(F.lit(now) - F.col(written) <= max_age)


def enable_language(tracks: DataFrame, by: list[str], language: str, *, kind: str = "audio") -> DataFrame:
    """Enable the first non-auxiliary (else any) track of a language and disable the rest of its alternate group."""
    match = (F.col("kind") == kind) & (F.col("language") == language)
    rank = F.row_number().over(Window.partitionBy(*by, match).orderBy(F.col("is_auxiliary"), "pos"))
    picked = tracks.withColumn("__pick", match & (rank == 1))
    group = F.max(F.when(F.col("__pick"), F.col("alt_group"))).over(Window.partitionBy(*by))
    state = F.when(F.col("__pick"), True).when(F.col("alt_group") == group, False).otherwise(F.col("enabled"))
    return picked.withColumn("enabled", state).drop("__pick")


def complete_languages(tracks: DataFrame, language: str) -> DataFrame:
    """Give tracks of undetermined language the given one."""
    unknown = F.coalesce(F.nullif(F.col("language"), F.lit("")), F.lit("und")) == "und"
    return tracks.withColumn("language", F.when(unknown, language).otherwise(F.col("language")))


def admit_jobs(new: DataFrame, queue: DataFrame) -> DataFrame:
    """Jobs whose path is not waiting or running already."""
    return new.join(queue.where(F.col("status").isin("Ready", "Working")), "path", "left_anti")


def restart_jobs(queue: DataFrame) -> DataFrame:
    """After a restart, interrupted jobs are ready again."""
    return queue.withColumn("status", F.when(F.col("status") == "Working", "Ready").otherwise(F.col("status")))


def current_state(edits: DataFrame, key: list[str]) -> DataFrame:
    """Latest value of each field in an append-only edit log of transactions that were not undone."""
    undone = edits.where("op = 'undo'").select("txn").distinct()
    live = edits.where("op = 'set'").join(undone, "txn", "left_anti")
    return live.groupBy(*key).agg(F.max_by("new", "seq").alias("value"))
