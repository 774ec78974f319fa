"""State machines, runs and retention over ordered events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold_runs(df: DataFrame, by: Sequence[str], order: Sequence[str], same: Sequence[str]) -> DataFrame:
    """Neighbouring rows that agree become one run with its count, first and last place."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = F.lit(False)
    for c in same:
        new = new | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    runs = df.withColumn("_new", (new | (F.row_number().over(w) == 1)).cast("int")).withColumn("run", F.sum("_new").over(w))
    first, last = (f(F.struct(*order)) for f in (F.min, F.max))
    return runs.groupBy(*by, "run", *same).agg(F.count("*").alias("n"), first.alias("first"), last.alias("last"))


#: Events that are folded at a time.
FOLD = 1024


def fold_events(df: DataFrame, key: Sequence[str], order: Sequence[str], event: str, start: str, transitions: dict[tuple[str, str], str]) -> DataFrame:
    """The final state of each key after its events in order, and how many of them were allowed.

    Transitions compose: FOLD events in a row become, for every state they may meet, the
    state they end in and the moves on the way; a key's pieces are folded from the start
    state. So no list is longer than FOLD or the number of a key's pieces.
    """
    states = sorted({start, *[x for (a, _), b in transitions.items() for x in (a, b)]})
    table = F.create_map(*[x for (a, e), b in transitions.items() for x in (F.lit(f"{a}\x1f{e}"), F.lit(b))])

    def step(acc: Column, e: Column) -> Column:
        to = F.try_element_at(table, F.concat(acc["state"], F.lit("\x1f"), e))
        return F.struct(F.coalesce(to, acc["state"]).alias("state"), (acc["moves"] + to.isNotNull().cast("long")).alias("moves"))

    def through(first: str) -> Column:
        return F.aggregate("_events", F.struct(F.lit(first).alias("state"), F.lit(0).cast("long").alias("moves")), step)

    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    pieces = df.withColumn("_piece", F.floor((place - 1) / FOLD))
    events = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(event).alias("_event")))), lambda x: x["_event"])
    folded = pieces.groupBy(*key, "_piece").agg(events.alias("_events")).select(*key, "_piece", F.size("_events").alias("_n"), F.map_from_arrays(F.array(*map(F.lit, states)), F.array(*map(through, states))).alias("_through"))
    whole = folded.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_piece", F.map_entries("_through").alias("ends")))).alias("_all"), F.sum("_n").alias("events"))

    def follow(acc: Column, piece: Column) -> Column:
        end = F.element_at(F.filter(piece["ends"], lambda x: x["key"] == acc["state"]), 1)["value"]
        return F.struct(end["state"].alias("state"), (acc["moves"] + end["moves"]).alias("moves"))

    end = F.aggregate("_all", F.struct(F.lit(start).alias("state"), F.lit(0).cast("long").alias("moves")), follow)
    return whole.withColumn("_end", end).select(*key, F.col("_end.state").alias("state"), F.col("_end.moves").alias("moves"), F.col("events").cast("long").alias("events"))


def compare_and_set(rows: DataFrame, delta: DataFrame, key: str, state: str, allowed: dict[str, Sequence[str]]) -> DataFrame:
    """rows with the states of delta (key, from, to) where the current state is ``from`` and the move is allowed."""
    moves = F.create_map(*[x for a, to in allowed.items() for x in (F.lit(a), F.array(*map(F.lit, to)))])
    d = delta.select(key, F.col("from").alias("_from"), F.col("to").alias("_to"))
    may = (F.col(state) == F.col("_from")) & F.coalesce(F.array_contains(F.try_element_at(moves, F.col(state)), F.col("_to")), F.lit(False))
    return rows.join(d, key, "left").withColumn(state, F.when(may, F.col("_to")).otherwise(F.col(state))).select(rows.columns)


def throttle(df: DataFrame, key: Sequence[str], order: Sequence[str], phase: str, seconds: str, interval: float) -> DataFrame:
    """Events that pass: the first, a change of phase, or an interval since the last that passed.

    The first event of a run of one phase always passes, so runs are folded each alone.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    fresh = ~F.col(phase).eqNullSafe(F.lag(phase).over(w)) | (F.row_number().over(w) == 1)
    runs = df.withColumn("_fresh", fresh.cast("int")).withColumn("_run", F.sum("_fresh").over(w))
    times = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(seconds).cast("double").alias("_s")))), lambda x: x["_s"])

    def step(acc: Column, s: Column) -> Column:
        due = acc["at"].isNull() | (s - acc["at"] >= interval)
        return F.struct(F.when(due, s).otherwise(acc["at"]).alias("at"), (acc["kept"] + due.cast("long")).alias("kept"))

    start = F.struct(F.lit(None).cast("double").alias("at"), F.lit(0).cast("long").alias("kept"))
    each = runs.groupBy(*key, "_run").agg(times.alias("_times")).select(*key, F.aggregate("_times", start, step)["kept"].alias("kept"), F.size("_times").alias("n"))
    return each.groupBy(*key).agg(F.sum("kept").alias("kept"), F.sum("n").cast("long").alias("events"))


def stable_files(polls: DataFrame, path: str, poll: str, size: str, age: str, least_age: float = 2.0) -> DataFrame:
    """Paths at the first poll whose size is that of the poll before and that are old enough; again only after a change."""
    w = Window.partitionBy(path).orderBy(poll)
    steady = (F.col(size) == F.lag(size).over(w)) & (F.col(age) >= least_age)
    marked = polls.withColumn("_steady", F.coalesce(steady, F.lit(False)))
    before = F.lag("_steady", 1, False).over(w)
    return marked.withColumn("_before", before).where(F.col("_steady") & ~F.col("_before")).drop("_steady", "_before")


def newest(df: DataFrame, by: Sequence[str], order: Sequence[str], keep: int) -> DataFrame:
    """The newest rows of each key."""
    w = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")


def prune(df: DataFrame, by: Sequence[str], order: Sequence[str], keep: int, old: Column) -> DataFrame:
    """df without rows beyond the newest ``keep`` that are old as well."""
    w = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where((F.col("_n") <= keep) | ~old).drop("_n")


def expire(ops: DataFrame, tries: str, age: str, most_tries: int = 20, most_age: float = 86_400) -> DataFrame:
    """Operations that still count: those with too many tries that are too old as well are gone."""
    return ops.where(~((F.col(tries) >= most_tries) & (F.col(age) >= most_age)))


def one_per_subject(jobs: DataFrame, kind: str, subject: str, order: Sequence[Column]) -> DataFrame:
    from .relational import first_per_key

    return first_per_key(jobs, [kind, subject], order)


def wanted_without_offer(items: DataFrame, open_rows: DataFrame, offers: DataFrame, item: str) -> DataFrame:
    """New rows for missing items: queued where an offer exists, else wanted; items with an open row are left out."""
    fresh = items.join(open_rows.select(item).distinct(), item, "left_anti")
    marks = offers.select(item).distinct().withColumn("_offer", F.lit(True))
    return fresh.join(marks, item, "left").withColumn("state", F.when(F.col("_offer"), "queued").otherwise("wanted")).drop("_offer")


def session_runs(df: DataFrame, by: Sequence[str], time: str, gap: str) -> DataFrame:
    """Sessions of each key that a gap without events ends."""
    return df.groupBy(*by, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
