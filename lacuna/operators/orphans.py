"""References to records that do not exist, by keyed state over time.

The state has one row an id: whether its parent is present, and how many
references to it there are by table.  New references probe the times in which
their parent was present; an arriving parent resolves the references that wait
for it, a deletion reopens them.  References never meet in a window: they are
joined with the few times at which their parent came or went, so an id with very
many references is split like any other skewed key.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacuna.functions.ids import id_form
from lacuna.plans.runtime import Folder, Scratch


@dataclass(frozen=True)
class Source:
    """Rows with an id and a time; ``key`` names the reference rows in results."""

    df: DataFrame
    id: str
    time: str
    key: str | None = None


_ARRIVAL, _DELETION = 0, 1
_CHANGES = "id string, t timestamp_ntz, turn int, here boolean"
_REFERENCES = "id string, t timestamp_ntz, ref_table string, ref_seq bigint"
_ORPHANS = "ref_table string, ref_seq bigint, id string, t timestamp_ntz"
_DELTAS = "ref_table string, month int, refs bigint, orphans bigint, change bigint"
_STATE = "id string, here boolean, last_change timestamp_ntz, last_seen timestamp_ntz, refs map<string,bigint>"


def _month(t: Column) -> Column:
    return F.year(t) * 12 + F.month(t) - 1


def _events(references: dict[str, Source], parents: Source, deletions: Source | None) -> tuple[DataFrame, DataFrame]:
    """(changes, references) of all rows that have an id and a time.

    At one time arrivals come before deletions and these before references.
    """

    def take(s: Source, *more: Column) -> DataFrame:
        return s.df.select(id_form(F.col(s.id)).alias("id"), F.col(s.time).cast("timestamp_ntz").alias("t"), *more).where("id is not null and t is not null")

    changes = take(parents, F.lit(_ARRIVAL).alias("turn"), F.lit(True).alias("here")).distinct()
    if deletions:
        changes = changes.unionByName(take(deletions, F.lit(_DELETION).alias("turn"), F.lit(False).alias("here")).distinct())
    refs = None
    for name, s in references.items():
        part = take(s, F.lit(name).alias("ref_table"), F.col(s.key).cast("bigint").alias("ref_seq"))
        refs = part if refs is None else refs.unionByName(part)
    return changes, refs


def _turns(changes: DataFrame, state: DataFrame | None) -> DataFrame:
    """(id, t, month, here, until): the changes that make a difference, each with the time of the next; t null for what the state begins with.

    Within a month by id and month, then over an id's months.
    """
    c = changes.withColumn("month", _month(F.col("t")))
    inside = F.lag("here").over(Window.partitionBy("id", "month").orderBy("t", "turn"))
    c = c.withColumn("was", inside).where("was is null or was != here").select("id", "t", "turn", "month", "here")
    if state is not None:
        none = [F.lit(None).cast("timestamp_ntz").alias("t"), F.lit(-1).alias("turn"), F.lit(None).cast("int").alias("month")]
        c = c.unionByName(state.where("here").select("id", *none, "here"))
    order = Window.partitionBy("id").orderBy(F.col("t").asc_nulls_first(), "turn")
    c = c.withColumn("was", F.coalesce(F.lag("here").over(order), F.lit(False))).where("was != here")
    return c.withColumn("until", F.lead("t").over(order)).select("id", "t", "month", "here", "until")


def _orphans(refs: DataFrame, turns: DataFrame) -> DataFrame:
    present = turns.where("here").select(F.col("id").alias("pid"), F.col("t").alias("since"), "until")
    at = (F.col("id") == F.col("pid")) & (F.col("since").isNull() | (F.col("since") <= F.col("t"))) & (F.col("until").isNull() | (F.col("t") < F.col("until")))
    return refs.join(present, at, "left_anti").select("ref_table", "ref_seq", "id", "t")


def _cells(refs: DataFrame, turns: DataFrame, tables: list[str], state: DataFrame | None) -> DataFrame:
    """(id, ref_table, month, n, after, change): references of each month, whether the parent is present at its end, change of the number waiting."""
    ends = turns.where("month is not null").groupBy("id", "month").agg(F.max_by("here", "t").alias("after"))
    ends = ends.select("id", F.explode(F.array(*map(F.lit, tables))).alias("ref_table"), "month", F.lit(0).cast("bigint").alias("n"), "after")
    counts = refs.groupBy("id", "ref_table", _month(F.col("t")).alias("month")).agg(F.count("*").alias("n")).withColumn("after", F.lit(None).cast("boolean"))
    x = ends.unionByName(counts).groupBy("id", "ref_table", "month").agg(F.sum("n").alias("n"), F.bool_or("after").alias("after"))
    if state is not None:
        x = x.join(state.select("id", "here", "refs"), "id", "left").withColumn("base", F.coalesce(F.try_element_at("refs", F.col("ref_table")), F.lit(0))).drop("refs")
    else:
        x = x.withColumn("here", F.lit(False)).withColumn("base", F.lit(0).cast("bigint"))
    by = Window.partitionBy("id", "ref_table").orderBy("month")
    start = F.coalesce("here", F.lit(False))
    x = x.withColumn("after", F.coalesce(F.last("after", ignorenulls=True).over(by), start)).withColumn("total", F.col("base") + F.sum("n").over(by))
    x = x.withColumn("waiting", F.when(F.col("after"), 0).otherwise(F.col("total")))
    return x.withColumn("change", F.col("waiting") - F.coalesce(F.lag("waiting").over(by), F.when(start, 0).otherwise(F.col("base"))))


def _deltas(cells: DataFrame, orphans: DataFrame) -> DataFrame:
    """(ref_table, month, refs, orphans, change)."""
    x = cells.groupBy("ref_table", "month").agg(F.sum("n").alias("refs"), F.sum("change").alias("change"))
    return x.join(_monthly(orphans), ["ref_table", "month"], "left").select("ref_table", "month", "refs", F.coalesce("orphans", F.lit(0)).alias("orphans"), "change")


def _monthly(orphans: DataFrame) -> DataFrame:
    return orphans.groupBy("ref_table", _month(F.col("t")).alias("month")).agg(F.count("*").alias("orphans"))


def _report(deltas: DataFrame) -> DataFrame:
    """(ref_table, period, orphans, open_at_end) of summed deltas: one row a table and month from here on."""
    x = deltas.groupBy("ref_table", "month").agg(*[F.sum(c).alias(c) for c in ("refs", "orphans", "change")]).where("refs > 0 or change != 0")
    period = F.format_string("%04d-%02d", F.expr("month div 12"), F.expr("month % 12 + 1"))
    run = Window.partitionBy("ref_table").orderBy("month")
    return x.select("ref_table", period.alias("period"), "orphans", F.sum("change").over(run).alias("open_at_end"))


def orphan_references(references: dict[str, Source], parents: Source, deletions: Source | None = None) -> DataFrame:
    """(ref_table, ref_seq, id, t) of the references whose id was not present at their time, of whole tables at once.

    Present: of the arrivals and deletions of the id up to then (the time itself
    included) the latest is an arrival; at equal times a deletion is later.  Rows
    without an id (null or blank) refer to nothing and are not listed, nor are
    references without a time; arrivals and deletions without one have no
    effect.  Repeated references come out each.  Empty tables are fine; columns
    of other names are not read.
    """
    changes, refs = _events(references, parents, deletions)
    return _orphans(refs, _turns(changes, None))


def orphan_counts(references: dict[str, Source], parents: Source, deletions: Source | None = None) -> DataFrame:
    """(ref_table, period, orphans, open_at_end): per table and calendar month ('2024-03'), of whole tables at once.

    orphans: references of the month whose id was not present at their time.
    open_at_end: all references so far whose id is not present when the month
    ends; those whose parent came later are resolved, those whose parent was
    deleted since are open again.  Months without any change are not listed.
    """
    changes, refs = _events(references, parents, deletions)
    turns = _turns(changes, None)
    return _report(_deltas(_cells(refs, turns, list(references), None), _orphans(refs, turns)))


class OrphanLedger:
    """The keyed state in a folder, carried on step by step with whatever rows are new.

    A step reads the state and its own rows.  Only where a row comes late, that
    is earlier than what was already settled about its id, are the kept rows of
    these ids read again and what was said of them is replaced; so the ledger
    always says what one pass over all rows would.  A step counts once its
    commit file is there; one that broke off leaves no trace.  One writer at a
    time; the tables' names stay the same.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)
        self.path = self.folder.path

    def parts(self) -> list[str]:
        return [n.split(".")[1] for n in self.folder.names("commits")]

    def _read(self, name: str, schema: str, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{name}/{p}" for p in parts])

    def advance(self, references: dict[str, Source], parents: Source, deletions: Source | None = None) -> None:
        """Take in new rows of the tables; rows without id or time are passed over, as in orphan_references."""
        scratch = Scratch(self.spark, "ledger")
        old, part, tables = self.parts(), uuid.uuid4().hex, list(references)
        changes, refs = _events(references, parents, deletions)
        write = lambda df, name: df.write.parquet(f"{self.path}/{name}/{part}")
        write(changes, "changes")
        write(refs, "references")
        changes, refs = self._read("changes", _CHANGES, [part]), self._read("references", _REFERENCES, [part])
        state = self._read("state", _STATE, old[-1:]) if old else None
        late, again = None, None
        if old:
            first = changes.groupBy("id").agg(F.min("t").alias("c")).join(refs.groupBy("id").agg(F.min("t").alias("r")), "id", "full")
            late = first.join(state, "id").where("c <= last_seen or r < last_change").select("id")
            late = scratch.save(late, "late")
            if late.isEmpty():
                late = None
        if late is not None:
            kept = [self._read(n, s, old).join(late, "id", "left_semi") for n, s in (("changes", _CHANGES), ("references", _REFERENCES))]
            new = [d.join(late, "id", "left_semi") for d in (changes, refs)]
            before = self._settled(*kept, tables, None, scratch)
            again = self._settled(kept[0].unionByName(new[0]).distinct(), kept[1].unionByName(new[1]), tables, None, scratch)
            changes, refs = (d.join(late, "id", "left_anti") for d in (changes, refs))
            state = state.join(late, "id", "left_anti")
        orphans, deltas, ends = self._settled(changes, refs, tables, state, scratch)
        if state is not None:
            ends = ends.unionByName(state.join(ends.select("id"), "id", "left_anti"))
        if again is not None:
            orphans, ends = orphans.unionByName(again[0]), ends.unionByName(again[2])
            undone = before[1].select("ref_table", "month", *[(-F.col(c)).alias(c) for c in ("refs", "orphans", "change")])
            deltas = deltas.unionByName(again[1]).unionByName(undone)
        write(orphans, "orphans")
        write(deltas, "deltas")
        write(ends, "state")
        write(late if late is not None else self.spark.createDataFrame([], "id string"), "revised")
        self.folder.write(f"commits/{len(old):06d}.{part}", json.dumps({"tables": tables, "late": late is not None}))

    def _settled(self, changes: DataFrame, refs: DataFrame, tables: list[str], state: DataFrame | None, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(orphans, deltas, state afterwards of the ids that have rows)."""
        turns = scratch.save(_turns(changes, state), "turns")
        orphans = scratch.save(_orphans(refs, turns), "orphans")
        cells = scratch.save(_cells(refs, turns, tables, state).select("id", "ref_table", "month", "n", "after", "change"), "cells")
        ends = cells.groupBy("id", "ref_table").agg(F.sum("n").alias("n"), F.max_by("after", "month").alias("after"))
        ends = ends.groupBy("id").agg(F.bool_or("after").alias("here"), F.map_from_entries(F.collect_list(F.struct("ref_table", "n"))).alias("new"))  # one entry a table
        seen = changes.groupBy("id").agg(F.max("t").alias("c")).join(refs.groupBy("id").agg(F.max("t").alias("r")), "id", "full")
        ends = seen.join(ends, "id", "left")
        if state is not None:
            ends = ends.join(state.withColumnRenamed("here", "was"), "id", "left")
        else:
            ends = ends.withColumns({"was": F.lit(False), "last_change": F.lit(None).cast("timestamp_ntz"), "last_seen": F.lit(None).cast("timestamp_ntz"), "refs": F.lit(None).cast("map<string,bigint>")})
        sums = F.map_from_arrays(F.array(*map(F.lit, tables)), F.array(*[F.coalesce(F.try_element_at("refs", F.lit(n)), F.lit(0)) + F.coalesce(F.try_element_at("new", F.lit(n)), F.lit(0)) for n in tables]))
        ends = ends.select("id", F.coalesce("here", "was", F.lit(False)).alias("here"), F.greatest("last_change", "c").alias("last_change"), F.greatest("last_seen", "c", "r").alias("last_seen"), sums.alias("refs"))
        return orphans, _deltas(cells, orphans), scratch.save(ends, "ends")

    def orphans(self) -> DataFrame:
        """(ref_table, ref_seq, id, t), as orphan_references gives them for all rows so far."""
        parts, out = self.parts(), None
        for i, p in enumerate(parts):
            own = self._read("orphans", _ORPHANS, [p])
            if later := [q for q in parts[i + 1 :] if json.loads(self.folder.read(f"commits/{parts.index(q):06d}.{q}"))["late"]]:
                own = own.join(self._read("revised", "id string", later).distinct(), "id", "left_anti")
            out = own if out is None else out.unionByName(own)
        out = self._read("orphans", _ORPHANS, []) if out is None else out
        return out.select("ref_table", "ref_seq", "id", "t")

    def counts(self) -> DataFrame:
        """(ref_table, period, orphans, open_at_end), as orphan_counts gives them for all rows so far."""
        return _report(self._read("deltas", _DELTAS, self.parts()))
