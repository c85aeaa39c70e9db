"""Orphan references as a stream: keyed state of present parents and waiting references."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lacuna.plans.runtime import ship

_OUTPUT = "id string, ref_table string, period string, change string, references bigint"
_STATE = "present boolean, tables array<string>, periods array<string>, counts array<bigint>"


def track(events: DataFrame) -> DataFrame:
    """(id, ref_table, period, change, references): what each micro-batch changes.

    events: (id, t, kind, ref_table), kind one of arrival, deletion, reference;
    id in comparable form.  An id's state is whether its parent is present and
    how many references of each table and month it has, not the references
    themselves.  change is 'orphan' (new references without a parent), 'resolved'
    (their parent came) or 'reopened' (their parent was deleted).  Events of one
    micro-batch are taken by time, arrivals first; an event that comes in a later
    micro-batch counts as later.  Rows without id or time are passed over.
    """
    ship(events.sparkSession)
    turn = {"arrival": 0, "deletion": 1, "reference": 2}

    def work(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        present, counts = False, {}
        if state.exists:
            present, tables, periods, numbers = state.get
            counts = dict(zip(zip(tables, periods, strict=True), numbers, strict=True))
        rows = pd.concat(list(frames))
        rows = rows.assign(turn=rows["kind"].map(turn)).dropna(subset=["turn", "t"]).sort_values(["t", "turn"], kind="stable")
        out: list[tuple] = []
        for t, kind, table in zip(rows["t"], rows["kind"], rows["ref_table"], strict=True):
            if kind == "reference":
                at = (str(table), t.strftime("%Y-%m"))
                counts[at] = counts.get(at, 0) + 1
                if not present:
                    out.append((key[0], *at, "orphan", 1))
            elif present != (kind == "arrival"):
                present = kind == "arrival"
                out += [(key[0], *at, "resolved" if present else "reopened", n) for at, n in counts.items()]
        state.update((present, [a for a, _ in counts], [b for _, b in counts], list(counts.values())))
        yield pd.DataFrame(out, columns=["id", "ref_table", "period", "change", "references"])

    keyed = events.where("id is not null and t is not null").select("id", "t", "kind", "ref_table").groupBy("id")
    return keyed.applyInPandasWithState(work, _OUTPUT, _STATE, "append", GroupStateTimeout.NoTimeout)
