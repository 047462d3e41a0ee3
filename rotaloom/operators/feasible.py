"""Proof that a day cannot be filled.

Whoever takes a slot is busy while it runs, so slots that run at one moment need
as many different members.  Where some shifts S need more members than can take any of
them, no roster exists; such a set S with its members N(S) is the witness.  It is found
per organisation, day and moment as a minimum cut between shifts and classes of members,
not single members, so a group is bounded by the shifts of a day times the classes.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotaloom.operators.candidates import CLASS
from rotaloom.plans.skew import growing
from rotaloom.plans.workers import ship

WITNESS = "org_id int, shift_date date, at_min int, n_needed long, n_members long, shift_ids array<string>"


def worst_set(needs: dict, members: dict, able: dict) -> tuple[int, frozenset]:
    """The largest excess of needed over able members of any set of shifts, and the smallest set that has it.

    ``needs`` has the slots of each shift, ``members`` those of each class, ``able`` the classes of each shift.
    The excess is the slots that a maximum flow from shifts to classes leaves open.
    """
    flow: dict = {}
    used = dict.fromkeys(members, 0)
    open_ = dict(needs)
    takers: dict = {c: set() for c in members}

    def reach(starts) -> tuple[object, dict]:
        """Breadth-first over shift -> class -> a shift that hands a member back; ends at a class with members left."""
        came: dict = {("s", s): None for s in starts}
        queue = deque(came)
        while queue:
            node = queue.popleft()
            kind, name = node
            if kind == "c" and used[name] < members[name]:
                return node, came
            ahead = [("c", c) for c in able[name]] if kind == "s" else [("s", s) for s in takers[name] if flow[s, name] > 0]
            for step in ahead:
                if step not in came:
                    came[step] = node
                    queue.append(step)
        return None, came

    for shift in needs:
        while open_[shift]:
            end, came = reach([shift])
            if end is None:
                break
            path = [end]
            while came[path[-1]] is not None:
                path.append(came[path[-1]])
            path.reverse()  # shift, class, shift, ..., class
            # Give as many members as the path, the class at its end and the shift can.
            backs = [flow[path[i + 1][1], path[i][1]] for i in range(1, len(path) - 1, 2)]
            n = min([open_[shift], members[end[1]] - used[end[1]], *backs])
            for i in range(0, len(path) - 1, 2):
                s, c = path[i][1], path[i + 1][1]
                flow[s, c] = flow.get((s, c), 0) + n
                takers[c].add(s)
                if i + 2 < len(path):
                    flow[path[i + 2][1], c] -= n
            used[end[1]] += n
            open_[shift] -= n
    short = [s for s in needs if open_[s]]
    _, came = reach(short)
    return sum(open_.values()), frozenset(name for kind, name in came if kind == "s") if short else frozenset()


def witnesses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of moments with the shifts that each sort of members may take, those that cannot be filled."""
    schema = pa.schema([
        ("org_id", pa.int32()), ("shift_date", pa.date32()), ("at_min", pa.int32()),
        ("n_needed", pa.int64()), ("n_members", pa.int64()), ("shift_ids", pa.list_(pa.string())),
    ])
    for batch in batches:
        found = []
        for org, day, at, sorts in zip(*(c.to_pylist() for c in batch.columns)):
            members = {i: sort["n"] for i, sort in enumerate(sorts)}
            needs = dict(sorted((s["shift_id"], s["n_slots"]) for sort in sorts for s in sort["shifts"]))
            able: dict = {s: [] for s in needs}
            for i, sort in enumerate(sorts):
                for s in sort["shifts"]:
                    able[s["shift_id"]].append(i)
            excess, shifts = worst_set(needs, members, able)
            if excess:
                needed = sum(needs[s] for s in shifts)
                found.append((org, day, at, needed, needed - excess, sorted(shifts)))
        columns = zip(*found) if found else [[]] * len(schema)
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def moments(free: DataFrame) -> DataFrame:
    """(org_id, shift_date, at_min, shift and class columns): what runs whenever a shift begins."""
    own = free.filter("problem = 'KVW'")
    starts = own.select("org_id", "shift_date", F.col("start_min").alias("at_min")).distinct()
    runs = own.join(growing(starts), ["org_id", "shift_date"]).filter("start_min <= at_min and at_min < end_min")
    return runs.select("org_id", "shift_date", "at_min", "shift_id", "n_slots", *CLASS[1:], "n_persons")


def impossible_moments(free: DataFrame) -> DataFrame:
    """Witnesses of days that cannot be filled, one row per organisation, day and moment.

    ``n_needed`` members are needed at ``at_min`` by the shifts ``shift_ids``, and only ``n_members`` can take any of
    them.  Of all such sets the row has the one with the largest excess, and of these the smallest.  No row proves
    nothing beyond that moment: whole days and the rule of teams may still forbid a roster.  In team mode
    nothing is forbidden at one moment, so ``free`` should come from a season of single members.
    Shifts without any candidate are not in ``free``; ``uncovered_shifts`` lists them.
    """

    # Where every shift alone has as many able members as all slots need, any order of filling works; these go first.
    rows = moments(free)
    keys = ["org_id", "shift_date", "at_min"]
    fewest = rows.groupBy(*keys, "shift_id").agg(F.sum("n_persons").alias("n_able"), F.max("n_slots").alias("n_slots"))
    tight = fewest.groupBy(*keys).agg(F.min("n_able").alias("n_able"), F.sum("n_slots").alias("n_slots")).filter("n_able < n_slots")
    # Classes that may take the same shifts count as one.
    shift = F.struct("shift_id", F.col("n_slots").cast("int").alias("n_slots"))
    classes = (
        rows.join(growing(tight.select(*keys)), keys, "left_semi")
        .groupBy(*keys, *CLASS[1:])
        .agg(F.sort_array(F.collect_set(shift)).alias("shifts"), F.max("n_persons").alias("n"))
    )
    alike = classes.groupBy(*keys, "shifts").agg(F.sum("n").cast("long").alias("n"))
    judged = alike.groupBy(*keys).agg(F.collect_list(F.struct("shifts", "n")).alias("able"))
    ship(free.sparkSession)
    return judged.mapInArrow(witnesses, WITNESS)
