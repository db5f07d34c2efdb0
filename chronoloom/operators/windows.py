"""Cutting a transcript into windows of a token budget, with overlap carried."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import estimated_tokens, render_turn


@dataclass(frozen=True)
class Budget:
    """A budget that leaves room for its overhead."""

    max_input: int = 180_000
    overhead: int = 2_000
    overlap: int = 8

    def __post_init__(self):
        if self.max_input <= self.overhead:
            raise ValueError(f"a budget of {self.max_input} tokens leaves no room beside {self.overhead} of overhead")
        if self.overlap < 0:
            raise ValueError("overlap must not be negative")

    @property
    def capacity(self) -> int:
        return self.max_input - self.overhead


def plan_windows(turns: DataFrame, budget: Budget, key: str = "session_id") -> DataFrame:
    """session, window_ix, pos, id of every turn in every window.

    The plan depends on what came before, so it is a fold over each session's turns in order.  Sorted turns are streamed, as ids and costs without their texts, and a turn's rows leave at once: what is kept of a session is
    its open window's number, size and cost and its last `overlap` turns, however many turns it has.  The carry after a full window is not priced again with the turn that follows, so a window may hold up to half its
    capacity more than the budget.
    """
    cost = (estimated_tokens(render_turn("id", "physical_speaker", "text")) + 1).cast("bigint")
    cap, lap = budget.capacity, budget.overlap
    kind = turns.schema[key].dataType.simpleString()
    rows = turns.select(key, "ord", F.col("id").cast("string").alias("id"), cost.alias("cost")).repartition(key).sortWithinPartitions(key, "ord", "id", "cost").select(key, "id", "cost")

    def run(batches):
        import pyarrow as pa

        session, ix, n, total, tail = object(), 0, 0, 0, []  # no session yet
        for b in batches:
            keys, windows, places, ids, costs = [], [], [], [], []

            def put(pos: int, turn: tuple[str, int]) -> None:
                keys.append(session)  # noqa: B023
                windows.append(ix)  # noqa: B023
                places.append(pos)  # noqa: B023
                ids.append(turn[0])  # noqa: B023
                costs.append(turn[1])  # noqa: B023

            for k, *turn in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if k != session:
                    session, ix, n, total, tail = k, 0, 0, 0, []
                price = turn[1]
                if price > cap:  # a window of its own
                    ix += n > 0
                    put(0, turn)
                    ix, n, total, tail = ix + 1, 0, 0, []
                    continue
                if n and total + price > cap:
                    carried = sum(c for _, c in tail)
                    ix, n, total, tail = (ix + 1, len(tail), carried, tail) if carried <= cap // 2 else (ix + 1, 0, 0, [])
                    for pos, old in enumerate(tail):
                        put(pos, old)
                put(n, turn)
                n, total, tail = n + 1, total + price, [*tail, turn][-lap:] if lap else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, b.schema.field(0).type), pa.array(windows, pa.int32()), pa.array(places, pa.int32()), pa.array(ids, pa.string()), pa.array(costs, pa.int64())], names=[key, "window_ix", "pos", "id", "cost"]
            )

    return rows.mapInArrow(run, f"{key} {kind}, window_ix int, pos int, id string, cost bigint")
