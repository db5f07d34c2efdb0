"""Plug points: engines and models are callables that others bring; only their contracts are here."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Plug(Protocol):
    def preflight(self) -> None:
        """Raise before anything is written, if the plug can't work."""


@dataclass(frozen=True)
class Model:
    """complete(prompt) -> (reply, tokens in, tokens out); retries only where a reply can't be parsed."""

    complete: Callable[[str], tuple[str, int, int]]
    retries: int = 1

    def preflight(self) -> None:
        if not callable(self.complete):
            raise TypeError("a model needs a callable")


# What each claim of a reply must say.
SAID = {"scenes": ("title", "summary"), "entities": ("name", "kind"), "threads": ("description",), "questions": ("issue", "why_it_matters")}
CONSEQUENCES = ("low", "medium", "high")


def shape_error(payload: dict, known: set[str]) -> str | None:
    """The first thing wrong with a reply, or None.

    Groups are lists of objects, or absent or null; what a claim must say is a string with more than space; it cites one turn at least, by strings, all of its window (by their exact
    id, or one that differs in leading zeros from one known id only); a question's confidence is a number of [0, 1] and its consequence a known one.
    """
    loose: dict[str, int] = {}
    for k in known:
        loose[_unpadded(k)] = loose.get(_unpadded(k), 0) + 1
    for group, fields in SAID.items():
        items = payload.get(group)
        if items is None:
            continue
        if not isinstance(items, list) or not all(isinstance(x, dict) for x in items):
            return f"{group} must be a list of objects"
        for x in items:
            for f in fields:
                if not isinstance(x.get(f), str) or not x[f].strip():
                    return f"{group} must say {f}"
            ids = x.get("turn_ids")
            if not isinstance(ids, list) or not ids or not all(isinstance(i, str) and i.strip() for i in ids):
                return f"{group} must cite turns by their ids"
            if any(i not in known and loose.get(_unpadded(i)) != 1 for i in ids):
                return f"{group} cites a turn outside its window"
            if group == "questions":
                c = x.get("confidence")
                if isinstance(c, bool) or not isinstance(c, int | float) or not 0 <= c <= 1:
                    return "questions need a confidence from 0 to 1"
                if x.get("consequence") not in CONSEQUENCES:
                    return "questions need a known consequence"
    return None


def _unpadded(turn_id: str) -> str:
    """An id with the number that ends it, if any, as digits without leading zeros."""
    head = turn_id.rstrip("0123456789")
    return head + (turn_id[len(head) :].lstrip("0") or "0") if len(head) < len(turn_id) else turn_id


OUT = "session_id bigint, window_ix bigint, payload string, attempts int, tokens_in bigint, tokens_out bigint, error string"


def analysed(prompts: DataFrame, model: Model) -> DataFrame:
    """prompts(session_id, window_ix, prompt, turn_ids) through a model, window by window: the reply's object, if it can be read and shape_error finds nothing; what has the wrong
    shape or cites a turn outside the window is refused, never retried."""
    model.preflight()

    def run(frames):
        for f in frames:
            rows = []
            for r in f.itertuples():
                error, payload, a, tin, tout = None, None, 0, 0, 0
                for a in range(1, model.retries + 2):
                    text, i, o = model.complete(r.prompt)
                    tin, tout = tin + i, tout + o
                    try:
                        payload, error = json.loads(text[text.index("{") : text.rindex("}") + 1], strict=False), None
                        break
                    except ValueError as e:
                        error = f"unparseable reply: {e}"
                if payload is not None:
                    error = shape_error(payload, set(r.turn_ids))
                rows.append((r.session_id, r.window_ix, json.dumps(payload) if error is None else None, a, tin, tout, error))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    return prompts.select("session_id", "window_ix", "prompt", "turn_ids").mapInPandas(run, OUT)


def usage(analyses: DataFrame) -> DataFrame:
    """A7 of a run: requests and tokens of each session."""
    return analyses.groupBy("session_id").agg(F.count("*").alias("windows"), F.sum("attempts").alias("requests"), F.sum(F.col("attempts") - 1).alias("retries"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
