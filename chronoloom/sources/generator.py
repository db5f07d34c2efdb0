"""Long synthetic sessions from a plan: beats of authored lines, filled up in turn from a pool until each beat's share of the time is used."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import vary_digits



def generate(plans: DataFrame, word_ms: int = 400, gap_ms: int = 400) -> DataFrame:
    """plans(session_id, target_ms, beat, lines array<struct<speaker,text>>, pool array<struct<speaker,text>>) -> session_id, ord, id, speaker, text, start_ms, end_ms.

    The clock decides where a beat stops, so each session is a loop of its own; numbers in fillers move by column functions afterwards.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, clock = [], 0
        beats = pdf.sort_values("beat")
        for i, b in enumerate(beats.itertuples()):
            stop = int(b.target_ms) * (i + 1) // len(beats)

            def say(line, step):
                nonlocal clock
                end = clock + max(1, len(line["text"].split())) * word_ms
                out.append((b.session_id, len(out), line["speaker"], line["text"], step, clock, end))
                clock = end + gap_ms

            for line in b.lines:
                say(line, 0)
            n = 0
            while clock < stop and len(b.pool):
                place = n + i * 7
                say(b.pool[place % len(b.pool)], place // len(b.pool))
                n += 1
        return pd.DataFrame(out, columns=["session_id", "ord", "speaker", "text", "step", "start_ms", "end_ms"])

    x = plans.groupBy("session_id").applyInPandas(run, "session_id bigint, ord bigint, speaker string, text string, step int, start_ms bigint, end_ms bigint")
    return x.select("session_id", "ord", F.format_string("turn-%05d", F.col("ord") + 1).alias("id"), "speaker", vary_digits("text", F.col("step")).alias("text"), "start_ms", "end_ms")
