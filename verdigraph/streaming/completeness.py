"""Queries whose runs come in a stream: each is given out once all its runs are there, in one piece, and then forgotten."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Runs of a query so far; once it is given out only the mark that it was.
STATE = "runs array<int>, outputs array<string>, correct array<boolean>, done boolean"
GROUPS = "qid string, output string, correct boolean, size int, first_run int, n_runs int, complete boolean"


def _groups(qid: str, runs: dict[int, tuple[str, bool]], complete: bool) -> pd.DataFrame:
    found: dict[tuple[str, bool], list[int]] = {}
    for run in sorted(runs):
        found.setdefault(runs[run], []).append(run)
    rows = [(qid, output, correct, len(own), own[0], len(runs), complete) for (output, correct), own in found.items()]
    return pd.DataFrame(rows, columns=["qid", "output", "correct", "size", "first_run", "n_runs", "complete"])


def completed(runs: DataFrame, n_runs: int, patience: str = "1 hour") -> DataFrame:
    """qid, output, correct, size, first_run, n_runs, complete: the groups of equal outputs of each query of the stream ``runs(qid, run, output, correct, ts)``.

    A query's groups come, by their first run, as soon as ``n_runs`` different runs of it are in; of a run that comes twice the first counts. If the watermark of ``ts``
    gets past a query's last run and ``patience`` with runs still missing, what is there is given out with ``complete`` false.
    Runs that come after that, in the time of ``patience``, are repeats or late and change nothing; then the query's state is dropped. Nulls in qid or run are left out. State is
    one row of ``n_runs`` runs for each open query, kept in the checkpoint, so a restart goes on where the stream was.
    """
    late = int(pd.Timedelta(patience).total_seconds() * 1000)

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ([], [], [], False)
        known, done = dict(zip(held[0], zip(held[1], held[2], strict=True), strict=True)), held[3]
        if state.hasTimedOut:
            # An open query is given out and its mark stays for a while; a mark that is that old goes.
            if done:
                state.remove()
            else:
                yield _groups(key[0], known, False)
                state.update(([], [], [], True))
                state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + late)
            return
        newest = 0
        for batch in batches:
            newest = max(newest, int(batch.ts.max().timestamp() * 1000))
            for r in batch.sort_values("ts", kind="stable").itertuples():
                known.setdefault(int(r.run), (r.output, bool(r.correct)))
        if not done and len(known) >= n_runs:
            yield _groups(key[0], known, True)
            done = True
        rest = [] if done else sorted(known)
        state.update((rest, [known[i][0] for i in rest], [known[i][1] for i in rest], done))
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + late)

    timed = runs.filter("qid IS NOT NULL AND run IS NOT NULL").withWatermark("ts", "0 seconds")
    own = timed.select(F.col("qid").cast("string").alias("qid"), F.col("run").cast("int").alias("run"), "output", F.coalesce("correct", F.lit(False)).alias("correct"), "ts")
    return own.groupBy("qid").applyInPandasWithState(step, GROUPS, STATE, "append", GroupStateTimeout.EventTimeTimeout)
