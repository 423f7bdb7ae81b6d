"""The states of sessions as a machine: one step function, run over a stream with kept state or over a table in order.

An event (session, seq, kind, size, version) is one of
- grown: the session's file has this size now. A session that was done, or failed as often as it may, opens again if the
  file is longer than what was worked on; a shorter one was written anew and opens again too.
- started: work begins on it. done: it was worked on up to this size, by this version. failed, blocked: the work ended so.

A state is pending, running, complete, failed, retrying (failed, may be tried again) or blocked; `terminal` says that no work
is due. A session that failed `MOST_ATTEMPTS` times stays failed until it grows past its offset; then its attempts count
anew. A done session of another version opens again with its next event.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from lodestone.operators.fold import folded

MOST_ATTEMPTS, KEPT_ERRORS, KEPT_DAYS = 5, 5, 30
KINDS = ("grown", "started", "done", "failed", "blocked")
#: status, attempts, offset (bytes worked on), size, version, and how often it has opened again.
START = ("pending", 0, 0, 0, "", 0)
OUT = "session string, seq long, status string, attempts int, offset long, size long, reopened int, terminal boolean"


def step(state: tuple, kind: str, size: int | None, version: str | None, current: str) -> tuple:
    """The state after an event; `current` is the version that works now."""
    status, attempts, offset, known, made_by, reopened = state
    if kind == "grown":
        size = size or 0
        again = status in ("complete", "failed") and (size > offset or size < offset)
        old = status == "complete" and made_by != current
        if again or old:
            status, attempts, reopened = "pending", 0, reopened + 1
            offset = 0 if size < offset or old else offset
        known = size
    elif kind == "started":
        status, attempts = "running", attempts + 1
    elif kind == "done":
        offset, made_by = max(offset, known if size is None else size), version or current
        status = "complete" if offset >= known else "pending"
        attempts = 0 if status == "pending" else attempts
    elif kind == "failed":
        status = "failed" if attempts >= MOST_ATTEMPTS else "retrying"
        if status == "failed":
            offset = max(offset, known)  # what failed is not tried again, only what comes after it
    elif kind == "blocked":
        status = "blocked"
    return status, attempts, offset, known, made_by, reopened


def terminal(state: tuple, current: str) -> bool:
    return state[0] == "failed" or (state[0] == "complete" and state[4] == current)


def _told(session: str, seq: int, s: tuple, current: str) -> tuple:
    return session, seq, s[0], s[1], s[2], s[3], s[5], terminal(s, current)


def batch(events: DataFrame, current: str) -> DataFrame:
    """The state after each event (session, seq, kind, size, version), in the order of seq."""

    def go(held: list, row) -> list[tuple]:
        held[0] = step(held[0], row.kind, None if row.size is None else int(row.size), row.version, current)
        return [_told(row.session, int(row.seq), held[0], current)]

    return folded(events.select("session", "seq", "kind", "size", "version"), ["session"], ["seq"], lambda: [START], go, lambda key, held: [], OUT)


class Machine(StatefulProcessor):
    """States in a stream: a value for each session, a list of its last errors, both forgotten after a time without events."""

    def __init__(self, current: str, kept_days: int = KEPT_DAYS):
        self.current, self.kept = current, kept_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        kinds = (StringType(), IntegerType(), LongType(), LongType(), StringType(), IntegerType())
        names = ("status", "attempts", "offset", "size", "version", "reopened")
        schema = StructType([StructField(n, k, True) for n, k in zip(names, kinds, strict=True)])
        self.state = handle.getValueState("state", schema, self.kept)
        self.errors = handle.getListState("errors", StructType([StructField("seq", LongType(), True)]), self.kept)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.state.get()) if self.state.exists() else START
        out, failed = [], []
        parts = [p for p in rows]
        for row in pd.concat(parts).sort_values("seq").itertuples(index=False):
            size = None if pd.isna(row.size_) else int(row.size_)
            held = step(held, row.kind, size, row.version, self.current)
            out.append(_told(key[0], int(row.seq), held, self.current))
            if row.kind == "failed":
                failed.append((int(row.seq),))
        self.state.update(held)
        if failed:
            kept = [tuple(e) for e in self.errors.get()] if self.errors.exists() else []
            self.errors.put((kept + failed)[-KEPT_ERRORS:])
        yield pd.DataFrame(out, columns=[f.split()[0] for f in OUT.split(", ")])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """A state that another store had: (session, status, attempts, offset, size, version). A finished one without an
        offset was worked on through its size."""
        r = initialState.iloc[0]
        attempts, offset, size = (0 if pd.isna(v) else int(v) for v in (r["attempts"], r["offset"], r["size"]))
        offset = size if not offset and r["status"] in ("complete", "failed") else offset
        self.state.update((r["status"], attempts, offset, size, r["version"] or "", 0))

    def close(self) -> None:
        pass


def stream(events: DataFrame, current: str, known: DataFrame | None = None, kept_days: int = KEPT_DAYS) -> DataFrame:
    """The state after each event of a stream; known: states taken over from another store, once.

    Events of a session come in the order of seq, batch by batch. Needs a state store with column families (RocksDB).
    """
    named = events.select("session", "seq", "kind", events["size"].alias("size_"), "version")
    start = known.select("session", "status", "attempts", "offset", "size", "version").groupBy("session") if known is not None else None
    return named.groupBy("session").transformWithStateInPandas(Machine(current, kept_days), OUT, "Append", "ProcessingTime", start)
