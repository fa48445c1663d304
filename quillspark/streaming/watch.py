"""Noticing changes of a vault: drift between its files and the index becomes events, which the index stream applies."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quillspark.operators import index as I
from quillspark.sources import vault
from quillspark.sources.events import EventLog
from quillspark.sources.store import IndexStore

ACTIONS = {"insert": "created", "update": "updated", "remove": "deleted"}


@dataclass
class Watch:
    """State of a watched vault: generation counts the rounds in which something had changed."""

    generation: int = 0
    changed: int = 0


def changes(spark: SparkSession, store: IndexStore, root: str) -> DataFrame:
    """Paths that differ from the index by size, time or presence: normalized_path, change. The index's own folder and those
    of version control and editors are left out, as they are of any scan."""
    return I.drift(vault.scan(spark, root, store.state().get("case_sensitive", True)), store.table("files"))


def notice(spark: SparkSession, store: IndexStore, root: str, log: EventLog, state: Watch) -> int:
    """One round: an event for each path that changed; returns their number. Paths that were noticed before and are not yet
    applied are named again, which does no harm: the index finds them unchanged."""
    n = 0
    for r in changes(spark, store, root).orderBy("normalized_path").toLocalIterator():
        log.note_changed("", r["normalized_path"], ACTIONS[r["change"]])
        n += 1
    if n:
        state.generation += 1
        state.changed += n
    return n


def watch(spark: SparkSession, store: IndexStore, root: str, log: EventLog, apply: Callable[[], None], seconds: float = 2.0, stop: threading.Event | None = None) -> Watch:
    """Notice changes every so many seconds, and apply them (an index stream, say), until told to stop."""
    state, stop = Watch(), stop or threading.Event()
    while not stop.is_set():
        if notice(spark, store, root, log, state):
            apply()
        stop.wait(seconds)
    return state
