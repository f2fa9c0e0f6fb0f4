"""Conversations compacted as their turns arrive: the streaming twin of ``sondage.operators.memory.compact``."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sondage.operators.memory import LIMITS, SUMMARY, empty_summary, fold_turn

_OUT = f"conversation_id long, through_sequence long, n_folded long, {SUMMARY}"


def _plain(value: Any) -> Any:
    """Rows and arrays of state and batches as dictionaries and lists."""
    if hasattr(value, "asDict"):
        return value.asDict()
    if isinstance(value, dict):
        return value
    return [_plain(v) for v in value] if not isinstance(value, (str, int, type(None))) else value


class _Compactor(StatefulProcessor):
    """State of a conversation: its summary, the last turn in it, and turns that wait for an earlier one or are among the newest ``keep``.

    A turn follows the one whose sequence number is 2 less; the first has 2, or 3 after a message of the system. A turn is folded once all before it are, and ``keep`` newer ones have come; one that comes again, or late for what is folded, changes nothing.
    """

    def __init__(self, keep: int, idle_ms: int) -> None:
        self.keep, self.idle_ms = keep, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ttl = {"ttlDurationMs": self.idle_ms} if self.idle_ms else {}
        self.summary = handle.getValueState("summary", f"through long, n long, {SUMMARY}", **ttl)
        self.waiting = handle.getMapState("waiting", "sequence_no long", SUMMARY, **ttl)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        through, n, summary = 0, 0, empty_summary()
        if self.summary.exists():
            held = self.summary.get()
            through, n, summary = held[0], held[1], {name: _plain(held[2 + k]) for k, name in enumerate(LIMITS)}
        for part in rows:
            for row in part.to_dict("records"):
                if row["sequence_no"] > through:
                    self.waiting.updateValue((int(row["sequence_no"]),), tuple(_plain(row[name]) for name in LIMITS))
        numbers = sorted(int(k[0]) for k in self.waiting.keys())
        ready = numbers[: max(0, len(numbers) - self.keep)]
        folded = 0
        for number in ready:
            if number != through + 2 and (through or number > 3):
                break
            items = self.waiting.getValue((number,))
            fold_turn(summary, {name: _plain(items[k]) for k, name in enumerate(LIMITS)})
            self.waiting.removeKey((number,))
            through, folded = number, folded + 1
        if folded:
            self.summary.update((through, n + folded, *(summary[name] for name in LIMITS)))
            yield pd.DataFrame([(key[0], through, n + folded, *(summary[name] for name in LIMITS))], columns=["conversation_id", "through_sequence", "n_folded", *LIMITS])

    def close(self) -> None:
        pass


def compact_stream(items: DataFrame, keep: int, idle_ms: int = 0) -> DataFrame:
    """A summary for each conversation and batch that folds turns of it; ``through_sequence`` grows with each, so a sink keeps the greatest.

    ``items`` is a stream of ``turn_items``. What a conversation holds is its summary, of fixed size, and the turns that are not folded yet: ``keep`` of them, and those beyond a gap. ``idle_ms``: state that has not changed for so long is dropped (0: never). Needs the RocksDB state store.
    """
    return items.groupBy("conversation_id").transformWithStateInPandas(_Compactor(keep, idle_ms), _OUT, "update", "processingTime" if idle_ms else "none")
