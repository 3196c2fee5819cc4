"""Hooks for a language model or any other judge; off unless given.

Each is called on the driver with bounded context (a few dozen rows at most) and may return None,
which leaves the heuristic result as it is. An exception does the same.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from tallyframe.plans.cleaning_plan import CleaningPlan

MOST_ROWS = 25


@dataclass(frozen=True)
class Enricher:
    plan: Callable[[dict[str, Any]], CleaningPlan | None] | None = None
    rank_insights: Callable[[list[dict]], list[dict] | None] | None = None
    flag_texts: Callable[[list[dict]], list[dict] | None] | None = None
    explain_anomalies: Callable[[list[dict]], list[dict] | None] | None = None
    narrate: Callable[[dict], tuple[str, list[tuple[str, str]]] | None] | None = None
    extract_graph: Callable[[list[dict]], tuple[list[dict], list[dict]] | None] | None = None
    summarise: Callable[[dict], dict | None] | None = None

    def ask(self, hook: str, context, otherwise):
        """(answer, "model"), or (otherwise, "heuristic")."""
        f = getattr(self, hook)
        if f is None:
            return otherwise, "heuristic"
        try:
            answer = f(context[:MOST_ROWS] if isinstance(context, list) else context)
        except Exception:  # whatever a hook raises, the heuristic stands
            answer = None
        return (otherwise, "heuristic") if answer is None else (answer, "model")
