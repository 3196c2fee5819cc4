"""The declarative cleaning plan, and the planner that derives one from profiles."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from tallyframe.functions.names import DATE, MONEY, canonical
from tallyframe.functions.scalars import DATE_FORMATS

FILLS = ("mean", "median", "zero", "mode", "forward_fill", "drop", "constant")
DTYPES = ("string", "int", "float", "boolean", "date")


@dataclass(frozen=True)
class DateParser:
    column: str
    formats: tuple[str, ...] = DATE_FORMATS


@dataclass(frozen=True)
class Fill:
    column: str
    strategy: str
    value: Any = None

    def __post_init__(self):
        if self.strategy not in FILLS:
            raise ValueError(f"unknown fill strategy {self.strategy!r}")


@dataclass(frozen=True)
class CleaningPlan:
    """Applied in this order to each table: renames, currency, dates, types, fills; then join or union, then dedup."""

    renames: dict[str, str] = field(default_factory=dict)
    currency: tuple[str, ...] = ()
    dates: tuple[DateParser, ...] = ()
    dtypes: dict[str, str] = field(default_factory=dict)
    fills: tuple[Fill, ...] = ()
    join_keys: tuple[str, ...] = ()
    dedup_keys: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    max_duplicate_rate: float = 0.05
    primary: str | None = None
    #: A date parser or type fix that reads less than this share of the non-null values is left out.
    min_parse_rate: float = 0.0

    def __post_init__(self):
        if bad := set(self.dtypes.values()) - set(DTYPES):
            raise ValueError(f"unknown types {sorted(bad)}")


def heuristic_plan(profile: dict[str, Any]) -> CleaningPlan:
    """A plan from the profiles of files: {"files": {name: {columns: [names], sample_rows, candidate_join_keys}}}."""
    files = profile.get("files", {})
    renames: dict[str, str] = {}
    currency, dates, dtypes, fills = [], {}, {}, {}
    for meta in files.values():
        for name in meta["columns"]:
            target = canonical(name)
            if target != name:
                renames[name] = target
            if MONEY.search(target) or any(isinstance(v := row.get(name), str) and re.search(r"[$,]", v) for row in meta.get("sample_rows", [])):
                currency.append(target)
                dtypes.setdefault(target, "float")
                fills.setdefault(target, Fill(target, "median"))
            if DATE.search(target):
                dates.setdefault(target, DateParser(target))
                dtypes.setdefault(target, "date")
    keys = [set(m["candidate_join_keys"]) for m in files.values() if m.get("candidate_join_keys")]
    join = sorted(set.intersection(*keys) or keys[0]) if keys else []
    join = [renames.get(k, canonical(k)) for k in join]
    money = tuple(dict.fromkeys(currency))
    return CleaningPlan(
        renames=renames,
        currency=money,
        dates=tuple(dates.values()),
        dtypes=dtypes,
        fills=tuple(fills.values()),
        join_keys=tuple(join),
        dedup_keys=tuple(join),
        required=tuple(dict.fromkeys([*join, *money])),
        primary=next(iter(files), None),
    )
