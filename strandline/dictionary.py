"""Variable dictionaries: what is known about each variable, from which plans generate columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

KINDS = ("num", "cat", "ord", "bin")


@dataclass(frozen=True)
class Variable:
    """One variable: its kind, how it is aggregated and filled, and which values are valid."""

    name: str
    kind: str = "num"
    agg: str = "mean"
    fill1: str = "median"
    fill2: str = "locf"
    const: float | str | None = None
    valid: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None
    last_value: float | None = None
    stats: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind!r} of {self.name!r}")


def listed(text: str | None) -> tuple[str, ...]:
    """The sorted, trimmed entries of a list separated by bars."""
    return tuple(sorted(x.strip() for x in (text or "").split("|") if x.strip()))


def from_rows(rows: Iterable[Mapping]) -> list[Variable]:
    """Variables from rows of a dictionary table; lists in valid_value and stat are separated by bars."""
    out = []
    for r in rows:
        out.append(
            Variable(
                name=r.get("itemid") or r["item_name"], kind=r["value_type"], agg=r.get("agg_f") or "mean", fill1=r.get("fill1") or "median", fill2=r.get("fill2") or "locf",
                const=r.get("cont"), valid=listed(r.get("valid_value")), low=r.get("low"), high=r.get("high"), last_value=r.get("last_value"),
                stats=tuple(x.strip() for x in (r.get("stat") or "").split("|") if x.strip()),
            )
        )
    return out


def check_against(stats: Mapping[str, Mapping], variables: Iterable[Variable]) -> None:
    """Raise ValueError if saved statistics and a dictionary do not name the same variables of the same kinds."""
    kinds = {v.name: v.kind for v in variables}
    if missing := sorted(set(kinds) - set(stats)):
        raise ValueError(f"statistics lack {missing}")
    if extra := sorted(set(stats) - set(kinds)):
        raise ValueError(f"statistics have unknown {extra}")
    if wrong := sorted(n for n, s in stats.items() if s.get("type") != kinds[n]):
        raise ValueError(f"kinds differ for {wrong}")
