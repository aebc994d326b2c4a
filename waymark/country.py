"""What differs between countries, passed along as a value."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Country:
    code: str
    crs: int
    homes: tuple[str, ...]
    has_population: bool
    #: Any finite terrain sample will do, or all must be finite.
    partial_terrain: bool
    climb_always: bool
    most_vertices: int | None
    window_mining: bool
    circuit_retrace_gate: float | None
    reach_times: bool


NL = Country("nl", 28992, ("Zaandam", "Haarlem"), True, True, True, 900, True, None, True)
EE = Country("ee", 3301, ("Tallinn", "Tartu"), False, False, False, None, False, 0.20, False)
