"""Parameters of the demand model."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """Defaults are the values that existing maps are built with."""

    min_flow: float = 50.0
    max_pop: int = 400
    seconds_per_metre: float = 0.12
    sqft_per_m2: float = 10.7639
    terminal_factor: int = 20
    building_cell: float = 0.0009
    water_cell: float = 0.0027
    water_depth: int = -4
    locale: str = "en"
    thumbnail_zoom: int = 12
    water_zoom: int = 13
    #: Number index rows by raw ordinals, and keep rows without a cell.
    compat_ordinals: bool = False


DEFAULTS = Params()
