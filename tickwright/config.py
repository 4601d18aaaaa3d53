"""Configuration objects: one per series to clean, one per table to scale."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field


@dataclass(frozen=True)
class SeriesConfig:
    """How to read and check one wide sensor series.

    ``time_format`` uses ``strptime`` directives.  ``expected_gap_seconds`` is the cadence;
    a longer step between two parsed times is flagged as a gap.
    """

    name: str
    path: str = ""
    time_format: str = "%Y-%m-%d %H:%M:%S"
    expected_gap_seconds: int = 3600
    has_pump_state: bool = False


class SeriesRegistry:
    """Named series; ``select("all")`` gives every one, any other name just that one."""

    def __init__(self, configs: Sequence[SeriesConfig]):
        self._by_name = {config.name: config for config in configs}
        if len(self._by_name) != len(configs):
            raise ValueError("series names must be unique")

    def select(self, name: str = "all") -> list[SeriesConfig]:
        if name == "all":
            return list(self._by_name.values())
        if name not in self._by_name:
            raise ValueError(f"unknown series {name!r}; known: {sorted(self._by_name)}")
        return [self._by_name[name]]


@dataclass(frozen=True)
class ScalerConfig:
    """Columns of a modelling table by role; the mappings go from node name to column."""

    pressure_cols: Mapping[str, str]
    ratio_cols: Mapping[str, str] = field(default_factory=dict)
    inj_flow_col: str | None = None
    flag_cols: Sequence[str] = ()

    @property
    def standard_columns(self) -> list[str]:
        flow = [self.inj_flow_col] if self.inj_flow_col else []
        return list(dict.fromkeys([*self.pressure_cols.values(), *flow]))

    @property
    def ratio_columns(self) -> list[str]:
        return list(dict.fromkeys(self.ratio_cols.values()))
