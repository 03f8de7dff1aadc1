"""Parameters of the behavioural engine. One frozen object goes into each call; nothing is global."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    #: Days within which a return counts, each evaluated by itself.
    horizons: tuple[int, ...] = (1, 3, 7)
    n_states: int = 5
    #: The state of minimal sessions, and the states that count as recovery from it.
    focal_state: int = 4
    recovery_states: tuple[int, ...] = (1, 2)
    #: Login dates, both included, of the window that sensitivity runs leave out.
    window_start: str = "2024-01-14"
    window_end: str = "2024-01-16"
    #: Least evaluable sessions of a reported group, and least rows on either side of a threshold.
    min_group: int = 5
    min_side: int = 20
    rolling: tuple[int, ...] = (3, 5)
    densities: tuple[int, ...] = (3, 5, 10)
    #: Sessions before an anchor that a slope looks at, and the least points it needs.
    slope_back: int = 10
    slope_points: int = 5
    max_lag: int = 20

    @property
    def long_horizon(self) -> int:
        return self.horizons[-1]


#: The reference horizons and sizes for telemetry of months; the defaults fit a table of 30 days.
MONTHS = Config(horizons=(7, 14, 30), min_group=30, min_side=200)
