"""All parameters of the demand pipeline in one place."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class Params:
    # cleaning and panel
    unknown_store: str = "desconhecido"
    anomalous_week: int | None = 37
    extra_week: int | None = 53
    # features
    basic_lags: tuple[int, ...] = (1, 2, 3, 4, 8, 12)
    extra_lags: tuple[int, ...] = (5, 6, 7, 16, 24)
    rolling_windows: tuple[int, ...] = (8, 12, 16, 20)
    least_periods: int = 4
    dummy_columns: tuple[str, ...] = ("categoria", "premise", "tipos", "label")
    frequency_columns: tuple[str, ...] = ("subcategoria", "fabricante", "descricao", "marca")
    top_values: int = 10
    most_interactions: int = 15
    # outliers
    outlier_method: str = "z_score"
    percentile_cap: float = 98.0
    absolute_cap: float = float("inf")
    outlier_window: int = 12
    z_threshold: float = 4.0
    treatment: str = "winsorize"
    adaptive_threshold: bool = True
    least_observations: int = 8
    cap_multiplier: float = 5.0
    # split and forecast
    train_until: int = 44
    valid_from: int = 45
    valid_until: int = 52
    forecast_weeks: tuple[int, ...] = (1, 2, 3, 4, 5)
    least_history: int = 12
    history_kept: int = 24
    # boosted trees
    rounds: int = 60
    depth: int = 5
    step: float = 0.1
    most_step: float = 10.0
    zero_weight: float = 1.0
    seed: int = 42

    def key(self, *more: str) -> str:
        """A name for results made with these parameters and inputs: every parameter counts."""
        return hashlib.md5(json.dumps([asdict(self), *more], sort_keys=True, default=str).encode()).hexdigest()
