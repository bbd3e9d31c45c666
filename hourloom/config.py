"""Settings shared by the operators. All of them are immutable."""

from __future__ import annotations

from dataclasses import dataclass, field

# The column contract of the readings, weather and clean tables.
WEATHER_COLUMNS = ("temp", "humidity", "wind_speed", "wind_dir", "precip", "pressure")
READING_COLUMNS = ("pm25", "aqi", "no2", "o3")

# Half-open risk bands [low, high); anything unmatched takes the last band.
RISK_BANDS = (
    {"band": 1, "label": "Clean", "low": 0.0, "high": 12.0, "color": "#2ecc71",
     "audience": "Everyone",
     "action": "Nothing to do."},
    {"band": 2, "label": "Moderate", "low": 12.0, "high": 35.0, "color": "#f1c40f",
     "audience": "Sensitive groups",
     "action": "Tell people at risk to take it easy outside."},
    {"band": 3, "label": "High", "low": 35.0, "high": 55.0, "color": "#e67e22",
     "audience": "City and clinics",
     "action": "Reduce car traffic and move events indoors."},
    {"band": 4, "label": "Critical", "low": 55.0, "high": 999.0, "color": "#e74c3c",
     "audience": "Government and plants",
     "action": "Throttle emitters and keep people inside."},
)

# Annual guideline for the ratio, and the two limits of the trailing statistics.
ANNUAL_GUIDELINE = 5.0
CRITICAL_LIMIT = 55.0
GUIDELINE_LIMIT = 12.0


@dataclass(frozen=True)
class CleanSettings:
    target: str = "pm25"
    fenced: tuple[str, ...] = ("pm25", "no2", "o3")
    fence_factor: float = 3.0
    edge_filled: tuple[str, ...] = WEATHER_COLUMNS
    interpolate_limit: int = 3


@dataclass(frozen=True)
class FeatureSettings:
    target_lags: tuple[int, ...] = (1, 3, 6, 12, 24, 48, 168)
    mean_windows: tuple[tuple[int, str], ...] = (
        (3, "3h"), (6, "6h"), (24, "24h"), (168, "7d"))
    std_windows: tuple[tuple[int, str], ...] = ((24, "24h"), (168, "7d"))
    secondary: str = "no2"
    secondary_lags: tuple[int, ...] = (1, 24)
    precip_window: int = 3
    pressure_span: int = 3
    wind_floor: float = 0.1

    @property
    def reach(self) -> int:
        """How many earlier rows a feature of one row may read."""
        return max(
            *self.target_lags, *self.secondary_lags,
            *(n for n, _ in self.mean_windows + self.std_windows),
            self.precip_window, self.pressure_span + 1,
        )


@dataclass(frozen=True)
class ScaleSettings:
    """Limits that decide between the one-task-per-series plan and the split plan.

    A series with more than ``max_group_rows`` rows is cut into chunks of that many rows.
    A lookup table is broadcast only when its measured size is at most ``broadcast_bytes``.
    """

    max_group_rows: int = 1_000_000
    broadcast_bytes: int = 64 << 20


# The hyperparameters of the models.
@dataclass(frozen=True)
class RidgeSettings:
    alpha: float = 1.0


@dataclass(frozen=True)
class ForestSettings:
    trees: int = 200
    depth: int = 12
    min_leaf: int = 5
    bins: int = 255
    seed: int = 42


@dataclass(frozen=True)
class BoostingSettings:
    rounds: int = 500
    step: float = 0.05
    depth: int = 5
    min_leaf: int = 20
    row_share: float = 0.8
    column_share: float = 0.8
    tail_share: float = 0.1
    patience: int = 50
    bins: int = 255
    seed: int = 42


@dataclass(frozen=True)
class ExperimentSettings:
    n_splits: int = 5
    models: tuple[str, ...] = ("persistence", "ridge", "forest", "boosting")
    ridge: RidgeSettings = field(default_factory=RidgeSettings)
    forest: ForestSettings = field(default_factory=ForestSettings)
    boosting: BoostingSettings = field(default_factory=BoostingSettings)
