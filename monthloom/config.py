"""Parameters of the panel, the features and the models."""

from __future__ import annotations

from dataclasses import dataclass, field

# Column names, labels and hyper-parameters that results and saved tables are keyed on.
FEATURE_COLS = (
    "month_sin", "month_cos", "year_norm",
    "is_spring_trek", "is_autumn_trek", "is_monsoon", "is_covid",
    "lag_1", "lag_3", "lag_12",
)
EXOG_COLS = ("is_spring_trek", "is_autumn_trek", "is_monsoon", "is_covid")
LAGS = (1, 3, 12)
HORIZONS = (1, 3, 6, 12)
SEASON_MONTHS = {
    "spring_trek": (3, 4, 5),
    "monsoon": (6, 7, 8),
    "autumn_trek": (9, 10, 11),
}
DEFAULT_SEASON = "shoulder"
MLP, SARIMA, HOLT_WINTERS, LINEAR = "MLP", "SARIMA", "Holt-Winters", "Linear Regression"
# The lead model of a summary: the first of these that has a forecast.
LEAD_ORDER = (SARIMA, MLP, HOLT_WINTERS, LINEAR)

PERIOD = 12


@dataclass(frozen=True)
class PanelConfig:
    """One set of parameters for a whole run; the defaults are those of the fixed values above."""

    test_months: int = 12
    anomaly_years: tuple[int, ...] = (2020, 2021)
    season_months: dict[str, tuple[int, ...]] = field(default_factory=lambda: dict(SEASON_MONTHS))
    default_season: str = DEFAULT_SEASON

    mlp_hidden: tuple[int, ...] = (64, 32)
    mlp_learning_rate: float = 0.001
    mlp_epochs: int = 2000
    mlp_batch_size: int = 16
    # Epochs between two averagings of the weights, and parts that the series are dealt into for training.
    mlp_local_epochs: int = 100
    mlp_shards: int = 8
    seed: int = 7

    hw_min_rows: int = 2 * PERIOD
    # 13 rows go into differencing and 13 differences feed the longest lag of the model.
    sarima_min_rows: int = 2 * (PERIOD + 1)

    @property
    def seasons(self) -> tuple[str, ...]:
        return (*self.season_months, self.default_season)
