"""Monthly-series analytics and forecasting on Spark DataFrames."""

from monthloom.config import PanelConfig

__all__ = ["PanelConfig"]
