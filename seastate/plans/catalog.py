"""Imports every query module; the order is the order of the inventory."""

from . import q_forecast, q_functions, q_series, q_sources, q_spectra, q_streams, q_swell  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
