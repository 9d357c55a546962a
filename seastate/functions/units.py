"""Units, compass names, wind vectors, energy indices and fill values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Conversion factors that results must agree on.
FT_PER_M = 3.28084
MPH_PER_MS = 2.23694
KTS_PER_MS = 1.94384
GRAVITY = 9.81

# Compass points clockwise from north, and travel arrows.
CARDINALS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE",
             "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")
TRAVEL_ARROWS = ("↑", "↗", "→", "↘", "↓", "↙", "←", "↖")

# Station files write missing readings as one of these.
STATION_FILLS = (99.0, 999.0, 9999.0)
SPECTRAL_FILLS = (99.0, 999.0, 9999.0, -99.0, -999.0)
# A bearing of 99 degrees is real, so direction columns only use the wider marks.
DIRECTION_FILLS = (999.0, 9999.0)
MISSING_TOKENS = ("MM", "m", "")


def m_to_ft(c: Column) -> Column:
    return F.round(c * F.lit(FT_PER_M), 1)


def ft_to_m(c: Column) -> Column:
    return c / F.lit(FT_PER_M)


def ms_to_mph(c: Column) -> Column:
    return F.round(c * F.lit(MPH_PER_MS), 1)


def ms_to_kts(c: Column) -> Column:
    return F.round(c * F.lit(KTS_PER_MS), 1)


def finite(c: Column) -> Column:
    """Fold NaN to null so that 'missing' has one spelling."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def parse_number(text: Column, fills=STATION_FILLS) -> Column:
    """Text token to double; unparseable tokens and fill marks become null."""
    v = text.try_cast("double")
    return F.when(~text.isin(*MISSING_TOKENS) & ~v.isin(*[float(x) for x in fills]) & ~F.isnan(v), v)


def parse_direction(text: Column) -> Column:
    """Degrees, or a compass name turned into whole degrees (truncated)."""
    names = F.create_map(*[x for i, card in enumerate(CARDINALS) for x in (F.lit(card), F.lit(float(int(i * 22.5))))])
    return F.coalesce(parse_number(text, DIRECTION_FILLS), F.try_element_at(names, F.upper(F.trim(text))))


def _pick(names, idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), idx.cast("int") + 1)


def to_cardinal(deg: Column) -> Column:
    """16-point name; ties on a boundary go to the even point."""
    idx = F.pmod(F.rint(deg / 22.5), F.lit(16))
    return F.when(deg.isNull(), F.lit("?")).otherwise(_pick(CARDINALS, idx))


def to_travel_arrow(deg: Column) -> Column:
    """Arrow for where the waves go, i.e. opposite to where they come from."""
    idx = F.pmod(F.rint(F.pmod(deg + 180, F.lit(360.0)) / 45), F.lit(8))
    return F.when(deg.isNull(), F.lit("·")).otherwise(_pick(TRAVEL_ARROWS, idx))


def wind_u(speed: Column, deg: Column, calm_if_missing: bool = False) -> Column:
    u = F.round(-speed * F.sin(F.radians(deg)), 4) + F.lit(0.0)
    return F.coalesce(u, F.lit(0.0)) if calm_if_missing else u


def wind_v(speed: Column, deg: Column, calm_if_missing: bool = False) -> Column:
    v = F.round(-speed * F.cos(F.radians(deg)), 4) + F.lit(0.0)
    return F.coalesce(v, F.lit(0.0)) if calm_if_missing else v


def forecast_energy(height_ft: Column, period_s: Column) -> Column:
    """Ranking energy of a forecast partition: H squared times T."""
    return F.round(height_ft * height_ft * period_s, 1)


def observed_energy(height_ft: Column, period_s: Column) -> Column:
    """Charted energy of an observation: H times T squared."""
    return F.round(height_ft * period_s * period_s, 1)
