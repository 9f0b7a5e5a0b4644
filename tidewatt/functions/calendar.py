"""Calendar, cyclic and solar-geometry features.

All inputs are market-local wall-clock timestamps (TIMESTAMP_NTZ) unless the
argument is called ``utc``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatt.functions.columns import col_
from tidewatt.session import MARKET_ZONE

# Site used for solar geometry and the 15-minute market switch.
SITE_LAT_DEG = 38.0
SITE_LON_DEG = 23.7
MTU_SWITCH_DATE = "2025-10-01"
DECLINATION_AMPLITUDE_DEG = 23.45
DECLINATION_DAY_OFFSET = 284


def local_to_utc(ts, zone: str = MARKET_ZONE) -> Column:
    """Market-local wall time -> UTC wall time (both NTZ)."""
    return F.to_utc_timestamp(col_(ts).cast("timestamp"), zone).cast("timestamp_ntz")


def localize(df: DataFrame, ts: str = "ts", keys: tuple = ("series_id",), *, order: str,
             zone: str = MARKET_ZONE, out: str = "ts_utc") -> DataFrame:
    """A2: naive market-local wall times -> UTC instants.

    * repeated autumn hour: the first pass of a local time is summer time,
      the second (by ``order``, the row's place in its feed) winter time -- a
      ``row_number`` over (keys, local ts) picks the pass, so ``keys`` must
      name the file where several files may repeat a row;
    * spring gap: a non-existent local time moves forward to the first valid
      local time after the gap."""
    t = F.col(ts)
    utc = F.to_utc_timestamp(t.cast("timestamp"), zone)
    back = F.from_utc_timestamp(utc, zone).cast("timestamp_ntz")
    gap_fix = F.to_utc_timestamp((F.date_trunc("hour", t.cast("timestamp")) + F.expr("INTERVAL 1 HOUR")), zone)
    base = F.when(back != t, gap_fix).otherwise(utc)
    w = Window.partitionBy(*keys, ts).orderBy(order)
    second_pass = F.row_number().over(w) == 2
    # an ambiguous local time resolves to the earlier (summer) offset; the
    # second pass is one hour later in UTC
    amb = F.from_utc_timestamp(utc + F.expr("INTERVAL 1 HOUR"), zone).cast("timestamp_ntz") == t
    res = F.when(second_pass & amb, utc + F.expr("INTERVAL 1 HOUR")).otherwise(base)
    return df.withColumn(out, res.cast("timestamp_ntz"))


def utc_to_local(ts, zone: str = MARKET_ZONE) -> Column:
    return F.from_utc_timestamp(col_(ts).cast("timestamp"), zone).cast("timestamp_ntz")


def calendar_columns(ts="ts") -> dict[str, Column]:
    """Hour, minute_of_day, dow (Mon=0), is_weekend, month, doy."""
    t = col_(ts)
    dow = F.weekday(t)
    return {
        "hour": F.hour(t),
        "minute_of_day": F.hour(t) * 60 + F.minute(t),
        "dow": dow,
        "is_weekend": (dow >= 5).cast("int"),
        "month": F.month(t),
        "doy": F.dayofyear(t),
    }


def cyclic_columns(ts="ts") -> dict[str, Column]:
    """sin/cos of time-of-day (minute/1440) and day-of-year (doy/365)."""
    t = col_(ts)
    mod = F.hour(t) * 60 + F.minute(t)
    doy = F.dayofyear(t)
    two_pi = 2 * math.pi
    return {
        "sin_tod": F.sin(F.lit(two_pi) * mod / 1440.0),
        "cos_tod": F.cos(F.lit(two_pi) * mod / 1440.0),
        "sin_doy": F.sin(F.lit(two_pi) * doy / 365.0),
        "cos_doy": F.cos(F.lit(two_pi) * doy / 365.0),
    }


def _declination_deg(doy: Column) -> Column:
    return F.lit(DECLINATION_AMPLITUDE_DEG) * F.sin(
        F.lit(2 * math.pi) * (F.lit(DECLINATION_DAY_OFFSET) + doy) / 365.0)


def solar_elevation(utc, lat_deg=SITE_LAT_DEG, lon_deg=SITE_LON_DEG) -> Column:
    """Closed-form solar elevation in degrees from the UTC instant.

    ``lat_deg`` / ``lon_deg`` may be literals or columns (site dimension)."""
    u = col_(utc)
    doy = F.dayofyear(u)
    frac_h = F.hour(u) + F.minute(u) / 60.0 + F.second(u) / 3600.0
    decl = F.radians(_declination_deg(doy))
    lat = F.lit(lat_deg) if not isinstance(lat_deg, Column) else lat_deg
    lon = F.lit(lon_deg) if not isinstance(lon_deg, Column) else lon_deg
    solar_time = frac_h + lon / 15.0
    hour_angle = F.radians(F.lit(15.0) * (solar_time - 12.0))
    phi = F.radians(lat)
    sin_alt = F.sin(phi) * F.sin(decl) + F.cos(phi) * F.cos(decl) * F.cos(hour_angle)
    sin_alt = F.least(F.greatest(sin_alt, F.lit(-1.0)), F.lit(1.0))
    return F.degrees(F.asin(sin_alt))


def solar_columns(utc, lat_deg=SITE_LAT_DEG, lon_deg=SITE_LON_DEG) -> dict[str, Column]:
    elev = solar_elevation(utc, lat_deg, lon_deg)
    return {
        "solar_elevation_deg": elev,
        "solar_is_day": (elev > 0).cast("int"),
        "solar_clip_pos": F.greatest(elev, F.lit(0.0)),
    }


def day_length_hours(ts="ts", lat_deg=SITE_LAT_DEG) -> Column:
    """C4: hours of daylight from the declination of the local day."""
    doy = F.dayofyear(col_(ts))
    lat = F.lit(lat_deg) if not isinstance(lat_deg, Column) else lat_deg
    cos_omega = -F.tan(F.radians(lat)) * F.tan(F.radians(_declination_deg(doy)))
    cos_omega = F.least(F.greatest(cos_omega, F.lit(-1.0)), F.lit(1.0))
    return F.lit(2.0) * F.degrees(F.acos(cos_omega)) / 15.0


def regime_flag(ts="ts", switch_date: str = MTU_SWITCH_DATE) -> Column:
    """1 from the market-switch date on."""
    return (col_(ts) >= F.lit(switch_date).cast("timestamp_ntz")).cast("int")


def add_calendar(df: DataFrame, ts: str = "ts", zone: str = MARKET_ZONE,
                 with_solar: bool = True) -> DataFrame:
    """C1-C4 in one projection (no shuffle)."""
    cols = {**calendar_columns(ts), **cyclic_columns(ts)}
    if with_solar:
        cols.update(solar_columns(local_to_utc(ts, zone)))
        cols["day_length_h"] = day_length_hours(ts)
    return df.withColumns(cols)
