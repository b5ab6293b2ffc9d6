"""Sun events as column expressions: the almanac procedure, whole seconds, local dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..columns import settle

# Zenith angles (degrees) of the official event and of civil twilight.
ZENITH_OFFICIAL, ZENITH_CIVIL = 90.833, 96.0


def _mod(value: Column, n: float) -> Column:
    return F.pmod(value, F.lit(n))


def _approx(day: Column, lon: Column, rising: bool) -> Column:
    return F.dayofyear(day) + ((6.0 if rising else 18.0) - lon / 15.0) / 24.0


def _true_lon(approx: Column) -> Column:
    anomaly = 0.9856 * approx - 3.289
    return _mod(anomaly + 1.916 * F.sin(F.radians(anomaly)) + 0.020 * F.sin(F.radians(2.0 * anomaly)) + 282.634, 360.0)


def _ascension(true_lon: Column) -> Column:
    return _mod(F.degrees(F.atan(0.91764 * F.tan(F.radians(true_lon)))), 360.0)


def _cos_hour(true_lon: Column, lat: Column, zenith: float) -> Column:
    sin_dec = 0.39782 * F.sin(F.radians(true_lon))
    below = F.cos(F.asin(sin_dec)) * F.cos(F.radians(lat))
    out = (F.cos(F.radians(F.lit(zenith))) - sin_dec * F.sin(F.radians(lat))) / below
    return F.when(F.abs(below) >= 1e-12, out)


def _second(approx: Column, true_lon: Column, ascension: Column, cos_hour: Column, lon: Column, rising: bool) -> Column:
    angle = F.degrees(F.acos(cos_hour))
    hour = (360.0 - angle if rising else angle) / 15.0
    right = (ascension + F.floor(true_lon / 90.0) * 90.0 - F.floor(ascension / 90.0) * 90.0) / 15.0
    utc = _mod(hour + right - 0.06571 * approx - 6.622 - lon / 15.0, 24.0)
    return F.when(cos_hour.between(-1.0, 1.0), F.bround(utc * 3600.0).cast("bigint"))


def _on_date(day: Column, second: Column, offset_min: Column) -> Column:
    """Epoch second of a UTC second of day that falls on the local date: tried on the day before, the
    day and the day after; if none has the local date, the one nearest to local noon."""
    midnight = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("bigint") * 86400
    tries = [midnight + s * 86400 + second for s in (-1, 0, 1)]
    hit = F.coalesce(*[F.when(F.floor((e + offset_min * 60) / 86400) * 86400 == midnight, e) for e in tries])
    noon = midnight + 43200 - offset_min * 60
    near = F.least(*[F.struct(F.abs(e - noon).alias("gap"), F.lit(i).alias("i"), e.alias("e")) for i, e in enumerate(tries)])["e"]
    return F.coalesce(hit, near)


def sun_events(df: DataFrame, day: Column, lat: Column, lon: Column, offset_min: Column) -> DataFrame:
    """Add ``sunrise``, ``sunset`` and ``civil_end`` (epoch seconds) on the local date ``day``.

    NULL where the sun does not cross the zenith angle. Each step of the procedure is settled, as
    later steps use it several times.
    """
    base = df.columns
    events = {"sunrise": (ZENITH_OFFICIAL, True), "sunset": (ZENITH_OFFICIAL, False), "civil_end": (ZENITH_CIVIL, False)}
    c = F.col
    df = settle(df, _a1=_approx(day, lon, True), _a0=_approx(day, lon, False))
    df = settle(df, _t1=_true_lon(c("_a1")), _t0=_true_lon(c("_a0")))
    df = settle(
        df, _r1=_ascension(c("_t1")), _r0=_ascension(c("_t0")),
        **{f"_c_{n}": _cos_hour(c(f"_t{int(up)}"), lat, z) for n, (z, up) in events.items()})
    df = settle(df, **{
        f"_s_{n}": _second(c(f"_a{int(up)}"), c(f"_t{int(up)}"), c(f"_r{int(up)}"), c(f"_c_{n}"), lon, up) for n, (_, up) in events.items()})
    df = settle(df, **{n: F.when(c(f"_s_{n}").isNotNull(), _on_date(day, c(f"_s_{n}"), offset_min)) for n in events})
    return df.select(*base, *events)


def offset_minutes(configured: Column, zone: Column, at: Column, default: int = 0) -> Column:
    """UTC offset: configured minutes within 14 hours, else the named zone's at ``at``, else the default."""
    in_zone = (F.unix_timestamp(F.from_utc_timestamp(at, zone)) - F.unix_timestamp(at)) / 60
    return F.when(configured.between(-840, 840), configured).when(zone.isNotNull(), in_zone.cast("bigint")).otherwise(F.lit(default))
