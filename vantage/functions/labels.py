"""Bands, levels and other values turned to words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper bounds (inclusive), label and action of the interpretation bands.
BANDS = [
    (0.30, "normal", "store"),
    (0.55, "mildly unusual", "timeline marker"),
    (0.75, "interesting", "include in summary"),
    (0.90, "strong anomaly", "local alert"),
    (None, "rare", "preserve raw data + report"),
]
#: WMO weather codes.
WMO = {
    0: "clear", 1: "mostly clear", 2: "partly cloudy", 3: "overcast", 45: "fog", 48: "rime fog", 51: "drizzle", 53: "drizzle", 55: "drizzle",
    61: "rain", 63: "rain", 65: "heavy rain", 66: "freezing rain", 67: "freezing rain", 71: "snow", 73: "snow", 75: "heavy snow", 77: "snow grains",
    80: "showers", 81: "showers", 82: "heavy showers", 85: "snow showers", 86: "snow showers", 95: "thunderstorm", 96: "thunderstorm + hail", 99: "thunderstorm + hail",
}
#: Geomagnetic storm levels from K index 5 on.
STORMS = ["G1 minor storm", "G2 moderate storm", "G3 strong storm", "G4 severe storm"]


def _chain(score: Column, values: list) -> Column:
    out = F.when(score <= BANDS[0][0], values[0])
    for (top, *_), v in zip(BANDS[1:-1], values[1:-1], strict=True):
        out = out.when(score <= top, v)
    return out.otherwise(values[-1])  # NaN compares above every bound


def band(score: Column) -> Column:
    return _chain(score, [b[1] for b in BANDS])


def band_rank(score: Column) -> Column:
    """0 to 4, in the order of BANDS."""
    return _chain(score, list(range(len(BANDS))))


def band_action(score: Column) -> Column:
    return _chain(score, [b[2] for b in BANDS])


def wmo_text(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in WMO.items() for x in kv])
    return F.coalesce(F.try_element_at(table, code.cast("int")), F.concat(F.lit("wmo "), code.cast("string")))


def _number(c: Column) -> Column:
    """A number as short as it can be told: no point for whole ones."""
    return F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))


def weather_line() -> Column:
    """One line from the columns of ``feeds.weather_now``."""
    c = F.col
    rain = F.when(c("precipitation") > 0, F.concat(F.lit(" · precip "), _number(c("precipitation")), F.lit(" mm"))).otherwise("")
    told = F.format_string("wx %s°C · wind %d kn @ %03d° · cloud %s%% · %s", _number(c("temperature_2m")), F.round("wind_speed_10m").cast("int"), F.round("wind_direction_10m").cast("int"), _number(c("cloud_cover")), wmo_text(c("weather_code")))
    return F.concat(told, rain)


def weather_lines() -> Column:
    """Four lines of detail from the same columns."""
    c, whole = F.col, lambda k: F.round(k).cast("int")
    return F.array(
        F.format_string("temperature %s °C · humidity %s%%", _number(c("temperature_2m")), _number(c("relative_humidity_2m"))),
        F.format_string("wind %d kn @ %03d° · gusts %d kn", whole("wind_speed_10m"), whole("wind_direction_10m"), whole("wind_gusts_10m")),
        F.format_string("pressure %d hPa · cloud %s%%", whole("surface_pressure"), _number(c("cloud_cover"))),
        F.format_string("%s · precip %s mm", wmo_text(c("weather_code")), _number(c("precipitation"))),
    )


def kp_level(kp: Column) -> Column:
    """Geomagnetic level from the planetary K index."""
    out = F.when(kp < 4, "quiet").when(kp < 5, "active")
    for i, storm in enumerate(STORMS):
        out = out.when(kp < 6 + i, storm)
    return out.otherwise("G5 extreme storm")


def aurora_hint(kp: Column) -> Column:
    return kp >= 7


def kp_line(kp: Column) -> Column:
    """The level in words, with a hint from K 7 on."""
    return F.concat(F.format_string("Kp %.1f · %s", kp, kp_level(kp)), F.when(aurora_hint(kp), " · aurora possible").otherwise(""))


def emergency(flag: Column, squawk: Column) -> Column:
    """The emergency field unless none, else the distress squawk."""
    return F.when(flag.isNotNull() & (flag != "") & (flag != "none"), flag).when(squawk.isin("7500", "7600", "7700"), F.concat(F.lit("squawk "), squawk))


def display_name(callsign: Column, icao24: Column) -> Column:
    return F.coalesce(F.nullif(callsign, F.lit("")), icao24)
