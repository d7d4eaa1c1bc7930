"""Variables, locations, eras and levels that the operators know by name."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions.weather import wind_components

# Station coordinates (latitude, longitude in degrees); add stations of your own by name.
LOCATIONS = {
    "Gorge": (46.117215, 5.914877), "Basel": (47.561227, 7.603047), "MontTendre": (46.594542, 6.309533), "Chasseral": (47.132963, 7.058849), "ColGrandSaintBernard": (45.868846, 7.165453),
    "Schaffhausen": (47.697376, 8.634737), "Munich": (48.144714, 11.572036), "Dijon": (47.323463, 5.033933), "Frankfurt": (50.118894, 8.670885), "Stuttgart": (48.775951, 9.181457),
    "Berlin": (52.522825, 13.404231), "Prague": (50.072197, 14.436136), "Warsaw": (52.21639, 21.014928),
}
# Eras, their labels and stand-in years, quantile levels, season, smoothing window.
ERA_EDGES = (1993, 2014)
ERA_LABELS = ("pre-1993", "1993-2013", "2014+")
PERIOD_YEARS = (2000, 2100, 2200)
QUANTILE_LEVELS = (1, 5, 10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 99)
SEASON = (196, 335)
SMOOTH_WINDOW = 7
SUN_VARIABLES = ("sun_altitude", "sun_azimuth")
# Learning rate, weight decay, loss weight and Tweedie power of each species.
HYPERPARAMETERS = {
    "Black Kite": (0.005268440609667772, 0.08028188145537898, 4.16394139825189, 1.5141599673056123),
    "Common Buzzard": (0.02644218004857521, 0.006036431232167953, 8.287946511017436, 1.3504277144335508),
    "Hen Harrier": (0.0382935134579475, 0.005481981146109035, 9.820227367804325, 1.451648408260859),
    "Eurasian Hobby": (0.006074941355707205, 0.018510279672999983, 6.752060626387479, 1.0473552788015152),
    "European Honey-buzzard": (0.01586545404831044, 0.02999222709845246, 3.6281048434333463, 1.1972628281681463),
    "Eurasian Kestrel": (0.033033877717529414, 0.05034638662795058, 6.075865125122661, 1.1118943175744038),
    "Western Marsh Harrier": (0.033033877717529414, 0.05034638662795058, 6.075865125122661, 1.1118943175744038),
    "Merlin": (0.01923279309285134, 0.06224866622687921, 0.5, 1.4377277390071144),
    "Osprey": (0.006074941355707205, 0.018510279672999983, 6.752060626387479, 1.0473552788015152),
    "Red Kite": (0.016603463806371642, 0.06917231737226445, 4.813958972870758, 1.6536238720641603),
    "Eurasian Sparrowhawk": (0.007532292260521066, 0.0780084440070012, 6.948045337808714, 1.5534882583732639),
}


@dataclass(frozen=True)
class Variable:
    """A named variable: its source columns, their conversion, its daily aggregate and transform, and whether the archive has it."""

    source: tuple[str, ...]
    convert: Callable[..., Column]
    daily: str = "mean"
    transform: str = "standardize"
    archived: bool = True


def _scaled(factor: float, offset: float = 0.0) -> Callable[[Column], Column]:
    return lambda c: c * F.lit(factor) + F.lit(offset) if offset else c * F.lit(factor)


def _divided(by: float) -> Callable[[Column], Column]:
    return lambda c: c / F.lit(by)


# Names of variables, their source columns and units, how a day sums them up and how they are scaled.
VARIABLES = {
    "temperature_2m": Variable(("temperature_2m",), lambda c: c + F.lit(273.15)),
    "dewpoint_temperature_2m": Variable(("dew_point_2m",), lambda c: c + F.lit(273.15)),
    "surface_pressure": Variable(("surface_pressure",), _scaled(100.0)),
    "total_precipitation": Variable(("precipitation",), _divided(1000.0), daily="sum", transform="log_standardize"),
    "u_component_of_wind_10m": Variable(("wind_speed_10m", "wind_direction_10m"), lambda v, d: wind_components(v, d)[0]),
    "v_component_of_wind_10m": Variable(("wind_speed_10m", "wind_direction_10m"), lambda v, d: wind_components(v, d)[1]),
    "u_component_of_wind_100m": Variable(("wind_speed_100m", "wind_direction_100m"), lambda v, d: wind_components(v, d)[0]),
    "v_component_of_wind_100m": Variable(("wind_speed_100m", "wind_direction_100m"), lambda v, d: wind_components(v, d)[1]),
    "instantaneous_10m_wind_gust": Variable(("wind_gusts_10m",), lambda c: c),
    "total_cloud_cover": Variable(("cloud_cover",), _divided(100.0), transform="minmax"),
    "low_cloud_cover": Variable(("cloud_cover_low",), _divided(100.0), transform="minmax"),
    "medium_cloud_cover": Variable(("cloud_cover_mid",), _divided(100.0), transform="minmax"),
    "high_cloud_cover": Variable(("cloud_cover_high",), _divided(100.0), transform="minmax"),
    "surface_solar_radiation_downwards": Variable(("shortwave_radiation",), _scaled(3600.0), daily="sum"),
    "convective_available_potential_energy": Variable(("cape",), lambda c: c, archived=False),
}
#: Units asked of every source.
REQUEST_UNITS = {"wind_speed_unit": "ms", "temperature_unit": "celsius", "precipitation_unit": "mm", "timezone": "GMT"}


def as_list(value: str | Iterable[str]) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


def checked_locations(names: str | Iterable[str]) -> dict[str, tuple[float, float]]:
    names = as_list(names)
    if unknown := [n for n in names if n not in LOCATIONS]:
        raise ValueError(f"unknown locations {unknown}; known: {sorted(LOCATIONS)}")
    return {n: LOCATIONS[n] for n in names}


def checked_variables(names: str | Iterable[str], source: str = "archive") -> list[str]:
    names = as_list(names)
    if unknown := [n for n in names if n not in VARIABLES and n not in SUN_VARIABLES]:
        raise ValueError(f"unknown variables {unknown}; known: {sorted(VARIABLES)}")
    if source in ("archive", "cache") and (late := [n for n in names if n in VARIABLES and not VARIABLES[n].archived]):
        raise ValueError(f"only forecasts have {late}")
    return names


def source_columns(names: Iterable[str]) -> list[str]:
    """The source columns that the variables need, in order, each once."""
    return list(dict.fromkeys(c for n in names if n in VARIABLES for c in VARIABLES[n].source))


def request_parameters(names: str | Iterable[str]) -> dict[str, str]:
    return {"hourly": ",".join(source_columns(as_list(names))), **REQUEST_UNITS}


def converted(names: Iterable[str]) -> list[Column]:
    """Variables from their source columns."""
    return [VARIABLES[n].convert(*[F.col(c) for c in VARIABLES[n].source]).alias(n) for n in names]
