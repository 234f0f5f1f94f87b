"""Settings of the operators, and the fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass

# Sensor and rule constants, needed as they are for right results.
WAVELENGTH_M = 0.055465
PIXEL_AREA_KM2 = 0.0036
VALID_CLASSES = (4, 5, 6, 7, 11)
WATER_CLASS = 6
MAX_CLOUD = 60.0
MIN_VALID_FRACTION = 0.80
MAD_FLOOR = 1e-6
MAD_SCALE = 0.6745
METRES_PER_DEGREE = 111320.0
DAYS_PER_YEAR = 365.25


@dataclass(frozen=True)
class HarmonicConfig:
    harmonics: int = 4
    min_rows: int = 10
    threshold: float = 3.0
    value_digits: int = 3


@dataclass(frozen=True)
class InversionConfig:
    min_coherence: float = 0.3
    min_mean_coherence: float = 0.4
    orphan: str = "null"  # or "zero": what an epoch without observations gives


@dataclass(frozen=True)
class ChangeConfig:
    seed_db: float = -4.0
    grow_db: float = -3.0
    min_slope_deg: float = 15.0
    min_pixels: int = 8
    pixel_area_m2: float = 100.0


@dataclass(frozen=True)
class TrailingConfig:
    days: int = 15
    factor: float = 1.5
    strict: bool = True


@dataclass(frozen=True)
class ClimatologyConfig:
    threshold: float = 2.0
    years: int = 10
    ddof: int = 1
    min_history: int = 2


@dataclass(frozen=True)
class RunConfig:
    steps: int = 3


@dataclass(frozen=True)
class PrecursorConfig:
    """A study of the days before events: 30 scored days, each against the 15 before it; the twin window is a year earlier."""

    scored_days: int = 30
    history_days: int = 15
    factor: float = 1.5
    twin_months: int = 12
    shifts: tuple[int, ...] = tuple(s for d in range(15, 76, 10) for s in (d, -d))
