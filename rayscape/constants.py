"""Values that results depend on, and the rules that larger tables follow."""

from __future__ import annotations

# Receiver logs.
MINIMUM_VERSION = "1.4.0.0"
MINIMUM_PLATFORM = 7
PLATFORM_LETTERS = {"N": 7, "O": 8, "P": 9}
JOIN_TOLERANCE_MS = 990

# Constellations by their number in receiver logs, and how many satellites each has.
CONSTELLATIONS = {1: "G", 3: "R", 5: "C", 6: "E"}
SATELLITES = {"G": 32, "R": 24, "C": 37, "E": 36}

# Signal state bits without which a measurement is ambiguous.
REQUIRED_STATE_BITS = {"G": (1, 8), "R": (1, 8, 128), "C": (1, 8), "E": (1, 8, 2048)}

# A GLONASS frequency channel's two orbital slots.
CHANNEL_SLOTS = {
    93: (10, 14), 96: (2, 6), 97: (18, 22), 98: (9, 13), 99: (12, 16), 100: (11, 15), 101: (1, 5),
    102: (20, 24), 103: (19, 23), 104: (17, 21), 105: (3, 7), 106: (4, 8),
}

# Time, in nanoseconds.
SECOND = 10**9
DAY = 86_400 * SECOND
WEEK = 7 * DAY
PERIOD = {"G": WEEK, "R": DAY, "C": WEEK, "E": 10**8}
EPOCH_OFFSET = {"G": 0, "R": -3 * 3600 * SECOND, "C": 14 * SECOND, "E": 0}
AMBIGUITY = 10**8
GPS_EPOCH = 315_964_800 * SECOND  # 1980-01-06, as Unix time
LEAP_TABLE = ((1_435_708_800 * SECOND, 17), (1_483_228_800 * SECOND, 18))  # from these Unix times on

# Physics and geometry.
LIGHT_SPEED = 299_792_458  # m/s
WAVELENGTH = 0.1903  # m, of the L1 signal as the diffraction formulas round it
RAY_LENGTH = 1000.0  # m
MINIMUM_ELEVATION = 0.0  # degrees
MAXIMUM_ELEVATION = 85.0

LLA = "EPSG:4979"  # longitude, latitude, height
ECEF = "EPSG:4978"


def svid(constellation: str, number: int) -> str:
    return f"{constellation}{number:02d}"


def supported_svids(constellations: set[str] | None = None) -> list[str]:
    """All satellites of the named constellations (of all four, if not said otherwise)."""
    return [svid(c, n) for c in SATELLITES if constellations is None or c in constellations for n in range(1, SATELLITES[c] + 1)]
