"""Satellite identifiers, signal states and pseudoranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rayscape.constants import AMBIGUITY, CHANNEL_SLOTS, CONSTELLATIONS, EPOCH_OFFSET, LIGHT_SPEED, MINIMUM_PLATFORM, PERIOD, PLATFORM_LETTERS, REQUIRED_STATE_BITS, SATELLITES, SECOND
from rayscape.functions.time import leap_seconds_at_gps


def by_constellation(constellation: Column, values: dict[str, int]) -> Column:
    """A constellation's value; NULL for any other letter."""
    table = F.create_map(*[F.lit(x) if isinstance(x, str) else F.lit(x).cast("long") for pair in values.items() for x in pair])
    return F.try_element_at(table, constellation)


def constellation(number: Column) -> Column:
    """The letter of a log's constellation number; NULL for any other."""
    return F.try_element_at(F.create_map(*[F.lit(x) if isinstance(x, str) else F.lit(x).cast("long") for pair in CONSTELLATIONS.items() for x in pair]), number.cast("long"))


def svid(letter: Column, number: Column) -> Column:
    """Letter and number, padded to two digits and never cut."""
    text = number.cast("string")
    return F.concat(letter, F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text))


def ambiguity(x: Column) -> Column:
    """What Galileo times are unknown beyond: whole tenths of a second."""
    return x - F.pmod(x, F.lit(AMBIGUITY).cast("long"))


def period_start(rx: Column, state: Column, letter: Column) -> Column:
    """Start of the constellation's period at ``rx``; NULL unless all state bits are there."""
    mask = by_constellation(letter, {c: sum(bits) for c, bits in REQUIRED_STATE_BITS.items()})
    return F.when(state.bitwiseAND(mask) == mask, rx - F.pmod(rx, by_constellation(letter, PERIOD)))


def transmit_time(rx: Column, received: Column, state: Column, letter: Column) -> Column:
    """GPS nanoseconds at which the signal left, moved back by a period where it would have come before it left."""
    own = received - F.when(letter == "E", ambiguity(received)).otherwise(F.lit(0).cast("long"))
    sent = own + period_start(rx, state, letter) + by_constellation(letter, EPOCH_OFFSET)
    # GLONASS runs on UTC; arrays of one compute each step once
    leap = lambda t: F.when(letter == "R", leap_seconds_at_gps(t).cast("long") * F.lit(SECOND).cast("long")).otherwise(F.lit(0).cast("long"))
    tx = F.transform(F.array(sent), lambda t: t + leap(t))
    return F.transform(tx, lambda t: F.when(rx > t, t).otherwise(t - by_constellation(letter, PERIOD)))[0]


def pseudorange(rx: Column, tx: Column) -> Column:
    return (rx - tx).cast("double") * F.lit(1e-9) * F.lit(float(LIGHT_SPEED))


def is_channel(sv: Column) -> Column:
    """Whether a GLONASS satellite is named by its frequency channel."""
    return (F.substring(sv, 1, 1) == "R") & (F.substring(sv, 2, 9).try_cast("int") >= 93)


def slots(sv: Column) -> Column:
    """The satellites that an identifier may stand for: a channel's two slots, or itself."""
    table = F.create_map(*[x for channel, pair in CHANNEL_SLOTS.items() for x in (F.lit(f"R{channel}"), F.array(*[F.lit(f"R{k:02d}") for k in pair]))])
    return F.coalesce(F.try_element_at(table, sv), F.array(sv))


def is_supported(sv: Column) -> Column:
    letter, number = F.substring(sv, 1, 1), F.substring(sv, 2, 9)
    most = by_constellation(letter, SATELLITES)
    return F.coalesce(number.rlike("^[0-9]{2}$") & number.try_cast("int").between(1, most), F.lit(False))


def version_parts(version: Column) -> Column:
    """Four numbers of a version such as v2.0.0.1, filled up with zeros."""
    found = F.transform(F.split(F.regexp_replace(version, "[^0-9.]", ""), r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))
    return F.slice(F.concat(found, F.array_repeat(F.lit(0), 4)), 1, 4)


def version_at_least(actual: Column, expected: Column) -> Column:
    return version_parts(actual) >= version_parts(expected)


def platform_number(platform: Column) -> Column:
    out = platform.try_cast("int")
    for letter, n in PLATFORM_LETTERS.items():
        out = F.when(platform == letter, F.lit(n)).otherwise(out)
    return out


def platform_at_least(platform: Column, expected: int = MINIMUM_PLATFORM) -> Column:
    """False for platforms that can't be told."""
    return F.coalesce(platform_number(platform) >= expected, F.lit(False))
