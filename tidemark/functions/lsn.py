"""Log sequence numbers and segment names as column expressions.

Positions are unsigned 64-bit numbers and kept as DECIMAL(20,0); text that cannot be read is null,
never 0, since a missing position means unknown.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEGMENT_BYTES = 16 * 1024 * 1024
WIDE = "decimal(20,0)"
_HALF = 1 << 32


def lsn_number(text: Column) -> Column:
    """``hi/lo`` in hex, or a plain number; null for anything else."""
    hi = F.conv(F.regexp_extract(text, r"^([0-9A-Fa-f]{1,8})/[0-9A-Fa-f]{1,8}$", 1), 16, 10)
    lo = F.conv(F.regexp_extract(text, r"^[0-9A-Fa-f]{1,8}/([0-9A-Fa-f]{1,8})$", 1), 16, 10)
    both = (hi.cast(WIDE) * F.lit(_HALF).cast(WIDE) + lo.cast(WIDE)).cast(WIDE)
    return F.when(text.rlike(r"^[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}$"), both).when(text.rlike(r"^\d{1,20}$"), text.cast(WIDE))


def lsn_text(number: Column, pad: bool = True) -> Column:
    """``hi/lo`` in upper-case hex; the low half has eight digits unless ``pad`` is off."""
    whole = number.cast(WIDE)
    hi = F.floor(whole / F.lit(_HALF).cast(WIDE)).cast("long")
    lo = (whole - hi.cast(WIDE) * F.lit(_HALF).cast(WIDE)).cast("long")
    low = F.hex(lo)
    return F.concat(F.hex(hi), F.lit("/"), F.lpad(low, 8, "0") if pad else low)


def segment_number(lsn: Column, segment_bytes: int = SEGMENT_BYTES) -> Column:
    return F.floor(lsn.cast(WIDE) / F.lit(segment_bytes).cast(WIDE)).cast("long")


def last_segment(stop: Column, on_standby: Column, segment_bytes: int = SEGMENT_BYTES) -> Column:
    """The last segment a backup needs: the one before, if it ended on a standby exactly at a segment's start."""
    at = segment_number(stop, segment_bytes)
    exact = (at.cast(WIDE) * F.lit(segment_bytes).cast(WIDE)) == stop.cast(WIDE)
    return F.when(on_standby & exact & (at > 0), at - 1).otherwise(at)


def segment_name(tli: Column, segno: Column, segment_bytes: int = SEGMENT_BYTES) -> Column:
    """24 hex digits: timeline, log and segment."""
    per_log = _HALF // segment_bytes
    part = lambda c: F.lpad(F.hex(c.cast("long")), 8, "0")
    return F.concat(part(tli), part(F.floor(segno / per_log)), part(F.pmod(segno, F.lit(per_log))))


def parse_segment(name: Column, segment_bytes: int = SEGMENT_BYTES) -> Column:
    """Struct of ``tli`` and ``segno``, null where the name is no segment's."""
    per_log = _HALF // segment_bytes
    part = lambda at: F.conv(F.substring(name, at, 8), 16, 10).cast("long")
    return F.when(name.rlike("^[0-9A-F]{24}$"), F.struct(part(1).cast("int").alias("tli"), (part(9) * per_log + part(17)).alias("segno")))
