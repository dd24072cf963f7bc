"""Text as people and other programs read it: sizes, spans of time, quoted paths, target times, JSON keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PART = r'"(?:[^"]|"")*"|[^".][^.]*|'


def human_bytes(n: Column) -> Column:
    """``12.5 MiB``: the largest of the units B to PiB that leaves at least one, with one decimal (ties to even)."""
    size, out = n.cast("double"), None
    for power, unit in enumerate(["B", "KiB", "MiB", "GiB", "TiB", "PiB"]):
        shown = F.format_string(f"%.1f {unit}", F.bround(size / 1024.0**power, 1))
        out = F.when(F.abs(size) < 1024.0, shown) if out is None else out.otherwise(shown) if unit == "PiB" else out.when(F.abs(size) < 1024.0 ** (power + 1), shown)
    return F.when(n.isNotNull(), out)


def human_hours(hours: Column) -> Column:
    """Days from two days on, hours from two hours on, else minutes, one at least."""
    whole = lambda x: F.floor(x + 0.5)
    minutes = F.greatest(F.lit(1).cast("long"), whole(hours * 60))
    less = F.format_string("%d %s", minutes, F.when(minutes == 1, "minute").otherwise("minutes"))
    return F.when(hours >= 48, F.format_string("%d days", whole(hours / 24))).when(hours >= 2, F.format_string("%d hours", whole(hours))).when(hours.isNotNull(), less)


def join_path(parts: Column) -> Column:
    """Parts joined by dots; one with a dot or a quote is quoted, its quotes doubled."""
    return F.array_join(F.transform(parts, lambda p: F.when(p.contains(".") | p.contains('"'), F.concat(F.lit('"'), F.replace(p, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(p)), ".")


def split_path(path: Column) -> Column:
    """The parts of what ``join_path`` gives; null for a quote that does not end or has text after it."""
    dotted = F.concat(F.lit("."), path)
    bare = lambda p: F.when(p.startswith('"'), F.replace(F.substring(p, F.lit(2), F.length(p) - 2), F.lit('""'), F.lit('"'))).otherwise(p)
    return F.when(dotted.rlike(rf"(?s)^(?:\.(?:{PART}))+$"), F.transform(F.regexp_extract_all(dotted, F.lit(rf"(?s)\.({PART})"), F.lit(1)), bare))


def target_time(text: Column) -> Column:
    """A target time as a server accepts it (``YYYY-MM-DD HH:MM:SS[.f]+HH[:MM]``); null without an explicit offset from UTC."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), r"(?i)\s*(z|utc)$", "+00"), r"^(\d{4}-\d{2}-\d{2})[Tt]", "$1 ")
    return F.when(F.trim(text).rlike(r"([+-]\d{2}(:?\d{2})?|Z|UTC)\s*$"), plain)


def target_micros(text: Column) -> Column:
    """Microseconds since 1970 of a target time; null if it has no offset or is no time."""
    shape = r"^(\d{4}-\d{2}-\d{2}) (\d{2}:\d{2}:\d{2})(\.\d{1,6})?\d*\s*([+-]\d{2})(?::?(\d{2}))?$"
    part = lambda k: F.regexp_extract(target_time(text), shape, k)
    minutes = F.when(part(5) == "", "00").otherwise(part(5))
    return F.unix_micros(F.concat(part(1), F.lit(" "), part(2), part(3), part(4), F.lit(":"), minutes).try_cast("timestamp"))


#: How a log dump writes times, and what a name is made of.
EVENT_TIME = r"^\s*(\d{4}-\d\d-\d\d)(?:[T ](\d\d:\d\d)(:\d\d(?:\.\d{1,6})?)?)?\s*(Z|UTC|[+-]\d\d(?::?\d\d)?)?\s*$"
SLUG_CHARACTERS, SLUG_LENGTH, SLUG_DEFAULT = "a-z0-9_-", 60, "cluster"


def event_micros(text: Column) -> Column:
    """Microseconds since 1970 of the time of a logged event: a date, with or without a time of day; without an offset it is UTC. Null if it is no time."""
    part = lambda k: F.regexp_extract(text, EVENT_TIME, k)
    or_else = lambda x, y: F.when(x == "", y).otherwise(x)
    base = F.unix_micros(F.concat(part(1), F.lit(" "), or_else(part(2), "00:00"), or_else(part(3), ":00"), F.lit("+00:00")).try_cast("timestamp"))
    offset = F.regexp_replace(part(4), "Z|UTC|:", "")
    number = lambda at: F.coalesce(F.substring(offset, at, 2).try_cast("long"), F.lit(0))
    away = (number(2) * 60 + number(4)) * 60_000_000
    return F.when(text.rlike(EVENT_TIME) & ~F.trim(text).startswith("0000"), base - F.when(offset.startswith("-"), -away).otherwise(away))


def slug(text: Column) -> Column:
    """A name for paths and keys: lower case, other characters than letters, digits, ``_`` and ``-`` as one ``-``, none at either end."""
    dashed = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"[^{SLUG_CHARACTERS}]+", "-")
    name = F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, SLUG_LENGTH)
    return F.when(name == "", SLUG_DEFAULT).otherwise(name)


def json_value(value: Column) -> Column:
    """JSON text of one value, ``null`` of null."""
    whole = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def json_key(*values: Column) -> Column:
    """The values of a key as a JSON array, a blank after each comma."""
    return F.concat(F.lit("["), F.concat_ws(", ", *[json_value(v) for v in values]), F.lit("]"))


def stable_json(entries: Column, volatile: tuple[str, ...] = ()) -> Column:
    """JSON of a map as an array of key and value, keys in order, those in ``volatile`` left out: equal for equal work."""
    keys = F.array_sort(F.filter(F.map_keys(entries), lambda k: ~k.isin(*volatile)) if volatile else F.map_keys(entries))
    return F.to_json(F.transform(keys, lambda k: F.array(k, entries[k])), {"ignoreNullFields": "false"})
