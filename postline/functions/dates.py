"""Date column functions: posting-date normalisation and next schedule slot."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, remembered

ISO_OUT = "yyyy-MM-dd'T'HH:mm:ssxxx"
# Largest epoch second that still formats as a four-digit year.
MAX_EPOCH_SECONDS = 253402300799
EPOCH_MILLIS_ABOVE = 10_000_000_000

# fixed values: shapes of a written date (Y: four digits, 9: one or two, M: a month's name) and how each is read
DATE_SHAPES = {
    "M 9, Y": "MMM d, yyyy", "M 9 Y": "MMM d yyyy", "9 M Y": "d MMM yyyy", "9 M, Y": "d MMM, yyyy", "9-M-Y": "d-MMM-yyyy", "Y M 9": "yyyy MMM d",
    "Y-9-9": "yyyy-M-d", "Y/9/9": "yyyy/M/d", "Y.9.9": "yyyy.M.d", "9/9/Y": "M/d/yyyy", "9-9-Y": "M-d-yyyy", "9.9.Y": "M.d.yyyy",
    "9/9/9": "M/d/yy", "9-9-9": "M-d-yy", "9.9.9": "M.d.yy",
}
# fixed values: the same for a written time (P: half of the day)
TIME_SHAPES = {"9:9": "H:m", "9:9:9": "H:m:s", "9:9 P": "h:m a", "9:9:9 P": "h:m:s a"}
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
_MONTH = r"(?i)\b(" + "|".join(MONTHS) + r")(?:uary|ruary|ch|il|e|y|ust|t|tember|ober|ember)?\b\.?"
_WEEKDAY = r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun|monday|tuesday|wednesday|thursday|friday|saturday|sunday)\.?,? +"
# a date, and a time behind it
_WRITTEN = r"^(.*?[0-9A-Za-z])(?:(?:,? +(?:at +)?| *T)([0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?(?: ?[AaPp]\.?[Mm]\.?)?))?$"
# a mail date ends in a zone of its own
_MAIL_ZONE = r"(?i) (?:GMT|UTC)$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# an offset stands behind a time only (the end of 06-08-2026 is none)
_ZONE = r"(Z|z|(?<=:[0-9]{2} ?|[.][0-9]{1,9} ?)[+-][0-9]{2}:?[0-9]{2})$"


def _epoch(s: Column) -> Column:
    n = F.when(s.rlike("^[0-9]{1,18}$"), s.cast("bigint"))
    secs = F.when(n > EPOCH_MILLIS_ABOVE, F.floor(n / 1000).cast("bigint")).otherwise(n)
    return F.when(secs <= MAX_EPOCH_SECONDS, F.timestamp_seconds(secs))


def _shape(text: Column, names: str, mark: str) -> Column:
    """The text with four digits as Y, one or two as 9 and the names as mark."""
    s = F.regexp_replace(text, names, mark)
    return F.regexp_replace(F.regexp_replace(s, r"(?<![0-9])[0-9]{4}(?![0-9])", "Y"), r"(?<![0-9])[0-9]{1,2}(?![0-9])", "9")


def _by_shape(text: Column, shape: Column, shapes: dict[str, str]) -> Column:
    """One parse: by the layout that the shape names."""
    out = None
    for known, layout in shapes.items():
        read = F.try_to_timestamp(text, F.lit(layout))
        out = F.when(shape == known, read) if out is None else out.when(shape == known, read)
    return out


def _written(body: Column) -> Column:
    """Wall-clock time of a written date with or without a time."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(body), _WEEKDAY, ""), _MONTH, "$1")

    def parts(s: Column) -> Column:
        clock = F.upper(F.regexp_replace(F.regexp_replace(F.regexp_extract(s, _WRITTEN, 2), r"\.", ""), r"(?<=[0-9])(?=[AaPp])", " "))
        return F.struct(F.regexp_extract(s, _WRITTEN, 1).alias("d"), clock.alias("t"))

    def read(z: Column) -> Column:
        day = _by_shape(z["d"], _shape(z["d"], "(?i)\\b(" + "|".join(MONTHS) + ")\\b", "M"), DATE_SHAPES)
        time = _by_shape(z["t"], _shape(z["t"], "[AP]M$", "P"), TIME_SHAPES)
        both = F.try_to_timestamp(F.concat(F.date_format(day, "yyyy-MM-dd "), F.date_format(time, "HH:mm:ss")))
        return F.when(z["t"] == "", day).otherwise(both)

    return let(let(plain, parts), read)


def _wall_clock(body: Column) -> Column:
    """Wall-clock time written in ``body`` (no zone), or NULL: the ISO-8601 forms, else the layout of its shape."""
    return F.coalesce(F.try_to_timestamp(body), _written(body))


@remembered
def normalize_date(c) -> Column:
    """'' for empty; ISO-8601 text when it parses; else unchanged.

    Epoch values become the session-zone time with its offset (seconds).
    Text keeps its own wall-clock time: with a zone the offset is written as
    ``+HH:MM`` (``Z`` -> ``+00:00``), without one no offset is written;
    microseconds appear only when non-zero.
    """
    return let(F.coalesce(_col(c).cast("string"), F.lit("")), _normalized)


def _normalized(s: Column) -> Column:
    digits = s.rlike("^[0-9]+$")
    epoch = _epoch(s)
    mail = s.rlike(_MAIL_ZONE)
    zone = F.when(mail, F.lit("Z")).otherwise(F.regexp_extract(s, _ZONE, 1))
    body = F.when(mail, F.regexp_replace(s, _MAIL_ZONE, "")).when(zone != "", F.substring(s, F.lit(1), F.length(s) - F.length(zone))).otherwise(s)
    # a trailing zone name (PST, ...) would be converted away: keep such text as is; digits are an epoch and not tried as a date
    wall = F.when(~digits & ~body.rlike("[A-Za-z]{3,}$"), _wall_clock(body))
    return let(F.struct(s.alias("s"), digits.alias("digits"), epoch.alias("epoch"), zone.alias("zone"), wall.alias("wall")), _as_iso)


def _as_iso(z: Column) -> Column:
    s, digits, epoch, zone, wall = (z[c] for c in ("s", "digits", "epoch", "zone", "wall"))
    offset = (
        F.when(zone == "", F.lit(""))
        .when(F.upper(zone) == "Z", F.lit("+00:00"))
        .when(F.length(zone) == 5, F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, 4, 2)))
        .otherwise(zone)
    )
    micros = F.date_format(wall, "SSSSSS")
    frac = F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(F.lit(""))
    text = F.concat(F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss"), frac, offset)
    return (
        F.when(s == "", F.lit(""))
        .when(digits, F.coalesce(F.date_format(epoch, ISO_OUT), s))
        .when(wall.isNotNull(), text)
        .otherwise(s)
    )


def iso_text(c) -> Column:
    """Timestamp as ISO-8601 text with offset, seconds precision."""
    return F.date_format(_col(c), ISO_OUT)


_SLOT = re.compile(r"\s*([01]?\d|2[0-3])\s*:\s*([0-5]?\d)\s*")


def parse_slots(slots) -> list[tuple[int, int]]:
    """Driver-side parse of 'HH:MM' parameters; entries of another form are skipped."""
    found = [_SLOT.fullmatch(str(s)) for s in slots or ()]
    return [(int(m[1]), int(m[2])) for m in found if m]


def next_slot(ts, slots) -> Column:
    """Earliest configured HH:MM strictly after ``ts`` (tomorrow if passed today)."""
    ts = _col(ts)
    parsed = parse_slots(slots)
    if not parsed:
        return F.lit("")
    day = F.date_trunc("day", ts)
    cands = []
    for hour, minute in parsed:
        cand = day + F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(hour), F.lit(minute))
        cands.append(F.when(cand > ts, cand).otherwise(cand + F.expr("INTERVAL 1 DAY")))
    best = F.least(*cands) if len(cands) > 1 else cands[0]
    return iso_text(best)
