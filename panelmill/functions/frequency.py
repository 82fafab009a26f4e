"""Frequency aliases, their fixed tables, and calendar arithmetic on columns.

Every frequency is a regular grid over an integer unit: seconds for S, T, H, D
and W, business days for B, months for M, Q and A. A step is `stride` units, so
the position of a row is plain integer arithmetic on its own timestamp; nothing
has to be sorted or numbered to find it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values ----------------------------------------------------------
# Smallest usable series length per base frequency; 20 for anything else.
MIN_LENGTH = {
    "S": 259200, "T": 40320, "H": 720, "D": 183, "B": 130,
    "W": 104, "M": 120, "Q": 40, "A": 20,
}
DEFAULT_MIN_LENGTH = 20
# Candidate seasonal periods and the half-width of the band around each.
CANDIDATE_PERIODS = {
    "S": [(60, 10), (3600, 600), (43200, 3600), (86400, 7200)],
    "T": [(60, 10), (720, 60), (1440, 120), (10080, 720)],
    "H": [(12, 1), (24, 2), (168, 12), (720, 24)],
    "D": [(7, 1), (30, 3), (91, 7), (365, 14)],
    "B": [(5, 1), (21, 3), (63, 5), (252, 10)],
    "W": [(4, 1), (13, 2), (52, 4)],
    "M": [(12, 1)],
    "Q": [(4, 1)],
    "A": [(1, 0)],
}
# Season used by the naive forecast and the scaled error.
BASE_SEASON = {"S": 3600, "T": 1440, "H": 24, "D": 1, "B": 5, "W": 1, "M": 12, "Q": 4, "A": 1}
SEASON_CHOICES = {
    "S": [3600], "T": [1440, 10080], "H": [24, 168], "D": [7, 30, 365],
    "W": [52, 4], "M": [12, 6, 3], "B": [5], "Q": [4, 2],
}
# Default horizons per base frequency, the M4 variant, and the term multipliers.
HORIZON = {"A": 6, "Q": 8, "M": 12, "W": 8, "B": 21, "D": 30, "H": 48, "T": 48, "S": 60}
M4_HORIZON = {"A": 6, "Q": 8, "M": 18, "W": 13, "D": 14, "H": 48}
TERM_MULTIPLIER = {"short": 1, "medium": 10, "long": 15}
# Spellings of the base frequencies.
ALIASES = {
    "S": "S", "s": "S", "T": "T", "min": "T", "H": "H", "h": "H", "D": "D", "B": "B",
    "W": "W", "M": "M", "MS": "M", "ME": "M", "Q": "Q", "QS": "Q", "QE": "Q",
    "A": "A", "AS": "A", "Y": "A", "YS": "A", "YE": "A",
}
SECONDS = {"S": 1, "T": 60, "H": 3600, "D": 86400, "W": 604800}
MONTHS = {"M": 1, "Q": 3, "A": 12}
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Freq:
    """A parsed alias: base letter, multiplier, and whether calendar steps sit
    on the first or the last day of their month."""

    base: str
    n: int
    month_end: bool = False

    @property
    def stride(self) -> int:
        """Units per step."""
        return self.n * (SECONDS.get(self.base) or MONTHS.get(self.base) or 1)


def parse_freq(alias: str) -> Freq:
    """`15T` -> (T, 15); an anchor such as `-DEC` is dropped."""
    match = re.fullmatch(r"(\d*)([A-Za-z]+)", alias.split("-")[0])
    if not match or match.group(2) not in ALIASES:
        raise ValueError(f"frequency {alias!r} not recognised")
    count, name = match.groups()
    base = ALIASES[name]
    return Freq(base, int(count or 1), base in MONTHS and not name.endswith("S"))


def min_length(alias: str) -> int:
    """Smallest usable length; an alias that carries an anchor gets the default."""
    try:
        freq = parse_freq(alias)
    except ValueError:
        return DEFAULT_MIN_LENGTH
    if "-" in alias:
        return DEFAULT_MIN_LENGTH
    return max(1, MIN_LENGTH[freq.base] // freq.n)


def candidate_periods(alias: str) -> list[tuple[int, float]]:
    """(period, margin) pairs scaled by the multiplier of the alias."""
    freq = parse_freq(alias)
    return [(max(p // freq.n, 1), margin / freq.n) for p, margin in CANDIDATE_PERIODS[freq.base]]


def period_bands(alias: str) -> list[tuple[int, float, float]]:
    """(period, lowest, highest frequency) of the band around each candidate."""
    bands = []
    for period, margin in candidate_periods(alias):
        width = abs(1 / (period - margin) - 1 / (period + margin))
        bands.append((period, 1 / period - width / 2, 1 / period + width / 2))
    return bands


def seasonality(alias: str) -> int:
    """Season length in steps, 1 where the multiplier does not divide it."""
    freq = parse_freq(alias)
    base = BASE_SEASON[freq.base]
    return base // freq.n if base % freq.n == 0 else 1


def seasonality_list(alias: str) -> list[int]:
    """Every divisible season candidate, then 1."""
    freq = parse_freq(alias)
    return [s // freq.n for s in SEASON_CHOICES.get(freq.base, []) if s % freq.n == 0] + [1]


def freq_seconds(alias: str) -> float:
    """Seconds per step; 0 for frequencies without a fixed length."""
    freq = parse_freq(alias)
    fixed = freq.base in SECONDS and freq.base != "W"
    return float(SECONDS[freq.base] * freq.n) if fixed else 0.0


def default_horizon(alias: str, term: str = "short", m4: bool = False) -> int:
    base = parse_freq(alias).base
    return (M4_HORIZON if m4 else HORIZON)[base] * TERM_MULTIPLIER[term]


# --- The same for a column of aliases -----------------------------------------
# An alias that is not recognised gives NULL.

def _looked_up(table: dict, key: Column) -> Column:
    """The value of a small fixed table for a column of keys, NULL where it has none."""
    entries = [F.lit(x) for pair in table.items() for x in (pair[0], list(pair[1]) if isinstance(pair[1], list) else pair[1])]
    return F.try_element_at(F.create_map(*entries), key)


def parsed(alias: Column) -> Column:
    """Struct `(base, n)` of an alias."""
    plain = F.split(alias, "-")[0]
    count, name = (F.regexp_extract(plain, r"^(\d*)([A-Za-z]+)$", k) for k in (1, 2))
    base = _looked_up(ALIASES, name)
    number = F.when(count == "", F.lit(1)).otherwise(F.try_to_number(count, F.lit("9" * 18))).cast("bigint")
    return F.when(base.isNotNull(), F.struct(base.alias("base"), number.alias("n")))


def season_of(alias: Column) -> Column:
    freq = parsed(alias)
    base = _looked_up(BASE_SEASON, freq["base"])
    return F.when(base % freq["n"] == 0, F.call_function("div", base, freq["n"])).when(base.isNotNull(), F.lit(1)).cast("bigint")


def seasons_of(alias: Column) -> Column:
    freq = parsed(alias)
    choices = F.coalesce(_looked_up(SEASON_CHOICES, freq["base"]), F.array().cast("array<int>"))
    whole = F.transform(F.filter(choices, lambda s: s % freq["n"] == 0), lambda s: F.call_function("div", s, freq["n"]))
    return F.when(freq.isNotNull(), F.concat(whole, F.array(F.lit(1).cast("bigint"))))


def seconds_of(alias: Column) -> Column:
    freq = parsed(alias)
    fixed = _looked_up({k: v for k, v in SECONDS.items() if k != "W"}, freq["base"])
    return F.when(freq.isNotNull(), F.coalesce((fixed * freq["n"]).cast("double"), F.lit(0.0)))


def horizon_of(alias: Column, term: Column, m4: bool = False) -> Column:
    base = _looked_up(M4_HORIZON if m4 else HORIZON, parsed(alias)["base"])
    return (base * _looked_up(TERM_MULTIPLIER, term)).cast("bigint")


# --- Columns ---------------------------------------------------------------

def floor_div(value: Column, k: int) -> Column:
    """Exact floor division of a BIGINT."""
    return ((value - F.pmod(value, F.lit(k))) / F.lit(k)).cast("bigint") if k > 1 else value


def weekday(ds: Column) -> Column:
    """0 = Monday ... 6 = Sunday."""
    return F.weekday(ds).cast("bigint")


def days_of(ds: Column) -> Column:
    return F.unix_date(ds.cast("date")).cast("bigint")


def _midnight(ds: Column) -> Column:
    return ds == F.date_trunc("day", ds)


def units(ds: Column, freq: Freq) -> Column:
    """Index of the unit that holds `ds`: seconds, business days or months."""
    if freq.base in SECONDS:
        return F.unix_seconds(ds)
    if freq.base == "B":
        monday = days_of(ds) + 3
        return floor_div(monday, 7) * 5 + F.least(F.pmod(monday, F.lit(7)), F.lit(4))
    return (F.year(ds) * 12 + F.month(ds) - 1).cast("bigint")


def units_at_or_after(ds: Column, freq: Freq) -> Column:
    """First unit that starts at or after `ds` (rolls an off-grid start forward)."""
    if freq.base in SECONDS:
        return units(ds, freq)
    if freq.base == "B":
        return units(ds, freq) + F.when(weekday(ds) > 4, 1).otherwise(0)
    if freq.month_end:
        return units(ds, freq)
    return units(ds, freq) + F.when(on_unit(ds, freq), 0).otherwise(1)


def units_at_or_before(ds: Column, freq: Freq) -> Column:
    """Last unit that starts at or before `ds`."""
    if freq.base in MONTHS and freq.month_end:
        return units(ds, freq) - F.when(days_of(ds) == F.unix_date(F.last_day(ds)), 0).otherwise(1)
    return units(ds, freq)


def on_unit(ds: Column, freq: Freq) -> Column:
    """Does `ds` sit exactly on a unit boundary?"""
    if freq.base in SECONDS:
        return F.unix_micros(ds) == F.unix_seconds(ds) * 1_000_000
    if freq.base == "B":
        return _midnight(ds) & (weekday(ds) < 5)
    if freq.month_end:
        return _midnight(ds) & (ds.cast("date") == F.last_day(ds))
    return ds == F.date_trunc("month", ds)


def unit_time(index: Column, freq: Freq) -> Column:
    """Timestamp of a unit; the inverse of `units`."""
    if freq.base in SECONDS:
        return F.timestamp_seconds(index)
    if freq.base == "B":
        days = floor_div(index, 5) * 7 + F.pmod(index, F.lit(5)) - 3
        return F.date_from_unix_date(days.cast("int")).cast("timestamp")
    year = floor_div(index, 12).cast("int")
    month = (F.pmod(index, F.lit(12)) + 1).cast("int")
    first = F.make_date(year, month, F.lit(1))
    return (F.last_day(first) if freq.month_end else first).cast("timestamp")


def min_length_column(alias: Column) -> Column:
    """`min_length` for a column of aliases, e.g. in a task table."""
    count = F.regexp_extract(alias, r"^(\d*)([A-Za-z]+)$", 1)
    name = F.regexp_extract(alias, r"^(\d*)([A-Za-z]+)$", 2)
    table = F.create_map(*[F.lit(v) for a, b in ALIASES.items() for v in (a, MIN_LENGTH[b])])
    base = F.try_element_at(table, F.when(name != "", name).otherwise("?"))
    n = F.when(count == "", F.lit("1")).otherwise(count).cast("bigint")
    scaled = F.when(base.isNotNull(), F.greatest(F.lit(1), F.floor(base / n)))
    return F.coalesce(scaled, F.lit(DEFAULT_MIN_LENGTH)).cast("bigint")
