"""Column expressions for text: separators, numbers, names, lists, curation, times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fields(line: Column) -> Column:
    """The fields of a line: any run of tabs, semicolons, commas or white space separates, a run of minus signs is one."""
    line = F.regexp_replace(line, r"^\s+|\s+$", "")
    return F.split(F.regexp_replace(F.regexp_replace(line, r"[\t;\s,]+", " "), "-+", "-"), " ")


def number(token: Column) -> Column:
    """A repaired number: only digits, points and minus signs count, and at most one point; null if none can be read."""
    kept = F.regexp_replace(token, "[^-0-9.]", "")
    return F.regexp_extract(kept, r"^[^.]*(\.[^.]*)?", 0).try_cast("double")


def name_field(file: Column, which: int) -> Column:
    """From ``RID_wWEIGHT#part.ext``: 1 the dataset, 2 its weight; null if the name has another form."""
    got = F.regexp_extract(file, r"([^_/]+)_w([^#./]+)[^/]*$", which)
    return F.when(got != "", got)


def curated(text: Column) -> Column:
    """Without tabs and line ends, trimmed; what is blank or a pair of quotes is null."""
    clean = F.trim(F.translate(text, "\t\r\n", ""))
    return F.when(~clean.isin("", '""', "''"), clean)


def tile_list(text: Column) -> Column:
    """``"3-6"`` as 3, 4, 5, 6 and ``"3;9"`` as 3, 9."""
    ends = F.split(text, "-")
    span = F.sequence(F.element_at(ends, 1).cast("int"), F.element_at(ends, 2).cast("int"))
    return F.when(text.contains("-"), span).otherwise(F.transform(F.split(text, ";"), lambda x: x.cast("int")))


def list_length(text: Column) -> Column:
    return F.when(text.isNull() | (text == ""), 0).otherwise(F.size(F.split(text, ";")))


def megabytes(size: Column) -> Column:
    return size / 1024 / 1024


def stamp(text: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.to_timestamp_ntz(text, F.lit(pattern))


def stamp_text(time: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(time, pattern)


def epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)
