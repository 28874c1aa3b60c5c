"""Column functions on lines and values of calendar files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEAD = r'^((?:[^":]++|"[^"]*+")*+):([\s\S]*)$'


def property_head(line: Column) -> Column:
    """Name and parameters: what precedes the first colon outside quotes."""
    return F.regexp_extract(line, _HEAD, 1)


def property_name(line: Column) -> Column:
    return F.split_part(property_head(line), F.lit(";"), F.lit(1))


def property_value(line: Column) -> Column:
    return F.regexp_extract(line, _HEAD, 2)


def parameter(line: Column, name: str) -> Column:
    """Value of a parameter without quotes, null if absent; the last one counts."""
    pieces = F.filter(F.split(property_head(line), ";"), lambda p: F.startswith(p, F.lit(f"{name}=")))
    return F.btrim(F.substring(F.try_element_at(pieces, F.lit(-1)), len(name) + 2, 2**31 - 1), F.lit('"'))


def unescape(text: Column) -> Column:
    """\\n and \\N to line breaks, \\, \\; and \\\\ to the character; other backslashes stay."""
    def plain(piece: Column) -> Column:
        for code, char in (("\\n", "\n"), ("\\N", "\n"), ("\\,", ","), ("\\;", ";")):
            piece = F.replace(piece, F.lit(code), F.lit(char))
        return piece

    # Between two backslashes in a row, which stand for one, every escape is whole.
    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def mail_address(value: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(value), "(?i)^mailto:", ""))


def attendee(line: Column) -> Column:
    return F.struct(
        mail_address(property_value(line)).alias("email"),
        *[F.coalesce(parameter(line, p), F.lit("")).alias(n) for p, n in (("CN", "name"), ("ROLE", "role"), ("PARTSTAT", "partstat"), ("CUTYPE", "cutype"))],
    )
