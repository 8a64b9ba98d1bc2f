"""Parsing and building of CPE names; a backslash keeps the character after it in its segment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def segments(cpe: Column) -> Column:
    """Segments between colons that no backslash escapes; a lone backslash at the end belongs to the last one."""
    lone = cpe.rlike(r"(?:^|[^\\])(?:\\\\)*\\$")
    body = F.concat(F.when(lone, F.regexp_replace(cpe, r"\\$", "")).otherwise(cpe), F.lit(":"))
    found = F.regexp_extract_all(body, F.lit(r"((?:\\.|[^:\\])*):"), 1)
    n = F.size(found)
    return F.when(lone, F.concat(F.slice(found, F.lit(1), n - 1), F.array(F.concat(F.element_at(found, -1), F.lit("\\"))))).otherwise(found)


def vendor(cpe: Column) -> Column:
    """Null for a name of less than five segments."""
    s = segments(cpe)
    return F.when(F.size(s) > 4, s[3])


def product(cpe: Column) -> Column:
    s = segments(cpe)
    return F.when(F.size(s) > 4, s[4])


def part(cpe: Column) -> Column:
    """``a`` where the name has none."""
    s = segments(cpe)
    return F.coalesce(F.when((F.size(s) > 2) & (F.trim(s[2]) != ""), s[2]), F.lit("a"))


def version(cpe: Column) -> Column:
    """``*`` where the name has none."""
    s = segments(cpe)
    return F.coalesce(F.when(F.size(s) > 5, s[5]), F.lit("*"))


def build(of_part: Column, of_vendor: Column, of_product: Column, of_version: Column) -> Column:
    return F.concat(F.concat_ws(":", F.lit("cpe:2.3"), of_part, of_vendor, of_product, of_version), F.lit(":*" * 7))


def with_version(cpe: Column, new: Column) -> Column:
    """The name with another version and no update; a name of less than six segments as it is."""
    s = segments(cpe)
    tail = F.slice(s, F.lit(8), F.greatest(F.size(s) - 7, F.lit(0)))
    update = F.when(F.size(s) > 6, F.array(F.lit("*"))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(s) > 5, F.array_join(F.concat(F.slice(s, 1, 5), F.array(new), update, tail), ":")).otherwise(cpe)


def masked(cpe: Column) -> Column:
    """The name with any version, by plain colons: escapes are not looked at."""
    s = F.split(cpe, ":")
    return F.when(F.size(s) > 5, F.array_join(F.concat(F.slice(s, 1, 5), F.array(F.lit("*")), F.slice(s, F.lit(7), F.greatest(F.size(s) - 6, F.lit(0)))), ":")).otherwise(cpe)


def plain_part(cpe: Column) -> Column:
    """The part by plain colons; null where there is none."""
    return F.try_element_at(F.split(cpe, ":"), F.lit(3))


def plain_segment(cpe: Column, n: int) -> Column:
    """Segment ``n`` (from 1) once escaped colons are removed; "" where there is none."""
    return F.split_part(F.replace(cpe, F.lit("\\:"), F.lit("")), F.lit(":"), F.lit(n))


def catalogue_major(cpe: Column) -> Column:
    """The leading one to nine digits of the version; null where there are none."""
    return F.nullif(F.regexp_extract(plain_segment(cpe, 6), "^[0-9]{1,9}", 0), F.lit("")).cast("int")


def query_name(name: Column) -> Column:
    """A name percent-encoded as a query value; letters, digits and ``-._~!$'()*,;:@/?`` stay."""
    raw = F.url_encode(name)
    for code, char in (("%21", "!"), ("%24", "$"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%2C", ","), ("%3B", ";"), ("%3A", ":"), ("%40", "@"), ("%2F", "/"), ("%3F", "?"), ("%7E", "~")):
        raw = F.replace(raw, F.lit(code), F.lit(char))
    return F.replace(raw, F.lit("+"), F.lit("%20"))
