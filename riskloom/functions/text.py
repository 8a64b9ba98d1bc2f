"""Normalisers and other text functions as column expressions. Each takes null for null unless it says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Connector words of acronyms, generic endings of artifact names.
CONNECTORS = ("a", "an", "the", "of", "for", "and", "or", "&")
GENERIC_ENDINGS = ("core", "api", "client", "clients", "impl", "common", "commons")
# Shapes of identifiers.
OSV_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,39}$"
GHSA_ID = r"^GHSA-[0-9a-z]{4}-[0-9a-z]{4}-[0-9a-z]{4}$"
KNOWN_ID = r"^(CVE-[0-9]{4}-[0-9]+|GHSA-[a-zA-Z0-9]{4}-[a-zA-Z0-9]{4}-[a-zA-Z0-9]{4})$"
SEED_NAME = r"^[A-Za-z0-9._@/~+-]+$"
SIMPLE_PACKAGE = r"^[A-Za-z0-9_-]+$"
VENDOR_PACKAGE = r"^[A-Za-z0-9._-]+$"
MODULE_PATH = r"^[A-Za-z0-9][A-Za-z0-9.\-]*\.[A-Za-z]{2,}/.+"
COORDINATE = r"^[A-Za-z0-9_]+(?:\.[A-Za-z0-9_]+)+:[A-Za-z0-9_.+-]+$"


def control_trim(text: Column) -> Column:
    """Without leading and trailing characters up to the space, control characters among them."""
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def unicode_trim(text: Column) -> Column:
    """Without leading and trailing white space of any script."""
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def blank_to_null(text: Column) -> Column:
    """Null for a blank text; any other stays as it is, outer spaces included."""
    return F.when(unicode_trim(text) != "", text)


def package_name(ecosystem: Column, name: Column) -> Column:
    """A package's name as its ecosystem compares it."""
    low = F.lower(name)
    return F.when(ecosystem == "pypi", F.regexp_replace(low, "[-_.]+", "-")).when(ecosystem == "crates.io", F.regexp_replace(low, "[-_]+", "-")).otherwise(low)


def containment_form(text: Column) -> Column:
    """Lower case, underscores as spaces, no backslashes, trimmed; "" for null."""
    return control_trim(F.replace(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("_"), F.lit(" ")), F.lit("\\"), F.lit("")))


def source_form(text: Column) -> Column:
    """Lower case, underscores and hyphens as spaces, trimmed; "" for null."""
    return control_trim(F.translate(F.lower(F.coalesce(text, F.lit(""))), "_-", "  "))


def bundled_form(text: Column) -> Column:
    """Lower case without white space, underscores and hyphens."""
    return F.regexp_replace(F.lower(text), r"[\s_\-]", "")


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of an already lower-case text; other letters separate."""
    return F.filter(F.split(text, "[^a-z0-9]+"), lambda t: t != "")


def without_annotation(name: Column) -> Column:
    """Cut before the first bracket or reference mark; the trimmed name where nothing would remain."""
    cut = control_trim(F.regexp_extract(name, "^([^(（※]*)", 1))
    return F.when(cut != "", cut).otherwise(control_trim(name))


def acronym(name: Column) -> Column:
    """First letters of at least four meaningful words, else null."""
    words = F.filter(F.split(F.lower(name), "[^a-zA-Z0-9]+"), lambda w: (w != "") & ~w.isin(*CONNECTORS))
    return F.when(F.size(words) >= 4, F.array_join(F.transform(words, lambda w: F.left(w, F.lit(1))), ""))


def without_vendor(name: Column, vendor: Column) -> Column:
    """The name after its vendor, which must end at a word's end; null where the name does not begin so or nothing remains."""
    v = control_trim(vendor)
    rest = F.substr(name, F.length(v) + 1)
    left = control_trim(F.regexp_replace(rest, "^[^a-zA-Z0-9]+", ""))
    begins = (v != "") & F.startswith(F.lower(name), F.lower(v)) & ~F.coalesce(rest.rlike(r"^[\p{L}\p{Nd}]"), F.lit(False))
    return F.when(begins & (left != ""), left)


def artifact_variants(name: Column) -> Column:
    """Of a Java coordinate: the artifact, it without generic endings, and its longer segments; else an empty array."""
    artifact = control_trim(F.regexp_extract(name, "([^:]*)$", 1))
    ending = "(?:-(?:" + "|".join(GENERIC_ENDINGS) + "))+$"
    bare = F.regexp_replace(artifact, "(?i)" + ending, "")
    segments = F.filter(F.split(artifact, "-"), lambda s: (F.length(s) >= 3) & ~F.lower(s).isin(*GENERIC_ENDINGS))
    parts = F.when(artifact.contains("-"), segments).otherwise(F.array().cast("array<string>"))
    return F.when(control_trim(name).rlike(COORDINATE), F.array_distinct(F.concat(F.array(artifact), F.array(bare), parts))).otherwise(F.array().cast("array<string>"))


def without_host(name: Column) -> Column:
    """A module path without its host; other names as they are."""
    return F.when(control_trim(name).rlike(MODULE_PATH), F.regexp_extract(control_trim(name), "^[^/]*/(.*)$", 1)).otherwise(name)


def last_segment(name: Column) -> Column:
    """What follows the last colon or slash of a package's name, the host taken off first; "" for null."""
    return F.regexp_extract(without_host(F.coalesce(name, F.lit(""))), "([^:/]*)$", 1)


def scoped_id(identifier: Column, package: Column, item: Column, longest: int = 100) -> Column:
    """A known identifier as it is; any other within the scope of its package or item."""
    known = control_trim(identifier)
    scope = F.coalesce(package, F.concat(F.lit("item"), item.cast("string")))
    return F.when(known.rlike(KNOWN_ID), known).otherwise(F.left(F.concat(F.lit("llm:"), scope, F.lit(":"), known), F.lit(longest)))


def cut_text(text: Column, longest: int) -> Column:
    """At most so many UTF-16 units: a character beyond the basic plane counts as two and goes where only one has room."""
    beyond, second = r"[\x{10000}-\x{10FFFF}]", "\uffff"  # the second unit is marked by a code point that is no character
    marked = F.left(F.regexp_replace(text, f"({beyond})", f"$1{second}"), F.lit(longest))
    return F.when(text.rlike(beyond), F.translate(F.regexp_replace(marked, f"{beyond}$", ""), second, "")).otherwise(F.left(text, F.lit(longest)))


def one_line(text: Column) -> Column:
    """A text for a log: without control characters of ASCII, so it can neither end a line nor steer a terminal."""
    return F.regexp_replace(text, r"[\x00-\x1F\x7F]", "")


def tracking_id(path: Column) -> Column:
    """The advisory a JSON path names: its stem in upper case, the first underscore as a colon; null for other paths."""
    stem = F.regexp_extract(path, r"([^/]*)\.json$", 1)
    return F.when(path.endswith(".json") & stem.contains("_"), F.upper(F.regexp_replace(stem, "^([^_]*)_", "$1:")))


def escaped_module(path: Column) -> Column:
    """A module path whose capitals are written as ``!`` and the small letter."""
    return F.lower(F.regexp_replace(path, "([A-Z])", "!$1"))


def escaped_query(text: Column) -> Column:
    """A text quoted for a full-text query string."""
    return F.regexp_replace(text, r'([+\-!(){}\[\]^"~*?:\\/]|&&|\|\|)', r"\\$1")


def initials(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.left(w, F.lit(1))), "")


def run_at(whole: Column, part: Column) -> Column:
    """The first place (from 1) where the array ``part`` stands in ``whole`` without a gap; 0 where it does not."""
    last = F.size(whole) - F.size(part) + 1
    places = F.when(last >= 1, F.filter(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.slice(whole, i, F.size(part)) == part))
    return F.coalesce(F.when(F.size(part) == 0, F.lit(1)), F.try_element_at(places, F.lit(1)), F.lit(0))


def pairs(left: Column, right: Column, most: int = 8) -> Column:
    """All pairs of the first few entries of two arrays, at most most * most."""
    return F.array_distinct(F.flatten(F.transform(F.slice(left, 1, most), lambda a: F.transform(F.slice(right, 1, most), lambda b: F.struct(a.alias("a"), b.alias("b"))))))


def plausible(query: Column, candidate: Column) -> Column:
    """One contains the other, or the candidate contains a word of four letters or more of the query."""
    shared = F.exists(F.split(query, r"\s+"), lambda w: (F.length(w) >= 4) & candidate.contains(w))
    return query.contains(candidate) | candidate.contains(query) | shared
