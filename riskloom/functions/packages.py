"""Package addresses and what ecosystems are called."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ecosystems as advisories name them, and as packages' addresses and the catalogue do.
ADVISORY_NAME = {"npm": "npm", "pypi": "PyPI", "maven": "Maven", "go": "Go", "nuget": "NuGet", "rubygems": "RubyGems", "crates.io": "crates.io", "packagist": "Packagist", "hex": "Hex", "pub": "Pub"}
ADDRESS_TYPE = {"npm": "npm", "pypi": "pypi", "maven": "maven", "go": "golang", "nuget": "nuget", "rubygems": "gem", "crates.io": "cargo", "packagist": "composer", "hex": "hex", "pub": "pub"}
TARGET_SOFTWARE = {"npm": "node.js", "pypi": "python", "rubygems": "ruby", "crates.io": "rust", "go": "go", "packagist": "php", "pub": "dart", "nuget": ".net"}
# Hosts that an extension is installed from.
INSTALL_HOST = {"marketplace.visualstudio.com": "visual_studio_code", "chromewebstore.google.com": "chrome", "plugins.jetbrains.com": "jetbrains", "addons.mozilla.org": "firefox"}
# Words of a usage text that speak for an ecosystem.
USAGE_WORDS = {
    "pypi": ["pypi", "pip"], "npm": ["npm", "node"], "rubygems": ["gem", "ruby"], "crates.io": ["crate", "rust", "cargo"], "packagist": ["packagist", "composer", "php"],
    "hex": ["hex", "elixir"], "pub": ["pub.dev", "dart", "flutter"], "maven": ["maven", "gradle", "java"], "nuget": ["nuget", ".net", "c#"], "go": ["go get", "golang"],
}


def looked_up(table: dict[str, str], name: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for x in chain(*table.items()))), name)


def advisory_ecosystem(ecosystem: Column) -> Column:
    return looked_up(ADVISORY_NAME, ecosystem)


def ecosystem_of_advisory(name: Column) -> Column:
    return looked_up({v: k for k, v in ADVISORY_NAME.items()}, name)


def target_software(ecosystem: Column) -> Column:
    return looked_up(TARGET_SOFTWARE, ecosystem)


def address(ecosystem: Column, name: Column, version: Column) -> Column:
    """``pkg:type/name@version``; the group and the artifact of a Java coordinate are parted by a slash."""
    path = F.when(ecosystem == "maven", F.replace(name, F.lit(":"), F.lit("/"))).when(ecosystem == "nuget", F.lower(name)).otherwise(name)
    return F.concat(F.lit("pkg:"), looked_up(ADDRESS_TYPE, ecosystem), F.lit("/"), path, F.lit("@"), version)


def _decoded(text: Column) -> Column:
    """Percent-decoded; a plus stays one, and a text that is not well encoded stays as it is."""
    return F.when(text.contains("%"), F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)).otherwise(text)


def parsed(purl: Column) -> Column:
    """struct(name, version) of a package's address; null unless both are there."""
    body = F.regexp_extract(F.regexp_extract(purl, r"^pkg:([^#?]*)", 1), r"^(.*)$", 1)
    name, version = F.regexp_extract(body, r"([^/]*)@[^@]*$", 1), F.regexp_extract(body, r"@([^@]*)$", 1)
    name, version = _decoded(name), _decoded(version)
    return F.when(purl.startswith("pkg:") & (F.trim(name) != "") & (F.trim(version) != ""), F.struct(name.alias("name"), version.alias("version")))


def speaks_for(usage: Column, ecosystem: Column) -> Column:
    """Whether a usage text names the ecosystem by one of its words, which must stand alone."""
    out = F.lit(False)
    for name, words in USAGE_WORDS.items():
        escaped = ["".join("\\" + c if c in ".#+" else c for c in w) for w in words]
        out = out | ((ecosystem == name) & F.lower(usage).rlike("(?<![a-z0-9])(?:" + "|".join(escaped) + ")(?![a-z0-9])"))
    return F.coalesce(out, F.lit(False))
