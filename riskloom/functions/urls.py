"""Hosts and paths of addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions.packages import INSTALL_HOST
from riskloom.functions.text import unicode_trim


def with_scheme(url: Column) -> Column:
    stripped = unicode_trim(url)
    return F.when(stripped.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), stripped).otherwise(F.concat(F.lit("https://"), stripped))


def host(url: Column) -> Column:
    """The host in lower case; null where the address has none or is not well formed."""
    return F.lower(F.nullif(F.try_parse_url(with_scheme(url), F.lit("HOST")), F.lit("")))


def path(url: Column) -> Column:
    return F.try_parse_url(with_scheme(url), F.lit("PATH"))


def is_or_below(name: Column, suffix: str) -> Column:
    """Whether a host is ``suffix`` or ends with it as whole labels."""
    return (name == suffix) | name.endswith("." + suffix)


def declared_target(url: Column) -> Column:
    """The software that an extension installed from this address is for; null where the host tells nothing."""
    name, out = host(url), None
    for suffix, target in INSTALL_HOST.items():
        out = F.when(is_or_below(name, suffix), target) if out is None else out.when(is_or_below(name, suffix), target)
    store = path(url)
    return out.when(is_or_below(name, "chrome.google.com") & ((store == "/webstore") | store.startswith("/webstore/")), "chrome")


def safe(url: Column) -> Column:
    """The address if it is of http or https and has no spaces inside, else null."""
    return F.when(F.trim(url).rlike(r"^(?i:https?):\S+$"), url)
