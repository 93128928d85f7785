"""Natural keys: ``eco:name``, ``eco:name:version``, ``eco:user``, ``svc:name``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ecosystems and what "unknown" looks like in raw inputs.
ECOSYSTEMS = ("npm", "pypi")
UNKNOWN_NUMBER = -1
UNKNOWN_TEXT = ""
#: Text that may be stored as a literal, and its greatest length.
SAFE_TEXT = r"^[A-Za-z0-9._~+@/:-]+$"
MAX_SAFE_TEXT = 512


def package_key(ecosystem: Column, name: Column) -> Column:
    return F.concat_ws(":", ecosystem, name)


def version_key(ecosystem: Column, name: Column, version: Column) -> Column:
    return F.concat_ws(":", ecosystem, name, version)


def maintainer_key(ecosystem: Column, username: Column) -> Column:
    return F.concat_ws(":", ecosystem, username)


def service_key(name: Column) -> Column:
    return F.concat(F.lit("svc:"), name)


def label_key(label: Column, key: Column) -> Column:
    """Identity of a node across labels."""
    return F.concat_ws("|", label, key)


def _parts(text: Column, pattern: str, *names: str) -> Column:
    """A struct of the pattern's groups, or null where it doesn't match."""
    fields = [F.regexp_extract(text, pattern, i + 1).alias(n) for i, n in enumerate(names)]
    return F.when(text.rlike(pattern), F.struct(*fields))


def parse_version_key(key: Column) -> Column:
    """(ecosystem, name, version): cut at the first and the last colon."""
    return _parts(key, r"^(npm|pypi):(.+):([^:]+)$", "ecosystem", "name", "version")


def parse_package_key(key: Column) -> Column:
    """(ecosystem, name): cut at the first colon."""
    return _parts(key, r"^(npm|pypi):(.+)$", "ecosystem", "name")


def parse_package_spec(spec: Column) -> Column:
    """(name, version): cut at the last ``@`` that doesn't open a scope."""
    return _parts(spec, r"^(.+)@([^@]+)$", "name", "version")


def version_name(key: Column) -> Column:
    """``name@version`` of a version key; any other key as it is."""
    p = parse_version_key(key)
    return F.when(p.isNotNull(), F.concat_ws("@", p["name"], p["version"])).otherwise(key)


def package_of_version(key: Column) -> Column:
    """The package key of a version key."""
    p = parse_version_key(key)
    return F.when(p.isNotNull(), package_key(p["ecosystem"], p["name"]))


def known_number(x: Column) -> Column:
    """Null where a raw number is unknown."""
    return F.when(x != UNKNOWN_NUMBER, x)


def known_text(x: Column) -> Column:
    """Null where a raw text is unknown."""
    return F.when(x != UNKNOWN_TEXT, x)


def raw_number(x: Column) -> Column:
    return F.coalesce(x, F.lit(UNKNOWN_NUMBER))


def raw_text(x: Column) -> Column:
    return F.coalesce(x, F.lit(UNKNOWN_TEXT))


def is_selectable(text: Column) -> Column:
    """Whether a key can be used to look a node up."""
    return text.isNotNull() & text.rlike(SAFE_TEXT) & (F.length(text) <= MAX_SAFE_TEXT)


def placed_instant(ms: Column) -> Column:
    """An instant after the epoch, or null: what a time window can use."""
    return F.when(ms > 0, ms)


def readable_instant(ms: Column) -> Column:
    """An instant at or after the epoch, or null: what an ordering can use."""
    return F.when(ms >= 0, ms)


def instant_ms(text: Column) -> Column:
    """Epoch milliseconds of an ISO timestamp, or null."""
    return F.unix_millis(F.try_to_timestamp(text))


def ghsa_id(own: Column, aliases: Column) -> Column:
    """The GHSA id of a vulnerability record: its own, else the first alias
    of that kind, else its own id whatever it is.
    """
    return F.when(own.startswith("GHSA-"), own).otherwise(F.coalesce(F.try_element_at(F.filter(aliases, lambda a: a.startswith("GHSA-")), F.lit(1)), own))


def ecosystem_of(name: Column) -> Column:
    """The ecosystem of a registry's name as public databases spell it."""
    lowered = F.lower(name)
    return F.when(lowered == "npm", F.lit("npm")).when(lowered == "pypi", F.lit("pypi"))
