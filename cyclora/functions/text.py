"""Identifiers, names and lists in text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Forms of feature identifiers, <container>_<start>_<stop>[_<gene>].
PID = r"^(.+?)_(\d+)_(\d+)$"
PID_PREFIX = r"^(.+?_\d+_\d+)(?:_.+)?$"
PID_FILE = r"^(.*)_(\d+)_(\d+)_(.*)\.fa$"


def last_field(c: Column, sep: str = "_") -> Column:
    return F.element_at(F.split(c, sep), -1)


def field_from_end(c: Column, k: int, sep: str = "_") -> Column:
    """The k-th field from the end (1 is the last); null if there are fewer."""
    return F.try_element_at(F.split(c, sep), F.lit(-k))


def without_last_fields(c: Column, k: int, sep: str = "_") -> Column:
    parts = F.split(c, sep)
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - k, F.lit(0))), sep)


def pid_parts(c: Column) -> dict[str, Column]:
    """container, start and stop of an identifier, null where it has another form."""
    hit = c.rlike(PID)
    part = lambda i: F.when(hit, F.regexp_extract(c, PID, i))
    return {"container": part(1), "start": part(2).cast("long"), "stop": part(3).cast("long")}


def pid_reduced(c: Column) -> Column:
    """The identifier without what follows its coordinates; itself if it has none."""
    return F.when(c.rlike(PID_PREFIX), F.regexp_extract(c, PID_PREFIX, 1)).otherwise(c)


def split_once(c: Column, sep_class: str) -> Column:
    """At most two fields, cut at the first of the class's characters."""
    return F.split(c, sep_class, 2)


def drop_last_dash(c: Column) -> Column:
    """Without the last dash and what follows; empty without a dash."""
    return F.when(c.contains("-"), F.regexp_replace(c, "-[^-]*$", "")).otherwise(F.when(c.isNotNull(), F.lit("")))


def strip_number_suffix(c: Column) -> Column:
    """Without a last dash field that is a number with at most one small letter; itself if nothing would be left."""
    cut = F.regexp_replace(c, r"-\d+[a-z]?$", "")
    return F.when(c.isNull(), None).when(cut == "", c).otherwise(cut)


def family(c: Column, known: dict[str, str]) -> Column:
    """A name's family: from the map, else what follows `bla` and a capital, else without a number suffix, else itself."""
    name = F.trim(c)
    mapped = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[name] if known else F.lit(None).cast("string")
    cut = F.regexp_extract(name, r"^(.+?)-\d+[a-z]?$", 1)
    good = cut.rlike(r"^[A-Za-z][A-Za-z0-9\-]*[A-Za-z]$|^[A-Za-z]+$")
    return F.coalesce(mapped, F.when(name.rlike("^bla[A-Z]"), F.substring(name, 4, 10_000_000)), F.when(good, cut), name)


def node_family(c: Column, exceptions: dict[str, str]) -> Column:
    """A hierarchy node's family: from the map, else the letters (with one dash between) after `bla`, else the node."""
    mapped = F.create_map(*[F.lit(x) for kv in exceptions.items() for x in kv])[c] if exceptions else F.lit(None).cast("string")
    after = F.regexp_extract(c, r"^bla([A-Za-z]+-[A-Za-z]+|[A-Za-z]+)", 1)
    return F.coalesce(mapped, F.when(after != "", after), c)


def without_prefix(c: Column, prefix: str, other: Column) -> Column:
    """What follows the prefix; the other column if there is no prefix or nothing after it."""
    return F.coalesce(F.nullif(F.regexp_extract(c, f"^{prefix}(.*)$", 1), F.lit("")), other)


def without_chars(c: Column, chars: str) -> Column:
    return F.translate(c, chars, "")


def joined_set(c: Column, sep: str = ";") -> Column:
    """Aggregate: the different values, sorted and joined."""
    return F.array_join(F.array_sort(F.collect_set(c)), sep)


def joined_or_empty(c: Column, sep: str = "; ") -> Column:
    return F.coalesce(F.array_join(c, sep), F.lit(""))


def lineage(ranks: list[Column], tested: int | None = None, sep: str = ";") -> Column:
    """The ranks joined; null if any of the first `tested` is missing, missing others are left out."""
    must = ranks[: tested if tested is not None else len(ranks)]
    known = must[0].isNotNull()
    for r in must[1:]:
        known = known & r.isNotNull()
    return F.when(known, F.concat_ws(sep, *ranks))


def first_token(c: Column) -> Column:
    return F.split(c, " ")[0]


def safe_file_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\w\-.]", "_")


def list_literal(c: Column, kind: str = "string") -> Column:
    """A list written with single quotes, as a real array."""
    return F.from_json(F.replace(c, F.lit("'"), F.lit('"')), f"array<{kind}>")


def tail_share(values: Column, start: Column, limit: float) -> Column:
    """The share of values from a place (from 0) on that are at most the limit; null if there are none."""
    tail = F.slice(values, start + 1, F.greatest(F.size(values) - start, F.lit(0)))
    return F.when(F.size(tail) > 0, F.size(F.filter(tail, lambda x: x <= limit)) / F.size(tail))


def any_value(m: Column, test) -> Column:
    """Whether a map's value passes the test."""
    return F.exists(F.map_values(m), test)
