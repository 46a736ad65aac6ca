"""Names of tables and codebases."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


# The form of a table's name, the substitutions of names, in their order, and the marks between words.
def table_name(name: Column, version: str = "1.0.0") -> Column:
    return F.concat(F.lit("codebase_"), F.regexp_replace(name, "[^a-zA-Z0-9_-]", "_"), F.lit("_" + version.replace(".", "_")))


def table_of(name: str, version: str = "1.0.0") -> str:
    """table_name() for one name on the driver."""
    return f"codebase_{re.sub('[^a-zA-Z0-9_-]', '_', name)}_{version.replace('.', '_')}"


def recovered_name(table: Column) -> Column:
    """Name in a table's name, '' for other tables. Lossy: every '_' comes back as '-'."""
    return F.translate(F.regexp_extract(table, r"^codebase_(.+)_\d+_\d+_\d+$", 1), "_", "-")


def normalised(name: Column) -> Column:
    """Lower case, white space as single hyphens, nothing but [a-z0-9_-]; '' if nothing is left."""
    out = F.regexp_replace(F.lower(name), r"^\s+|\s+$", "")
    for pattern, by in ((r"\s+", "-"), ("[^a-z0-9_-]", ""), ("-+", "-"), ("^-|-$", "")):
        out = F.regexp_replace(out, pattern, by)
    return out


def normalise(name: str) -> str:
    """normalised() for one name on the driver; a name of which nothing is left is an error."""
    out = re.sub("-+", "-", re.sub("[^a-z0-9_-]", "", re.sub(r"\s+", "-", name.lower().strip())))
    out = re.sub("^-|-$", "", out)
    if not out:
        raise ValueError(f"no usable character in the name {name!r}")
    return out


def display_name(name: Column, marks: str = "[-_]") -> Column:
    """Words parted by the marks, first letters raised, the rest of each word as it is."""
    words = F.split(F.regexp_replace(name, marks, " "), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")
