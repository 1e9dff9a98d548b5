"""Scalar text functions as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..fixed import CODE_EXTENSIONS, CODE_NAMES, LANGUAGES, READERS


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode NFKC, which Spark has no function for; texts already normal are passed on."""
    return texts.map(lambda t: t if t is None or t.isascii() or unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t))


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tidy(c: Column) -> Column:
    """Line ends to line feeds, control characters away, four or more line feeds to three, then no blanks before line feeds."""
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.regexp_replace(c, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", "")
    c = F.regexp_replace(c, "\n{4,}", "\n\n\n")
    return F.regexp_replace(c, "[ \t]+\n", "\n")


def sanitize(c: Column) -> Column:
    return tidy(nfkc(c))


def nonblank(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def stem(c: Column) -> Column:
    """A name without its last extension."""
    return F.regexp_replace(c, r"\.[^.]*$", "")


def extension(c: Column) -> Column:
    """The last extension with its dot, '' without one; leading dots of a name do not count."""
    return F.regexp_extract(basename(c), r"[^.].*?(\.[^.]*)$", 1)


def _lookup(c: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[c], F.lit(""))


def detect_language(path: Column) -> Column:
    """Language by extension, case-sensitive; '' if unknown."""
    return _lookup(extension(path), LANGUAGES)


def reader_of(path: Column) -> Column:
    """Kind of document reader by extension, in any case; '' if there is none."""
    return _lookup(F.lower(extension(path)), READERS)


def is_code_file(path: Column) -> Column:
    """Whether a path is taken as code: by extension (case-sensitive) or by exact name."""
    return extension(path).isin(*CODE_EXTENSIONS) | basename(path).isin(*CODE_NAMES)


def truncated(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)
