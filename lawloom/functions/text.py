"""Column expressions on strings that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a regular-expression class; Java's ``\s`` alone is ASCII only.
BLANKS = r"[\s\u0085   -​    　﻿]"


def squeeze_out(c: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(c, BLANKS + "+", "")


def slug(c: Column) -> Column:
    """Lower case, every other character ``_``, one for one."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "_")


def act_slug(c: Column) -> Column:
    """Lower case, runs of other characters one ``_``, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_|_$", "")


def unify_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")
