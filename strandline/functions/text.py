"""Column expressions on strings: canonical forms, bracket grammar, numbers in text, hashes."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbers import is_finite

#: Patterns of the bracket grammar and of numbers.
STAR_GROUP = r"\[\d*\*(?::\d+)?\]"
ANY_GROUP = r"\[[^\]]*\]"
FULL_GROUP = r"\[[^\]]+\]"
STRICT_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
LOOSE_NUMBER = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"


def strip(c: Column) -> Column:
    """All white space off both ends, not only spaces."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def canonical(c: Column) -> Column:
    """The default canonical form of a text: stripped, white space collapsed, lower case."""
    return F.lower(F.regexp_replace(strip(c), r"\s+", " "))


def n_words(canon: Column) -> Column:
    """Words of a canonical text, in which one space stands between two."""
    return F.when(canon == "", 0).otherwise(F.length(canon) - F.length(F.replace(canon, F.lit(" "), F.lit(""))) + 1)


def content_key(canon: Column) -> Column:
    """What stands for a canonical text in joins and groups: 32 bytes instead of the text."""
    return F.unhex(F.sha2(canon, 256))


def star_to_at(c: Column) -> Column:
    """Every marked end, bracketed or bare, as [At]; null as empty."""
    return F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), STAR_GROUP, "[At]"), F.lit("*"), F.lit("[At]"))


def at_to_star(c: Column) -> Column:
    return F.replace(F.coalesce(c, F.lit("")), F.lit("[At]"), F.lit("[*]"))


def split_tokens(c: Column) -> Column:
    """Bracket groups in order; what stands outside is discarded."""
    return F.regexp_extract_all(c, F.lit(ANY_GROUP), F.lit(0))


def count_tokens(c: Column) -> Column:
    """Number of groups that are not empty."""
    return F.size(F.regexp_extract_all(c, F.lit(FULL_GROUP), F.lit(0))).cast("long")


def is_pure_run(c: Column) -> Column:
    """One or more bracket groups and nothing else."""
    return strip(c).rlike(r"^(\[[^\[\]]+\])+$")


def is_pure_run_of_two(c: Column) -> Column:
    """As ``is_pure_run`` with two groups at least, and no blank or star."""
    s = strip(c)
    return s.rlike(r"^(\[[^\[\]]+\]){2,}$") & ~s.rlike(r"[\s*]")


def is_balanced_run(c: Column) -> Column:
    """Groups, empty ones allowed, with no character outside."""
    return strip(c).rlike(r"^(\[[^\[\]]*\])+$")


def structure_kind(c: Column) -> Column:
    """pselfies for a run of two groups or more, psmiles with an end marker, else null."""
    s = strip(c)
    run = s.rlike(r"^(\[[^\[\]\s]*\]){2,}$")
    return F.when(s == "", None).when(run, F.lit("pselfies")).when(s.contains("*") | s.contains("[At]"), F.lit("psmiles"))


def parse_strict(c: Column) -> Column:
    """A plain finite number or null; words that casts accept (nan, inf, 1d) are no numbers."""
    s = strip(c)
    value = F.when(s.rlike(STRICT_NUMBER), s.try_cast("double"))
    return F.when(is_finite(value), value)


def parse_permissive(c: Column) -> Column:
    """As a general-purpose language reads a float: also with underscores between digits; finite."""
    s = strip(c)
    value = F.when(s.rlike(LOOSE_NUMBER), F.replace(s, F.lit("_"), F.lit("")).try_cast("double"))
    return F.when(is_finite(value), value)


@F.pandas_udf(T.StringType())
def format_property(v: pd.Series) -> pd.Series:
    """One decimal, rounding the binary value half to even, which no built-in function does."""
    return v.map(lambda x: None if pd.isna(x) else f"{x:.1f}")


@F.pandas_udf(T.LongType())
def blake64(v: pd.Series) -> pd.Series:
    """BLAKE2b of eight bytes, big-endian, as a signed long (for equality)."""
    return v.map(lambda s: int.from_bytes(hashlib.blake2b(("" if s is None else s).encode(), digest_size=8).digest(), "big", signed=True))


def md5_long(c: Column) -> Column:
    """The first fifteen hex digits of the MD5 as a long: a hash that SQL engines share."""
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("long")


def md5_unit(c: Column) -> Column:
    """A number in [0, 1) from the MD5 of a string."""
    return F.conv(F.substring(F.md5(c), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def clean_path(c: Column) -> Column:
    return F.lower(F.replace(c, F.lit("\\"), F.lit("/")))


def seed_of_run(c: Column) -> Column:
    """The seed in a run's name: 0 without a suffix, null for a malformed one (leading zeros)."""
    suffix = F.regexp_extract(c, r"_seed(.*)$", 1)
    good = F.regexp_extract(c, r"_seed(0|-?[1-9]\d*)$", 1)
    return F.when(~c.contains("_seed"), F.lit(0).cast("long")).when(good != "", good.cast("long")).when(suffix != "", None)


def eta(seconds: Column) -> Column:
    """HH:MM:SS, dashes if unknown."""
    s = F.floor(seconds).cast("long")
    known = is_finite(seconds) & (seconds >= 0)
    return F.when(known, F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)).otherwise("--:--:--")


def duration(seconds: Column) -> Column:
    """s up to 90, m up to 90 minutes, h up to two days, d beyond; ? if unknown or negative."""
    f = F.format_string
    return (
        F.when(seconds.isNull() | (seconds < 0), F.lit("?"))
        .when(seconds < 90, f("%ds", F.bround(seconds, 0).cast("long")))
        .when(seconds < 5400, f("%dm", F.bround(seconds / 60, 0).cast("long")))
        .when(seconds < 172800, f("%.1fh", seconds / 3600))
        .otherwise(f("%.1fd", seconds / 86400))
    )


def bytes_text(n: Column) -> Column:
    f = F.format_string
    return F.when(n >= 1e9, f("%.2f GB", n / 1e9)).when(n >= 1e6, f("%.2f MB", n / 1e6)).when(n >= 1e3, f("%.2f KB", n / 1e3)).otherwise(f("%d B", n.cast("long")))
