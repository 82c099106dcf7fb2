"""Pieces of DuckDB SQL that the queries' oracles share."""


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def canonical(c: str) -> str:
    return rf"lower(regexp_replace({strip(c)}, '\s+', ' ', 'g'))"


def md5_unit(c: str) -> str:
    return f"(CAST('0x' || substr(md5({c}), 1, 13) AS BIGINT) / {float(16**13)!r})"


def md5_long(c: str) -> str:
    return f"CAST('0x' || substr(md5({c}), 1, 15) AS BIGINT)"


def half_even(c: str) -> str:
    return f"round_even({c}, 0)"


def words(c: str) -> str:
    """Number of words of a text."""
    return f"CASE WHEN {strip(c)} = '' THEN 0 ELSE len(string_split_regex({strip(c)}, '\\s+')) END"


STRICT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
