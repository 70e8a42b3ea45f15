"""Tokens, sentences, names and labels."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegralType


def quoted(name: str) -> Column:
    """A column by its exact name, also with blanks or dots in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def token(name: str, value: Column | None = None) -> Column:
    """`name_value`; a null value gives the bare name, which no vocabulary holds."""
    value = quoted(name) if value is None else value
    return F.concat_ws("_", F.lit(name), value.cast("string"))


def whole_columns(df: DataFrame) -> set[str]:
    """Names of the whole-number columns."""
    return {f.name for f in df.schema if isinstance(f.dataType, IntegralType)}


def choose(name: str, by_text: dict[str, int | float], otherwise: Column, whole: bool = False) -> Column:
    """The entry for a column's value as text. For `whole` columns the texts are compared as numbers."""
    if whole:
        # A text beyond 64 bits is no value of a whole column.
        numbers = {int(t): v for t, v in by_text.items() if re.fullmatch(r"0|-?[1-9][0-9]{0,18}", t)}
        by_value = {n: v for n, v in numbers.items() if -(2**63) <= n < 2**63}
    else:
        by_value = by_text
    if not by_value:
        return otherwise
    value = quoted(name) if whole else quoted(name).cast("string")
    chosen = F
    for text, entry in by_value.items():
        chosen = chosen.when(value == F.lit(text), F.lit(entry))
    return chosen.otherwise(otherwise)


def sentence(names: list[str]) -> Column:
    """The tokens of a row, joined by blanks."""
    return F.concat_ws(" ", *[token(n) for n in names])


def printed_sentence(text: Column) -> Column:
    """Sentence of a row printed as `name  value` lines: `_` inside a line, a blank between lines."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.trim(line) != "")
    return F.array_join(F.transform(lines, lambda line: F.regexp_replace(F.trim(line), r"\s+", "_")), " ")


def mask_text(text: Column, option: Column, mask: str = "[MASK]") -> Column:
    """Replace every occurrence of `option`, also inside longer tokens."""
    return F.replace(text, option, F.lit(mask))


def comma_items(text: Column) -> Column:
    """Lower-cased, stripped, distinct, non-empty items of a comma list, in first-seen order."""
    items = F.transform(F.split(F.lower(text), ","), lambda item: F.trim(item))
    return F.array_distinct(F.filter(items, lambda item: item != ""))


def comma_text(text: Column) -> Column:
    return F.array_join(comma_items(text), ", ")


def policy_key(name: Column) -> Column:
    """Normal form of a policy name: lower case, blank to `_`, slash to `-`."""
    return F.translate(F.lower(name), " /", "_-")


def escape_label(text: Column) -> Column:
    """Put a backslash before backslash, pipe and braces."""
    return F.regexp_replace(text, r"([\\|{}])", r"\\$1")


def angle_words(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<"), F.lit("LT")), F.lit(">"), F.lit("GT"))


def sign_colour(x: Column) -> Column:
    return F.when(x < 0, "red").when(x > 0, "green").otherwise("white")


# Patterns that mark a rule as using custom attributes.
CUSTOM_PATTERNS = ("local_attrib", "custom_match", "cc_bin_number[^_]", "cc_bin_number$")
CONDITION_PATTERNS = ("condition_attrib", *CUSTOM_PATTERNS)


def any_matches(params: Column, patterns: tuple[str, ...] = CUSTOM_PATTERNS) -> Column:
    """True if any element matches any pattern."""
    either = "|".join(f"(?:{p})" for p in patterns)
    return F.coalesce(F.exists(params, lambda p: p.rlike(either)), F.lit(False))


def parse_time(text: Column) -> Column:
    """`yyyy-MM-dd HH:mm:ss.f`; the fraction is required, one to six digits. Bad text is an error."""
    return F.to_timestamp_ntz(text, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS"))
