"""Column expressions on text: cleaning, words, lines, truncation. Lengths count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritext.functions import patterns as P


def strip(text: Column) -> Column:
    """Without white space at both ends, Unicode and control separators included."""
    return F.regexp_replace(text, P.EDGES, "")


def strip_invisible(text: Column) -> Column:
    """H2: fillers that take up width become a space, other invisible characters go."""
    spaced = F.regexp_replace(text, f"[{P.SPACE_LIKE}]", " ")
    gone = F.regexp_replace(spaced, f"[{P.ZERO_WIDTH}{P.BIDI}{P.TAG}]", "")
    return F.when(text.rlike(P.INVISIBLE), gone).otherwise(text)


def without_controls(text: Column) -> Column:
    """H4: C0 and C1 controls become spaces."""
    return F.regexp_replace(text, P.CONTROLS, " ")


def clean_field(text: Column, most: int) -> Column:
    """H1: one line without invisible characters, at most `most` characters, or null."""
    return F.nullif(F.left(strip(without_controls(strip_invisible(text))), F.lit(most)), F.lit(""))


def as_text(value: Column) -> Column:
    """B2: null counts as empty."""
    return F.coalesce(value.try_cast("string"), F.lit(""))


def category(char: Column) -> Column:
    """H3: the class of one character, or null."""
    return (
        F.when(char.rlike(f"^[{P.TAG}]$"), "tag").when(char.rlike(f"^[{P.ZERO_WIDTH}{P.SPACE_LIKE}]$"), "zero_width").when(char.rlike(f"^[{P.BIDI}]$"), "bidi")
    )


def code_label(char: Column, count: Column) -> Column:
    """H5: U+XXXX xN."""
    return F.format_string("U+%04X x%d", F.ascii(char), count)


def tokens(text: Column) -> Column:
    """H7: runs of a-z and 0-9 in the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def word_count(text: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(text, F.lit(r"(?U)[^\s\x1C-\x1F]+")).cast("bigint")


def lines(text: Column) -> Column:
    """Lines with their ends; an empty text has none."""
    parts = F.split(text, P.LINE_ENDS)
    return F.filter(parts, lambda x: x != "")


def truncated(text: Column, tokens_: int) -> Column:
    """The head up to the last paragraph break within the budget, and a marker."""
    limit = tokens_ * P.CHARS_PER_TOKEN
    head = F.left(text, F.lit(limit))
    back = F.instr(F.reverse(head), "\n\n")
    at = F.length(head) - back - 1
    cut = F.when((back > 0) & (at > 0), F.substring(head, F.lit(1), at)).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(cut, P.TAIL, ""), F.lit(P.MARKER)))


def is_truncated(text: Column, tokens_: int) -> Column:
    return F.length(text) > tokens_ * P.CHARS_PER_TOKEN


def token_budget(requested: Column, default: int = P.DEFAULT_TOKENS) -> Column:
    """Null and non-positive budgets become the default."""
    return F.when(requested > 0, requested).otherwise(F.lit(default))


def finite_score(value: Column) -> Column:
    """A finite double or 0."""
    number = value.try_cast("double")
    return F.when(number.between(F.expr("-1.7976931348623157e308D"), F.expr("1.7976931348623157e308D")), number).otherwise(F.lit(0.0))


def plausible_author(value: Column) -> Column:
    """At most 80 characters and 8 words once white space is single, or null."""
    one = strip(F.regexp_replace(value, r"(?U)[\s\x1C-\x1F]+", " "))
    return F.when((one != "") & (F.length(one) <= 80) & (F.size(F.split(one, " ")) <= 8), one)


def clamp(value: Column, low: int, high: int) -> Column:
    """B22."""
    return F.greatest(F.lit(low), F.least(value, F.lit(high)))


def escape_html(value: Column) -> Column:
    """Characters that are active in HTML as references."""
    for char, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "#39")):
        value = F.replace(value, F.lit(char), F.lit(f"&{name};"))
    return F.regexp_replace(value, r"[\r\n]+", " ")


def escape_markdown(value: Column) -> Column:
    """Characters that are active in reports are escaped."""
    return F.regexp_replace(F.regexp_replace(value, r"([\\|`*_\[\]<>])", r"\\$1"), r"[\r\n]+", " ")
