"""Column functions on text and numbers, with one defined meaning for Unicode."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"
_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
CLOSERS = list(".!?\"')]")
#: The characters of SPACE under (?U).
WHITE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x evaluated once a row however often f uses it, within lambdas too."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row, however often they are used.

    A generator is a bound that the optimizer moves no expression across; in
    projections it would copy them into each place that uses them.
    """
    (name, one), *more = columns.items()
    if more:
        return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
    return df.select("*", F.explode(F.array(one)).alias(name))


def split_lines(text: Column) -> Column:
    """Lines of a text, at any Unicode line end; a line end at the very end adds none.

    Texts with line feeds alone, by far the most, are split at that character, without a regular expression.
    """
    other = text.rlike(r"[\r\x0b\x0c\x1c\x1d\x1e\x{85}]") | text.contains("\u2028") | text.contains("\u2029")
    return let(F.when(other, F.split(text, _LINE_END, -1)).otherwise(F.split(text, "\n", -1)), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def strip(text: Column) -> Column:
    """Without white space, in the sense of Unicode, at either end; only the ends are looked at."""
    return F.btrim(text, F.lit(WHITE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITE))


def is_blank(text: Column) -> Column:
    return ~text.rlike(rf"(?U)[^\s\x1c-\x1f]")


def ends_clean(text: Column) -> Column:
    """Whether the last character that isn't white space closes a sentence."""
    return F.coalesce(text.rlike(rf"(?U)[.!?\"')\]]{SPACE}*+\z"), F.lit(False))


def columns_of(line: Column) -> Column:
    """Parts of a line between runs of two spaces or more."""
    return F.filter(F.split(strip(line), " {2,}"), lambda p: p != "")


def is_wide(line: Column) -> Column:
    """Whether a line has two columns or more."""
    return F.when(line.contains("  "), F.size(columns_of(line)) >= 2).otherwise(False)


def clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def round_to(x: Column, digits: int) -> Column:
    """The multiple of 10**-digits nearest to the exact value of a small double.

    Spark's round() rounds the shortest decimal that reads as x. Here the error
    of x * 10**digits is recovered by splitting x, so halves are real halves;
    they go to the even neighbour.
    """
    scale = float(10**digits)

    def rounded(x: Column) -> Column:
        p = x * F.lit(scale)
        c = x * F.lit(134217729.0)
        hi = c - (c - x)
        error = (hi * F.lit(scale) - p) + (x - hi) * F.lit(scale)
        low = F.floor(p).cast("double")
        over = ((p - low) - F.lit(0.5)) + error
        up = low + F.lit(1.0)
        whole = F.when(over > 0, up).when(over < 0, low).when(low % 2 == 0, low).otherwise(up)
        return whole / F.lit(scale)

    return let(x, rounded)


def round3(x: Column) -> Column:
    return round_to(x, 3)


def fixed(x: Column, digits: int) -> Column:
    """x with so many decimals, as text, rounded like round_to()."""
    return F.format_string(f"%.{digits}f", round_to(x, digits))


def compact(*reasons: Column) -> Column:
    """An array of the reasons that aren't null, in order."""
    return F.filter(F.array(*reasons), lambda r: r.isNotNull())


def minus(condition: Column, amount: Column | float) -> Column:
    """What a score loses under a condition, as a term to add."""
    return F.when(condition, -(amount if isinstance(amount, Column) else F.lit(amount))).otherwise(F.lit(0.0))
