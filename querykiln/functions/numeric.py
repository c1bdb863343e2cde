"""Number, date and ratio expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as double; 0.0 where the denominator is zero."""
    return F.coalesce(
        F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0)
    )


def count_true(flag: Column) -> Column:
    return F.count_if(F.coalesce(flag, F.lit(False)))


def as_money(c: Column, digits: int = 2) -> Column:
    """Exact decimal rounded half-up once, at the report edge, as double."""
    return F.round(c, digits).cast("double")


def half_even(c: Column, digits: int) -> Column:
    """A share between 0 and 1 rounded to `digits` by its exact binary value; a true half goes to the even side.

    A double such as 0.0045 lies a little beside the decimal it is written as, and that little decides.
    Near a half the value is taken apart into its upper 26 binary places and the rest: both times
    2 * 10^digits are exact, and so is the sign of what they differ from the half by.
    """
    scale = 10 ** digits
    below = F.floor(c * scale)
    upper = F.floor(c * (1 << 26)) / (1 << 26)
    beyond = (upper * (2 * scale) - (2 * below + 1)) + (c - upper) * (2 * scale)
    up = (beyond > 0) | ((beyond == 0) & (below % 2 == 1))
    near = F.abs(c * scale - below - 0.5) < 1e-6
    return F.when(near, below + up.cast("int")).otherwise(F.floor(c * scale + 0.5)) / scale


def three_decimals(c: Column) -> Column:
    return F.format_string("%.3f", half_even(c, 3))


def whole_percent(c: Column) -> Column:
    """The product with 100 is a double, too, and rounded as such."""
    return F.format_string("%.0f%%", F.rint(c * 100))


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def days_before(snapshot: str, days: int) -> Column:
    """A date relative to the snapshot; never the wall clock."""
    return F.date_sub(F.lit(snapshot).cast("date"), days)


def digest_sum(hex64: Column, part: int) -> Column:
    """Exact sum over one of the eight 32-bit words of SHA-256 hex digests."""
    word = F.conv(F.substring(hex64, 8 * part + 1, 8), 16, 10)
    return F.sum(word.cast("decimal(20,0)")).cast("string")


def multiset_fingerprint(row_text: Column) -> Column:
    """Order-independent digest of all rows, as an aggregate with constant-size state.

    The row digests are added word by word and the sums hashed again; addition commutes, so
    partitions combine on the map side and nothing is sorted or collected.
    """
    hexed = F.sha2(row_text, 256)
    words = [F.coalesce(digest_sum(hexed, i), F.lit("0")) for i in range(8)]
    return F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *words), 256)
