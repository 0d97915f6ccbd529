"""Exact rounding and number text.

Published tables round the binary value of a double half-even, which differs from decimal
rounding of its shortest text (0.285 is stored below the tie and goes to 0.28). The value is
therefore taken apart into an exact integer mantissa and rounded in integer arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pow2(shift: Column) -> Column:
    """2^shift for 0 <= shift <= 124 as DECIMAL(38,0)."""
    one = F.lit(1).cast("bigint")
    part = lambda s: F.call_function("shiftleft", one, s.cast("int")).cast("decimal(19,0)")
    return (part(F.least(shift, F.lit(62))) * part(F.greatest(shift - 62, F.lit(0)))).cast("decimal(38,0)")


def exact_round(value: Column, digits: int) -> Column:
    """Half-even rounding of the exact binary value to ``digits`` decimals, as a double."""
    return _scaled(value, digits).cast("double") / F.lit(10.0**digits)


def _scaled(value: Column, digits: int) -> Column:
    """round(value * 10^digits) as an exact integer (bigint); NULL for NULL."""
    tiny = 2.0**-60

    def half_even(number: Column, unit: Column) -> Column:
        def carry(whole: Column) -> Column:
            rest = (number - (whole.cast("decimal(19,0)") * unit).cast("decimal(38,0)")).cast("decimal(38,0)")
            twice = (rest * 2).cast("decimal(38,0)")
            return whole + F.when(twice > unit, 1).when(twice < unit, 0).otherwise(whole % 2)

        return let(F.call_function("div", number, unit), carry)

    def of_size(size: Column) -> Column:
        def shifted(shift: Column) -> Column:
            mantissa = (size * F.pow(F.lit(2.0), shift)).cast("bigint").cast("decimal(19,0)")
            number = (mantissa * F.lit(10**digits).cast(f"decimal({digits + 1},0)")).cast("decimal(38,0)")
            return let(F.struct(number.alias("n"), _pow2(shift).alias("u")), lambda x: half_even(x["n"], x["u"]))

        return F.when(size < tiny, F.lit(0).cast("bigint")).otherwise(
            let((F.lit(60) - F.floor(F.log2(F.greatest(size, F.lit(tiny))))).cast("int"), shifted)
        )

    return let(
        value.cast("double"),
        lambda v: F.when(v.isNotNull(), let(F.abs(v), of_size) * F.when(v < 0, -1).otherwise(1)),
    )


def fixed_digits(value: Column, digits: int = 4, empty: str = "", plus: bool = False) -> Column:
    """Text with a fixed number of decimals; ``empty`` for NULL, a leading plus on request."""
    def text(n: Column) -> Column:
        plain = F.abs(n).cast("string")
        size = F.when(F.length(plain) > digits, plain).otherwise(F.lpad(plain, digits + 1, "0"))
        if digits == 0:
            return size
        return let(size, lambda s: F.concat(F.substr(s, F.lit(1), F.length(s) - digits), F.lit("."), F.right(s, F.lit(digits))))

    sign = F.when(value < 0, "-").otherwise("+" if plus else "")
    return F.when(value.isNull(), F.lit(empty)).otherwise(F.concat(sign, let(_scaled(value, digits), text)))
