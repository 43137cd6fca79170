"""Security-code normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import as_col, with_value

# First digit of a six-digit code -> exchange.
EXCHANGE_BY_FIRST_DIGIT = {"6": "SH", "0": "SZ", "3": "SZ", "4": "BJ", "8": "BJ"}


def _fit(digits: Column, length: int) -> Column:
    """Left-pad with zeros to ``length``, then keep the last ``length`` digits."""
    # lpad truncates longer input on the right, hence the greatest().
    padded = F.lpad(digits, F.greatest(F.lit(length), F.length(digits)), F.lit("0"))
    return F.right(padded, F.lit(length))


def exchange_of(code: Column, other: Column) -> Column:
    first = F.substring(code, 1, 1)
    out = None
    for digit, exch in EXCHANGE_BY_FIRST_DIGIT.items():
        out = F.when(first == digit, exch) if out is None else out.when(first == digit, exch)
    return out.otherwise(other)


def _attach(digits: Column, exchange: str | None, position: str, sep: str) -> Column:
    exch = F.lit(exchange) if exchange else exchange_of(digits, F.lit("UNKNOWN"))
    exch = F.when(digits.isNotNull(), exch)
    parts = (digits, F.lit(sep), exch) if position == "suffix" else (exch, F.lit(sep), digits)
    return F.concat(*parts)


def normalize_ts_code(
    code: str | Column,
    *,
    length: int = 6,
    add_exchange: bool = False,
    exchange: str | None = None,
    position: str = "suffix",
    sep: str = ".",
    case: str = "upper",
) -> Column:
    """First run of digits as a fixed-length code, optionally with its exchange; null without digits."""
    found = F.regexp_extract(as_col(code), r"(\d+)", 1)
    digits = with_value(found, lambda d: _fit(F.nullif(d, F.lit("")), length))
    if not add_exchange:
        return digits

    def attached(digits: Column) -> Column:
        exch = F.lit(exchange) if exchange else exchange_of(digits, F.lit("UNKNOWN"))
        exch = F.upper(exch) if case == "upper" else F.lower(exch)
        return F.concat(*((digits, F.lit(sep), exch) if position == "suffix" else (exch, F.lit(sep), digits)))

    return with_value(digits, attached)


def normalize_ts_code_all_digits(
    code: str | Column,
    *,
    length: int = 6,
    add_exchange: bool = False,
    exchange: str | None = None,
    position: str = "suffix",
    sep: str = ".",
    strict: bool = False,
) -> Column:
    """All digits of the string joined together; without digits null, or an error when ``strict``.

    The exchange is always written as given or in upper case: this variant has no effective case switch.
    """
    code = as_col(code)

    def fitted(found: Column) -> Column:
        digits = F.nullif(found, F.lit(""))
        if strict:
            digits = F.when(
                code.isNotNull() & digits.isNull(), F.raise_error(F.concat(F.lit("no digits in code: "), code))
            ).otherwise(digits)
        return _fit(digits, length)

    digits = with_value(F.regexp_replace(code, r"\D", ""), fitted)
    return with_value(digits, lambda d: _attach(d, exchange, position, sep)) if add_exchange else digits


def _reject(code: Column, strict: bool, why: str) -> Column:
    if strict:
        return F.raise_error(F.concat(F.lit(f"{why}: "), code)).cast("string")
    return F.lit(None).cast("string")


def suffix_ts_code(code: str | Column, *, strict: bool = False) -> Column:
    """Add ``.SH/.SZ/.BJ``; a dotted code only gets upper-cased, an unknown first digit stays bare.

    Anything else is an error when ``strict``, otherwise null.
    """
    code = as_col(code)
    exch = exchange_of(code, F.lit(None).cast("string"))
    return (
        F.when(code.rlike(r"^[^.]{6}\."), F.upper(code))
        .when(~code.rlike(r"^\d{6}$"), _reject(code, strict, "invalid code format"))
        .otherwise(F.coalesce(F.concat(code, F.lit("."), exch), code))
    )


def strip_ts_code(code: str | Column, *, strict: bool = False) -> Column:
    """Drop the exchange suffix; bare six-digit codes pass through, other shapes null or an error."""
    code = as_col(code)
    return (
        F.when(code.rlike(r"^\d{6}$"), code)
        .when(code.rlike(r"^\d{6}\.[^.]*$"), F.substring(code, 1, 6))
        .otherwise(F.when(code.isNotNull(), _reject(code, strict, "invalid ts_code format")))
    )


def not_special_treatment(name: str | Column) -> Column:
    """True for names without the ST / *ST marker; null names give null, so a filter drops them."""
    return ~as_col(name).rlike(r"(?i)ST|\*ST")
