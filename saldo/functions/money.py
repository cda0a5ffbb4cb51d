"""Integer-cent arithmetic as column expressions. Only amounts that arrive as doubles pass through one, once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"
SAFE_CENTS = 2**53 - 1
#: Characters of a printed amount whose digits are surely within ``SAFE_CENTS``.
PLAIN = 15


def from_major(amount: Column) -> Column:
    """Major units (double) to cents, half rounded up."""
    return F.floor(amount * 100 + F.lit(0.5)).cast("bigint")


def round_half_up(x: Column) -> Column:
    """Nearest integer with halves towards plus infinity."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def scale(value: Column, num: Column | int, den: Column | int, rounding: str = "TRUNCATE") -> Column:
    """``value * num / den`` exactly, rounded on the magnitude; the sign is put back afterwards."""
    num = F.lit(num) if isinstance(num, int) else num
    den = F.lit(den) if isinstance(den, int) else den
    product = F.abs(value.cast(WIDE)) * F.abs(num.cast("decimal(10,0)"))
    divisor = F.abs(den.cast("decimal(10,0)"))
    rest = product % divisor
    whole = ((product - rest) / divisor).cast(WIDE)
    if rounding == "TRUNCATE":
        bump = F.lit(0)
    elif rounding == "HALF_UP":
        bump = F.when(rest * 2 >= divisor, 1).otherwise(0)
    elif rounding == "HALF_EVEN":
        bump = (
            F.when(rest * 2 > divisor, 1)
            .when(rest * 2 < divisor, 0)
            .otherwise((whole % 2).cast("int"))
        )
    else:
        raise ValueError(f"unknown rounding {rounding}")
    sign = F.signum(value.cast("double")) * F.signum(num.cast("double")) * F.signum(den.cast("double"))
    magnitude = (whole + bump.cast(WIDE)).cast("bigint")
    return F.when(sign < 0, -magnitude).otherwise(magnitude)


# Fixed values: (thousands mark, decimal mark) of the two number formats.
STATEMENT_FORMAT = (",", ".")
SPANISH_FORMAT = (".", ",")


def parse_amount(text: Column, marks: tuple[str, str] = STATEMENT_FORMAT) -> Column:
    """Decimal text to ``struct(cents, error)``; exactly one of the two is null.

    Accepts a leading or trailing minus (ASCII or typographic), brackets for negatives, a plus, a
    currency sign and blanks. The digits go to an exact decimal.
    """
    thousands, decimal = marks

    def unwrapped(trimmed: Column) -> Column:
        bracketed = trimmed.startswith("(") & trimmed.endswith(")")
        inner = F.when(bracketed, F.trim(F.regexp_replace(trimmed, r"^\(|\)$", ""))).otherwise(trimmed)
        return F.struct(inner.alias("text"), bracketed.alias("bracketed"))

    def unsigned(part: Column) -> Column:
        minus = part["text"].rlike("^[-−]|-$")
        # one minus goes: the leading one, else the trailing one
        body = F.regexp_replace(part["text"], r"^[-−]\s*\+?|^(?=[^-−].*-$)\+?|^\+", "")
        body = F.when(part["text"].rlike("^[^-−].*-$"), F.regexp_replace(body, "-$", "")).otherwise(body)
        plain = F.regexp_replace(F.regexp_replace(body, r"^\s*\$", ""), r"\s", "")
        parts = F.split(F.replace(plain, F.lit(thousands), F.lit("")), f"[{decimal}]", -1)
        return F.struct(parts.alias("parts"), (part["bracketed"] != minus).alias("negative"))

    def checked(part: Column) -> Column:
        whole, fraction = F.get(part["parts"], F.lit(0)), F.coalesce(F.get(part["parts"], F.lit(1)), F.lit(""))
        error = (
            F.when(F.size(part["parts"]) > 2, "MANY_DECIMAL_MARKS")
            .when(~whole.rlike(r"^\d+$") | ~fraction.rlike(r"^\d*$"), "NON_NUMERIC")
            .when(F.length(fraction) > 2, "MANY_DECIMALS")
        )
        digits = F.concat(whole, F.rpad(fraction, 2, "0"))
        return F.struct(error.alias("error"), digits.alias("digits"), part["negative"].alias("negative"))

    def valued(part: Column) -> Column:
        # try_cast turns digits beyond the widest decimal into null instead of failing the job
        cents = F.when(part["error"].isNull(), part["digits"].try_cast(WIDE))
        fits = F.coalesce(cents <= F.lit(SAFE_CENTS).cast(WIDE), F.lit(False))
        error = F.coalesce(part["error"], F.when(~fits, "TOO_LARGE"))
        signed = F.when(part["negative"], -cents).otherwise(cents)
        return F.struct(F.when(error.isNull(), signed).cast("bigint").alias("cents"), error.alias("error"))

    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    parsed = let(let(let(let(trimmed, unwrapped), unsigned), checked), valued)
    empty = F.struct(F.lit(None).cast("bigint").alias("cents"), F.lit("EMPTY").alias("error"))
    careful = F.when(F.coalesce(trimmed, F.lit("")) == "", empty).otherwise(parsed)
    # nearly every amount is printed plainly: its digits are its cents
    plainly = rf"^(?:-\d[\d{thousands}]*[{decimal}]\d\d|\d[\d{thousands}]*[{decimal}]\d\d-?)\z"
    digits = F.translate(text, f"{thousands}{decimal}-", "").try_cast("bigint")
    plain = F.struct(F.when(F.contains(text, F.lit("-")), -digits).otherwise(digits).alias("cents"), F.lit(None).cast("string").alias("error"))
    return F.when((F.length(text) <= PLAIN) & text.rlike(plainly), plain).otherwise(careful)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, for steps that use it several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def format_money(cents: Column) -> Column:
    """``-$1.234,56``: points between thousands, comma before the cents."""
    digits = F.abs(cents).cast("string")
    digits = F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits)
    major = digits.substr(F.lit(1), F.length(digits) - 2)
    grouped = F.regexp_replace(major, r"\B(?=(\d{3})+(?!\d))", ".")
    return F.concat(
        F.when(cents < 0, "-").otherwise(""), F.lit("$"), grouped, F.lit(","), F.right(digits, F.lit(2))
    )


def percent(rate: Column) -> Column:
    """Two decimals with a comma, as rates are shown."""
    return F.concat(F.replace(F.format_string("%.2f", rate * 100), F.lit("."), F.lit(",")), F.lit("%"))


def money_text(cents: Column) -> Column:
    """The text evidence carries for an amount: already formatted, so nothing rewrites it later."""
    return format_money(cents)


def is_safe(cents: Column) -> Column:
    """Whether an amount is inside the range the wire format can carry exactly."""
    return F.abs(cents) <= SAFE_CENTS


def humanise(text: Column) -> Column:
    """Replace every ``COP <cents>`` in a text by the formatted amount.

    The text is cut before each amount; the leading amount of each piece is replaced.
    """
    pieces = F.split(text, r"(?=COP\s-?\d)")

    def piece(p: Column) -> Column:
        cents = F.regexp_extract(p, r"^COP\s(-?\d+)", 1)
        rest = F.regexp_replace(p, r"^COP\s-?\d+", "")
        return F.when(cents != "", F.concat(format_money(cents.try_cast("bigint")), rest)).otherwise(p)

    return F.array_join(F.transform(pieces, piece), "")
