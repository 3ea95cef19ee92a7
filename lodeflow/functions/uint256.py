"""Exact arithmetic on unsigned 256-bit numbers held as text.

decimal(38,0) is Spark's widest exact number, a uint256 has up to 78 digits. A
value is therefore cut into three limbs of 27 decimal digits; limbs are summed
apart (room for 10^11 addends) and carried when the sum is written as text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMB = 27
BASE = "1" + "0" * LIMB
LIMBS = ("limb_hi", "limb_mid", "limb_lo")
_WIDE = "decimal(38,0)"


def digits(c: Column | str) -> Column:
    """Plain digits of an amount, padding and leading zeros removed; NULL if it isn't a whole number of at most 78 digits."""
    col = F.col(c) if isinstance(c, str) else c
    d = F.regexp_replace(F.btrim(col, F.lit(" \t\n\r\f\x0b")), r"^0+(?=[0-9])", "")
    return F.when(d.rlike(r"^[0-9]{1,78}$"), d)


def names(prefix: str = "") -> list[str]:
    """The limb columns of one amount, from high to low."""
    return [prefix + x for x in LIMBS]


def limbs(prefix: str = "") -> list[Column]:
    return [F.col(c) for c in names(prefix)]


def split(d: Column, prefix: str = "") -> list[Column]:
    """Limbs (high, middle, low) of digit text, decimal(27,0) each."""
    kind = f"decimal({LIMB},0)"
    long = F.length(d)

    def part(i: int) -> Column:
        # Position of a limb from the right end; shorter numbers have none of it.
        start, width = long - LIMB * (3 - i) + 1, F.least(F.lit(LIMB), long - LIMB * (2 - i))
        text = F.substring(d, F.greatest(start, F.lit(1)), width)
        return F.when(long > LIMB * (2 - i), text.cast(kind)).otherwise(F.when(d.isNotNull(), F.lit(0).cast(kind)))

    return [part(i).alias(prefix + LIMBS[i]) for i in range(3)]


def sums(prefix: str = "") -> list[Column]:
    """Aggregates that add limbs; the columns keep their names."""
    return [F.sum(c).cast(_WIDE).alias(c) for c in names(prefix)]


def _carried(hi: Column, mid: Column, lo: Column) -> tuple[Column, Column, Column]:
    """The same number with middle and low limb from 0 to below 10^27; only the high limb may be negative."""
    base = F.lit(BASE).cast("decimal(28,0)")
    rest = lambda x: F.pmod(x, base).cast(f"decimal({LIMB},0)")
    over = lambda x: ((x - F.pmod(x, base)).cast(_WIDE) / base).cast("decimal(20,0)")
    middle = (mid + over(lo)).cast(_WIDE)
    return (hi + over(middle)).cast(_WIDE), rest(middle), rest(lo)


def _joined(hi: Column, mid: Column, lo: Column) -> Column:
    """Digit text of three limbs from 0 to below 10^27."""
    return F.regexp_replace(F.concat(hi.cast("string"), F.lpad(mid.cast("string"), LIMB, "0"), F.lpad(lo.cast("string"), LIMB, "0")), r"^0+(?=[0-9])", "")


def _once(value: Column, f) -> Column:
    """f(value) with value worked out once. Keeps the code of rare, long cases small, as a lambda isn't unrolled."""
    return F.transform(F.array(value), f)[0]


def to_text(hi: Column, mid: Column, lo: Column) -> Column:
    """Digit text of summed limbs (NULL if a limb is NULL); a minus sign leads if their number is negative."""

    def wide(s: Column) -> Column:
        h, m, x = s["h"], s["m"], s["x"]
        return F.when(_carried(h, m, x)[0] < 0, F.concat(F.lit("-"), _joined(*_carried(-h, -m, -x)))).otherwise(_joined(*_carried(h, m, x)))

    # Nearly all numbers have a low limb only.
    small = (hi == 0) & (mid == 0)
    return F.when(small, lo.cast("string")).otherwise(_once(F.struct(hi.cast(_WIDE).alias("h"), mid.cast(_WIDE).alias("m"), lo.cast(_WIDE).alias("x")), wide))


def to_double(hi: Column, mid: Column, lo: Column) -> Column:
    """Nearest double of the exact sum, by its digits."""
    return to_text(hi, mid, lo).cast("double")


def at_least(d: Column, minimum: int) -> Column:
    """Whether digit text (without leading zeros, at most 78 digits) is a number of at least minimum."""
    return F.lpad(d, 3 * LIMB, "0") >= F.lit(f"{minimum:0{3 * LIMB}d}")


def hex_to_text(c: Column) -> Column:
    """'0x' and up to 64 hex digits to decimal digits, exactly at any size; NULL if it isn't hexadecimal."""
    h = F.lpad(F.substring(F.lower(c), 3, 64), 64, "0")
    kind = f"decimal({LIMB},0)"
    zero, base, shift = F.lit(0).cast(kind), F.lit(BASE).cast("decimal(28,0)"), F.lit(1 << 32).cast("decimal(10,0)")

    def step(s: Column, piece: Column) -> Column:
        """Limbs times 2^32 plus a piece of 32 bits, carried."""
        times = lambda x, more: ((x * shift).cast(_WIDE) + more).cast(_WIDE)
        over = lambda x: ((x - F.pmod(x, base)).cast(_WIDE) / base).cast("decimal(11,0)")
        lo = times(s["lo"], piece)
        mid = times(s["mid"], over(lo))
        hi = times(s["hi"], over(mid))
        return F.struct(hi.cast(kind).alias("hi"), F.pmod(mid, base).cast(kind).alias("mid"), F.pmod(lo, base).cast(kind).alias("lo"))

    def wide(text: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(text, i * 8 + 1, F.lit(8)), 16, 10).cast("decimal(10,0)"))
        return F.aggregate(pieces, F.struct(zero.alias("hi"), zero.alias("mid"), zero.alias("lo")), step, lambda s: _joined(s["hi"], s["mid"], s["lo"]))

    # Most amounts fit 64 bits and need one conversion only.
    short = F.conv(F.substring(h, 49, 16), 16, 10)
    return F.when(c.rlike("(?i)^0x[0-9a-f]{1,64}$"), F.when(F.substring(h, 1, 48) == "0" * 48, short).otherwise(_once(h, wide)))
