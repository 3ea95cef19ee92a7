"""Validation of raw block and transfer records as Columns.

Every check is one pattern over the raw text, blanks and letter case included,
and refuses NULL and the null tokens by its form; valid rows are thus found by
a plain conjunction, which Catalyst can split and push down, and only they are
normalised. The first reason is worked out only where it is asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeflow.functions.text import NULL_TOKENS, NUMBER, null_tokens_to_null, number_or_null, trimmed

LOWEST_BLOCK, HIGHEST_BLOCK, LONGEST_NUMBER = 10_000, 999_999_999, 20
_B = r"[ \t\n\r\f\x0b]*+"
Checks = list[tuple[str, Column]]


def block_number(c: str) -> Column:
    """The block number as bigint, fractions cut off, of a text that is_block_number."""
    return F.coalesce(F.col(c).try_cast("bigint"), F.floor(trimmed(c).try_cast("double")).cast("bigint"))


def is_block_number(c: str) -> Column:
    """A number of at most 20 characters from 10,000 to 999,999,999, fractions cut off."""
    t = trimmed(c)
    middle, half = (LOWEST_BLOCK + HIGHEST_BLOCK) / 2, (HIGHEST_BLOCK - LOWEST_BLOCK) / 2
    general = t.rlike(NUMBER) & (F.length(t) <= LONGEST_NUMBER) & (F.abs(F.floor(t.try_cast("double")) - middle) <= half)
    # Nearly all numbers are plain digits within the bounds; the rest takes the long way.
    return F.col(c).rlike(r"^[1-9][0-9]{4,8}\z") | general


def is_fraction(c: str) -> Column:
    """Whether a block number's fraction is cut off."""
    v = trimmed(c).try_cast("double")
    return is_block_number(c) & (v != F.floor(v))


def is_hash(c: str) -> Column:
    """0x and 64 more characters; they needn't be hexadecimal."""
    return F.col(c).rlike(rf"(?is)^{_B}0x.{{63}}[^ \t\n\r\f\x0b]{_B}\z")


def is_address(c: str) -> Column:
    return F.col(c).rlike(rf"(?i)^{_B}0x[0-9a-f]{{40}}{_B}\z")


def is_amount(c: str) -> Column:
    return F.col(c).rlike(rf"(?i)^{_B}0x[0-9a-f]{{64}}{_B}\z")


def is_index(c: Column) -> Column:
    """A whole number of at most 18 digits, zeros ahead not counted."""
    return c.rlike(rf"^{_B}0*+(?:[1-9][0-9]{{0,17}})?(?<=[0-9]){_B}\z")


def chain_id() -> Column:
    """chain_id as text, 1 where it is NULL or a null token."""
    return F.coalesce(null_tokens_to_null("chain_id"), F.lit("1"))


def is_chain(c: Column) -> Column:
    """A whole number that fits an int."""
    return c.rlike(rf"^{_B}0*+(?:[1-9][0-9]{{0,9}})?(?<=[0-9]){_B}\z") & (c.try_cast("bigint") <= 2**31 - 1)


def present(*columns: str) -> Column:
    return reduce(Column.__and__, [F.col(c).isNotNull() & ~F.col(c).isin(*NULL_TOKENS) for c in columns])


def all_of(checks: Checks) -> Column:
    return reduce(Column.__and__, [ok for _, ok in checks])


def first_reason(missing: tuple[str, ...], checks: Checks) -> Column:
    """missing_value, or the name of the first check that fails; NULL if all hold."""
    return F.coalesce(F.when(~present(*missing), F.lit("missing_value")), *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks])


def transfer_checks() -> Checks:
    return [
        ("block_number", is_block_number("block_number")), ("transaction_hash", is_hash("transaction_hash")), ("from_address", is_address("from_address")), ("to_address", is_address("to_address")),
        ("value_binary", is_amount("value_binary")), ("transfer_index", is_index(F.col("transfer_index"))), ("chain_id", is_chain(chain_id())),
    ]


def block_checks() -> Checks:
    return [
        ("block_number", is_block_number("block_number")), ("block_hash", is_hash("block_hash")),
        ("timestamp", F.abs(number_or_null("timestamp")) <= 9e18), ("chain_id", is_chain(chain_id())),
    ]
