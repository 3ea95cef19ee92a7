"""Lossless binary form of sids, half as long, for shuffles.

chain_0x<hash>[_index] becomes a tag, the bytes of the hash and the text around
it; any other text keeps its bytes behind another tag. Two texts are equal
exactly if their binary forms are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LONG = r"^[0-9]{1,18}_0x[0-9a-f]{64}(_[0-9]{1,18})?$"
_SHORT = r"^[0-9]{1,18}_0x[0-9a-f]{40}(_[0-9]{1,18})?$"


def _hashed(c: Column, tag: int, width: int) -> Column:
    at = F.instr(c, "_0x")
    around = F.concat(F.substring(c, F.lit(1), at - 1), F.substring(c, at + 3 + width, F.lit(40)))
    return F.concat(F.unhex(F.lit(f"{tag:02x}")), F.unhex(F.substring(c, at + 3, F.lit(width))), F.encode(around, "utf-8"))


def compact(c: Column) -> Column:
    """Text to binary; NULL stays NULL."""
    return F.when(c.rlike(_LONG), _hashed(c, 1, 64)).when(c.rlike(_SHORT), _hashed(c, 2, 40)).otherwise(F.concat(F.unhex(F.lit("00")), F.encode(c, "utf-8")))


def restore(b: Column) -> Column:
    """The text of a binary form."""
    tag = F.hex(F.substring(b, 1, 1))

    def text(width: int) -> Column:
        around = F.decode(F.substring(b, F.lit(2 + width), F.lit(60)), "utf-8")
        chain = F.substring_index(around, "_", 1)
        return F.concat(chain, F.lit("_0x"), F.lower(F.hex(F.substring(b, 2, width))), F.substring(around, F.length(chain) + 1, F.lit(40)))

    rest = F.decode(F.substring(b, F.lit(2), F.greatest(F.octet_length(b) - 1, F.lit(0))), "utf-8")
    return F.when(tag == "01", text(32)).when(tag == "02", text(20)).otherwise(rest)
