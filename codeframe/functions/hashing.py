"""FNV-1a and fingerprints as expressions.

A 64-bit product overflows a long, and ANSI arithmetic raises; the hash is kept as
two 32-bit halves.  The prime is 2**40 + 435, so one step is two small products
and a shift.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

_LOW = 0xFFFFFFFF


def _with(value: Column, use) -> Column:
    """``use(value)`` with the value computed once; lambdas of higher-order functions would repeat it per element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def utf8_bytes(s: Column) -> Column:
    """Bytes of a string as an array of longs; empty for the empty string.  Each byte is a character of Latin-1."""
    chars = F.split(F.decode(F.encode(s, "utf-8"), "iso-8859-1"), "")
    return F.transform(F.filter(chars, lambda c: c != ""), lambda c: F.ascii(c).cast("long"))


def _state(s: Column) -> Column:
    start = F.struct(F.lit(3421674724).cast("long").alias("hi"), F.lit(2216829733).cast("long").alias("lo"))

    def step(acc: Column, byte: Column) -> Column:
        x = acc["lo"].bitwiseXOR(byte)
        low = x * 435
        high = acc["hi"] * 435 + F.shiftright(low, 32) + F.shiftleft(x.bitwiseAND(0xFFFFFF), 8)
        return F.struct(high.bitwiseAND(_LOW).alias("hi"), low.bitwiseAND(_LOW).alias("lo"))

    return F.aggregate(utf8_bytes(s), start, step)


def fnv1a_hex(s: Column) -> Column:
    """FNV-1a 64 of the UTF-8 bytes as 16 hex digits; null stays null."""
    digits = lambda h: F.lower(F.concat(F.lpad(F.hex(h["hi"]), 8, "0"), F.lpad(F.hex(h["lo"]), 8, "0")))
    return F.when(s.isNotNull(), _with(_state(s), digits))


def fnv1a(s: Column) -> Column:
    """The same as a signed long."""
    return F.when(s.isNotNull(), _with(_state(s), lambda h: F.shiftleft(h["hi"], 32).bitwiseOR(h["lo"])))


@F.arrow_udf(LongType())
def _fnv1a_long(s: pa.Array) -> pa.Array:
    from codeframe.functions import sets

    return pa.array(sets.fnv1a(s.fill_null("")).view("int64"), mask=s.is_null().to_numpy(zero_copy_only=False))


def set_fingerprint(items: Column) -> Column:
    """FNV of the sorted items joined by a bar; in Arrow batches, as the sets of whole texts are long."""
    return _fnv1a_long(F.array_join(F.sort_array(items), "|"))


def fingerprint_similarity(a: Column, b: Column) -> Column:
    """1 - differing bits / 64."""
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / 64.0


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 where both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is zero; arrays of different length raise, like any bad index."""
    mul = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(mul(a, a)) * F.sqrt(mul(b, b))
    return F.when(norm == 0, 0.0).otherwise(mul(a, b) / norm)


def chi_squared(a: Column, b: Column) -> Column:
    """Half the sum of (a - b)**2 / (a + b) over bins that are not both zero."""
    part = lambda x, y: F.when(x + y == 0, 0.0).otherwise((x - y) * (x - y) / (x + y))
    return F.aggregate(F.zip_with(a, b, lambda x, y: part(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, v: s + v) / 2


def min_max(x: Column, lo: Column, hi: Column) -> Column:
    """Scaled to 0..1; 0.5 where all values are the same."""
    return F.when(lo == hi, 0.5).otherwise((x - lo) / (hi - lo))
