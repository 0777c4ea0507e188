"""Hashes and pointer codes on columns, bit for bit, in built-in functions.

Spark's sums and products raise on overflow; arithmetic modulo 2 ** 64 is put together here from parts that can't overflow.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seed and mask of the string hash, and the constants of the integer mixers.
WORD_SEED = 1159241
WORD_MASK = (1 << 27) - 1
MURMUR_64 = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
MURMUR_32 = (0x85EBCA6B, 0xC2B2AE35)
JENKINS = (0x7ED55D16, 0xC761C23C, 0x165667B1, 0xD3A2646C, 0xFD7046C5, 0xB55A4F09)
LOW = 0xFFFFFFFF


def add64(a: Column, b: Column) -> Column:
    """a + b modulo 2 ** 64."""
    a, b = a.cast("bigint"), b.cast("bigint")  # a shift of an int by 32 would leave it as it is
    mask = F.lit(LOW)
    low = a.bitwiseAND(mask) + b.bitwiseAND(mask)
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(mask))


def mul64(a: Column, factor: int) -> Column:
    """a * factor modulo 2 ** 64: products of 16-bit parts, summed by place, none of which overflows."""
    x = [F.shiftrightunsigned(a, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    y = [F.lit(factor >> 16 * i & 0xFFFF) for i in range(4)]
    at = [sum((x[i] * y[n - i] for i in range(1, n + 1)), x[0] * y[n]) for n in range(4)]
    low = at[0] + F.shiftleft(at[1].bitwiseAND(F.lit(0xFFFF)), 16)
    high = at[2] + F.shiftrightunsigned(at[1], 16) + F.shiftleft(at[3].bitwiseAND(F.lit(0xFFFF)), 16) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(LOW)))


def _bound(value: Column, steps) -> Column:
    """Each step applied to what the one before gave, which is worked out once."""
    for step in steps:
        value = F.get(F.transform(F.array(value), step), F.lit(0))
    return value


def shift_mix(key: Column) -> Column:
    """Thomas Wang's 64-bit integer hash: additions of shifted keys and right shifts."""
    def right(n):
        return lambda k: k.bitwiseXOR(F.shiftrightunsigned(k, n))

    def add_left(*shifts):
        def step(k):
            out = k
            for n in shifts:
                out = add64(out, F.shiftleft(k, n))
            return out
        return step

    first = lambda k: add64(F.bitwise_not(k), F.shiftleft(k, 21))
    return _bound(key.cast("bigint"), [first, right(24), add_left(3, 8), right(14), add_left(2, 4), right(28), add_left(31)])


def add_xor_mix(key: Column) -> Column:
    """Robert Jenkins' six-step integer hash, over 64 bits: each step brings in a constant and the shifted value, by addition or exclusive or."""
    c = [F.lit(x).cast("bigint") for x in JENKINS]
    steps = [
        lambda a: add64(add64(a, c[0]), F.shiftleft(a, 12)),
        lambda a: a.bitwiseXOR(c[1]).bitwiseXOR(F.shiftrightunsigned(a, 19)),
        lambda a: add64(add64(a, c[2]), F.shiftleft(a, 5)),
        lambda a: add64(a, c[3]).bitwiseXOR(F.shiftleft(a, 9)),
        lambda a: add64(add64(a, c[4]), F.shiftleft(a, 3)),
        lambda a: a.bitwiseXOR(c[5]).bitwiseXOR(F.shiftrightunsigned(a, 16)),
    ]
    return _bound(key.cast("bigint"), steps)


def murmur_mix(key: Column) -> Column:
    """The 64-bit finaliser of MurmurHash3."""
    fold = lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, 33))
    return _bound(key.cast("bigint"), [fold, lambda x: mul64(x, MURMUR_64[0]), fold, lambda x: mul64(x, MURMUR_64[1]), fold])


def murmur_mix_int(key: Column) -> Column:
    """The 32-bit finaliser of MurmurHash3 with sign-keeping shifts, as of a signed integer."""
    def fold(n):
        return lambda x: x.bitwiseXOR(F.shiftright(x, n))

    def times(factor):
        def step(x):
            low = mul64(x.cast("bigint"), factor).bitwiseAND(F.lit(LOW))
            return F.when(low > 0x7FFFFFFF, low - F.lit(1 << 32)).otherwise(low).cast("int")
        return step

    return _bound(key.cast("int"), [fold(16), times(MURMUR_32[0]), fold(13), times(MURMUR_32[1]), fold(16)])


def word_hash(word: Column, mask: int = WORD_MASK, seed: int = WORD_SEED) -> Column:
    """The string hash: over 32-bit unsigned states; for ASCII words."""
    def step(h: Column, c: Column) -> Column:
        return h.bitwiseXOR((F.shiftleft(h, 5) + F.ascii(c) + F.shiftright(h, 2)).bitwiseAND(F.lit(LOW)))

    letters = F.filter(F.split(word, ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(seed).cast("bigint"), step).bitwiseAND(F.lit(mask))


def pointer(segment: Column, offset: Column) -> Column:
    return F.shiftleft(segment.cast("bigint"), 32).bitwiseOR(offset.cast("bigint"))


def pointer_segment(code: Column) -> Column:
    return F.shiftrightunsigned(code, 32)


def pointer_offset(code: Column) -> Column:
    return code.bitwiseAND(F.lit(LOW))
