"""Byte, nibble and bit functions on binary columns, and word-array bitsets.

Every function takes and returns columns.  A binary column is worked on as the
array of its unsigned bytes; results that are binary again are packed once.
Operands of different lengths raise an error, as does an odd interleave.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def unsigned_bytes(b: Column) -> Column:
    """The bytes of a binary column as array<int> of 0 to 255."""
    chars = F.split(F.decode(b, "ISO-8859-1"), "")
    return F.when(F.length(b) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.slice(chars, F.lit(1), F.length(b)), lambda c: F.ascii(c)))


def pack(values: Column) -> Column:
    """Binary of an array of ints; each is taken modulo 256."""
    return F.unhex(F.array_join(F.transform(values, lambda x: F.lpad(F.hex(F.pmod(x, F.lit(256)).cast("long")), 2, "0")), ""))


def _pairwise(a: Column, b: Column, f: Callable) -> Column:
    joined = pack(F.zip_with(unsigned_bytes(a), unsigned_bytes(b), f))
    return F.when(F.length(a) == F.length(b), joined).otherwise(F.raise_error(F.lit("operands differ in length")).cast("binary"))


def bytes_and(a: Column, b: Column) -> Column:
    return _pairwise(a, b, lambda x, y: x.bitwiseAND(y))


def bytes_or(a: Column, b: Column) -> Column:
    return _pairwise(a, b, lambda x, y: x.bitwiseOR(y))


def bytes_xor(a: Column, b: Column) -> Column:
    return _pairwise(a, b, lambda x, y: x.bitwiseXOR(y))


def bytes_and_not(a: Column, b: Column) -> Column:
    """a without the bits of b."""
    return _pairwise(a, b, lambda x, y: x.bitwiseAND(F.bitwise_not(y)))


def _each(b: Column, f: Callable) -> Column:
    return pack(F.transform(unsigned_bytes(b), f))


def bytes_and_const(b: Column, v: int) -> Column:
    return _each(b, lambda x: x.bitwiseAND(F.lit(v)))


def bytes_or_const(b: Column, v: int) -> Column:
    return _each(b, lambda x: x.bitwiseOR(F.lit(v)))


def bytes_xor_const(b: Column, v: int) -> Column:
    return _each(b, lambda x: x.bitwiseXOR(F.lit(v)))


def bytes_and_not_const(b: Column, v: int) -> Column:
    return _each(b, lambda x: x.bitwiseAND(F.lit(255 - v)))


def bytes_add_const(b: Column, v: int) -> Column:
    return _each(b, lambda x: x + F.lit(v))


def bytes_subtract_from_const(b: Column, v: int) -> Column:
    return _each(b, lambda x: F.lit(v) - x)


def first_unequal(a: Column, b: Column, start: int = 0) -> Column:
    """First index from ``start`` on where a and b differ, else the shorter length."""
    n = F.least(F.length(a), F.length(b))
    x, y = unsigned_bytes(a), unsigned_bytes(b)
    rest = lambda v: F.slice(v, F.lit(start + 1), F.greatest(n - start, F.lit(0)))
    at = F.array_position(F.zip_with(rest(x), rest(y), lambda p, q: p != q), F.lit(True))
    return F.when(at > 0, at - 1 + start).otherwise(n).cast("int")


def _first_index(b: Column, test: Callable) -> Column:
    hit = F.array_position(F.transform(unsigned_bytes(b), test), F.lit(True))
    return F.when(hit > 0, hit - 1).otherwise(F.length(b)).cast("int")


def first_greater(b: Column, v: int) -> Column:
    """First index of a byte over v, else the length."""
    return _first_index(b, lambda x: x > v)


def first_at_most(b: Column, v: int) -> Column:
    """First index of a byte of v or less, else the length."""
    return _first_index(b, lambda x: x <= v)


def popcount(b: Column) -> Column:
    return F.aggregate(unsigned_bytes(b), F.lit(0).cast("long"), lambda s, x: s + F.bit_count(x))


def mask_then_count(b: Column, mask: int, v: int) -> Column:
    return F.size(F.filter(unsigned_bytes(b), lambda x: x.bitwiseAND(F.lit(mask)) == v)).cast("long")


def count_bytes(b: Column, values: list[int]) -> Column:
    """How many bytes are one of two or three values."""
    return F.size(F.filter(unsigned_bytes(b), lambda x: x.isin(values))).cast("long")


def _in_table(table: list[int], x: Column) -> Column:
    return F.get(F.array(*map(F.lit, table)), x)


def count_nibbles(b: Column, table: list[int]) -> Column:
    """Of both nibbles of each byte, how many are in the set given as 16 zeros and ones."""
    return F.aggregate(unsigned_bytes(b), F.lit(0).cast("long"), lambda s, x: s + _in_table(table, x.bitwiseAND(F.lit(15))) + _in_table(table, F.shiftright(x, 4)))


def count_nibbles_in_two(b: Column, one: list[int], two: list[int]) -> Column:
    return F.struct(count_nibbles(b, one).alias("one"), count_nibbles(b, two).alias("two"))


def count_unpacked_nibbles(b: Column, table: list[int]) -> Column:
    """The same where every byte is one nibble, under 16."""
    return F.aggregate(unsigned_bytes(b), F.lit(0).cast("long"), lambda s, x: s + _in_table(table, x))


def count_unpacked_nibbles_in_two(b: Column, one: list[int], two: list[int]) -> Column:
    return F.struct(count_unpacked_nibbles(b, one).alias("one"), count_unpacked_nibbles(b, two).alias("two"))


def sum_bytes(b: Column) -> Column:
    return F.aggregate(unsigned_bytes(b), F.lit(0).cast("long"), lambda s, x: s + x)


def sum_bytes_over(b: Column, v: int) -> Column:
    """Sum of the bytes over v."""
    return F.aggregate(F.filter(unsigned_bytes(b), lambda x: x > v), F.lit(0).cast("long"), lambda s, x: s + x)


def reverse_bytes(b: Column) -> Column:
    return pack(F.reverse(unsigned_bytes(b)))


def interleave(even: Column, odd: Column) -> Column:
    """Bytes in turn; ``even`` has as many as ``odd`` or one more."""
    x, y = unsigned_bytes(even), unsigned_bytes(odd)
    mixed = F.filter(F.flatten(F.zip_with(x, y, lambda p, q: F.array(p, q))), lambda v: v.isNotNull())
    return F.when((F.length(even) - F.length(odd)).isin(0, 1), pack(mixed)).otherwise(F.raise_error(F.lit("operands don't interleave")).cast("binary"))


def fill_bytes(v: int, n: Column) -> Column:
    return F.unhex(F.repeat(F.lit(f"{v % 256:02X}"), n))


def unpacked_nibble_lookup(b: Column, table: list[int]) -> Column:
    """Each byte under 128 by its low nibble, others as 0."""
    return _each(b, lambda x: F.when(x < 128, _in_table(table, x.bitwiseAND(F.lit(15)))).otherwise(F.lit(0)))


def packed_nibble_lookup(b: Column, table: list[int], n: Column | None = None) -> Column:
    """Low then high nibble of each byte, looked up; ``n`` results (default: all)."""
    both = F.flatten(F.transform(unsigned_bytes(b), lambda x: F.array(_in_table(table, x.bitwiseAND(F.lit(15))), _in_table(table, F.shiftright(x, 4)))))
    return pack(both if n is None else F.slice(both, F.lit(1), n))


def bit_of_every_byte(b: Column, bit: int) -> Column:
    """Bit ``bit`` of each byte, packed eight to a byte, lowest first."""
    eight = lambda g: unsigned_bytes(F.substring(b, g * 8 + 1, F.lit(8)))
    groups = F.transform(
        F.sequence(F.lit(0), F.floor((F.length(b) - 1) / 8).cast("int")),
        lambda g: F.aggregate(eight(g), F.struct(F.lit(0).alias("v"), F.lit(1).alias("p")), lambda a, x: F.struct((a["v"] + F.shiftright(x, bit).bitwiseAND(F.lit(1)) * a["p"]).alias("v"), (a["p"] * 2).alias("p")), lambda a: a["v"]),
    )
    return F.when(F.length(b) == 0, F.lit(b"")).otherwise(pack(groups))


def round_up_pow2(v: Column, log2: int) -> Column:
    step = 1 << log2
    return (v + F.lit(step - 1)).bitwiseAND(F.lit(-step))


def div_up_pow2(v: Column, log2: int) -> Column:
    return F.shiftright(v + F.lit((1 << log2) - 1), log2)


# -- arrays of numbers -------------------------------------------------------


def first_nan_or_inf(a: Column) -> Column:
    """First index of a NaN or an infinity in array<double>, else -1."""
    return (F.array_position(F.transform(a, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True)) - 1).cast("int")


def index_of(a: Column, v) -> Column:
    """First index of v, else -1."""
    return (F.array_position(a, v) - 1).cast("int")


def reverse_items(a: Column) -> Column:
    return F.reverse(a)


def repeat_item(v: Column, n: Column) -> Column:
    return F.array_repeat(v, n)


# -- bitsets: array<bigint> of 64-bit words ----------------------------------


def clear_bits(n: int) -> Column:
    """Words for n bits, all clear."""
    return F.array_repeat(F.lit(0).cast("long"), -(-n // 64))


def _place(i: Column) -> tuple[Column, Column]:
    return F.floor(i / 64).cast("int"), F.pmod(i, F.lit(64)).cast("int")


def _bit(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k)


def set_bit(words: Column, i: Column) -> Column:
    word, k = _place(i)
    return F.transform(words, lambda w, j: F.when(j == word, w.bitwiseOR(_bit(k))).otherwise(w))


def clear_bit(words: Column, i: Column) -> Column:
    word, k = _place(i)
    return F.transform(words, lambda w, j: F.when(j == word, w.bitwiseAND(F.bitwise_not(_bit(k)))).otherwise(w))


def test_bit(words: Column, i: Column) -> Column:
    word, k = _place(i)
    return F.get(words, word).bitwiseAND(_bit(k)) != 0


def _interval_mask(j: Column, start: Column, limit: Column) -> Column:
    """Bits of word j in [start, limit)."""
    low = F.greatest(start - j * 64, F.lit(0)).cast("int")
    high = F.least(limit - j * 64, F.lit(64)).cast("int")
    below = lambda k: F.when(k <= 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), 64 - k))
    return F.when(high > low, below(high).bitwiseAND(F.bitwise_not(below(low)))).otherwise(F.lit(0).cast("long"))


def set_interval(words: Column, start: Column, limit: Column) -> Column:
    """Bits [start, limit) set; nothing where start >= limit."""
    return F.transform(words, lambda w, j: w.bitwiseOR(_interval_mask(j, start, limit)))


def clear_interval(words: Column, start: Column, limit: Column) -> Column:
    return F.transform(words, lambda w, j: w.bitwiseAND(F.bitwise_not(_interval_mask(j, start, limit))))


def set_bits(n: int) -> Column:
    """Words for n bits, all n set."""
    return set_interval(clear_bits(n), F.lit(0), F.lit(n))


def bit_places(words: Column) -> Column:
    """Places of the set bits, ascending; reads only, and gives [] for an empty set."""
    per_word = F.transform(words, lambda w, j: F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.call_function("shiftrightunsigned", w, k).bitwiseAND(F.lit(1).cast("long")) == 1), lambda k: j * 64 + k))
    return F.flatten(per_word)
