"""Scalar functions of the engine as Spark columns. Nulls give null unless said otherwise."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cyclomatic(decisions: Column, exits: Column) -> Column:
    """Decision points minus exits plus 2, signed."""
    return decisions - exits + 2


def adjusted_weight(weight: Column, adjust: float) -> Column:
    """Exponential below the threshold, linear above it."""
    w = weight.cast("double")
    return F.when(w <= adjust, F.exp((w - adjust) / adjust)).otherwise(w - adjust + 1)


def spill_discount(spills: Column, weight: Column) -> Column:
    """Less weight the more often a vertex has spilled, nothing from the tenth time on."""
    return (10 - F.least(spills, F.lit(10))) / 10.0 * weight


def bitness(file_type: Column) -> Column:
    """32 or 64 from a file type's text, else null."""
    t = F.lower(file_type)
    return F.when(t.contains("64-bit"), 64).when(t.contains("32-bit"), 32)


def escape_controls(text: Column) -> Column:
    r"""Control characters, backslashes and quotes as a backslash and two hexadecimal digits."""
    special = F.split(text, "")
    one = F.transform(
        special,
        lambda c: F.when(c.rlike(r"[\x00-\x1f\x7f\\\"']"), F.concat(F.lit("\\"), F.lpad(F.lower(F.hex(F.ascii(c))), 2, "0"))).otherwise(c),
    )
    return F.array_join(one, "")


def mount_node(path: Column, root: str = "") -> Column:
    """The node below the mount root of a path."""
    return F.regexp_extract(path, rf"^{root}/+([^/]+)/", 1)


def mount_rest(path: Column, root: str = "") -> Column:
    """The path within its node."""
    return F.regexp_extract(path, rf"^{root}/+[^/]+(/.*)$", 1)


def single_slashes(path: Column) -> Column:
    """D17."""
    return F.regexp_replace(path, "/{2,}", "/")


def archive_path(path: Column) -> Column:
    """A member of an archive, ``lib.a(member.o)`` or ``lib.a/member.o``, as ``lib.a:member.o``, so that it
    reads as one file name; other paths stay."""
    rewritten = F.regexp_replace(path, r"(\.a)\(([^()/]+)\)$", "$1:$2")
    return F.regexp_replace(rewritten, r"(\.a)/+([^/]+)$", "$1:$2")


def opcode_length(code: Column) -> Column:
    """Length of the opcode at the start of hexadecimal code: 1, 2 after 0f, 3 after 0f38 and 0f3a."""
    c = F.lower(code)
    return F.when(F.length(c) < 2, None).when(~c.startswith("0f"), 1).when(F.substring(c, 3, 2).isin("38", "3a"), 3).otherwise(2)


def opcode_hex(codes: Column) -> Column:
    """A list of operation codes, two bytes each, most significant first."""
    return F.array_join(F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c.cast("int"))), 4, "0")), "")


def elapsed_ms(start: Column, end: Column) -> Column:
    """Whole seconds in milliseconds plus the microseconds, rounded up to milliseconds."""
    us = F.unix_micros(end) - F.unix_micros(start)
    return (F.floor(us / 1_000_000) * 1000 + F.ceil(F.pmod(us, F.lit(1_000_000)) / 1000)).cast("long")


def masked(value: Column, bits: int) -> Column:
    """A value cut to its low ``bits``, 63 at most."""
    return value.bitwiseAND(F.lit((1 << bits) - 1))


def machine_op(op: str, a: Column, b: Column | None = None, bits: int = 32, c: Column | None = None) -> Column:
    """One operation of the machine IR on concrete values of up to 32 bits, unsigned.

    Division by zero follows the bit-vector theory: all ones, or the dividend as remainder; signed
    division by zero gives 1 for a negative dividend, else all ones. ``concat`` puts the low halves of
    ``a`` and ``b`` together, ``high`` and ``low`` take a value's halves, ``sext`` extends the sign of the
    low half, ``ite`` is ``b`` where ``a`` is not 0, else ``c``."""
    full = F.lit((1 << bits) - 1).cast("long")
    half = bits // 2
    a = masked(a.cast("long"), bits)
    b = a if b is None else masked(b.cast("long"), bits)
    c = F.lit(0).cast("long") if c is None else masked(c.cast("long"), bits)
    signed = lambda x, n=bits: F.when(x >= 1 << (n - 1), x - (1 << n)).otherwise(x)
    left = lambda x, n: F.call_function("shiftleft", x, n)
    right = lambda x, n: F.call_function("shiftright", x, n)
    by = F.least(b, F.lit(bits - 1)).cast("int")
    some = F.when(b == 0, F.lit(1).cast("long")).otherwise(b)  # a divisor that can be divided by
    s, d = signed(a), signed(some)
    quotient = F.when(s.bitwiseXOR(d) >= 0, F.expr("1")).otherwise(F.expr("-1")) * F.floor(F.abs(s) / F.abs(d))
    rest = F.when(s >= 0, F.abs(s) % F.abs(d)).otherwise(-(F.abs(s) % F.abs(d)))
    # a product of two values of 32 bits does not fit: one is taken by halves of 16 bits
    product = a * masked(b, 16) + left(masked(a * right(b, F.lit(16)), 16), F.lit(16))
    results = {
        "not": lambda: a.bitwiseXOR(full), "neg": lambda: -a, "add": lambda: a + b, "sub": lambda: a - b, "mul": lambda: product,
        "and": lambda: a.bitwiseAND(b), "or": lambda: a.bitwiseOR(b), "xor": lambda: a.bitwiseXOR(b),
        "div": lambda: F.when(b == 0, full).otherwise(F.floor(a / some)), "mod": lambda: F.when(b == 0, a).otherwise(a % some),
        "sdiv": lambda: F.when(b != 0, quotient).when(s < 0, 1).otherwise(full), "srem": lambda: F.when(b == 0, a).otherwise(rest),
        "smod": lambda: F.when(b == 0, a).when((rest == 0) | ((rest < 0) == (d < 0)), rest).otherwise(rest + d),
        "shl": lambda: F.when(b >= bits, 0).otherwise(left(a, by)), "shr": lambda: F.when(b >= bits, 0).otherwise(right(a, by)), "sar": lambda: right(s, by),
        "eq": lambda: (a == b).cast("long"), "ult": lambda: (a < b).cast("long"), "ule": lambda: (a <= b).cast("long"),
        "slt": lambda: (s < signed(b)).cast("long"), "sle": lambda: (s <= signed(b)).cast("long"),
        "sext": lambda: signed(masked(a, half), half), "low": lambda: masked(a, half), "high": lambda: right(a, F.lit(half)),
        "concat": lambda: left(masked(a, half), F.lit(half)) + masked(b, half), "ite": lambda: F.when(a != 0, b).otherwise(c),
    }
    return masked(results[op]().cast("long"), bits)


def memory_write(memory: Column, address: Column, value: Column) -> Column:
    """WRITE to a memory, a map of addresses and values: what stood there goes."""
    return F.map_concat(F.map_filter(memory, lambda k, _: k != address), F.create_map(address, value))


def memory_read(memory: Column, address: Column) -> Column:
    """READ from a memory; 0 where nothing has been written."""
    return F.coalesce(F.try_element_at(memory, address), F.lit(0).cast("long"))


def fnv1a(text: Column) -> Column:
    """FNV-1a of the bytes of a text, 32 bits, inside generated expressions."""
    data = F.hex(F.encode(text, "UTF-8"))
    steps = F.when(F.length(data) > 0, F.sequence(F.lit(1), F.length(data), F.lit(2))).otherwise(F.array().cast("array<int>"))

    def step(h: Column, i: Column) -> Column:
        byte = F.conv(F.substr(data, i, F.lit(2)), 16, 10).cast("long")
        return (h.bitwiseXOR(byte) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))

    return F.when(text.isNotNull(), F.aggregate(steps, F.lit(2166136261).cast("long"), step))


def one_at_a_time(text: Column) -> Column:
    """The published one-at-a-time hash of the bytes of a text, 32 bits, inside generated expressions."""
    data = F.hex(F.encode(text, "UTF-8"))
    steps = F.when(F.length(data) > 0, F.sequence(F.lit(1), F.length(data), F.lit(2))).otherwise(F.array().cast("array<int>"))
    full = F.lit(0xFFFFFFFF).cast("long")
    left = lambda h, n: (h + F.call_function("shiftleft", h, F.lit(n))).bitwiseAND(full)
    right = lambda h, n: h.bitwiseXOR(F.call_function("shiftright", h, F.lit(n)))

    def step(h: Column, i: Column) -> Column:
        byte = F.conv(F.substr(data, i, F.lit(2)), 16, 10).cast("long")
        return right(left((h + byte).bitwiseAND(full), 10), 6)

    return F.when(text.isNotNull(), F.aggregate(steps, F.lit(0).cast("long"), step, lambda h: left(right(left(h, 3), 11), 15)))


def murmur2_32(data: bytes, seed: int = 0) -> int:
    """The published 32-bit Murmur2 hash."""
    mask, factor = 0xFFFFFFFF, 0x5BD1E995
    h = seed ^ len(data)
    whole = len(data) // 4 * 4
    for i in range(0, whole, 4):
        k = int.from_bytes(data[i : i + 4], "little") * factor & mask
        h = (h * factor & mask) ^ ((k ^ (k >> 24)) * factor & mask)
    if whole < len(data):
        h = (h ^ int.from_bytes(data[whole:], "little")) * factor & mask
    h = (h ^ (h >> 13)) * factor & mask
    return h ^ (h >> 15)


def murmur2_64(data: bytes, seed: int = 0) -> int:
    """The published 64-bit Murmur2 hash for 64-bit machines (64A)."""
    mask, factor = 0xFFFFFFFFFFFFFFFF, 0xC6A4A7935BD1E995
    h = seed ^ (len(data) * factor & mask)
    whole = len(data) // 8 * 8
    for i in range(0, whole, 8):
        k = int.from_bytes(data[i : i + 8], "little") * factor & mask
        h = (h ^ ((k ^ (k >> 47)) * factor & mask)) * factor & mask
    if whole < len(data):
        h = (h ^ int.from_bytes(data[whole:], "little")) * factor & mask
    h = (h ^ (h >> 47)) * factor & mask
    return h ^ (h >> 47)


def _signed64(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@F.pandas_udf(T.StructType([T.StructField("murmur2", T.LongType()), T.StructField("murmur2_64", T.LongType())]))
def murmur2(texts: pd.Series) -> pd.DataFrame:
    """Both Murmur2 hashes of the bytes of a text, the 64-bit one as a signed number."""
    rows = [(None, None) if t is None else (murmur2_32(t.encode()), _signed64(murmur2_64(t.encode()))) for t in texts]
    return pd.DataFrame(rows, columns=["murmur2", "murmur2_64"]).astype("Int64")


def murmur3_32(data: bytes, seed: int = 0) -> int:
    """The published 32-bit Murmur3 hash."""
    mask, h = 0xFFFFFFFF, seed
    turn = lambda x, r: ((x << r) | (x >> (32 - r))) & mask

    def mix(k: int) -> int:
        return turn(k * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask

    whole = len(data) // 4 * 4
    for i in range(0, whole, 4):
        h = (turn(h ^ mix(int.from_bytes(data[i : i + 4], "little")), 13) * 5 + 0xE6546B64) & mask
    if whole < len(data):
        h ^= mix(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ (h >> shift)) * factor & mask
    return h


@F.pandas_udf(T.LongType())
def murmur3(texts: pd.Series) -> pd.Series:
    """D13 of the bytes of a text."""
    return texts.map(lambda t: None if t is None else murmur3_32(t.encode())).astype("Int64")
