"""Content-derived identities and unsigned 64-bit ids kept as their bit pattern in BIGINT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EVENT_TYPES = {"start": 1, "end": 2, "attr": 3, "log": 4, "error": 5}
_BASIS = -3750763034362895579
_LOW = 4294967295
_SIGN = -(1 << 63)


def fnv1a64(data: Column) -> Column:
    """FNV-1a over BINARY. The product by 2^40 + 435 is taken in halves, as Spark's arithmetic must not overflow."""
    octets = F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("bigint"))

    def step(h: Column, x: Column) -> Column:
        v = h.bitwiseXOR(x)
        low = v.bitwiseAND(F.lit(_LOW)) * 435
        carry = F.shiftrightunsigned(low, 32) + F.shiftrightunsigned(v, 32) * 435 + v.bitwiseAND(F.lit(0xFFFFFF)) * 256
        return F.shiftleft(carry.bitwiseAND(F.lit(_LOW)), 32).bitwiseOR(low.bitwiseAND(F.lit(_LOW)))

    return F.when(F.octet_length(data) == 0, F.lit(_BASIS)).otherwise(F.aggregate(octets, F.lit(_BASIS).cast("bigint"), step))


def le8(value: Column) -> Column:
    """The 8 little-endian bytes of a BIGINT."""
    pairs = F.regexp_extract_all(F.lpad(F.hex(value.cast("bigint")), 16, "0"), F.lit("(..)"), F.lit(1))
    return F.unhex(F.array_join(F.reverse(pairs), ""))


def event_id(ext_span_id: Column, seq: Column, event_type: Column) -> Column:
    """Identity of an event: FNV-1a of the span's external id, the sequence number and the type tag."""
    return fnv1a64(F.concat(F.encode(ext_span_id, "utf-8"), le8(seq), F.unhex(F.lpad(F.hex(event_type.cast("bigint")), 2, "0"))))


def derive_seq(ts: Column, payload: Column) -> Column:
    """A sequence number for clients that give none."""
    return fnv1a64(F.concat(le8(ts), payload))


def unsigned_order(value: Column) -> Column:
    """Sorts as the unsigned value does."""
    return value.bitwiseXOR(F.lit(_SIGN))


def render(value: Column) -> Column:
    """The unsigned decimal string."""
    return F.conv(F.hex(value), 16, 10)


def parse_unsigned(text: Column) -> Column:
    """BIGINT bit pattern of a decimal string (a sign is allowed); null where it isn't one that fits 64 bits."""
    wide = text.try_cast("decimal(20,0)")
    long = F.when(wide.isNull() | (wide > F.lit("18446744073709551615").cast("decimal(20,0)")), None).when(text.startswith("-"), text.try_cast("bigint")).otherwise(F.conv(text, 10, -10).try_cast("bigint"))
    return F.when(text.rlike(r"^-?\d{1,18}$"), text.cast("bigint")).when(text.rlike(r"^-?\d{19,20}$"), long)


def hex_low(text: Column) -> Column:
    """The last 16 hex digits as bits; 0 where they aren't hex."""
    digits = F.right(text, F.lit(16))
    return F.when(digits.rlike("^[0-9a-fA-F]+$"), F.conv(digits, 16, -10).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def event_type_name(tag: Column) -> Column:
    out = F.lit("other")
    for name, n in EVENT_TYPES.items():
        out = F.when(tag == n, name).otherwise(out)
    return out


def event_type_tag(name: Column, other: Column | None = None) -> Column:
    """The tag of a type's name; another type's byte gets the high bit."""
    out = F.lit(0x80).bitwiseOR((F.lit(0) if other is None else other).bitwiseAND(F.lit(0x7F)))
    for known, n in EVENT_TYPES.items():
        out = F.when(name == known, n).otherwise(out)
    return out.cast("smallint")
