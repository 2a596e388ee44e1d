"""Addresses, networks, protocols and flags.

An IPv4 address is a BIGINT, so that masks, ranges and order are plain arithmetic. An IPv6 address is a BINARY of 16
bytes, which Spark orders numerically. Flows and aggregates of one family have the same columns as those of the other,
and operators tell them apart by the type. All of it is built-in expressions.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Protocol numbers (fixed values of the IP protocol registry).
PROTOCOLS = {"ICMP": 1, "GGP": 3, "TCP": 6, "IGP": 9, "UDP": 17, "GRE": 47, "ESP": 50, "ICMP6": 58, "OSPFIGP": 89, "PIM": 103, "SCTP": 132}

DNS_PORT, TCP, UDP = 53, PROTOCOLS["TCP"], PROTOCOLS["UDP"]


def parse_v4(text: Column) -> Column:
    """Dotted text as a number; anything else is null."""
    parts = F.split(text, r"\.")
    value = sum((F.try_element_at(parts, F.lit(k + 1)).try_cast("long") * (1 << 8 * (3 - k)) for k in range(4)), F.lit(0))
    return F.when(text.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"), value)


def format_v4(address: Column) -> Column:
    return F.concat_ws(".", *(F.shiftright(address, 8 * (3 - k)).bitwiseAND(255).cast("string") for k in range(4)))


def mask_v4(address: Column, prefix: int) -> Column:
    """The network of an address: its bits beyond the prefix cleared. Prefix 0 gives 0; above 32 is an error."""
    if not 0 <= prefix <= 32:
        raise ValueError(f"an IPv4 prefix has 0 to 32 bits, not {prefix}")
    return address.bitwiseAND(F.lit(((1 << prefix) - 1) << (32 - prefix)))


def broadcast_v4(net: Column, prefix: int) -> Column:
    return net + F.lit((1 << (32 - prefix)) - 1)


def cidr_v4(net: Column, prefix: int) -> Column:
    return F.concat(format_v4(net), F.lit(f"/{prefix}"))


def family(text: Column) -> Column:
    """4 or 6, by the colon."""
    return F.when(text.contains(":"), F.lit(6)).when(text.isNotNull(), F.lit(4))


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


_DIGITS = "0123456789ABCDEF"


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once however often it stands there."""
    return F.transform(F.array(value), body)[0]


def parse_v6(text: Column | str) -> Column:
    """The 16 bytes of an IPv6 address, also with a dotted tail; anything else is null."""
    none = F.array().cast("array<string>")

    def plain(text: Column) -> Column:
        tailed = r"^(.*:)(\d{1,3}(?:\.\d{1,3}){3})$"
        written = lambda tail: F.concat(F.regexp_extract(text, tailed, 1), F.hex(F.shiftright(tail, 16)), F.lit(":"), F.hex(tail.bitwiseAND(0xFFFF)))
        return F.when(~text.contains("."), text).otherwise(let(parse_v4(F.regexp_extract(text, tailed, 2)), written))

    def sides(halves: Column) -> Column:
        groups = lambda k: let(F.try_element_at(halves, F.lit(k)), lambda x: F.when(F.coalesce(x, F.lit("")) == "", none).otherwise(F.split(x, ":")))
        return F.struct(F.size(halves).alias("n"), groups(1).alias("left"), groups(2).alias("right"))

    def packed(x: Column) -> Column:
        gap = F.lit(8) - F.size(x["left"]) - F.size(x["right"])
        whole = F.when(x["n"] == 1, gap == 0).otherwise((x["n"] == 2) & (gap > 0))
        ok = whole & F.forall(F.concat(x["left"], x["right"]), lambda g: g.rlike("^[0-9a-fA-F]{1,4}$"))
        every = F.concat(x["left"], F.array_repeat(F.lit("0"), gap), x["right"])
        return F.when(ok, F.unhex(F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), "")))

    return let(let(F.split(let(_column(text), plain), "::", -1), sides), packed)


def format_v6(packed: Column | str) -> Column:
    """The usual short text: no leading zeros, and the first of the longest runs of zero groups as ::."""

    def short(long: Column) -> Column:
        out = F
        for n in range(8, 1, -1):
            run = rf"^((?:[0-9a-f]+:)*?)(?:0:){{{n - 1}}}0((?::[0-9a-f]+)*)$"
            filled = lambda k: let(F.regexp_extract(long, run, k), lambda x: F.when(x == "", ":").otherwise(x))  # noqa: B023, E731
            out = out.when(long.rlike(run), F.concat(filled(1), filled(2)))
        return out.otherwise(long)

    groups = lambda bare: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.regexp_replace(F.substring(bare, k * 4 + 1, F.lit(4)), "^0{1,3}", "")), ":")
    return F.when(_column(packed).isNotNull(), let(let(F.lower(F.hex(_column(packed))), groups), short))


def mask_v6(packed: Column | str, prefix: int) -> Column:
    """The network of an address: its bits beyond the prefix cleared. A prefix above 128 is an error."""
    if not 0 <= prefix <= 128:
        raise ValueError(f"an IPv6 prefix has 0 to 128 bits, not {prefix}")
    bare, whole, rest = F.hex(_column(packed)), prefix // 4, prefix % 4
    kept = F.substring(bare, 1, whole)
    if rest:
        digit = F.instr(F.lit(_DIGITS), F.substring(bare, whole + 1, 1)) - 1
        kept = F.concat(kept, F.substring(F.lit(_DIGITS), digit.bitwiseAND(16 - (16 >> rest)) + 1, F.lit(1)))
    return F.unhex(F.rpad(kept, 32, "0"))


def parse_any(text: Column | str) -> Column:
    """The 4 or 16 bytes of an address; null where it is none. Spark orders BINARY as unsigned bytes."""
    text = _column(text)
    return F.coalesce(F.unhex(F.lpad(F.hex(parse_v4(text)), 8, "0")), parse_v6(text))


def format_any(packed: Column | str) -> Column:
    packed = _column(packed)
    return F.when(F.octet_length(packed) == 4, format_v4(F.conv(F.hex(packed), 16, 10).cast("long"))).otherwise(format_v6(packed))


def mask_any(v4_prefix: int, v6_prefix: int):
    """A function of packed addresses to packed networks, with a prefix for each family."""
    if not (0 <= v4_prefix <= 32 and 0 <= v6_prefix <= 128):
        raise ValueError("prefix beyond the address")

    def masked(packed: Column | str) -> Column:
        packed = _column(packed)
        four = F.unhex(F.lpad(F.hex(mask_v4(F.conv(F.hex(packed), 16, 10).cast("long"), v4_prefix)), 8, "0"))
        return F.when(F.octet_length(packed) == 4, four).otherwise(mask_v6(packed, v6_prefix))

    return masked


def is_v6(rows: DataFrame, column: str) -> bool:
    """Whether a column of addresses or networks is of IPv6."""
    return rows.schema[column].dataType.typeName() == "binary"


def network(rows: DataFrame, column: str, v4_prefix: int = 24, v6_prefix: int = 48) -> Column:
    """The networks of a column of addresses, whichever family it is of."""
    return mask_v6(column, v6_prefix) if is_v6(rows, column) else mask_v4(F.col(column), v4_prefix)


def text_of(rows: DataFrame, column: str) -> Column:
    return format_v6(column) if is_v6(rows, column) else format_v4(F.col(column))


def tcp_flags(text: Column) -> Column:
    """The bit mask of eight flag characters, CWR first; any character but '.' sets its bit. Other lengths are an error."""
    bits = sum((F.when(F.substring(text, k + 1, 1) == ".", 0).otherwise(1 << (7 - k)) for k in range(8)), F.lit(0))
    return F.when(text.isNull(), None).when(F.length(text) == 8, bits).otherwise(F.raise_error(F.concat(F.lit("not eight flags: "), text)).cast("int"))


def networks(texts: list[str]) -> list[ipaddress.IPv4Network | ipaddress.IPv6Network]:
    """Networks as configured; bits set beyond the prefix are an error."""
    return [ipaddress.IPv6Network(t) if ":" in t else ipaddress.IPv4Network(t) for t in texts]


def in_networks_v4(address: Column, nets: list[ipaddress.IPv4Network | ipaddress.IPv6Network]) -> Column:
    """Whether an IPv4 address is in any of a configured list of networks; those of the other family never match."""
    found = F.lit(False)
    for net in nets:
        if net.version == 4:
            found = found | address.between(int(net.network_address), int(net.broadcast_address))
    return found


def in_networks(rows: DataFrame, column: str, nets: list[ipaddress.IPv4Network | ipaddress.IPv6Network]) -> Column:
    """Whether addresses, of whichever family the column is, are in any of the networks."""
    if not is_v6(rows, column):
        return in_networks_v4(F.col(column), nets)
    found = F.lit(False)
    for net in nets:
        if net.version == 6:
            found = found | F.col(column).between(F.lit(bytearray(net.network_address.packed)), F.lit(bytearray(net.broadcast_address.packed)))
    return found
