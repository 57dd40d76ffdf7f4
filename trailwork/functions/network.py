"""Addresses and networks as Columns: v4 as BIGINT, and both families as hexadecimal text of 8 or 32 digits."""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
#: How v4-mapped v6 addresses begin, in hexadecimal digits.
MAPPED = "0" * 20 + "ffff"


def v4_number(ip: Column) -> Column:
    """A dotted v4 address as BIGINT, NULL for anything else."""
    number = F.aggregate(F.split(ip, r"\."), F.lit(0).cast("long"), lambda n, part: n * 256 + F.coalesce(F.try_to_number(part, F.lit("999")).cast("long"), F.lit(0)))
    return F.when(ip.rlike(_V4), number)


def v4_text(number: Column) -> Column:
    part = lambda shift: F.shiftright(number, shift).bitwiseAND(F.lit(255).cast("long")).cast("string")
    dot = F.lit(".")
    return F.concat(part(24), dot, part(16), dot, part(8), dot, part(0))


def v4_mask(number: Column, bits: int | Column) -> Column:
    """The number with all but its first bits cleared."""
    n = F.lit(bits) if isinstance(bits, int) else bits
    block = F.call_function("shiftleft", F.lit(1).cast("long"), (32 - n).cast("int"))
    return number - F.pmod(number, block)


def v4_block(ip: Column, bits: int) -> Column:
    """The v4 network of an address, as text."""
    return F.concat(v4_text(v4_mask(v4_number(ip), bits)), F.lit(f"/{bits}"))


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _number(hexadecimal: Column) -> Column:
    return F.conv(hexadecimal, 16, 10).cast("long")


def v6_hex(ip: Column) -> Column:
    """A v6 address as 32 lower-case hexadecimal digits, NULL for anything else. The last 32 bits may be dotted."""
    def spread(low: Column) -> Column:
        tail = F.lower(F.lpad(F.hex(v4_number(F.regexp_extract(low, r":([0-9.]+)$", 1))), 8, "0"))
        return F.when(low.contains("."), let(tail, lambda t: F.concat(F.regexp_extract(low, r"^(.*:)[0-9.]+$", 1), F.substring(t, 1, 4), F.lit(":"), F.substring(t, 5, 4)))).otherwise(low)

    def digits(plain: Column) -> Column:
        halves = F.split(plain, "::")
        groups = lambda i: F.filter(F.split(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), ":"), lambda g: g != "")
        missing = 8 - F.size(groups(0)) - F.size(groups(1))
        whole = F.concat(groups(0), F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), groups(1))
        fits = plain.rlike(r"^(([0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|(([0-9a-f]{1,4}:)*[0-9a-f]{1,4})?::(([0-9a-f]{1,4}:)*[0-9a-f]{1,4})?)$") & F.when(~plain.contains("::"), missing == 0).otherwise(missing >= 1)
        return F.when(fits, F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), ""))

    return F.when(ip.contains(":") & (F.length(ip) <= 45), let(spread(F.lower(ip)), digits))


def ip_hex(ip: Column) -> Column:
    """8 or 32 hexadecimal digits of an address, v4-mapped v6 as v4; NULL if it doesn't parse."""
    short = lambda v6: F.when(v6.startswith(MAPPED), F.substring(v6, 25, 8)).otherwise(v6)
    return F.when(ip.contains(":"), let(v6_hex(ip), short)).otherwise(F.lower(F.lpad(F.hex(v4_number(ip)), 8, "0")))


def ip_bytes(ip: Column) -> Column:
    """4 or 16 bytes of an address, NULL if it doesn't parse."""
    return F.unhex(ip_hex(ip))


def hex_text(digits: Column) -> Column:
    """The canonical spelling of an address given in hexadecimal digits: in v6 the first of the longest runs of zero groups is ::."""
    inner = lambda text: F.regexp_replace(text, r"^:|:$", "")

    def shortened(joined: Column) -> Column:
        v6 = inner(joined)
        for n in range(2, 9):
            run = ":0" * n + ":"
            at = F.instr(joined, run)
            cut = F.concat(inner(F.substring(joined, F.lit(1), at)), F.lit("::"), inner(F.substring(joined, at + len(run) - 1, F.length(joined))))
            v6 = F.when(at > 0, cut).otherwise(v6)
        return v6

    def spelled(d: Column) -> Column:
        groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.lower(F.hex(_number(F.substring(d, i * 4 + 1, F.lit(4))))))
        return F.when(F.length(d) == 8, let(_number(d), v4_text)).when(F.length(d) == 32, let(F.concat(F.lit(":"), F.array_join(groups, ":"), F.lit(":")), shortened))

    return let(digits, spelled)


def canonical_ip(ip: Column) -> Column:
    """Canonical spelling of an address, v4-mapped v6 as v4, NULL if it doesn't parse."""
    return F.when(ip.rlike(_V4), ip).when(ip.contains(":"), hex_text(ip_hex(ip)))


def canonical_or_raw(ip: Column) -> Column:
    return F.coalesce(canonical_ip(ip), ip)


def canonical_hostname(host: Column) -> Column:
    """A syntactically valid host name in lower case without its last dot, NULL for anything else."""
    name = F.lower(F.regexp_replace(host, r"\.$", ""))
    return F.when((F.length(host) <= 253) & name.rlike("[a-z]") & name.rlike(r"^[a-z0-9-]{1,63}(\.[a-z0-9-]{1,63})*+$"), name)


def source_key(peer: Column, client: Column | None = None) -> Column:
    """(identity, source) of whom a request is grouped by, NULL for nobody.

    A validated client behind an address peer, else the peer's canonical address, else the canonical name of a hostname
    peer, which can't vouch for a client. A client that is no address gives nobody.
    """
    client = F.lit(None).cast("string") if client is None else client
    address, name = canonical_ip(peer), canonical_hostname(peer)
    key = lambda kind, value: F.when(value.isNotNull(), F.struct(F.lit(kind).alias("identity"), value.alias("source")))
    by_address = F.when(client.isNotNull(), key("validated-client", canonical_ip(client))).otherwise(key("observed-peer", address))
    return F.when(peer.isin("", "-"), None).when(address.isNotNull(), by_address).otherwise(key("hostname-peer", name))


def masked(digits: Column, bits: Column) -> Column:
    """The first bits of an address in hexadecimal digits, the digit they end in included, with the rest cleared."""
    whole, rest = F.floor(bits / 4).cast("int"), (bits % 4).cast("int")
    last = _number(F.substring(digits, whole + 1, F.lit(1))).cast("int")
    part = F.lower(F.hex(last.bitwiseAND(F.call_function("shiftleft", F.lit(15), 4 - rest)).bitwiseAND(F.lit(15))))
    return F.concat(F.substring(digits, F.lit(1), whole), F.when(rest > 0, part).otherwise(""))


def block(ip: Column, v4_bits: int = 24, v6_bits: int = 48) -> Column:
    """The network of an address as text, of v4_bits or v6_bits."""
    v4 = lambda d: F.concat(let(v4_mask(_number(d), v4_bits), v4_text), F.lit(f"/{v4_bits}"))
    v6 = lambda d: F.concat(hex_text(F.rpad(masked(d, F.lit(v6_bits)), 32, "0")), F.lit(f"/{v6_bits}"))
    return let(ip_hex(ip), lambda d: F.when(F.length(d) == 8, v4(d)).when(F.length(d) == 32, v6(d)))


def in_any(ip: Column, networks: list[str]) -> Column:
    """Whether an address lies in one of a few literal networks of either family; mapped addresses and networks are v4."""
    ends = []
    for text in networks:
        net = ipaddress.ip_network(text, strict=False)
        low, high = (format(int(x), "08x" if net.version == 4 else "032x") for x in (net.network_address, net.broadcast_address))
        cut = 24 if low.startswith(MAPPED) and net.version == 6 and net.prefixlen >= 96 else 0
        ends.append((low[cut:], high[cut:]))
    inside = lambda d: reduce(lambda a, b: a | b, [(F.length(d) == len(low)) & d.between(low, high) for low, high in ends], F.lit(False))
    return F.coalesce(let(ip_hex(ip), inside), F.lit(False))


in_any_v4 = in_any


def networks(nets: DataFrame, cidr: str = "network") -> DataFrame:
    """Add family (4 or 6), prefix_len and base (masked digits) to rows with a CIDR or address text; other rows are left out.

    A network of v4-mapped addresses is a v4 one.
    """
    address, given = F.split_part(F.col(cidr), F.lit("/"), F.lit(1)), F.split_part(F.col(cidr), F.lit("/"), F.lit(2))
    v6 = address.contains(":")
    raw = F.when(v6, v6_hex(address)).otherwise(ip_hex(address))
    bits = F.coalesce(F.try_to_number(F.when(given != "", given), F.lit("999")).cast("int"), F.when(v6, 128).otherwise(32))
    out = nets.withColumns({"__raw": raw, "__bits": bits}).filter(F.col("__raw").isNotNull() & F.col("__bits").between(0, F.length("__raw") * 4))
    mapped = F.col("__raw").startswith(MAPPED) & (F.length("__raw") == 32) & (F.col("__bits") >= 96)
    out = out.withColumns({"__raw": F.when(mapped, F.substring("__raw", 25, 8)).otherwise(F.col("__raw")), "prefix_len": F.when(mapped, F.col("__bits") - 96).otherwise(F.col("__bits"))})
    return out.withColumns({"family": F.when(F.length("__raw") == 8, 4).otherwise(6), "base": masked(F.col("__raw"), F.col("prefix_len"))}).drop("__raw", "__bits")


def longest_prefix(ips: DataFrame, nets: DataFrame, ip: str = "ip") -> DataFrame:
    """Every (ip, network row) where the network holds the address, by equality on (family, length, masked digits).

    Only the lengths that occur are tried, so the join is an equi join whose probe side has a row for each of them. An
    address spelled as v4-mapped v6 is tried in both families.
    """
    wide = networks(nets)
    lengths = wide.select("family", "prefix_len").distinct()  # at most 162 rows
    # Out of a generator of one row, so that the digits aren't spelt again for every filter and join key.
    probes = ips.select(ip).filter(F.col(ip).isNotNull()).distinct().select(ip, F.inline(F.array(F.struct(ip_hex(F.col(ip)).alias("__one"), v6_hex(F.col(ip)).alias("__six")))))
    both = probes.filter("__one is not null").select(ip, F.explode(F.array_distinct(F.array_compact(F.array("__one", "__six")))).alias("digits")).withColumn("family", F.when(F.length("digits") == 8, 4).otherwise(6))
    tried = both.join(F.broadcast(lengths), "family").withColumn("base", masked(F.col("digits"), F.col("prefix_len")))
    return tried.join(wide, ["family", "prefix_len", "base"]).drop("digits", "family")
