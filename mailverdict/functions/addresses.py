"""IP addresses: canonical text, lookup names, and what reverse names say about IPv6 senders."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The lookup zone, and the host endings that name an IPv6 sender.
LOOKUP_ZONE = "query.senderbase.org"
OUTLOOK_ENDING = "outlook.com"
OUTLOOK_ESP = "Outlook"
FORWARDING_ENDING = "unverified-forwarding.1e100.net"

_IPV4 = r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"


def canonical_text(text: str | None) -> str | None:
    """Shortest text of one address; None if it is none."""
    if not text or "%" in text:
        return None
    try:
        address = ipaddress.ip_address(text)
    except ValueError:
        return None
    return str(getattr(address, "ipv4_mapped", None) or address)


_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_DOTTED = r"\.".join([_OCTET] * 4)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` computed once per row, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _hex_pair(text: Column, first: int) -> Column:
    """Two octets of the dotted end of an address as one group."""
    high, low = (F.regexp_extract(text, rf":{_DOTTED}\z", k).cast("int") for k in (first, first + 1))
    return F.lower(F.hex(high * 256 + low))


def _groups(side: Column) -> Column:
    return F.when(side == "", F.array().cast("array<string>")).otherwise(F.split(side, ":"))


def _dotted(groups: Column) -> Column:
    """The IPv4 address in the last two groups."""
    number = F.conv(F.concat(F.lpad(groups[6], 4, "0"), F.lpad(groups[7], 4, "0")), 16, 10).cast("bigint")
    return F.concat_ws(".", *(F.shiftright(number, 24 - 8 * k).bitwiseAND(F.lit(255)).cast("string") for k in range(4)))


def _shortened(groups: Column) -> Column:
    """The groups with their first longest run of two or more zeros left out."""

    def without(text: Column) -> Column:
        found = F.lit(None).cast("string")
        for count in range(2, 9):  # the longest is tried first, so it stands outermost
            run = F.lit(":" + "0:" * count)
            at = F.locate(":" + "0:" * count, text)
            left = F.substring(text, F.lit(2), at - 2)
            right = F.rtrim(F.substring(text, at + F.length(run), F.length(text)), F.lit(":"))
            found = F.when(at > 0, F.concat(left, F.lit("::"), right)).otherwise(found)
        return F.coalesce(found, F.trim(text, F.lit(":")))

    return _let(F.concat(F.lit(":"), F.array_join(groups, ":"), F.lit(":")), without)


def _from_groups(sides: Column) -> Column:
    """Canonical text of what stands before and behind `::`, if it stands anywhere."""

    def read(pair: Column) -> Column:
        left, right = pair["left"], pair["right"]
        count = F.size(left) + F.size(right)
        fits = F.when(F.size(sides) == 1, count == 8).otherwise((F.size(sides) == 2) & (count <= 7))
        valid = fits & F.forall(F.concat(left, right), lambda g: g.rlike(r"\A[0-9a-f]{1,4}\z"))
        full = F.concat(left, F.array_repeat(F.lit("0"), F.lit(8) - count), right)
        plain = F.transform(full, lambda g: F.regexp_replace(g, r"\A0+(?=.)", ""))
        mapped = lambda g: F.forall(F.slice(g, 1, 5), lambda x: x == "0") & (g[5] == "ffff")
        return F.when(valid, _let(plain, lambda g: F.when(mapped(g), _dotted(g)).otherwise(_shortened(g))))

    right = F.coalesce(F.get(sides, F.lit(1)), F.lit(""))
    return _let(F.struct(_groups(sides[0]).alias("left"), _groups(right).alias("right")), read)


def canonical_ip(raw: Column | str) -> Column:
    """Column form of `canonical_text`, NULL for no address: built-in functions only."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    text = F.lower(raw)
    end = F.length(F.regexp_extract(text, rf"{_DOTTED}\z", 0))
    spelled = F.when(
        text.rlike(rf":{_DOTTED}\z"), F.concat(F.substring(text, F.lit(1), F.length(text) - end), _hex_pair(text, 1), F.lit(":"), _hex_pair(text, 3))
    ).otherwise(text)
    ipv6 = F.when(raw.rlike(r"\A[0-9A-Fa-f:.]+\z") & raw.contains(":"), _let(F.split(spelled, "::"), _from_groups))
    return F.when(raw.rlike(rf"\A{_DOTTED}\z"), raw).otherwise(ipv6)


def is_ipv4(ip: Column) -> Column:
    return ip.rlike(_IPV4)


def lookup_name(ip: Column) -> Column:
    """Name under which an IPv4 address is listed: its octets reversed, then the zone."""
    octets = F.reverse(F.split(ip, r"\."))
    return F.when(is_ipv4(ip), F.concat(F.array_join(octets, "."), F.lit("." + LOOKUP_ZONE)))


def first_host(names: Column) -> Column:
    """First reverse name without its closing dot; '' if there is none."""
    return F.coalesce(F.regexp_replace(F.get(names, F.lit(0)), r"\.$", ""), F.lit(""))


def ipv6_domain(host: Column) -> Column:
    return (
        F.when(host.endswith(FORWARDING_ENDING), FORWARDING_ENDING)
        .when(host.endswith(OUTLOOK_ENDING), OUTLOOK_ENDING)
        .otherwise("")
    )


def ipv6_esp(host: Column) -> Column:
    return F.when(host.endswith(OUTLOOK_ENDING), OUTLOOK_ESP).otherwise("")
