"""Which addresses may be fetched: scheme, port, literal hosts, and all addresses that a name resolves to.

Hosts are read as resolvers read them: characters that compatibility forms fold to
ASCII are folded, tabs and line ends dropped, full stops of other scripts taken as dots
and trailing dots left out. What does not look like a host after that is blocked. All
IPv4 and IPv6 addresses are compared in one order, as 32 hexadecimal digits (an IPv4
address as ::ffff:a.b.c.d), with sorted blocks by binary search.
"""

from __future__ import annotations

import ipaddress
import sys
import unicodedata
from collections.abc import Callable, Iterable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ports that may be fetched; ranges that are not public (first address, last address).
PORTS = [80, 443, 8000, 8080, 8443, 3000, 5000]
NOT_PUBLIC = [("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("100.64.0.0", "100.127.255.255"), ("127.0.0.0", "127.255.255.255"), ("169.254.0.0", "169.254.255.255"), ("172.16.0.0", "172.31.255.255"), ("192.0.0.0", "192.0.0.255"), ("192.0.2.0", "192.0.2.255"), ("192.168.0.0", "192.168.255.255"), ("198.18.0.0", "198.19.255.255"), ("198.51.100.0", "198.51.100.255"), ("203.0.113.0", "203.0.113.255"), ("224.0.0.0", "255.255.255.255")]
NOT_PUBLIC_6 = [("::", "1fff:ffff:ffff:ffff:ffff:ffff:ffff:ffff"), ("2001::", "2001:1ff:ffff:ffff:ffff:ffff:ffff:ffff"), ("2001:db8::", "2001:db8:ffff:ffff:ffff:ffff:ffff:ffff"), ("2002::", "2002:ffff:ffff:ffff:ffff:ffff:ffff:ffff"), ("3fff::", "3fff:ffff:ffff:ffff:ffff:ffff:ffff:ffff"), ("4000::", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff")]
MAPPED = "::ffff:0:0", "::ffff:ffff:ffff"


def number(ip: str) -> int:
    a, b, c, d = map(int, ip.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def _place(ip: str) -> int:
    """An address among all 128-bit numbers."""
    parsed = ipaddress.ip_address(ip)
    return int(parsed) + (0xFFFF << 32 if parsed.version == 4 else 0)


class Blocks:
    """Blocks of addresses (first, last) in one order, overlapping ones joined."""

    def __init__(self, blocks: Iterable[tuple[str, str]]):
        joined: list[list[int]] = []
        for a, b in sorted((_place(a), _place(b)) for a, b in blocks):
            if joined and a <= joined[-1][1] + 1:
                joined[-1][1] = max(joined[-1][1], b)
            else:
                joined.append([a, b])
        self.bounds = joined
        self.first, self.last = ([f"{x[k]:032x}" for x in joined] for k in (0, 1))

    def holds(self, place: Column) -> Column:
        """Whether an address lies in a block: a binary search for the last block that begins at or before it. Null counts as within."""
        first, last = (F.array(*map(F.lit, x)) for x in (self.first, self.last))
        n = len(self.first)
        halves = [1 << k for k in reversed(range(n.bit_length()))]
        at = F.aggregate(F.array(*map(F.lit, halves)), F.lit(-1), lambda lo, step: F.when((lo + step < n) & (F.get(first, lo + step) <= place), lo + step).otherwise(lo))
        return place.isNull() | _once(at, lambda k: (k >= 0) & (F.get(last, k) >= place))


@cache
def inner() -> Blocks:
    """What is not public, as one list of blocks: IPv4 addresses have a place of their own among those of IPv6."""
    before, after = (str(ipaddress.ip_address(_place(MAPPED[k]) + d)) for k, d in ((0, -1), (1, 1)))
    low, *others = NOT_PUBLIC_6
    return Blocks([*NOT_PUBLIC, (low[0], before), (after, low[1]), *others])


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """Names a value for an expression that reads it more than once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


@cache
def _folded() -> tuple[str, str]:
    """Characters whose compatibility form is one character of a host, and those characters; the rule is Unicode's."""
    pairs = {"。": ".", "｡": ".", "．": "."}
    for k in range(128, sys.maxunicode + 1):
        form = unicodedata.normalize("NFKC", chr(k))
        if len(form) == 1 and form.isascii() and (form.isalnum() or form in ".-"):
            pairs[chr(k)] = form.lower()
    return "".join(pairs), "".join(pairs.values())


def host_form(text: Column) -> Column:
    """A host as resolvers read it."""
    return F.regexp_replace(F.lower(F.translate(F.regexp_replace(text, r"[\t\r\n]", ""), *_folded())), r"\.+$", "")


def part_number(part: Column) -> Column:
    """A part of an address as a number: decimal, octal (leading 0) or hexadecimal (0x); null where it is none of these."""
    hexadecimal, octal = part.rlike(r"^0x[0-9a-f]{1,8}$"), part.rlike(r"^0[0-7]{1,11}$")
    return F.when(hexadecimal, F.conv(F.substring(part, 3, 8), 16, 10)).when(octal, F.conv(part, 8, 10)).when(part.rlike(r"^(0|[1-9][0-9]{0,9})$"), part).try_cast("long")


def ip_number(host: Column) -> Column:
    """The IPv4 address that a numeric host stands for: one to four parts, of which the last fills the bytes that are left; null if it is none."""
    parts = F.transform(F.split(host, r"\."), part_number)
    n = F.size(parts)
    leading, last = F.slice(parts, 1, F.greatest(n - 1, F.lit(1))), F.element_at(parts, -1)
    head = F.when(n == 1, F.lit(0).cast("long")).otherwise(F.aggregate(leading, F.lit(0).cast("long"), lambda a, x: a * 256 + x))
    room = F.pow(F.lit(256.0), 5 - n).cast("long")
    fine = (n <= 4) & F.forall(parts, lambda x: x.isNotNull()) & ((n == 1) | F.forall(leading, lambda x: x <= 255)) & (last < room)
    return F.when(fine, head * room + last)


def place4(host: Column) -> Column:
    return F.concat(F.lit("0" * 20 + "ffff"), F.lower(F.lpad(F.hex(ip_number(host)), 8, "0")))


def place6(text: Column) -> Column:
    """The 32 digits of an IPv6 address; null where it is none. Its last two groups may be written as an IPv4 address."""
    dotted = F.regexp_extract(text, r":((?:[0-9]{1,3}\.){3}[0-9]{1,3})$", 1)
    four = _once(F.lower(F.lpad(F.hex(ip_number(dotted)), 8, "0")), lambda h: F.concat(F.left(text, F.length(text) - F.length(dotted)), F.left(h, F.lit(4)), F.lit(":"), F.right(h, F.lit(4))))

    def filled(x: Column) -> Column:
        halves = F.split(x, "::")
        groups = lambda h: F.filter(F.split(h, ":"), lambda g: g != "")
        left, right = groups(F.get(halves, F.lit(0))), F.coalesce(groups(F.get(halves, F.lit(1))), F.array().cast("array<string>"))
        short = F.size(halves) == 2
        n = F.size(left) + F.size(right)
        fine = x.rlike(r"^([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?(::)?([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?$") & (F.size(halves) <= 2) & F.when(short, n <= 7).otherwise(n == 8)
        every = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(8 - n, F.lit(0))), right)
        return F.when(fine, F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ""))

    return _once(F.when(dotted == "", text).otherwise(four), filled)


def place(address: Column) -> Column:
    """The place of an address as text, of either kind; null where it is none. A zone behind % is left out."""
    text = F.lower(F.substring_index(F.trim(address), "%", 1))
    return F.when(text.contains(":"), place6(text)).when(text.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$"), place4(text))


def parts(hosts: DataFrame) -> Column:
    """scheme, host, port, six (a bracketed host) and odd (a backslash, which readers take for different things) of a row of `with_host`."""
    plain = F.regexp_replace("text", r"[\t\r\n]", "")
    scheme = F.lower(F.regexp_extract(plain, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))
    whole = F.regexp_extract(plain, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    authority = F.lower(F.regexp_replace("authority", r"[\t\r\n]", ""))
    six = authority.startswith("[")
    split = r"^\[([^\]]*)\](?::(.*))?$"
    host = F.when(six, F.regexp_extract(authority, split, 1)).otherwise(host_form(F.substring_index(authority, ":", 1)))
    given = F.when(six, F.regexp_extract(authority, split, 2)).otherwise(F.regexp_extract(authority, r"^[^:]*:(.*)$", 1))
    port = F.when(given == "", F.when(scheme == "https", 443).otherwise(80)).when(given.rlike("^[0-9]{1,5}$"), given.try_cast("int"))
    return F.struct(scheme.alias("scheme"), host.alias("host"), port.alias("port"), six.alias("six"), whole.contains("\\").alias("odd"))


NUMERIC = r"^(0x[0-9a-f]*|[0-9]+)(\.(0x[0-9a-f]*|[0-9]+))*$"
NAME = r"^[a-z0-9_\-\p{L}\p{M}]+(\.[a-z0-9_\-\p{L}\p{M}]+)*$"


def blocked(hosts: DataFrame) -> Column:
    """The reason that blocks a row of `with_host`, or null. Hosts and ports that cannot be read are blocked."""
    return _once(parts(hosts), _reason)


def _reason(x: Column) -> Column:
    """The reason for a host that is split in its parts."""
    host = x["host"]
    literal = inner().holds(F.when(x["six"], place6(host)).otherwise(place4(host)))
    within = F.when(x["six"] | host.rlike(NUMERIC), literal).otherwise((host == "localhost") | host.endswith(".localhost"))
    readable = x["six"] | host.rlike(NUMERIC) | host.rlike(NAME)
    return F.when(~x["scheme"].isin("http", "https"), "scheme").when((host == "") | x["odd"], "host").when(~F.coalesce(x["port"].isin(*PORTS), F.lit(False)), "port").when(within, "not public").when(~readable, "host")


def resolved(rows: DataFrame, answers: DataFrame, blocks: Blocks | None = None) -> DataFrame:
    """Adds blocked (a reason or null) and address (the first one to fetch from) to rows of `with_host`.

    answers: host, at (order of the answer), address. A name is public only if all its
    addresses are; a name without an answer is blocked ("no address"), and so is one
    with an answer that is no address. Answers are combined by host before the join.
    Literal hosts need no answer. Nulls in answers: a null host is left out, a null
    address is no address.
    """
    known = blocks or inner()
    spot = F.col("spot")
    own = answers.where("host is not null").select(host_form(F.col("host")).alias("__host"), "at", "address", place(F.col("address")).alias("spot"))
    by_host = own.groupBy("__host").agg(F.min_by("address", F.struct("at", "address")).alias("__address"), F.max(known.holds(spot)).alias("__inner"))
    split = rows.withColumn("__parts", parts(rows)).withColumns({"__reason": _once(F.col("__parts"), _reason), "__host": F.col("__parts.host")})
    literal = F.col("__parts.six") | F.col("__host").rlike(NUMERIC)
    joined = split.join(by_host, "__host", "left")
    reason = F.coalesce("__reason", F.when(~literal, F.when(F.col("__inner").isNull(), "no address").when(F.col("__inner"), "not public")))
    return joined.withColumn("blocked", reason).withColumn("address", F.when(F.col("blocked").isNull(), F.when(literal, F.col("__host")).otherwise(F.col("__address")))).drop("__parts", "__reason", "__host", "__address", "__inner")
