"""IPv4 arithmetic and quoting, as Spark expressions. Addresses are text or whole numbers; what is no address gives 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"


def ip4_int(c: Column) -> Column:
    """Dotted text to a number; 0 if it is no IPv4 address."""
    text = F.trim(c)
    part = lambda i: F.split_part(text, F.lit("."), F.lit(i)).try_cast("bigint")
    return F.when(text.rlike(IPV4), part(1) * 16777216 + part(2) * 65536 + part(3) * 256 + part(4)).when(c.isNull(), None).otherwise(F.lit(0).cast("bigint"))


def ip4_text(c: Column) -> Column:
    n = c.cast("bigint")
    part = lambda shift: F.shiftright(n, shift).bitwiseAND(F.lit(255)).cast("string")
    return F.when(n.between(0, 4294967295), F.concat_ws(".", part(24), part(16), part(8), part(0)))


def _size(cidr: Column) -> Column:
    bits = F.split_part(cidr, F.lit("/"), F.lit(2)).try_cast("int")
    return F.when(bits.between(0, 32), F.pow(F.lit(2), F.lit(32) - bits).cast("bigint"))


def cidr4_min(c: Column) -> Column:
    """First address of a block like 10.0.0.0/8, 0 if it is none."""
    size = _size(c)
    ip = ip4_int(F.split_part(c, F.lit("/"), F.lit(1)))
    return F.coalesce(ip - ip % size, F.when(c.isNotNull(), F.lit(0).cast("bigint")))


def cidr4_max(c: Column) -> Column:
    size = _size(c)
    ip = ip4_int(F.split_part(c, F.lit("/"), F.lit(1)))
    return F.coalesce(ip - ip % size + size - 1, F.when(c.isNotNull(), F.lit(0).cast("bigint")))


def _either(c: Column) -> Column:
    return F.coalesce(c.try_cast("bigint"), ip4_int(c.cast("string")))


def ip4_between(ip: Column, low: Column, high: Column) -> Column:
    """1 or 0; the ends are numbers or addresses."""
    return F.coalesce(_either(ip).between(_either(low), _either(high)).cast("int"), F.lit(0))


def cidr4_contains(ip: Column, cidr: Column) -> Column:
    return F.coalesce((_size(cidr).isNotNull() & ip.cast("string").rlike(IPV4) & ip4_int(ip).between(cidr4_min(cidr), cidr4_max(cidr))).cast("int"), F.lit(0))


def trim_quotes(c: Column) -> Column:
    """Takes one pair of quotes off, plain or with backslashes before them."""
    return F.regexp_replace(F.trim(c), r"""^(?s)(?:\\"(.*)\\"|\\'(.*)\\'|"(.*)"|'(.*)')$""", "$1$2$3$4")


#: Functions that lookups and table loads may call by name.
SQL_FUNCTIONS = {f.__name__: f for f in (ip4_int, ip4_text, cidr4_min, cidr4_max, ip4_between, cidr4_contains, trim_quotes)}
