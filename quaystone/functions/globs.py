"""Wildcards: * for any run, ? for one character."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: Column) -> Column:
    """An anchored regular expression for a glob; every other character stands for itself."""
    quoted = F.regexp_replace(pattern, r"([\\.^$|()\[\]{}+])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def glob_match(pattern: Column, text: Column) -> Column:
    return F.rlike(text, glob_regex(pattern))


def any_glob(patterns: Column, text: Column) -> Column:
    return F.coalesce(F.exists(patterns, lambda p: glob_match(p, text)), F.lit(False))


_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_DOTTED = _OCTET + r"(\." + _OCTET + "){3}"


def _let(value: Column, f) -> Column:
    """f(value), with the value computed once and named once in the plan."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def ip_hex(ip: Column) -> Column:
    """An address as 8 hex digits (IPv4, also inside IPv6) or 32 (IPv6); null if it is none."""
    octets = lambda t: F.array_join(F.transform(F.split(t, r"\."), lambda o: F.lpad(F.lower(F.hex(o.try_cast("bigint"))), 2, "0")), "")
    groups = lambda t: F.filter(F.split(t, ":", -1), lambda g: g != "")

    def full(halves: Column) -> Column:
        left, right = groups(F.get(halves, F.lit(0))), F.coalesce(groups(F.get(halves, F.lit(1))), F.array().cast("array<string>"))
        filled = _let(F.struct(left.alias("a"), right.alias("b")), lambda h: F.concat(h["a"], F.array_repeat(F.lit("0"), F.when(F.size(halves) == 2, F.greatest(8 - F.size(h["a"]) - F.size(h["b"]), F.lit(1))).otherwise(0)), h["b"]))
        # without :: nothing is filled in, with it one group at least: either way eight are needed
        return _let(filled, lambda g: F.when(F.size(g) == 8, F.array_join(F.transform(g, lambda x: F.lpad(x, 4, "0")), "")))

    def six(plain: Column) -> Column:
        shaped = plain.rlike("^([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?(::([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?)?$") & F.contains(plain, F.lit(":"))
        return F.when(shaped, _let(full(F.split(plain, "::", -1)), lambda t: F.when(F.startswith(t, F.lit("0" * 20 + "ffff")), F.substring(t, 25, 8)).otherwise(t)))

    # a dotted end becomes two groups
    dotted = ip.rlike(f":{_DOTTED}$")
    tail = _let(octets(F.regexp_extract(ip, "([^:]*)$", 1)), lambda t: F.concat(F.regexp_extract(ip, "^(.*:)[^:]*$", 1), F.substring(t, 1, 4), F.lit(":"), F.substring(t, 5, 4)))
    return F.when(ip.rlike(f"^{_DOTTED}$"), octets(ip)).otherwise(_let(F.lower(F.when(dotted, tail).otherwise(ip)), six))


def in_cidr(ip: Column, cidr: Column) -> Column:
    """Membership of an IPv4 or IPv6 address in a network, or equality with a plain address; false for anything malformed.

    An IPv4 address is the same inside IPv6 (::ffff:a.b.c.d).
    """
    text, given = F.substring_index(cidr, "/", 1), F.regexp_extract(cidr, r"/([0-9]{1,3})$", 1).try_cast("int")
    slash = F.contains(cidr, F.lit("/"))

    def bits(base: Column) -> Column:
        inside_six = F.contains(text, F.lit(":")) & (F.length(base) == 8)
        return F.when(~slash, F.length(base) * 4).otherwise(F.when(inside_six, given - 96).otherwise(given))

    def holds(x: Column) -> Column:
        whole, rest = F.floor(x["bits"] / 4).cast("int"), F.pmod(x["bits"], F.lit(4))
        digit = lambda h: F.floor(F.conv(F.substring(h, whole + 1, F.lit(1)), 16, 10).cast("int") / F.pow(F.lit(2), 4 - rest))
        same = (F.length(x["at"]) == F.length(x["base"])) & (F.substring(x["at"], F.lit(1), whole) == F.substring(x["base"], F.lit(1), whole)) & ((rest == 0) | (digit(x["at"]) == digit(x["base"])))
        return F.coalesce(F.when(x["bits"].between(0, F.length(x["base"]) * 4), same), F.lit(False))

    parsed = _let(F.struct(ip_hex(ip).alias("at"), ip_hex(text).alias("base")), lambda y: F.struct(y["at"].alias("at"), y["base"].alias("base"), bits(y["base"]).alias("bits")))
    # addresses of different kinds are not taken apart; only ::ffff:a.b.c.d is of both
    six = lambda t: F.contains(t, F.lit(":")) & ~F.contains(F.lower(t), F.lit("ffff"))
    apart = (six(ip) & ~F.contains(text, F.lit(":"))) | (six(text) & ~F.contains(ip, F.lit(":")))
    return F.when(apart, False).otherwise(_let(parsed, holds))
