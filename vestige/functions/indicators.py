"""Indicators, accounts and security identifiers: what each kind may hold, and how it is written once. Null where a text isn't one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The kinds of indicators; those that are guessed, in their order; bounds in characters.
KINDS = ["ip", "domain", "hostname", "url", "email", "md5", "sha1", "sha256", "file_name", "file_path", "registry_key", "service", "scheduled_task", "other"]
GUESSED = ["sha256", "sha1", "md5", "ip", "url", "email", "domain"]
MAX_VALUE, MAX_NAME = 4096, 256
HASH_DIGITS = {"md5": 32, "sha1": 40, "sha256": 64}

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"{OCTET}(?:\.{OCTET}){{3}}"
DOMAIN = r"[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*"
SPACE = r"\p{IsWhite_Space}"
CONTROL = r"[\x00-\x08\x0A-\x1F\x7F-\x9F]"


def _whole(text: Column, pattern: str) -> Column:
    return text.rlike(rf"^(?:{pattern})\z")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_domain(text: Column) -> Column:
    return (F.length(text) <= 253) & _whole(text, DOMAIN)


def _groups(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":"))


def ipv6_groups(text: Column) -> Column:
    """The eight 16-bit numbers of an IPv6 address: ``::`` once for one zero or more, the last two as an IPv4 address."""
    tail = F.split(F.regexp_extract(text, rf":({IPV4})\z", 1), r"\.")
    pair = lambda i: F.lower(F.hex(F.get(tail, F.lit(i)).try_cast("int") * 256 + F.get(tail, F.lit(i + 1)).try_cast("int")))
    plain = F.when(text.rlike(rf":{IPV4}\z"), F.concat(F.regexp_replace(text, rf"{IPV4}\z", ""), pair(0), F.lit(":"), pair(2))).otherwise(text)

    def read(t: Column) -> Column:
        halves = F.split(t, "::")
        short = F.size(halves) == 2
        head, rest = _groups(F.get(halves, F.lit(0))), F.when(short, _groups(F.get(halves, F.lit(1)))).otherwise(F.array().cast("array<string>"))
        missing = 8 - F.size(head) - F.size(rest)
        fits = F.when(short, missing >= 1).otherwise((F.size(halves) == 1) & (missing == 0))
        zeros = F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0)).cast("int"))
        every = F.concat(head, zeros, rest)
        good = fits & F.forall(every, lambda g: g.rlike(r"^[0-9A-Fa-f]{1,4}\z"))
        return F.when(good, F.transform(every, lambda g: F.conv(g, 16, 10).cast("int")))

    return F.when(text.contains(":") & (F.length(text) <= 45) & ~text.contains(":::"), _let(plain, read))


def ipv6_text(groups: Column) -> Column:
    """An IPv6 address as it is written: the longest run of two or more zeros as ``::`` (the first of them), an IPv4 address within IPv6 with dots."""

    def write(g: Column) -> Column:
        shown = F.transform(g, lambda x: F.lower(F.hex(x)))
        zeros = F.array_join(F.transform(g, lambda x: F.when(x == 0, "0").otherwise("1")), "")
        written = F.array_join(shown, ":")
        for n in range(2, 9):
            at = F.instr(zeros, "0" * n)
            short = F.concat(F.array_join(F.slice(shown, F.lit(1), F.greatest(at - 1, F.lit(0))), ":"), F.lit("::"), F.array_join(F.slice(shown, F.greatest(at, F.lit(1)) + n, F.lit(8)), ":"))
            written = F.when(at > 0, short).otherwise(written)
        six, seven = F.get(g, F.lit(6)), F.get(g, F.lit(7))
        dotted = F.concat_ws(".", F.shiftright(six, 8), six % 256, F.shiftright(seven, 8), seven % 256)
        return F.when(zeros.startswith("00000") & (F.get(g, F.lit(5)) == 0xFFFF), F.concat(F.lit("::ffff:"), dotted)).otherwise(written)

    return _let(groups, lambda g: F.when(g.isNotNull(), write(g)))


def _host_and_port(authority: Column) -> Column:
    port = r"(?::([0-9]{1,20}))?"
    host = F.regexp_extract(authority, rf"^({DOMAIN}){port}\z", 1)
    bracketed = F.regexp_extract(authority, rf"^\[([^\]]*)\]{port}\z", 1)
    number = F.regexp_extract(authority, r":([0-9]{1,20})\z", 1)
    port_fits = ~authority.rlike(r"(?:^[^\[]*|\]):[0-9]{1,20}\z") | (F.regexp_replace(number, "^0+(?=[0-9])", "").try_cast("decimal(20,0)") <= 65535)
    return port_fits & ((host != "") & (F.length(host) <= 253) | ipv6_groups(bracketed).isNotNull())


def is_url(text: Column) -> Column:
    """http, https or ftp, and a host that is a domain or an address, after any ``user@`` and before any port; no white space."""
    authority = F.regexp_extract(text, r"^(?i:https?|ftp)://([^/?#]*)", 1)
    after_user = F.regexp_replace(authority, "^.*@", "")
    return ~text.rlike(SPACE) & _let(after_user, _host_and_port)


def is_email(text: Column) -> Column:
    return text.rlike(rf"^[^@]{{1,64}}@[^@]*\z") & ~F.regexp_extract(text, "^([^@]*)@", 1).rlike(SPACE) & is_domain(F.regexp_extract(text, r"@([^@]*)\z", 1))


def indicator(kind: str, text: Column) -> Column:
    """The text as an indicator of a kind is kept: addresses in their one form, domains, host names and hashes in lower case, others as they are.

    At most ``MAX_VALUE`` characters, not blank, no control character but tab.
    """
    if kind not in KINDS:
        raise ValueError(f"{kind} is not one of {', '.join(KINDS)}")
    if kind == "ip":
        value = F.when(_whole(text, IPV4), text).otherwise(ipv6_text(ipv6_groups(text)))
    elif kind in ("domain", "hostname"):
        value = F.when(is_domain(text), F.lower(text))
    elif kind == "url":
        value = F.when(is_url(text), text)
    elif kind == "email":
        value = F.when(is_email(text), text)
    elif kind in HASH_DIGITS:
        value = F.when(_whole(text, f"[0-9A-Fa-f]{{{HASH_DIGITS[kind]}}}"), F.lower(text))
    elif kind == "file_name":
        value = F.when(~text.rlike(r"[\\/]"), text)
    else:
        value = text
    fits = (F.char_length(text) <= MAX_VALUE) & ~_whole(text, f"{SPACE}*") & ~text.rlike(CONTROL)
    return F.when(fits, value)


def guessed_kind(text: Column) -> Column:
    """The first of ``GUESSED`` that the text is."""
    return F.coalesce(*[F.when(indicator(kind, text).isNotNull(), F.lit(kind)) for kind in GUESSED])


def sid(text: Column) -> Column:
    """``S-1-authority-sub...`` with one to fifteen numbers of 32 bits behind an authority of 48; without leading zeros."""
    bare = F.regexp_replace(F.regexp_replace(text, "^s", "S"), r"-0+(?=[0-9])", "-")
    numbers = F.transform(F.slice(F.split(bare, "-"), 3, 20), lambda x: x.try_cast("decimal(20,0)"))
    largest = F.array_max(F.slice(numbers, 2, 15))
    return F.when((F.octet_length(text) <= 200) & text.rlike(r"^[Ss]-1(?:-[0-9]{1,20}){2,16}\z") & (F.get(numbers, F.lit(0)) < 2**48) & (largest < 2**32), bare)


def account(text: Column) -> Column:
    """A struct (domain, name) of ``domain\\name``, parted at the last backslash; a domain that is blank or ``-`` is null.

    Null where the name is blank or ``-``, or either part has a control character or more than ``MAX_NAME`` characters.
    """
    cut = F.regexp_extract(text, r"^(?s:(.*))\\", 1)
    name = F.regexp_extract(text, r"(?s)([^\\]*)\z", 1)
    blank = rf"{SPACE}*-?{SPACE}*"
    domain = F.when(text.contains("\\") & ~_whole(cut, blank), cut)
    fits = lambda c: (F.char_length(c) <= MAX_NAME) & ~c.rlike(r"[\x00-\x1F\x7F-\x9F]")
    return F.when(~_whole(name, blank) & fits(name) & (domain.isNull() | fits(domain)), F.struct(domain.alias("domain"), name.alias("name")))
