"""Pieces of paths, links, packed fields, codes and flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^\\/]*$", 0))


def extension(path: Column) -> Column:
    """What follows the last dot of the last part, without the dot."""
    return F.regexp_extract(F.regexp_extract(path, r"[^\\/]*$", 0), r"\.([^.]*)$", 1)


def join_path(parent: Column, name: Column, separator: str = "\\") -> Column:
    return F.when(F.coalesce(parent, F.lit("")) == "", name).otherwise(F.concat(F.rtrim(parent, F.lit(separator)), F.lit(separator), name))


def host_of(url: Column) -> Column:
    """The host of a link, in lower case, without user and port; an IPv6 literal stays in its brackets."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    bare = F.regexp_replace(authority, r"^.*@", "")
    return F.lower(F.regexp_replace(bare, r":\d*$", ""))


def packed_field(details: Column, key: str) -> Column:
    """One field of ``Key: value ¦ Key: value``."""
    import re

    return F.trim(F.regexp_extract(details, rf"(?:^|¦ ?){re.escape(key)}: ([^¦]*)", 1))


def flag_names(mask: Column, names: list[tuple[int, str]]) -> Column:
    """The names of the bits that are set, in the table's order, joined by ``|``."""
    return F.array_join(F.array_compact(F.array(*[F.when(mask.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for bit, name in names])), "|")


def code_name(code: Column, names: dict, miss: Column | None = None) -> Column:
    """The name of a code; where there is none, ``miss`` or the code itself."""
    out = None
    for value, name in names.items():
        out = F.when(code == value, F.lit(name)) if out is None else out.when(code == value, F.lit(name))
    return out.otherwise(miss if miss is not None else code.cast("string"))


def guid_text(raw: Column) -> Column:
    """16 bytes as hex with dashes, in plain order."""
    h = F.lower(F.hex(raw))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def guid_text_mixed(raw: Column) -> Column:
    """16 bytes whose first three groups are little-endian."""
    h = F.lower(F.hex(raw))
    swapped = lambda at, n: F.concat(*[F.substring(h, at + 2 * k, 2) for k in reversed(range(n))])
    return F.concat_ws("-", swapped(1, 4), swapped(9, 2), swapped(13, 2), F.substring(h, 17, 4), F.substring(h, 21, 12))


def normalised_scalar(value: Column) -> Column:
    """Hex numbers in upper case, GUIDs in lower case, all else as it is."""
    return (
        F.when(value.rlike(r"^0[xX][0-9A-Fa-f]+$"), F.concat(F.lit("0x"), F.upper(F.substr(value, F.lit(3)))))
        .when(value.rlike(r"^\{?[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\}?$"), F.lower(value))
        .otherwise(value)
    )


def account_name(value: Column) -> tuple[Column, Column]:
    """Domain and name, parted at the last backslash. A blank or ``-`` for the name is no account, for the domain no domain."""
    clean = F.trim(value)
    name, domain = F.regexp_extract(clean, r"([^\\]*)$", 1), F.regexp_extract(clean, r"(?s)^(.*)\\[^\\]*$", 1)
    real = ~F.trim(name).isin("", "-")
    return F.when(real & ~F.trim(domain).isin("", "-"), domain), F.when(real, name)


def logon_target(text: Column) -> tuple[Column, Column]:
    """Domain and name of ``Target: domain\\name``; null where the text is none."""
    return account_name(F.when(F.startswith(text, F.lit("Target: ")), F.substr(text, F.lit(9))))


def logon_type(text: Column) -> Column:
    """The number after ``LogonType ``, which must be all the rest; null for anything else, and beyond 32 bits."""
    number = F.regexp_extract(text, r"^LogonType ([0-9]+)\z", 1).try_cast("decimal(38,0)")
    return F.when(number < 1 << 32, number.cast("long"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# The audit bits of an event's keywords.
AUDIT_BITS = [(1 << 53, "Audit success"), (1 << 52, "Audit failure")]


def audit_keywords(text: Column) -> Column:
    """The names of the audit bits in a hex mask; a mask without them, or what is no mask, as it is."""
    shown = F.trim(text)
    mask = F.conv(F.nullif(F.regexp_extract(shown, r"^(?:0[xX])*0*([0-9A-Fa-f]{1,16})\z", 1), F.lit("")), 16, -10).cast("long")
    names = F.array_join(F.array_compact(F.array(*[F.when(mask.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for bit, name in AUDIT_BITS])), ", ")
    return F.when(names != "", names).otherwise(shown)


def app_text(text: Column) -> dict[str, Column]:
    """``!!program!time!user!description`` as program (which may hold ``!``), description and time; any other text is the program, whole."""
    parts = F.split(F.substr(text, F.lit(3)), "!", -1)
    n = F.size(parts)
    packed = F.startswith(text, F.lit("!!")) & (n >= 4)
    first = F.when(F.get(parts, F.lit(0)) == "", "!").otherwise(F.get(parts, F.lit(0)))
    more = F.transform(F.slice(parts, F.lit(2), F.greatest(n - 4, F.lit(0))), lambda p: F.concat(F.lit("!"), p))
    at = F.get(parts, n - 3)
    plain = F.regexp_replace(at, r"^(\d{4})/(\d\d)/(\d\d):(\d\d:\d\d:\d\d)$", "$1-$2-$3 $4")
    return {
        "exe": F.when(packed, F.concat(first, F.array_join(more, ""))).otherwise(text),
        "description": F.when(packed, F.get(parts, n - 1)).otherwise(""),
        "at": F.when(packed & (plain != at), plain.try_cast("timestamp_ntz")),
    }


def slots(raw: Column) -> Column:
    """The little-endian 32-bit numbers of a binary list, up to the first 0xFFFFFFFF; a last piece of under four bytes is left out."""
    digits = F.hex(raw)
    n = F.floor(F.length(digits) / 8).cast("int")
    words = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.substr(digits, i * 8 + 1, F.lit(8)))
    whole = F.filter(words, lambda w: F.length(w) == 8)
    end = F.array_position(whole, "FFFFFFFF").cast("int")
    kept = F.when(end > 0, F.slice(whole, F.lit(1), F.greatest(end - 1, F.lit(0)))).otherwise(whole)
    return F.transform(kept, lambda w: F.conv(F.concat(*[F.substring(w, k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("long"))


def sid_class(sid: Column) -> Column:
    """A coarse class of a security identifier."""
    return (
        F.when(sid == "S-1-5-18", "LocalSystem")
        .when(sid == "S-1-5-19", "LocalService")
        .when(sid == "S-1-5-20", "NetworkService")
        .when(sid.rlike(r"^S-1-5-21-.*-500$"), "Administrator")
        .when(sid.rlike(r"^S-1-5-21-.*-501$"), "Guest")
        .when(sid.startswith("S-1-5-21-"), "User")
        .when(sid.startswith("S-1-5-80-"), "Service")
        .when(sid.startswith("S-1-5-90-"), "WindowManager")
        .otherwise("Other")
    )


def is_technique(value: Column) -> Column:
    return value.rlike(r"^T\d{4}(\.\d{3})?$")


def row_hash(columns: list[str]) -> Column:
    """A digest of (name, text) pairs; NULL stays apart from the empty text."""
    return F.sha2(F.to_json(F.array(*[F.array(F.lit(c), F.col(c).cast("string")) for c in columns])), 256)


def user_of_path(path: Column) -> Column:
    """The profile that a path lies in; special profiles and none give the empty text."""
    name = F.regexp_extract(path, r"(?i)^[a-z]:\\(?:users|documents and settings)\\([^\\]+)(?:\\|$)", 1)
    return F.when(F.lower(name).isin("public", "default", "default user", "all users"), "").otherwise(name)
