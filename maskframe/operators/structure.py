"""Aliases of URLs and file paths that keep their shape: depth, extensions, query names. Built-in expressions only."""

from __future__ import annotations

import hashlib
import re
from urllib.parse import unquote

from pyspark.sql import Column
from pyspark.sql import functions as F

DOMAIN = "example.invalid"
OPAQUE = ("mailto", "data", "javascript", "tel", "urn", "about", "blob")
#: The generic syntax of RFC 3986: scheme, authority, path, query, fragment.
PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part_token(token: Column, label: Column | str) -> Column:
    return F.substring(F.sha2(F.concat(token, F.lit("\x1f"), label if isinstance(label, Column) else F.lit(label)), 256), 1, 8)


def segment_alias(token: Column, at: Column, segment: Column) -> Column:
    """Empty and dot segments stay; of a name all from its first dot on stays, but not of a lone dot file."""
    suffix = F.when(segment.rlike(r"^\.[^.]*$"), F.lit("")).otherwise(F.regexp_extract(segment, r"^[^.]*((?:\..*)?)$", 1))
    return F.when(segment.isin("", ".", ".."), segment).otherwise(F.concat(F.lit("mf-seg-"), part_token(token, F.concat(F.lit("seg"), at.cast("string"))), suffix))


def _segments(token: Column, path: Column, separator: str) -> Column:
    return F.array_join(F.transform(F.split(path, separator), lambda s, i: segment_alias(token, i, s)), "/")


def url_alias(token: Column, url: Column) -> Column:
    """A URL of the same shape without the names of the old one; null where there is no scheme, the scheme has no
    hierarchy or the port is no number (nothing is guessed; masking fails closed on a null alias)."""
    url = F.trim(url)
    of = lambda k: F.regexp_extract(url, PARTS, k)
    authority = of(2)
    who = F.regexp_extract(authority, "^(?:(.*)@)?", 1)
    has_who, has_password = F.contains(authority, F.lit("@")), F.contains(who, F.lit(":"))
    server = F.regexp_replace(authority, "^.*@", "")
    host, port = F.regexp_extract(server, r"^(\[[^\]]*\]|[^:]*)", 1), F.regexp_extract(server, r":([0-9]*)$", 1)
    good_port = server.rlike(r"^(?:\[[^\]]*\]|[^:\[\]]*)(?::[0-9]{0,5})?$") & (F.coalesce(F.nullif(port, F.lit("")).cast("int"), F.lit(0)) <= 65535)
    user = F.when(has_who, F.concat(F.lit("mf-user-"), part_token(token, "user"), F.when(has_password, F.concat(F.lit(":mf-pw-"), part_token(token, "pw"))).otherwise(F.lit("")), F.lit("@"))).otherwise(F.lit(""))
    named = F.when(host != "", F.concat(F.lit("mf-host-"), part_token(token, "host"), F.lit(f".{DOMAIN}"))).otherwise(F.lit(""))
    start = F.when(url.rlike(r"^[^/?#]*://"), F.concat(F.lit("//"), user, named, F.when(port != "", F.concat(F.lit(":"), port)).otherwise(F.lit("")))).otherwise(F.lit(""))
    path = _segments(token, F.coalesce(F.try_url_decode(of(3)), of(3)), "/")
    fields = F.filter(F.split(of(4), "&"), lambda q: q != "")
    pair = lambda q, i: F.concat(F.regexp_extract(q, "^([^=]*)", 1), F.lit("=mf-val-"), part_token(token, F.concat(F.lit("q"), i.cast("string"))))
    asked = F.when(F.contains(of(4), F.lit("=")), F.array_join(F.transform(F.filter(fields, lambda q: F.contains(q, F.lit("="))), pair), "&")).otherwise(F.concat(F.lit("mf-val-"), part_token(token, "q")))
    query = F.when(of(4) != "", F.concat(F.lit("?"), asked)).otherwise(F.lit(""))
    end = F.when(of(5) != "", F.concat(F.lit("#mf-frag-"), part_token(token, "frag"))).otherwise(F.lit(""))
    usable = url.rlike(PARTS) & ~F.lower(of(1)).isin(*OPAQUE) & good_port
    return F.when(usable, F.concat(F.lower(of(1)), F.lit(":"), start, path, query, end))


def path_alias(token: Column, path: Column) -> Column:
    """A path of the same form (POSIX, drive or share), depth and extensions; null for an empty path."""
    share = path.rlike(r"^\\\\")
    drive = F.regexp_extract(path, "^([A-Za-z]:)", 1)
    rest = F.when(share, F.regexp_replace(path, r"^\\\\", "")).otherwise(F.regexp_replace(path, "^[A-Za-z]:", ""))
    backward = F.contains(path, F.lit("\\"))
    cut = F.when(backward, F.split(rest, r"\\")).otherwise(F.split(rest, "/"))
    named = F.transform(cut, lambda s, i: F.when(share & (i == 0), F.concat(F.lit("mf-host-"), part_token(token, "unc-host"))).otherwise(segment_alias(token, i, s)))
    joined = F.when(backward, F.array_join(named, "\\")).otherwise(F.array_join(named, "/"))
    return F.when(path != "", F.concat(F.when(share, F.lit("\\\\")).otherwise(drive), joined))


_PARTS = re.compile(PARTS, re.DOTALL)


def part_token_of(token: str, label: str) -> str:
    return hashlib.sha256(f"{token}\x1f{label}".encode()).hexdigest()[:8]


def _named(token: str, k: int, part: str) -> str:
    if part in ("", ".", ".."):
        return part
    dot = part.find(".", 0 if part.count(".") > 1 or not part.startswith(".") else 1)
    return f"mf-seg-{part_token_of(token, f'seg{k}')}{part[dot:] if dot >= 0 else ''}"


def url_alias_of(token: str, url: str) -> str | None:
    """``url_alias`` of one value."""
    found = _PARTS.match(url.strip(" "))
    if not found or found[1].lower() in OPAQUE:
        return None
    scheme, authority, path, query, fragment = found.groups()
    who, at, server = (authority or "").rpartition("@")
    shape = re.fullmatch(r"(\[[^\]]*\]|[^:\[\]]*)(?::([0-9]{0,5}))?", server)
    if not shape or int(shape[2] or 0) > 65535:
        return None
    user = f"mf-user-{part_token_of(token, 'user')}{':mf-pw-' + part_token_of(token, 'pw') if ':' in who else ''}@" if at else ""
    host = f"mf-host-{part_token_of(token, 'host')}.{DOMAIN}" if shape[1] else ""
    out = f"{scheme.lower()}:" + (f"//{user}{host}{':' + shape[2] if shape[2] else ''}" if authority is not None else "")
    out += "/".join(_named(token, k, s) for k, s in enumerate(unquote(path).split("/")))
    if query:
        pairs = [q for q in query.split("&") if "=" in q]
        named = (f"{q.partition('=')[0]}=mf-val-{part_token_of(token, f'q{k}')}" for k, q in enumerate(pairs))
        out += "?" + ("&".join(named) if "=" in query else f"mf-val-{part_token_of(token, 'q')}")
    return out + (f"#mf-frag-{part_token_of(token, 'frag')}" if fragment else "")


def path_alias_of(token: str, path: str) -> str | None:
    """``path_alias`` of one value."""
    if not path:
        return None
    share, drive = path.startswith("\\\\"), re.match("[A-Za-z]:", path)
    head = "\\\\" if share else drive[0] if drive else ""
    by = "\\" if "\\" in path else "/"
    parts = path[len(head) :].split(by)
    return head + by.join(f"mf-host-{part_token_of(token, 'unc-host')}" if share and k == 0 else _named(token, k, s) for k, s in enumerate(parts))


def path_depth(path: Column) -> Column:
    """The number of names in a path."""
    return F.size(F.filter(F.split(path, r"[/\\]"), lambda s: s != ""))


def structurally_valid(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")).isNotNull(), F.lit(False))
