"""Hashing and masking of API keys and client addresses."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F

from .text import strip_blank

_V4_BYTE = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_V4 = rf"{_V4_BYTE}(?:\.{_V4_BYTE}){{3}}"
_H = "[0-9a-f]{1,4}"
_HEAD = rf"(?:{_H}(?::{_H})*)?"


def hash_key(c: Column, secret: str) -> Column:
    """HMAC-SHA256 of the stripped key as hex, built from two `sha2` calls.

    The padded secret is a literal of the plan. Keep plans out of logs and set
    `spark.sql.redaction.string.regex`, or hash keys once at ingestion.
    """
    raw = secret.encode("utf-8")
    block = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner_pad = F.lit(bytes(b ^ 0x36 for b in block))
    outer_pad = F.lit(bytes(b ^ 0x5C for b in block))
    message = F.encode(strip_blank(c), "UTF-8")
    inner = F.unhex(F.sha2(F.concat(inner_pad, message), 256))
    return F.sha2(F.concat(outer_pad, inner), 256)


def mask_key(c: Column) -> Column:
    """`first-****-last` for keys of three or more dash parts, else a few characters at both ends."""
    key = strip_blank(F.coalesce(c, F.lit("")))
    first, last = F.substring_index(key, "-", 1), F.substring_index(key, "-", -1)
    dashed = key.rlike(r"(?s)^[^-]+(?:-[^-]+){2,}$")

    def ends(n: int) -> Column:
        return F.concat(F.left(key, F.lit(n)), F.lit("****"), F.right(key, F.lit(n)))

    return (
        F.when(dashed, F.concat(first, F.lit("-****-"), last))
        .when(F.length(key) < 8, F.lit("****"))
        .when(F.length(key) >= 12, ends(4))
        .otherwise(ends(2))
    )


def mask_ip(c: Column) -> Column:
    """Hide the host part: last octet of IPv4, all but three hextets of IPv6, `unknown` otherwise."""
    ip = F.lower(strip_blank(c))
    v4 = F.concat(F.substring_index(ip, ".", 3), F.lit(".***"))

    # An embedded IPv4 tail is worth two groups and never reaches the visible ones.
    v6 = F.regexp_replace(ip, rf"(?<=:){_V4}$", "0:0")
    full = v6.rlike(rf"^{_H}(?::{_H}){{7}}$")
    short = v6.rlike(rf"^{_HEAD}::{_HEAD}$")
    left = _groups(F.substring_index(v6, "::", 1))
    right = _groups(F.substring_index(v6, "::", -1))
    spare = F.lit(8) - F.size(left) - F.size(right)
    zeros = F.array_repeat(F.lit("0"), F.greatest(spare, F.lit(0)))
    hextets = F.when(full, F.split(v6, ":")).otherwise(F.concat(left, zeros, right))
    shown = F.array_join(F.transform(F.slice(hextets, 1, 3), lambda h: F.lpad(h, 4, "0")), ":")
    masked_v6 = F.concat(shown, F.lit(":****:****:****:****:****"))

    return (
        F.when(ip.rlike(rf"^{_V4}$"), v4)
        .when(full | (short & (spare >= 1)), masked_v6)
        .otherwise(F.lit("unknown"))
    )


def _groups(c: Column) -> Column:
    return F.filter(F.split(c, ":"), lambda g: g != "")
