"""Redaction, injection flags and address checks, as columns."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lakewatch.functions.detect import any_of
from lakewatch.functions.text import nfkc

# Personal data and their masks, in order of replacement.
PII = (
    (r"(?U)\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b", "***.***.***-**"),
    (r"(?U)\b\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2}\b", "**.***.***/****-**"),
    (r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "***@***"),
    (r"(?U)\b(?:\+55\s*)?\(?\d{2}\)?\s*9?\d{4}-?\d{4}\b", "(**)****-****"),
)
# Access tokens and their masks.
TOKENS = (
    (r"sk_live_[0-9A-Za-z]{20,}", "sk_live_***REDACTED***"),
    (r"sk_test_[0-9A-Za-z]{20,}", "sk_test_***REDACTED***"),
    (r"pk_live_[0-9A-Za-z]{20,}", "pk_live_***REDACTED***"),
    (r"whsec_[0-9A-Za-z]{20,}", "whsec_***REDACTED***"),
    (r"AIza[0-9A-Za-z_\-]{35}", "AIza***REDACTED***"),
    (r"ya29\.[0-9A-Za-z_\-]+", "ya29.***REDACTED***"),
    (r"xox[baprs]-[0-9A-Za-z\-]{10,}", "xox*-***REDACTED***"),
    (r"ghp_[0-9A-Za-z]{30,}", "ghp_***REDACTED***"),
    (r"gho_[0-9A-Za-z]{30,}", "gho_***REDACTED***"),
    (r"ghu_[0-9A-Za-z]{30,}", "ghu_***REDACTED***"),
    (r"ghs_[0-9A-Za-z]{30,}", "ghs_***REDACTED***"),
    (r"github_pat_[0-9A-Za-z_]{50,}", "github_pat_***REDACTED***"),
    (r"\b(AKIA|ASIA)[0-9A-Z]{16}\b", "***REDACTED-AWS-KEY***"),
    (r"\b\d{8,12}:[A-Za-z0-9_\-]{30,}\b", "***REDACTED-TELEGRAM-TOKEN***"),
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", "***REDACTED-PRIVATE-KEY***"),
    (r"Bearer\s+[A-Za-z0-9_\-\.]{20,}", "Bearer ***REDACTED***"),
)
# Keys whose values are masked whole.
SENSITIVE_KEYS = ("password", "passwd", "secret", "token", "api_key", "apikey", "authorization", "auth", "private_key", "service_account", "session", "cookie", "x-api-key", "x-auth-token")
# Families of injection and their patterns.
INJECTION = {
    "sql": r"(?iU)\b(union\s+select|drop\s+table|insert\s+into|delete\s+from|update\s+set|--\s|\/\*|\*\/|exec\s*\()",
    "nosql": r"(?U)\$(eq|ne|gt|lt|gte|lte|in|nin|or|and|not|where|exists|regex)\b",
    "xss": r"(?iU)<\s*script|javascript:|on(load|click|error|mouseover|focus)\s*=|<\s*iframe|<\s*svg.*on",
    "prompt_injection": r"(?iU)(ignore\s+(previous|prior|all)\s+instructions|disregard\s+the\s+above|system\s*[:=]\s*you\s+are|<\|im_start\|>|act\s+as\s+(a\s+)?system)",
    "path_traversal": r"(?i)(\.\./|\.\.\\|/etc/passwd|c:\\\\windows|%2e%2e%2f)",
    "command_injection": r"(`[^`]+`|\$\(.+?\)|;\s*(rm|cat|ls|wget|curl|bash)\b|\|\s*(rm|cat|nc)\b)",
    "ssrf": r"(?i)(localhost|127\.0\.0\.1|169\.254\.169\.254|metadata\.|::1)",
}
#: Networks that no fetched address may lie in.
PRIVATE = ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/3")


def _chain(c: Column, pairs) -> Column:
    for pattern, mask in pairs:
        c = F.regexp_replace(c, pattern, mask)
    return c


def redact_pii(c: Column) -> Column:
    return _chain(c, PII)


def has_pii(c: Column) -> Column:
    return any_of(c, [p for p, _ in PII])


def redact_tokens(c: Column) -> Column:
    return _chain(c, TOKENS)


def mask_map(m: Column) -> Column:
    """Sensitive keys' values masked whole, other values' tokens masked."""
    return F.transform_values(m, lambda k, v: F.when(F.lower(k).isin(*SENSITIVE_KEYS), F.lit("***REDACTED***")).otherwise(redact_tokens(v)))


def injection_flags(c: Column, cap: int | None = None) -> Column:
    """map<family, bool> of the text's compatibility form. The whole text is read, unless `cap` is given: then texts over `cap`
    bytes are read up to half of it."""
    c = nfkc(c if cap is None else F.when(F.octet_length(c) > cap, F.substring(c, 1, cap // 2)).otherwise(c))
    return F.create_map(*[x for k, p in INJECTION.items() for x in (F.lit(k), c.rlike(p))])


def injection_types(c: Column) -> Column:
    return F.array_sort(F.map_keys(F.map_filter(injection_flags(c), lambda k, v: v)))


def ipv4(c: Column) -> Column:
    """An IPv4 address as a long; null if it is none."""
    part = F.split(c, r"\.")
    number = sum((F.element_at(part, i + 1).cast("long") * (1 << 8 * (3 - i)) for i in range(4)), F.lit(0).cast("long"))
    return F.when(c.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?!$)|$)){4}$"), number)


def cidr_bounds(cidr: str) -> tuple[int, int]:
    net = ipaddress.ip_network(cidr)
    return int(net.network_address), int(net.broadcast_address)


def safe_url(c: Column, http_hosts: tuple[str, ...] = (), blocked_hosts: tuple[str, ...] = ("localhost", "metadata.google.internal")) -> Column:
    """Not empty, at most 2048 characters, https (http for listed hosts), no blocked host, no address of a closed network."""

    @F.pandas_udf("boolean")
    def open_v6(s: pd.Series) -> pd.Series:
        def ok(x: str) -> bool:
            try:
                a = ipaddress.ip_address(x.strip("[]"))
            except ValueError:
                return False
            return not (a.is_private or a.is_loopback or a.is_link_local or a.is_multicast or a.is_reserved or a.is_unspecified)

        return s.map(lambda x: x is None or ok(x))

    host = F.lower(F.nullif(F.regexp_extract(c, r"(?i)^[a-z]+://(?:[^/@?#]*@)?(\[[0-9a-f:.]+\]|[^/:?#]+)", 1), F.lit("")))
    scheme = F.lower(F.regexp_extract(c, r"^([A-Za-z]+)://", 1))
    bounds = [cidr_bounds(n) for n in PRIVATE]
    closed = F.coalesce(any_between(ipv4(host), bounds), F.lit(False))
    right = (scheme == "https") | ((scheme == "http") & host.isin(*http_hosts) if http_hosts else F.lit(False))
    ok = (F.length(c) > 0) & (F.length(c) <= 2048) & host.isNotNull() & right & ~host.isin(*blocked_hosts) & ~closed
    return F.coalesce(ok & F.when(host.startswith("["), open_v6(host)).otherwise(F.lit(True)), F.lit(False))


def any_between(c: Column, bounds) -> Column:
    """Whether the value, computed once, lies in one of the (lo, hi)."""
    pairs = F.array(*[F.struct(F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi")) for lo, hi in bounds])
    return F.element_at(F.transform(F.array(c), lambda x: F.exists(pairs, lambda b: x.between(b["lo"], b["hi"]))), 1)
