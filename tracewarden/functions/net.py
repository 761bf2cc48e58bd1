"""Addresses, authorities and host patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_H = r"[0-9A-Fa-f]{1,4}"
_V6 = "(?:" + "|".join(
    [rf"(?:{_H}:){{7}}{_H}", rf"(?:{_H}:){{1,7}}:", rf":(?:(?::{_H}){{1,7}}|:)"]
    + [rf"(?:{_H}:){{1,{n}}}(?::{_H}){{1,{7 - n}}}" for n in range(1, 7)]
    + [rf"(?:{_H}:){{6}}{_V4}", rf":(?::{_H}){{0,5}}:{_V4}"]
    + [rf"(?:{_H}:){{1,{n}}}(?::{_H}){{0,{5 - n}}}:{_V4}" for n in range(1, 6)]
) + ")"


def _ip_pattern(v4: str, v6: str) -> str:
    """A valid address of either family whose text also starts with the given pattern."""
    return rf"^(?:(?={_V4}$)(?:{v4})|(?={_V6}$)(?i:{v6}))"


# ::, ::1 in any spelling
_ZERO, _ONE = r"[0:.]+$", r"[0:]*:(?:0{0,3}1|0\.0\.0\.1)$"
_PRIVATE = _ip_pattern(
    r"10\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|192\.168\.|127\.|169\.254\.|0\.0\.0\.0$",
    rf"{_ZERO}|{_ONE}|f[cd][0-9a-f]{{2}}:",
)
_RESERVED = _ip_pattern(
    r"198\.1[89]\.|100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|192\.0\.2\.|198\.51\.100\.|203\.0\.113\."
    r"|2[45][0-9]\.|0\.0\.0\.0$",
    r"2001:0?db8:",
)
_LOOPBACK = _ip_pattern(r"127\.|0\.0\.0\.0$", rf"{_ZERO}|{_ONE}")

# Hosts that are documentation, package or licence sites rather than endpoints.
BENIGN_HOST_SUFFIXES = [
    "w3.org",
    "schema.org",
    "localhost",
    "example.com",
    "gnu.org",
    "opensource.org",
    "openfontlicense.org",
    "creativecommons.org",
    "apache.org",
    "mozilla.org",
    "python.org",
    "rust-lang.org",
    "go.dev",
    "golang.org",
    "nodejs.org",
    "npmjs.com",
    "npmjs.org",
    "github.com",
    "githubusercontent.com",
    "adoptium.net",
    "unicode.org",
    "json-schema.org",
    "mitre.org",
    "nist.gov",
    "cve.org",
    "ietf.org",
    "rfc-editor.org",
    "tailwindcss.com",
    "google.com",
    "chromium.org",
    "stackoverflow.com",
    "wikipedia.org",
    "fontawesome.com",
    "fonts.googleapis.com",
    "fonts.gstatic.com",
    "json.org",
    "yaml.org",
    "toml.io",
    "sqlite.org",
    "docker.com",
    "kubernetes.io",
    "cncf.io",
    "vercel.com",
    "netlify.com",
    "cloudflare.com",
]


def is_private_ip(ip: Column) -> Column:
    """RFC 1918, loopback, link-local, unspecified; for IPv6 loopback, unspecified, unique local."""
    return F.coalesce(ip.rlike(_PRIVATE), F.lit(False))


def is_reserved_ip(ip: Column) -> Column:
    """Special-use space that never names a real destination (benchmarking, CGNAT, documentation, class E)."""
    return F.coalesce(ip.rlike(_RESERVED), F.lit(False))


def is_loopback_ip(ip: Column) -> Column:
    """Loopback or unspecified."""
    return F.coalesce(ip.rlike(_LOOPBACK), F.lit(False))


def _port(digits: Column) -> Column:
    number = digits.try_cast("int")
    return F.when(digits.rlike("^[0-9]+$") & number.between(0, 65535), number)


def parse_remote(name: Column) -> Column:
    """``local->remote`` to struct(ip, port); null for no peer, a ``*`` peer or no port separator."""
    remote = F.regexp_extract(name, r"^\s*\S*?->(\S+)", 1)
    bracketed = remote.startswith("[")
    v6, v6_port = F.regexp_extract(remote, r"^\[(.*?)\]:(.*)$", 1), F.regexp_extract(remote, r"^\[(.*?)\]:(.*)$", 2)
    v4, v4_port = F.regexp_extract(remote, r"^(.+):([^:]*)$", 1), F.regexp_extract(remote, r"^(.+):([^:]*)$", 2)
    ip = F.when(bracketed, v6).otherwise(v4)
    port = F.when(bracketed, v6_port).otherwise(v4_port)
    usable = (remote != "") & ~remote.startswith("*") & (ip != "")
    return F.when(usable, F.struct(ip.alias("ip"), _port(port).alias("port")))


def parse_local_port(name: Column) -> Column:
    local = F.regexp_extract(name, r"^\s*(\S*?)->", 1)
    digits = F.when(local.startswith("["), F.regexp_extract(local, r"^\[.*?\]:([0-9]+)$", 1)).otherwise(
        F.regexp_extract(local, r":([0-9]+)$", 1)
    )
    return _port(digits)


def split_authority(authority: Column) -> Column:
    """``host:port`` or ``[v6]:port`` to struct(host, port)."""
    with_port, bare = r"^\[(.*?)\]:(.*)$", r"^\[(.*)\]$"
    plain = r"^(.*):([0-9]+)$"
    host = (
        F.when(authority.rlike(with_port), F.regexp_extract(authority, with_port, 1))
        .when(authority.rlike(bare), F.regexp_extract(authority, bare, 1))
        .when(authority.rlike(plain), F.regexp_extract(authority, plain, 1))
        .otherwise(authority)
    )
    digits = F.when(authority.rlike(with_port), F.regexp_extract(authority, with_port, 2)).when(
        ~authority.rlike(bare) & authority.rlike(plain), F.regexp_extract(authority, plain, 2)
    )
    return F.struct(host.alias("host"), _port(digits).alias("port"))


def normalize_host(host: Column) -> Column:
    return F.lower(F.rtrim(host, F.lit(".")))


def host_suffixes(host: Column) -> Column:
    """The host and every parent domain: ``a.b.c`` gives ``[a.b.c, b.c, c]``."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def domain_variants(pattern: Column) -> Column:
    """A pattern in canonical form; ``*.x`` also stands for the bare ``x``."""
    canonical = F.lower(F.rtrim(F.trim(pattern), F.lit(".")))
    return F.when(
        canonical.startswith("*."), F.array(canonical, F.substring(canonical, 3, 1 << 30))
    ).otherwise(F.array(canonical))


def host_matches(pattern: Column, host: Column) -> Column:
    """Exact match, or for ``*.x`` the domain ``x`` and everything below it."""
    canonical = F.lower(F.rtrim(F.trim(pattern), F.lit(".")))
    suffix = F.substring(canonical, 3, 1 << 30)
    return F.when(
        canonical.startswith("*."), (host == suffix) | host.endswith(F.concat(F.lit("."), suffix))
    ).otherwise(host == canonical)


def is_benign_host(host: Column) -> Column:
    suffixes = F.array(*[F.lit(s) for s in BENIGN_HOST_SUFFIXES])
    return host.startswith("127.") | host.startswith("www.") | F.arrays_overlap(host_suffixes(host), suffixes)
