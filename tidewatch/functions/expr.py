"""Column expressions shared by the operators; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values
DNS_RESOLVERS = ("8.8.8.8", "8.8.4.4", "1.1.1.1", "1.0.0.1", "9.9.9.9", "149.112.112.112", "208.67.222.222", "208.67.220.220", "64.6.64.6", "64.6.65.6")
NTP_SERVERS = ("17.253.34.123", "17.253.34.253")
CDN_PREFIXES = ("13.32.0.0/15", "13.224.0.0/14", "104.16.0.0/13", "104.24.0.0/14", "151.101.0.0/16", "199.232.0.0/16", "23.0.0.0/12", "184.24.0.0/13")
INFRASTRUCTURE_PORTS = (53, 123, 5353)
FAILED_STATES = ("S0", "REJ", "RSTO", "RSTOS0", "OTH")
INTERNAL_PREFIXES = ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/29", "192.0.0.170/31", "192.168.0.0/16", "198.18.0.0/15", "240.0.0.0/4", "224.0.0.0/4")
DOCUMENTATION_PREFIXES = ("192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24")
BENIGN_AGENTS = (
    "microsoft update", "windows update", "wsus", "windows defender", "microsoft-cryptoapi", "mozilla/5.0 (windows nt", "curl/",
    "python-urllib", "go-http-client", "amazon cloudfront", "googlebot", "bingbot", "ntp", "ntpd",
)
BENIGN_SUFFIXES = (
    "windowsupdate.com", "microsoft.com", "windows.net", "azure.com", "office.com", "office365.com", "live.com", "msftconnecttest.com",
    "ocsp.verisign.net", "ocsp.digicert.com", "ctldl.windowsupdate.com", "googleapis.com", "gstatic.com", "amazon.com", "amazonaws.com",
    "cloudfront.net", "akamaiedge.net", "time.google.com", "time.windows.com", "pool.ntp.org", "ntp.org", "time.apple.com",
    "time.cloudflare.com", "time.nist.gov", "google.com", "github.com",
)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def resolve(df: DataFrame, *candidates: str) -> str | None:
    """The first of the candidate columns that the frame has."""
    return next((c for c in candidates if c in df.columns), None)


def null_nan(c) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)


def clip01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def ipv4(c) -> Column:
    """An IPv4 address as a number; null for anything else."""
    c = col(c)
    parts = [F.try_element_at(F.split(c, r"\."), F.lit(i)).try_cast("bigint") for i in (1, 2, 3, 4)]
    ok = c.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    for p in parts:
        ok = ok & (p <= 255)
    return F.when(ok, ((parts[0] * 256 + parts[1]) * 256 + parts[2]) * 256 + parts[3])


def _bounds(prefix: str) -> tuple[int, int]:
    address, _, size = prefix.partition("/")
    n = 0
    for p in address.split("."):
        n = n * 256 + int(p)
    span = 1 << (32 - int(size or 32))
    return n // span * span, n // span * span + span - 1


def in_prefixes(c, prefixes: tuple[str, ...] = CDN_PREFIXES) -> Column:
    """Whether an IPv4 address lies in one of the CIDR blocks."""

    def lies(n: Column) -> Column:
        out = F.lit(False)
        for p in prefixes:
            out = out | n.between(*_bounds(p))
        return out

    return F.coalesce(F.exists(F.array(ipv4(c)), lies), F.lit(False))  # the address is worked out once


def is_internal(c) -> Column:
    """Private, loopback, link-local or multicast, IPv4 or IPv6; documentation ranges count as external, non-addresses as not internal."""
    c = F.lower(col(c))
    v6 = c.rlike(r"^(::1?|f[cd][0-9a-f]{2}:[0-9a-f:]*|fe[89ab][0-9a-f]:[0-9a-f:]*|ff[0-9a-f]{2}:[0-9a-f:]*)$")
    return F.coalesce((in_prefixes(c, INTERNAL_PREFIXES) & ~in_prefixes(c, DOCUMENTATION_PREFIXES)) | v6, F.lit(False))


def benign_domain(c, extra: tuple[str, ...] = ()) -> Column:
    d = F.rtrim(F.lower(F.trim(col(c))), F.lit("."))
    out = F.lit(False)
    for s in (*BENIGN_SUFFIXES, *extra):
        out = out | (d == s) | d.endswith("." + s)
    return F.coalesce(out, F.lit(False))


def benign_agent(c) -> Column:
    a, out = F.lower(col(c)), F.lit(False)
    for p in BENIGN_AGENTS:
        out = out | a.contains(p)
    return F.coalesce(out, F.lit(False))


def string_entropy(c) -> Column:
    """Shannon entropy in bits over the lower-case characters; 0 for null or empty."""
    s = F.filter(F.split(F.lower(col(c)), ""), lambda x: x != "")
    n = F.size(s)
    share = lambda ch: F.size(F.filter(s, lambda x: x == ch)) / n
    total = F.aggregate(F.array_distinct(s), F.lit(0.0), lambda a, ch: a - share(ch) * F.log2(share(ch)))
    return F.coalesce(F.when(n > 0, total), F.lit(0.0))


def looks_generated(c, min_length: int = 8, entropy: float = 3.5) -> Column:
    """Whether a domain's first label reads as machine-made: long, high entropy, and no vowels, a run of six consonants or much of it in digit runs."""
    d = F.rtrim(F.lower(F.trim(col(c))), F.lit("."))
    label = F.substring_index(d, ".", 1)
    digits = F.aggregate(F.regexp_extract_all(label, F.lit(r"(\d{3,})"), F.lit(1)), F.lit(0), lambda a, x: a + F.length(x))
    odd = ~label.rlike("[aeiou]") | label.rlike("[^aeiou]{6,}") | (digits / F.greatest(F.length(label), F.lit(1)) > 0.3)
    return F.coalesce(d.contains(".") & (F.length(label) >= min_length) & (string_entropy(label) >= entropy) & odd, F.lit(False))


def answer_ips(c) -> Column:
    """Addresses in an ``ip`` or ``[a,b]`` answer string."""
    parts = F.transform(F.split(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"[\[\]'\"]", ""), ","), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | x.rlike(r"^[0-9a-fA-F:]{3,}$"))


def short_ttl(c, threshold: float = 300.0) -> Column:
    """Whether any TTL of a ``300`` or ``[60,120]`` string is short; a string that does not parse counts for nothing."""
    parts = F.transform(F.split(F.regexp_replace(col(c), r"[\[\]'\"\s]", ""), ","), lambda x: x.try_cast("double"))
    return F.coalesce(~F.exists(parts, lambda x: x.isNull()) & F.exists(parts, lambda x: x < threshold), F.lit(False))


def uri_path(c) -> Column:
    return F.substring_index(col(c), "?", 1)


def format_period(c) -> Column:
    s = col(c)
    return (
        F.when(s <= 0, F.lit("unknown"))
        .when(s < 60, F.format_string("%.0fs", s))
        .when(s < 3600, F.format_string("%.1f min", s / 60))
        .when(s < 86400, F.format_string("%.1f hr", s / 3600))
        .otherwise(F.format_string("%.1f days", s / 86400))
    )
