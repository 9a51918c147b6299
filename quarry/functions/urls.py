"""URL functions on columns: parts, assembly, hosts, domains, static resources, sanitising."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import strip
from quarry.schemas import URL_PARTS

SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
PARAMS = r"^((?:.*/)?[^/;]*);([^/]*)$"
IP = r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"
# What counts as a static resource, and what makes a link unusable.
STATIC_EXTENSIONS = ["png", "jpg", "jpeg", "gif", "css", "ico", "dtd", "svg", "scss", "vue", "ts"]
UNUSABLE = (
    r"\<|\>|\{|\}|\[|\]|\||\^|;|/node_modules/|www\.w3\.org|example\.com|jquery[-\.\w]*?\.js|\.src|\.replace|\.url|\.att|\.href"
    r"|location\.href|javascript:|location:|application/x-www-form-urlencoded|\.createObject|:location|\.path|\*#__PURE__\*|\*\$0\*|\n"
)
# End of the fixed values.
STATIC = r"\.(" + "|".join(STATIC_EXTENSIONS) + r")(\?|\z)"
#: Suffixes of two labels under which names are registered: a common label before any country, and some countries' own; of others the last label counts.
DOUBLE_SUFFIX = r"^(?:(?:co|com|net|org|gov|gob|gouv|go|edu|ac|or|ne|mil|ltd|plc|sch|nom)\.[a-z]{2}|me\.uk|(?:ad|ed|gr|lg)\.jp|re\.kr|id\.au|asn\.au|gen\.nz|geek\.nz|web\.za|law\.za|firm\.in|web\.id|in\.th)$"


def url_parts(url: Column) -> Column:
    """The six parts of a URL as a struct; a missing part is an empty string. The scheme is lower-cased, other parts keep their case."""
    text = F.regexp_replace(url, r"[\r\n\t]", "")
    part = lambda i: F.regexp_extract(text, SPLIT, i)
    path = part(3)
    split = path.rlike(PARAMS)
    return F.struct(
        F.lower(part(1)).alias("scheme"),
        part(2).alias("netloc"),
        F.when(split, F.regexp_extract(path, PARAMS, 1)).otherwise(path).alias("path"),
        F.when(split, F.regexp_extract(path, PARAMS, 2)).otherwise("").alias("params"),
        part(4).alias("query"),
        part(5).alias("fragment"),
    )


def url_join(parts: Column) -> Column:
    """The URL of six parts: empty parts leave no sign, a relative path after a host gets a slash."""
    p = {n: parts[n] for n in URL_PARTS}
    path = F.concat(p["path"], F.when(p["params"] != "", F.concat(F.lit(";"), p["params"])).otherwise(""))
    with_host = F.concat(F.lit("//"), p["netloc"], F.when((path != "") & ~F.startswith(path, F.lit("/")), "/").otherwise(""), path)
    body = F.when(p["netloc"] != "", with_host).when(F.startswith(path, F.lit("//")), F.concat(F.lit("//"), path)).otherwise(path)
    return F.concat(
        F.when(p["scheme"] != "", F.concat(p["scheme"], F.lit(":"))).otherwise(""),
        body,
        F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise(""),
        F.when(p["fragment"] != "", F.concat(F.lit("#"), p["fragment"])).otherwise(""),
    )


def host_port(netloc: Column) -> Column:
    """(host, port): split at one colon; both empty if there are more."""
    pieces = F.split(netloc, ":", -1)
    n = F.size(pieces)
    return F.struct(
        F.when(n == 1, netloc).when(n == 2, strip(F.get(pieces, F.lit(0)))).otherwise("").alias("host"),
        F.when(n == 2, strip(F.get(pieces, F.lit(1)))).otherwise("").alias("port"),
    )


def root_domain(host: Column) -> Column:
    """The registered name: the label before the suffix, and the suffix. A bare name or an address keeps a dot and no suffix."""
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    last = lambda k: F.array_join(F.slice(labels, -k, k), ".")
    double = (n >= 3) & F.lower(last(2)).rlike(DOUBLE_SUFFIX)
    return F.when(host.rlike(IP) | (n < 2), F.concat(host, F.lit("."))).when(double, last(3)).otherwise(last(2))


def rate_domain(url: Column) -> Column:
    """The name by which requests are limited: host without user and port, else the whole; lower case."""
    netloc = url_parts(url)["netloc"]
    host = F.regexp_replace(F.regexp_replace(netloc, r"^.*@", ""), r":[0-9]*$", "")
    return F.lower(F.when(host != "", host).when(netloc != "", netloc).otherwise(url))


def is_static(path: Column) -> Column:
    """Whether a path names a static resource; case counts."""
    return path.rlike(STATIC)


def sanitize_url(url: Column) -> Column:
    """The cleaned URL, or an empty string if it cannot be used."""
    clean = F.replace(F.replace(F.replace(F.replace(url, F.lit(" "), F.lit("")), F.lit("\\/"), F.lit("/")), F.lit("%3A"), F.lit(":")), F.lit("%2F"), F.lit("/"))
    netloc = F.regexp_extract(clean, SPLIT, 2)
    bad = ~clean.rlike("[a-zA-Z0-9]") | clean.rlike(UNUSABLE) | F.startswith(F.trim(clean), F.lit("javascript"))
    bad = bad | F.startswith(netloc, F.lit("127.0.0.1")) | F.startswith(netloc, F.lit("localhost"))
    return F.when(bad, "").otherwise(clean)


def link_kind(path: Column) -> Column:
    """js or url, by the path."""
    return F.when(path.rlike(r"\.js(\.map)?\z") | F.contains(path, F.lit(".js?")), "js").otherwise("url")
