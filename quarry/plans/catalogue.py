"""The queries of the library, each with the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import status as st
from quarry.functions import urls
from quarry.functions.patterns import ASCII
from quarry.operators import dom, extract, filters, links, multiscan, reports, suffixes, tables
from quarry.operators import crawl as crawling
from quarry.operators.scan import local_scan as scan_files
from quarry.plans import sql
from quarry.rules import DANGEROUS_PATHS, LEGACY_RULES, PROSE_RULES, Rule, link_rules, loaded
from quarry.schemas import URL_PARTS
from quarry.session import cut, shared_dir
from quarry.sources.answers import as_of
from quarry.sources.files import seeds
from quarry.sources.schedule import start_schedule

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

RULES = loaded(PROSE_RULES)
ALLOW, DENY = ["*.example.com", "m.*"], ["blog.*", "*.th??th*.org", "spam-farm.[!a-d]xample.org"]
RANGES = st.parse_status("200,300-399")
#: More steps than any way through the link graph of our tables takes: the SQL form needs a bound, ours stops when nothing new is reached.
DEPTH = 64


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages with the derived columns."""
    return _table(spark, sf_dir, "pages").withColumns({"status": F.expr(sql.STATUS), "content_type": F.expr(sql.CONTENT_TYPE), "content_length": F.expr(sql.CONTENT_LENGTH)})


_PAGES = f"(SELECT *, {sql.STATUS} AS status, {sql.CONTENT_TYPE} AS content_type, {sql.CONTENT_LENGTH} AS content_length FROM pages)"


# Extraction


@query("secrets_all", f"SELECT DISTINCT * FROM ({sql.matches('documents', 'doc_id', 'text', RULES)})")
def secrets_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", RULES, dialect=ASCII)


_FIRST = "\nUNION ALL\n".join(f"SELECT doc_id, {sql.quoted(r.name)} AS type, regexp_extract(text, {sql.quoted(r.regex)}, 0, 'i') AS data FROM documents WHERE regexp_matches(text, {sql.quoted(r.regex)}, 'i')" for r in RULES)


@query("secrets_first", _FIRST)
def secrets_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", RULES, "first", ASCII)


@query("secrets_whole", f"SELECT DISTINCT * FROM ({sql.matches('documents', 'doc_id', 'text', RULES, whole=True)})")
def secrets_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", RULES, "whole", ASCII)


_LEGACY_EMAIL = [Rule(r.name, r.regex.replace(r"\b", ""), True) for r in LEGACY_RULES if r.name == "Email"]


@query("secrets_legacy_email", f"SELECT DISTINCT * FROM ({sql.matches('documents', 'doc_id', 'text', _LEGACY_EMAIL)})")
def secrets_legacy_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", _LEGACY_EMAIL, dialect=ASCII)


@query("page_secrets", f"SELECT DISTINCT * FROM ({sql.matches('pages', 'page_id, url', 'html', RULES)})")
def page_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_secrets(_table(spark, sf_dir, "pages"), "html", RULES, dialect=ASCII)


#: Prose rarely holds secrets; a rule for the long words that end a sentence finds something in every conversation.
_SAID = [*RULES, Rule("Last Word", r"([a-z]{6,})\.")]


@query("conversation_secrets", f"SELECT DISTINCT conv_id, role, type, data FROM ({sql.matches('conversations', 'conv_id, role', 'text', _SAID)})")
def conversation_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.extract_secrets(_table(spark, sf_dir, "conversations").select("conv_id", "role", "text"), "text", _SAID, dialect=ASCII)
    return found.distinct()


_BY_DOCUMENT = f"SELECT doc_id, count(*) AS n, string_agg(s, chr(10) ORDER BY s) AS secrets FROM (SELECT DISTINCT doc_id, type || ': ' || data AS s FROM ({sql.matches('documents', 'doc_id', 'text', RULES)})) GROUP BY doc_id"


@query("secrets_by_page", _BY_DOCUMENT)
def secrets_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.secrets_by(secrets_all(spark, sf_dir), "doc_id")


@query("secret_type_counts", f"SELECT type, count(*) AS secrets, count(DISTINCT doc_id) AS documents FROM (SELECT DISTINCT * FROM ({sql.matches('documents', 'doc_id', 'text', RULES)})) GROUP BY type")
def secret_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_all(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("secrets"), F.countDistinct("doc_id").alias("documents"))


_ROLLUP = f"SELECT coalesce(type, 'all') AS type, coalesce(source, 'all') AS source, count(*) AS secrets FROM (SELECT DISTINCT * FROM ({sql.matches('documents', 'doc_id, source', 'text', RULES)})) GROUP BY ROLLUP (type, source)"


@query("secret_rollup", _ROLLUP)
def secret_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.extract_secrets(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text", RULES, dialect=ASCII)
    counted = found.rollup("type", "source").agg(F.count(F.lit(1)).alias("secrets"))
    return counted.select(F.coalesce("type", F.lit("all")).alias("type"), F.coalesce("source", F.lit("all")).alias("source"), "secrets")


_CROSS = ", ".join(f"({sql.quoted(r.name)}, {sql.quoted(r.regex)})" for r in RULES)


@query(
    "rule_crossjoin",
    "SELECT r.name, CAST(sum(len(regexp_extract_all(d.text, r.regex, 0, 'i'))) AS BIGINT) AS hits, count(*) FILTER (WHERE regexp_matches(d.text, r.regex, 'i')) AS texts"
    f" FROM documents d CROSS JOIN (VALUES {_CROSS}) AS r(name, regex) GROUP BY r.name",
)
def rule_crossjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.rule_hits(_table(spark, sf_dir, "documents"), "text", RULES, ASCII)


_SYLLABLES = ["er", "in", "on", "an", "th", "re", "ou", "en"]
#: A pack of 512 rules, built from syllables, and the prose rules: words that hold three of them in a row, and what follows a few more.
_PACK = [*RULES, *(Rule(f"Word {a}{b}{c}", f"{a}{b}{c}[a-z]*") for a in _SYLLABLES for b in _SYLLABLES for c in _SYLLABLES)]
_PACK_VALUES = ", ".join(f"({sql.quoted(r.name)}, {sql.quoted(r.regex)}, {sql.quoted(r.name[5:] if r.name.startswith('Word ') else '')})" for r in _PACK)
_PACK_PAIRS = f"documents d JOIN (VALUES {_PACK_VALUES}) AS r(name, regex, word) ON contains(lower(d.text), r.word)"


@query("multi_rule_secrets", f"SELECT DISTINCT doc_id, name AS type, unnest(regexp_extract_all(text, regex, 0, 'i')) AS data FROM {_PACK_PAIRS}")
def multi_rule_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """517 rules over all documents by one walk through each text."""
    return extract.extract_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", _PACK, "scan", ASCII)


@query(
    "multi_rule_hits",
    f"SELECT v.name, coalesce(CAST(sum(n) AS BIGINT), 0) AS hits, count(*) FILTER (WHERE n > 0) AS texts FROM (VALUES {_PACK_VALUES}) AS v(name, regex, word) LEFT JOIN (SELECT name, len(regexp_extract_all(text, regex, 0, 'i')) AS n FROM {_PACK_PAIRS}) h ON v.name = h.name GROUP BY v.name",
)
def multi_rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiscan.scan_hits(_table(spark, sf_dir, "documents"), "text", _PACK, ASCII)


_ENTITY = "replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
_TITLES = rf"array_to_string([regexp_replace(regexp_replace({_ENTITY}, '[\r\n]', ' ', 'g'), '^\s+|\s+$', '', 'g') for x in regexp_extract_all(html, '(?is)<title(?:\s[^>]*)?>(.*?)</title>', 1)], '|')"


@query("page_titles", f"SELECT page_id, {_TITLES} AS title FROM pages")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", extract.titles(F.col("html")).alias("title"))


# URLs


@query("url_parts", f"SELECT page_id, {', '.join(URL_PARTS)} FROM {sql.with_parts('pages', 'url')}")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", urls.url_parts(F.col("url")).alias("p")).select("page_id", "p.*")


@query("url_join", f"SELECT page_id, {sql.joined()} AS url FROM (SELECT page_id, scheme, netloc, 'x' || page_id || ';v' AS path, CASE WHEN page_id % 2 = 0 THEN 'p' ELSE '' END AS params, query, fragment FROM {sql.with_parts('pages', 'url')})")
def url_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "pages").withColumn("p", urls.url_parts(F.col("url")))
    other = F.struct(
        F.col("p.scheme"), F.col("p.netloc"), F.concat(F.lit("x"), F.col("page_id"), F.lit(";v")).alias("path"), F.when(F.col("page_id") % 2 == 0, "p").otherwise("").alias("params"), F.col("p.query"), F.col("p.fragment")
    )
    return p.select("page_id", urls.url_join(other).alias("url"))


_NETLOCS = f"(SELECT netloc FROM {sql.with_parts('pages', 'url')} UNION SELECT * FROM (VALUES {', '.join(f'({sql.quoted(n)})' for n in sql.NETLOCS)}) AS v(netloc))"


def _netlocs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _table(spark, sf_dir, "pages").select(urls.url_parts(F.col("url"))["netloc"].alias("netloc"))
    return own.union(spark.createDataFrame([(n,) for n in sql.NETLOCS], "netloc string")).distinct()


@query("host_port", f"SELECT netloc, {sql.host('netloc')} AS host, {sql.port('netloc')} AS port FROM {_NETLOCS}")
def host_port(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _netlocs(spark, sf_dir).select("netloc", urls.host_port(F.col("netloc")).alias("h")).select("netloc", "h.host", "h.port")


@query("root_domain", f"SELECT netloc, {sql.root('host')} AS root FROM (SELECT netloc, {sql.host('netloc')} AS host FROM {_NETLOCS})")
def root_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _netlocs(spark, sf_dir).select("netloc", urls.root_domain(urls.host_port(F.col("netloc"))["host"]).alias("root"))


_HOSTS_OF_PAGES = f"(SELECT page_id, {sql.host('netloc')} AS host FROM {sql.with_parts('pages', 'url')})"
#: Suffix rules of all kinds: of one to three labels, wildcards and exceptions.
_SUFFIXES = ["com", "net", "org", "uk", "co.uk", "example.org", "m.example.org", "*.example.net", "!www.example.net", "*.wild", "!kept.wild"]
_SUFFIXED_HOSTS = f"(SELECT DISTINCT page_id, unnest([{{h}}, 'a.' || {{h}}, 'b.' || page_id || '.' || {{h}}, 'www.' || {{h}}, 'm.' || {{h}}, page_id || '.wild', 'x.kept.wild', 'h' || page_id || '.none']) AS host FROM {_HOSTS_OF_PAGES})"


def _suffix_rule(rule: str) -> str:
    """(length, exception) of a rule where it matches labels, the host's in reverse."""
    labels = rule.lstrip("!").split(".")[::-1]
    match = " AND ".join([f"len(l) >= {len(labels)}", *(f"l[{i}] = {sql.quoted(x)}" for i, x in enumerate(labels, 1) if x != "*")])
    return f"CASE WHEN {match} THEN {len(labels) - 1 if rule.startswith('!') else len(labels)} ELSE 0 END"


_SUFFIX_N = f"coalesce(nullif(greatest({', '.join(_suffix_rule(r) for r in _SUFFIXES if r.startswith('!'))}), 0), greatest({', '.join(_suffix_rule(r) for r in _SUFFIXES if not r.startswith('!'))}))"


@query(
    "root_domain_rules",
    f"SELECT page_id, host, CASE WHEN n = 0 THEN '' ELSE array_to_string(k[-n:], '.') END AS suffix, CASE WHEN n = 0 THEN k[-1] || '.' WHEN n >= len(k) THEN '.' || array_to_string(k[-n:], '.') ELSE array_to_string(k[-n - 1:], '.') END AS root"
    f" FROM (SELECT *, {_SUFFIX_N} AS n FROM (SELECT *, CASE WHEN regexp_matches(host, {sql.quoted(urls.IP)}) THEN [host] ELSE string_split(host, '.') END AS k, [lower(x) FOR x IN list_reverse(k)] AS l FROM {_SUFFIXED_HOSTS.format(h='host')}))",
)
def root_domain_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public suffixes and registered domains of the pages' hosts and of names made from them, by a rule file that is written for it."""
    path = f"{shared_dir(spark).rstrip('/')}/quarry-rules-{uuid.uuid4().hex}"
    spark.createDataFrame([(r,) for r in _SUFFIXES], "value string").coalesce(1).write.text(path)
    host, page = urls.host_port(urls.url_parts(F.col("url"))["netloc"])["host"], F.col("page_id").cast("string")
    made = [host, F.concat(F.lit("a."), host), F.concat(F.lit("b."), page, F.lit("."), host), F.concat(F.lit("www."), host), F.concat(F.lit("m."), host), F.concat(page, F.lit(".wild")), F.lit("x.kept.wild"), F.concat(F.lit("h"), page, F.lit(".none"))]
    hosts = _table(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(F.array(*made))).alias("host"))
    return suffixes.with_suffix(hosts, "host", suffixes.read_suffix_rules(spark, path))


@query("rate_domain", f"SELECT lower(netloc) AS domain, count(*) AS pages FROM {sql.with_parts('pages', 'url')} GROUP BY 1")
def rate_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").groupBy(urls.rate_domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("pages"))


_RAW = f"SELECT DISTINCT page_id, url AS base, data FROM ({sql.matches('pages', 'page_id, url', 'html', link_rules())} UNION ALL SELECT page_id, url, 'extra' AS type, {sql.EXTRA_PATH} AS data FROM pages) WHERE data <> ''"


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link candidates (page_id, base, data): what the link rules match, and one derived path for each page."""
    pages = _table(spark, sf_dir, "pages").withColumnRenamed("url", "base")
    found = extract.extract_secrets(pages, "html", link_rules(), dialect=ASCII).select("page_id", "base", "data")
    return found.union(pages.select("page_id", "base", F.expr(sql.EXTRA_PATH))).filter("data != ''").distinct()


@query("static_filter", f"SELECT page_id, data, {sql.static('path')} AS static FROM {sql.with_parts(f'({_RAW})', 'data')}")
def static_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("page_id", "data", urls.is_static(urls.url_parts(F.col("data"))["path"]).alias("static"))


_MORE = ["javascript:void(0)", "http://127.0.0.1/x", "http%3A%2F%2Flocalhost%2Fa", "a b c", "---", "/node_modules/x", "https://www.w3.org/1", "jquery-3.1.min.js", "/ok/path", "x;y", r"http:\/\/h.net\/p"]


@query(
    "sanitize_urls",
    f"SELECT data, {sql.sanitized('data')} AS clean FROM (SELECT data FROM ({_RAW}) UNION SELECT * FROM (VALUES {', '.join(f'({sql.quoted(m)})' for m in _MORE)}) AS v(data))",
)
def sanitize_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = spark.createDataFrame([(m,) for m in _MORE], "data string")
    return _raw(spark, sf_dir).select("data").union(more).distinct().select("data", urls.sanitize_url(F.col("data")).alias("clean"))


# Filters

_HOSTS = _HOSTS_OF_PAGES


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", urls.url_parts(F.col("url"))["netloc"].alias("netloc"))


@query("domain_allow", f"SELECT page_id FROM {_HOSTS} WHERE {sql.globs('host', ALLOW)}")
def domain_allow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hosts(spark, sf_dir).filter(filters.domain_allowed(F.col("netloc"), ALLOW)).select("page_id")


@query("domain_deny", f"SELECT page_id FROM {_HOSTS} WHERE NOT {sql.globs('host', DENY)}")
def domain_deny(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hosts(spark, sf_dir).filter(filters.domain_not_denied(F.col("netloc"), DENY)).select("page_id")


@query("domain_chain", f"SELECT page_id FROM {_HOSTS} WHERE {sql.globs('host', ALLOW)} AND NOT {sql.globs('host', DENY)}")
def domain_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hosts(spark, sf_dir).filter(filters.domain_filter(F.col("netloc"), ",".join(ALLOW), ",".join(DENY))).select("page_id")


_GLOB_TABLE_HOSTS = "(SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a.d' || event_id // 2 || '.example.net' WHEN 1 THEN 'h' || user_id || '.org' WHEN 2 THEN 'x-deny' || event_id || '-y.com' ELSE 'plain' || event_id || '.net' END AS host FROM events)"


@query(
    "domain_deny_table",
    f"SELECT event_id, host FROM {_GLOB_TABLE_HOSTS} h WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_id % 3 = 0 AND regexp_extract(h.host, '[.]d([0-9]+)[.]example[.]net$', 1) = CAST(e.event_id AS VARCHAR))"
    " AND NOT EXISTS (SELECT 1 FROM events e WHERE e.event_id % 3 = 1 AND h.host = 'h' || e.event_id || '.org') AND NOT EXISTS (SELECT 1 FROM events e WHERE e.event_id % 3 = 2 AND regexp_extract(h.host, 'deny([0-9]+)-', 1) = CAST(e.event_id AS VARCHAR))",
)
def domain_deny_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts that none of a table of patterns denies, a pattern for each event."""
    events = _table(spark, sf_dir, "events")
    name = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    n = F.col("event_id")
    globs = events.select(F.when(n % 3 == 0, name("*.d", n, ".example.net")).when(n % 3 == 1, name("h", n, ".org")).otherwise(name("*deny", n, "-*")).alias("glob"))
    host = F.when(n % 4 == 0, name("a.d", F.floor(n / 2), ".example.net")).when(n % 4 == 1, name("h", F.col("user_id"), ".org")).when(n % 4 == 2, name("x-deny", n, "-y.com")).otherwise(name("plain", n, ".net"))
    return tables.by_globs(events.select("event_id", host.alias("host")), "host", globs, deny=True)


@query(
    "range_table",
    "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM events WHERE floor(o_totalprice) >= event_id * 31 AND floor(o_totalprice) < event_id * 31 + event_id % 13)",
)
def range_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose price lies in one of as many ranges as there are events."""
    ranges = _table(spark, sf_dir, "events").select((F.col("event_id") * 31).alias("low"), (F.col("event_id") * 31 + F.col("event_id") % 13).alias("high"))
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", F.floor("o_totalprice").cast("long").alias("price"))
    return tables.by_ranges(orders, "price", ranges).select("o_orderkey")


@query("evade_paths", f"SELECT page_id, {sql.EXTRA_PATH} AS path, regexp_matches({sql.EXTRA_PATH}, '/?({'|'.join(DANGEROUS_PATHS)})', 'i') AS dangerous FROM pages")
def evade_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _table(spark, sf_dir, "pages").select("page_id", F.expr(sql.EXTRA_PATH).alias("path"))
    return path.withColumn("dangerous", filters.is_dangerous(F.col("path"), DANGEROUS_PATHS))


_KIND = "lower(trim(split_part(coalesce(content_type, ''), ';', 1)))"


@query("content_type_gate", f"SELECT page_id, {_KIND} LIKE 'text/%' OR ({_KIND} LIKE 'application/%' AND {_KIND} NOT IN ('application/octet-stream', 'application/pdf')) AS links FROM {_PAGES}")
def content_type_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", st.links_wanted(F.col("content_type")).alias("links"))


_N = "try_cast(status AS INTEGER)"


@query("status_class", f"SELECT page_id, CASE WHEN {_N} IS NULL THEN status WHEN {_N} = 200 THEN 'green' WHEN {_N} BETWEEN 300 AND 399 THEN 'yellow' WHEN {_N} BETWEEN 400 AND 499 THEN 'magenta' ELSE 'red' END AS class FROM {_PAGES}")
def status_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", st.status_class(F.col("status")).alias("class"))


@query("status_filter", f"SELECT page_id, {sql.shown('status', None)} AS shown, {sql.shown('status', RANGES)} AS shown_in_ranges FROM {_PAGES}")
def status_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", st.status_allowed(F.col("status"), None).alias("shown"), st.status_allowed(F.col("status"), RANGES).alias("shown_in_ranges"))


@query("validate_targets", f"SELECT url FROM {_PAGES} WHERE NOT regexp_matches(coalesce(status, ''), '^[0-9]+$')")
def validate_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).filter(st.unknown_status(F.col("status"))).select("url")


# Links


@query("link_kind", f"SELECT page_id, data, {sql.kind('path')} AS kind FROM {sql.with_parts(f'({_RAW})', 'data')}")
def link_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("page_id", "data", urls.link_kind(urls.url_parts(F.col("data"))["path"]).alias("kind"))


_LINK_MATCHES = f"SELECT page_id, base, data FROM ({sql.matches('(SELECT page_id, url AS base, html FROM pages)', 'page_id, base', 'html', link_rules())})"
_REGEX_LINKS = sql.resolved(_LINK_MATCHES, dom=False)
_DOM_MATCHES = "SELECT page_id, url AS base, unnest(regexp_extract_all(html, '<a\\s[^>]*?href=\"([^\"]*)\"', 1)) AS data FROM pages"
_DOM_LINKS = sql.resolved(_DOM_MATCHES, dom=True)


def _flat(found: DataFrame) -> DataFrame:
    return found.select("page_id", "base", "parts.*", F.col("url").alias("child"), "kind")


def _based(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").withColumnRenamed("url", "base")


@query("regex_links", _REGEX_LINKS)
def regex_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(links.pattern_links(_based(spark, sf_dir), "base", "html", dialect=ASCII))


@query("dom_links", _DOM_LINKS)
def dom_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(links.dom_links(_based(spark, sf_dir), "base", "html"))


@query("all_links", f"{_REGEX_LINKS}\nUNION\n{_DOM_LINKS}")
def all_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(links.extract_links(_based(spark, sf_dir), "base", "html", dialect=ASCII))


_EDGES = f"(SELECT DISTINCT base AS parent, child, kind FROM ({_REGEX_LINKS}) UNION SELECT url, {sql.SCRIPT}, 'js' FROM pages)"
_NODES = f"(SELECT child AS url, {sql.CHILD_STATUS} AS status FROM (SELECT DISTINCT child FROM {_EDGES}))"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the pages, and a derived script for each: written once, as reports read them several times."""
    scripts = _table(spark, sf_dir, "pages").select(F.col("url").alias("parent"), F.expr(sql.SCRIPT).alias("child"), F.lit("js").alias("kind"))
    return cut(regex_links(spark, sf_dir).select(F.col("base").alias("parent"), "child", "kind").union(scripts).distinct(), "edges")


def _nodes(edges: DataFrame) -> DataFrame:
    """Children with a derived status and nothing else known."""
    children = edges.select("child").distinct()
    return children.select(F.col("child").alias("url"), F.expr(sql.CHILD_STATUS).alias("status"), F.lit(-1).alias("content_length"), F.lit("").alias("content_type"), F.lit("").alias("title"))


_LINE = "url || ' [' || status || '] [Content-Length: ] [Content-Type: ] [Title: ]'"


def _children_sql(kind: str, ranges: list[tuple[int, int]] | None) -> str:
    shown = f"SELECT url AS child, CASE WHEN {sql.shown('status', ranges)} THEN {_LINE} END AS line FROM {_NODES}"
    each = f"SELECT DISTINCT e.parent, n.line FROM {_EDGES} e LEFT JOIN ({shown}) n ON e.child = n.child WHERE e.kind = '{kind}'"
    return f"SELECT parent, count(line) AS n, coalesce(string_agg(line, chr(10) ORDER BY line), '') AS lines FROM ({each}) GROUP BY parent"


@query("url_hierarchy", _children_sql("url", RANGES))
def url_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    return reports.children_by_parent(edges, _nodes(edges), "url", RANGES)


@query("js_by_page", _children_sql("js", None))
def js_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    return reports.children_by_parent(edges, _nodes(edges), "js", None)


@query("found_domains", f"SELECT DISTINCT netloc FROM {sql.with_parts(_EDGES, 'child')}")
def found_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.found_domains(_edges(spark, sf_dir))


@query(
    "node_lines",
    f"SELECT page_id, url || ' [' || status || '] [Content-Length: ' || CASE WHEN coalesce(try_cast(content_length AS INTEGER), -1) > 0 THEN content_length ELSE '' END || '] [Content-Type: ' || coalesce(content_type, '') || '] [Title: ' || {_TITLES} || ']' AS line FROM {_PAGES}",
)
def node_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = F.coalesce(F.col("content_length").try_cast("int"), F.lit(-1))
    return _pages(spark, sf_dir).select("page_id", reports.format_node(F.col("url"), F.col("status"), length, F.col("content_type"), extract.titles(F.col("html"))).alias("line"))


_SEEDS = "(SELECT url FROM pages WHERE url LIKE '%example.net%')"


def _seed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").filter("url LIKE '%example.net%'").select("url")


def _root_sql(table: str, url: str) -> str:
    return f"(SELECT *, {sql.root('_host')} AS root FROM (SELECT *, {sql.host('netloc')} AS _host FROM {sql.with_parts(table, url)}))"


_PER_DOMAIN = (
    f"SELECT bucket, unnest(CASE WHEN count(line) = 0 THEN [NULL] ELSE list(line) FILTER (WHERE line IS NOT NULL) END) AS line FROM (SELECT DISTINCT coalesce(s.root, 'Other') AS bucket, n.line FROM {_root_sql(f'(SELECT child AS url FROM {_EDGES} WHERE kind = {sql.quoted('url')} UNION SELECT parent FROM {_EDGES} WHERE kind = {sql.quoted('url')})', 'url')} u"
    f" LEFT JOIN (SELECT DISTINCT root FROM {_root_sql(_SEEDS, 'url')}) s ON u.root = s.root LEFT JOIN (SELECT url, CASE WHEN {sql.shown('status', None)} THEN {_LINE} END AS line FROM {_NODES}) n ON u.url = n.url) GROUP BY bucket"
)


@query("urls_per_root_domain", _PER_DOMAIN)
def urls_per_root_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    return reports.urls_per_domain(edges, _nodes(edges), _seed_pages(spark, sf_dir))


# Crawl


_SEED = "https://seed.example.org/start"


@query("seeds_distinct", f"SELECT DISTINCT trim(url) AS url FROM (SELECT url FROM pages UNION ALL SELECT '  ' || url || ' ' FROM pages UNION ALL SELECT {sql.quoted(_SEED)}) WHERE trim(url) <> ''")
def seeds_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    both = pages.select("url").union(pages.select(F.concat(F.lit("  "), F.col("url"), F.lit(" \t"))))
    path = f"{shared_dir(spark).rstrip('/')}/quarry-seeds-{uuid.uuid4().hex}"
    both.write.text(path)
    return seeds(spark, f" {_SEED} ", path)


@query("fetch_join", f"SELECT s.url, p.status FROM (SELECT DISTINCT url FROM (SELECT url FROM pages UNION ALL SELECT url || '/none' FROM pages)) s LEFT JOIN (SELECT url, min(status) AS status FROM {_PAGES} GROUP BY url) p ON s.url = p.url")
def fetch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    asked = pages.select("url").union(pages.select(F.concat("url", F.lit("/none"))))
    return crawling.pages_fetch(pages.groupBy("url").agg(F.min("status").alias("status")))(asked)


_ASKED = "(SELECT url FROM pages UNION SELECT 'https://hot.example.net/' || page_id || '/' || unnest(range(9)) FROM pages UNION SELECT NULL)"


@query(
    "fetch_schedule",
    f"SELECT url, domain, CAST(r % 5 AS INTEGER) AS lane, r // 5 AS turn, r * 0.25::DOUBLE AS start FROM (SELECT url, lower({sql.parts('url')['netloc']}) AS domain, row_number() OVER (PARTITION BY lower({sql.parts('url')['netloc']}) ORDER BY md5(url), url) - 1 AS r FROM {_ASKED} WHERE url IS NOT NULL)",
)
def fetch_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When the pages are asked for, and nine times as many urls of one host."""
    pages = _table(spark, sf_dir, "pages")
    paths = pages.select("page_id", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k"))
    hot = paths.select(F.concat(F.lit("https://hot.example.net/"), F.col("page_id"), F.lit("/"), F.col("k")).alias("url"))
    return start_schedule(pages.select("url").union(hot).union(pages.limit(1).select(F.lit(None).cast("string"))), 5, 0.25)


_ANSWERED = "(SELECT 'https://h' || user_id % 50 || '.net/' AS url, ts, max(event_id) AS n FROM events WHERE event_id % 3 = 0 GROUP BY ALL)"


@query(
    "answers_as_of",
    f"SELECT r.event_id, r.url, a.n AS answer, epoch_us(r.ts) - epoch_us(a.ts) AS age FROM (SELECT event_id, 'https://h' || user_id % 50 || '.net/' AS url, ts FROM events WHERE event_id % 3 <> 0) r"
    f" ASOF LEFT JOIN (SELECT * FROM {_ANSWERED}) a ON r.url = a.url AND r.ts >= a.ts WHERE a.n IS NULL OR epoch_us(r.ts) - epoch_us(a.ts) < 3600000000"
    f" UNION ALL SELECT r.event_id, r.url, NULL, NULL FROM (SELECT event_id, 'https://h' || user_id % 50 || '.net/' AS url, ts FROM events WHERE event_id % 3 <> 0) r ASOF JOIN (SELECT * FROM {_ANSWERED}) a ON r.url = a.url AND r.ts >= a.ts WHERE epoch_us(r.ts) - epoch_us(a.ts) >= 3600000000",
)
def answers_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the events ask for a url; the others are answers, which count for an hour."""
    events = _table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("https://h"), F.col("user_id") % 50, F.lit(".net/")).alias("url"), "ts")
    found = as_of(events.filter("event_id % 3 <> 0"), events.filter("event_id % 3 = 0").withColumnRenamed("event_id", "n"), "url", "ts", 3600)
    return found.select("event_id", "url", F.col("answer.n").alias("answer"), (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("answer.ts").cast("timestamp"))).alias("age"))


_GRAPH = "(SELECT page_id AS parent, (page_id * k + c) % (SELECT count(*) FROM pages) AS child FROM pages, (VALUES (3, 1), (7, 2), (5, 11)) AS v(k, c))"


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A synthetic link graph with cycles and shared children."""
    pages = _table(spark, sf_dir, "pages").select("page_id")
    n = pages.agg(F.count(F.lit(1)).alias("n"))
    steps = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(c).alias("c")) for k, c in ((3, 1), (7, 2), (5, 11))))
    return pages.join(F.broadcast(n)).select("page_id", "n", F.inline(steps)).select(F.col("page_id").alias("parent"), ((F.col("page_id") * F.col("k") + F.col("c")) % F.col("n")).alias("child"))


@query("frontier_anti", f"SELECT DISTINCT child AS url FROM {_GRAPH} g WHERE NOT EXISTS (SELECT 1 FROM {_PAGES} p WHERE p.status = '200' AND p.page_id = g.child)")
def frontier_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    visited = _pages(spark, sf_dir).filter("status = '200'").select(F.col("page_id").alias("url"))
    return crawling.frontier_after(_graph(spark, sf_dir).select(F.col("child").alias("url")), visited)


@query("frontier_limit", "SELECT DISTINCT url FROM pages ORDER BY url LIMIT 40")
def frontier_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page cap is the feature here."""
    return crawling.capped(_table(spark, sf_dir, "pages").select("url").distinct(), 40)


@query("first_parent", f"SELECT child, parent, depth FROM (SELECT child, parent, parent % 4 AS depth, row_number() OVER (PARTITION BY child ORDER BY parent % 4, parent) AS n FROM {_GRAPH}) WHERE n = 1")
def first_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawling.first_parents(_graph(spark, sf_dir).withColumn("depth", F.col("parent") % 4))


@query(
    "bfs_depth",
    f"WITH RECURSIVE e AS (SELECT DISTINCT * FROM {_GRAPH}), w(node, depth) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION SELECT e.child, w.depth + 1 FROM w JOIN e ON e.parent = w.node WHERE w.depth < {DEPTH}) SELECT node, min(depth) AS depth FROM w GROUP BY node",
)
def bfs_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = spark.createDataFrame([(0,)], "node long")
    return crawling.bfs_depths(_graph(spark, sf_dir), start).select("node", F.col("depth").cast("long").alias("depth"))


_FINDINGS = f"(SELECT DISTINCT url, type, data FROM ({sql.matches('pages', 'page_id, url', 'html', RULES)}))"


@query(
    "crawl_summary",
    f"SELECT (SELECT count(*) FROM pages) AS pages, (SELECT count(DISTINCT child) FROM {_EDGES}) AS found, (SELECT count(DISTINCT url) FROM {_PAGES} WHERE regexp_matches(status, '^[0-9]+$')) AS visited, (SELECT count(*) FROM {_FINDINGS}) AS secrets",
)
def crawl_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    found = page_secrets(spark, sf_dir).select("url", "type", "data")
    return reports.summary(pages, _edges(spark, sf_dir), pages.filter(~st.unknown_status(F.col("status"))), found)


_CSV_NODES = f"(SELECT url, {_TITLES} AS title, status, coalesce(try_cast(content_length AS INTEGER), -1) AS content_length, coalesce(content_type, '') AS content_type FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS rn FROM {_PAGES}) WHERE rn = 1)"


@query(
    "csv_report",
    f'SELECT w.url AS "URL", coalesce(n.title, \'\') AS "Title", coalesce(n.status, \'Unknown\') AS "Response Code", CAST(coalesce(n.content_length, -1) AS BIGINT) AS "Content Length", coalesce(n.content_type, \'\') AS "Content Type", coalesce(s.secrets, \'\') AS "Secrets"'
    f" FROM (SELECT parent AS url FROM {_EDGES} WHERE kind = 'url' UNION SELECT child FROM {_EDGES} WHERE kind = 'url' UNION SELECT url FROM pages) w LEFT JOIN {_CSV_NODES} n ON w.url = n.url"
    f" LEFT JOIN (SELECT url, string_agg(s, chr(10) ORDER BY s) AS secrets FROM (SELECT DISTINCT url, type || ': ' || data AS s FROM {_FINDINGS}) GROUP BY url) s ON w.url = s.url",
)
def csv_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    first = pages.withColumn("_n", F.row_number().over(Window.partitionBy("url").orderBy("page_id"))).filter("_n = 1")
    nodes = first.select("url", extract.titles(F.col("html")).alias("title"), "status", F.coalesce(F.col("content_length").try_cast("int"), F.lit(-1)).alias("content_length"), F.coalesce("content_type", F.lit("")).alias("content_type"))
    rows = reports.csv_rows(nodes, _edges(spark, sf_dir), page_secrets(spark, sf_dir).select("url", "type", "data"), pages.select("url"))
    return rows.withColumn("Content Length", F.col("Content Length").cast("long"))


@query("validate_pass", f"SELECT url, CASE WHEN regexp_matches(status, '^[0-9]+$') OR content_type IS NULL THEN status ELSE '204' END AS status FROM {_PAGES}")
def validate_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages may share a url; each has its own status and its own answer, so they are asked for by page."""
    pages = _pages(spark, sf_dir)
    answers = pages.filter("content_type IS NOT NULL").select("page_id", F.lit("204").alias("status"))
    return crawling.validate(pages.select("page_id", "url", "status"), crawling.pages_fetch(answers, "page_id"), "page_id").select("url", "status")


_FETCHED = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS rn FROM {_PAGES}) WHERE rn = 1 AND NOT regexp_matches({sql.parts('url')['path']}, '/?({'|'.join(DANGEROUS_PATHS)})', 'i'))"
_CRAWLED = f"(SELECT base AS parent, child FROM ({_REGEX_LINKS}\nUNION\n{_DOM_LINKS}) l WHERE kind = 'url' AND page_id IN (SELECT page_id FROM {_FETCHED} WHERE {_KIND} LIKE 'text/%' OR ({_KIND} LIKE 'application/%' AND {_KIND} NOT IN ('application/octet-stream', 'application/pdf'))))"


@query(
    "crawl_pages",
    f'SELECT w.url AS "URL", coalesce(n.title, \'\') AS "Title", coalesce(n.status, \'Unknown\') AS "Response Code", CAST(coalesce(n.content_length, -1) AS BIGINT) AS "Content Length", coalesce(n.content_type, \'\') AS "Content Type", coalesce(s.secrets, \'\') AS "Secrets"'
    f" FROM (SELECT parent AS url FROM {_CRAWLED} UNION SELECT child FROM {_CRAWLED} UNION SELECT url FROM {_FETCHED}) w"
    f" LEFT JOIN (SELECT url, {_TITLES} AS title, status, coalesce(try_cast(content_length AS INTEGER), -1) AS content_length, content_type FROM {_FETCHED}) n ON w.url = n.url"
    f" LEFT JOIN (SELECT url, string_agg(s, chr(10) ORDER BY s) AS secrets FROM (SELECT DISTINCT url, type || ': ' || data AS s FROM ({sql.matches(_FETCHED, 'url', 'html', RULES)})) GROUP BY url) s ON w.url = s.url",
)
def crawl_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl of all pages as its seeds; what they link to is asked for in the table as well."""
    once = Window.partitionBy("url").orderBy("page_id")
    pages = _pages(spark, sf_dir).withColumnRenamed("html", "body").withColumn("_n", F.row_number().over(once)).filter("_n = 1")
    find_links = lambda df, base, text: links.extract_links(df, base, text, dialect=ASCII)
    plan = crawling.CrawlPlan(rules=RULES, max_depth=1, max_pages=0, find_links=find_links)
    done = crawling.crawl(pages.select("url"), crawling.pages_fetch(pages.select("url", "status", "content_type", "content_length", "body")), plan)
    rows = reports.csv_rows(done.nodes, done.edges, done.findings, done.fetched)
    return rows.withColumn("Content Length", F.col("Content Length").cast("long"))


@query(
    "dom_elements",
    "SELECT page_id, url, CAST(n AS BIGINT) AS n, regexp_extract(a, '<a\\s[^>]*?href=\"([^\"]*)\"', 1) AS href, replace(regexp_extract(a, '(?s)>(.*)</a>$', 1), '&amp;', '&') AS text"
    " FROM (SELECT page_id, url, unnest(found) AS a, generate_subscripts(found, 1) AS n FROM (SELECT page_id, url, regexp_extract_all(html, '(?s)<a\\s.*?</a>') AS found FROM pages))",
)
def dom_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anchors of each page, with their place, target and text, by the table function."""
    dom.register_functions(spark)
    pages = _table(spark, sf_dir, "pages")
    return spark.sql("SELECT page_id, url, CAST(e.n AS BIGINT) AS n, e.attrs['href'] AS href, e.text AS text FROM {pages} AS p, LATERAL html_elements(p.html, 'a') AS e", pages=pages)


@query("local_scan", f"SELECT DISTINCT doc_id // 100 AS folder, type, data FROM ({sql.matches('documents', 'doc_id', 'text', RULES)})")
def local_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of the texts of documents as files, which are written for it: a folder for every hundred ids."""
    folder = f"{shared_dir(spark).rstrip('/')}/quarry-scan-{uuid.uuid4().hex}"
    texts = _table(spark, sf_dir, "documents").select("text", F.floor(F.col("doc_id") / 100).alias("folder"))
    texts.repartition("folder").write.partitionBy("folder").text(folder)
    found = scan_files(spark, folder, RULES)
    return found.select(F.regexp_extract("path", "folder=([0-9]+)", 1).cast("long").alias("folder"), "type", "data").distinct()
