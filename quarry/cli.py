"""Command line: crawl from urls, or scan local files."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from quarry import __version__
from quarry.config import Settings, default_yaml, from_environment, load_file, updated
from quarry.errors import QuarryError
from quarry.functions.status import parse_status
from quarry.log import init_log
from quarry.operators import reports
from quarry.operators.crawl import CrawlPlan, CrawlResult, crawl, validate
from quarry.operators.scan import local_scan
from quarry.operators.suffixes import read_suffix_rules
from quarry.rules import link_rules
from quarry.sinks.reports import write_csv
from quarry.sinks.terminal import tell
from quarry.sources.answers import Answers
from quarry.sources.fetch import FetchPolicy, live_fetch
from quarry.sources.files import seeds

MODES = {"1": 1, "2": 2}
#: Where a local scan is written if no file is named.
DEFAULT_OUTFILE = "scanner.log"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry", description="Find secrets and links in web pages and files.")
    p.add_argument("-V", "--version", action="store_true", help="show the version")
    p.add_argument("--debug", action="store_true", help="debug logs")
    p.add_argument("-a", "--ua", help="user agent")
    p.add_argument("-c", "--cookie", help="cookie")
    p.add_argument("-d", "--allow-domains", help="allowed hosts, shell patterns with commas")
    p.add_argument("-D", "--disallow-domains", help="hosts that are not crawled")
    p.add_argument("-f", "--url-file", help="file of urls, one a line")
    p.add_argument("-i", "--config", help="settings file")
    p.add_argument("-m", "--mode", choices=sorted(MODES), help="1: depth 1, 2: depth 2")
    p.add_argument("--max-page", type=int, help="most pages, 0 for no limit")
    p.add_argument("--max-depth", type=int, help="most depth, 0 for no limit; wins over --mode")
    p.add_argument("--max-connections", type=int)
    p.add_argument("--max-keepalive-connections", type=int)
    p.add_argument("--max-concurrent-per-domain", type=int)
    p.add_argument("--min-request-interval", type=float)
    p.add_argument("-o", "--outfile", help="CSV of a crawl, or text of a local scan")
    p.add_argument("-s", "--status", help="statuses to show, as in 200,300-400")
    p.add_argument("-x", "--proxy", help="proxy url")
    p.add_argument("-H", "--hide-regex", action="store_true", help="do not show secrets")
    p.add_argument("-F", "--follow-redirects", action="store_true", help="follow redirects")
    p.add_argument("-u", "--url", help="url to begin at")
    p.add_argument("--detail", action="store_true", help="show urls by the page they were found on")
    p.add_argument("--validate", action="store_true", help="fetch urls of unknown status once more")
    p.add_argument("-l", "--local", help="file or folder to scan instead")
    return p


def settings_of(args: argparse.Namespace) -> Settings:
    """Settings from file, environment and options."""
    settings = Settings()
    if args.config:
        settings = load_file(settings, args.config)
    elif Path("settings.yml").is_file():
        settings = load_file(settings, "settings.yml")
    else:
        try:
            Path("settings.yml").write_text(default_yaml(), encoding="utf-8")
        except (OSError, QuarryError):
            pass
    settings = from_environment(settings)
    depth = args.max_depth if args.max_depth is not None else MODES.get(args.mode or "")
    headers = settings.headers | ({"User-Agent": args.ua} if args.ua else {}) | ({"Cookie": args.cookie} if args.cookie else {})
    return updated(
        settings,
        {
            "debug": args.debug or None, "loglevel": "debug" if args.debug else None, "max_depth": depth, "max_page_num": args.max_page, "headers": headers, "proxy": args.proxy,
            "follow_redirects": args.follow_redirects or None, "max_connections": args.max_connections, "max_keepalive_connections": args.max_keepalive_connections,
            "max_concurrent_per_domain": args.max_concurrent_per_domain, "min_request_interval": args.min_request_interval,
        },
    )


def plan_of(settings: Settings, args: argparse.Namespace) -> CrawlPlan:
    return CrawlPlan(settings.rules, link_rules(settings.urlFind, settings.jsFind), settings.engine, args.allow_domains, args.disallow_domains, settings.dangerousPath, settings.max_depth, settings.max_page_num)


def policy_of(settings: Settings) -> FetchPolicy:
    return FetchPolicy(settings.headers, settings.timeout, settings.follow_redirects, settings.proxy, settings.max_concurrent_per_domain, settings.min_request_interval, settings.max_connections, settings.max_keepalive_connections)


def show(result: CrawlResult, starts, args: argparse.Namespace, ranges, rules=None) -> str:
    """The text report of a crawl; rules: public suffix rules."""
    domains = {r["domain"]: r["n"] for r in reports.seed_domains(starts, rules).collect()}
    out = ["Targets: {} in {}\n".format(sum(domains.values()), ", ".join(sorted(domains)))]
    if args.detail:
        parents = reports.with_node(reports.children_by_parent(result.edges, result.nodes, "url", ranges), result.nodes, "parent")
        out.append(reports.text_report(parents, "URLs from", "parent", "lines", depth=True))
        out.append(reports.text_report(reports.children_by_parent(result.edges, result.nodes, "js", ranges), "JS from", "parent", "lines"))
    else:
        out.append(reports.domain_report(reports.urls_per_domain(result.edges, result.nodes, starts, "url", ranges, rules), "URL from"))
        out.append(reports.domain_report(reports.urls_per_domain(result.edges, result.nodes, starts, "js", ranges, rules), "JS from"))
    domains = [r[0] for r in reports.found_domains(result.edges).orderBy("netloc").toLocalIterator()]
    out.append("\n{} Domains:\n{}\n".format(len(domains), "\n".join(domains)))
    if not args.hide_regex:
        out.append(reports.text_report(reports.with_node(reports.secrets_by(result.findings, "url"), result.nodes, "url"), "Secrets found in", "url", "secrets", "No secrets found.\n"))
    return "".join(out)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run a command; 0 if it could."""
    args = parser().parse_args(argv)
    if args.version:
        print(__version__)
        return 0
    try:
        settings = settings_of(args)
        init_log(settings.loglevel, settings.verbose, settings.debug)
        ranges = parse_status(args.status) if args.status else None
        spark = spark or SparkSession.builder.appName("quarry").getOrCreate()
        if args.local:
            found = reports.secrets_by(local_scan(spark, args.local, settings.rules, settings.engine), "path")
            tell(reports.report_pieces(found, "Secrets found in", "path", "secrets", "No secrets found.\n"), args.outfile or DEFAULT_OUTFILE)
            return 0
        starts = seeds(spark, args.url, args.url_file)
        fetch = Answers(spark).fetch(live_fetch(policy_of(settings)))
        result = crawl(starts, fetch, plan_of(settings, args))
        if args.validate:
            result.nodes = validate(result.nodes, fetch)
        tell(show(result, starts, args, ranges, read_suffix_rules(spark, settings.suffix_file) if settings.suffix_file else None))
        if args.outfile:
            write_csv(reports.csv_rows(result.nodes, result.edges, result.findings, result.fetched), args.outfile)
        return 0
    except QuarryError as error:
        print(error, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
