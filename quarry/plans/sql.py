"""SQL pieces shared by the queries' SQL forms."""

from __future__ import annotations

from quarry.functions import urls
from quarry.functions.patterns import glob_to_regex
from quarry.rules import Rule

#: Columns that the pages table lacks, derived alike in both forms.
STATUS = "CASE page_id % 7 WHEN 0 THEN '200' WHEN 1 THEN '302' WHEN 2 THEN '404' WHEN 3 THEN '500' WHEN 4 THEN 'Unknown' WHEN 5 THEN '204' ELSE '301' END"
CONTENT_TYPE = (
    "CASE page_id % 6 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'application/javascript' WHEN 2 THEN 'application/pdf' WHEN 3 THEN NULL"
    " WHEN 4 THEN 'image/png' ELSE ' TEXT/Plain ' END"
)
CONTENT_LENGTH = "CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 5 = 1 THEN 'none' ELSE CAST((page_id * 37) % 5000 AS VARCHAR(10)) END"
EXTRA_PATH = "CASE page_id % 5 WHEN 0 THEN '/user/Logout' WHEN 1 THEN '/a/deleteAll?x=1' WHEN 2 THEN '/updates.html' WHEN 3 THEN '/static/app.js.map' ELSE '/img/a.png?v=2' END"
SCRIPT = "'https://cdn' || CAST(page_id % 4 AS VARCHAR(10)) || '.example.net/lib' || CAST(page_id % 10 AS VARCHAR(10)) || '.js'"
CHILD_STATUS = "CASE length(child) % 6 WHEN 0 THEN '200' WHEN 1 THEN '302' WHEN 2 THEN '404' WHEN 3 THEN '500' WHEN 4 THEN 'Unknown' ELSE '204' END"
NETLOCS = ["example.com", "example.com:8080", " spaced : 90 ", "user:pw@h:80", "[::1]:80", "", "127.0.0.1:9", "localhost", "a.b.co.uk", "x.y.example.org:443"]


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def matches(table: str, columns: str, text: str, rules: list[Rule], whole: bool = False) -> str:
    """(columns, type, data) of all matches of all rules."""
    each = [f"SELECT {columns}, {quoted(r.name)} AS type, coalesce(m, '') AS data FROM (SELECT {columns}, unnest(regexp_extract_all({text}, {quoted(r.regex)}, {1 if r.groups and not whole else 0}, 'i')) AS m FROM {table})" for r in rules]
    return "\nUNION ALL\n".join(each)


def parts(url: str) -> dict[str, str]:
    """Expressions of the six parts of a url expression."""
    path = f"regexp_extract({url}, {quoted(urls.SPLIT)}, 3)"
    split = f"regexp_matches({path}, {quoted(urls.PARAMS)})"
    return {
        "scheme": f"lower(regexp_extract({url}, {quoted(urls.SPLIT)}, 1))",
        "netloc": f"regexp_extract({url}, {quoted(urls.SPLIT)}, 2)",
        "path": f"CASE WHEN {split} THEN regexp_extract({path}, {quoted(urls.PARAMS)}, 1) ELSE {path} END",
        "params": f"CASE WHEN {split} THEN regexp_extract({path}, {quoted(urls.PARAMS)}, 2) ELSE '' END",
        "query": f"regexp_extract({url}, {quoted(urls.SPLIT)}, 4)",
        "fragment": f"regexp_extract({url}, {quoted(urls.SPLIT)}, 5)",
    }


def with_parts(table: str, url: str, prefix: str = "") -> str:
    """table with the parts of a column as columns."""
    return f"(SELECT *, {', '.join(f'{e} AS {prefix}{n}' for n, e in parts(url).items())} FROM {table})"


def joined(p: str = "") -> str:
    """The url of the columns of six parts."""
    path = f"({p}path || CASE WHEN {p}params <> '' THEN ';' || {p}params ELSE '' END)"
    return (
        f"(CASE WHEN {p}scheme <> '' THEN {p}scheme || ':' ELSE '' END || CASE WHEN {p}netloc <> '' THEN '//' || {p}netloc || CASE WHEN {path} <> '' AND left({path}, 1) <> '/' THEN '/' ELSE '' END || {path}"
        f" WHEN left({path}, 2) = '//' THEN '//' || {path} ELSE {path} END || CASE WHEN {p}query <> '' THEN '?' || {p}query ELSE '' END || CASE WHEN {p}fragment <> '' THEN '#' || {p}fragment ELSE '' END)"
    )


def host(netloc: str) -> str:
    return f"CASE len(string_split({netloc}, ':')) WHEN 1 THEN {netloc} WHEN 2 THEN trim(string_split({netloc}, ':')[1]) ELSE '' END"


def port(netloc: str) -> str:
    return f"CASE len(string_split({netloc}, ':')) WHEN 2 THEN trim(string_split({netloc}, ':')[2]) ELSE '' END"


def root(name: str) -> str:
    labels = f"string_split({name}, '.')"
    last = lambda k: f"array_to_string({labels}[-{k}:], '.')"
    return f"CASE WHEN regexp_matches({name}, {quoted(urls.IP)}) OR len({labels}) < 2 THEN {name} || '.' WHEN len({labels}) >= 3 AND regexp_matches(lower({last(2)}), {quoted(urls.DOUBLE_SUFFIX)}) THEN {last(3)} ELSE {last(2)} END"


def static(path: str) -> str:
    return f"regexp_matches({path}, {quoted(urls.STATIC)})"


def sanitized(url: str) -> str:
    clean = rf"replace(replace(replace(replace({url}, ' ', ''), '\/', '/'), '%3A', ':'), '%2F', '/')"
    netloc = f"regexp_extract({clean}, {quoted(urls.SPLIT)}, 2)"
    bad = f"NOT regexp_matches({clean}, '[a-zA-Z0-9]') OR regexp_matches({clean}, {quoted(urls.UNUSABLE)}) OR trim({clean}) LIKE 'javascript%' OR {netloc} LIKE '127.0.0.1%' OR {netloc} LIKE 'localhost%'"
    return f"CASE WHEN {bad} THEN '' ELSE {clean} END"


def kind(path: str) -> str:
    return f"CASE WHEN {path} LIKE '%.js' OR {path} LIKE '%.js.map' OR contains({path}, '.js?') THEN 'js' ELSE 'url' END"


def globs(name: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({name}, {quoted(glob_to_regex(g))})" for g in patterns) + ")"


def shown(status: str, ranges: list[tuple[int, int]] | None) -> str:
    n = f"try_cast({status} AS INTEGER)"
    if ranges is None:
        return f"coalesce({n} <> 404, true)"
    return f"coalesce({n} <> 404 AND ({' OR '.join(f'({n} >= {a} AND {n} < {b})' for a, b in ranges)}), false)"


def resolved(raw: str, dom: bool) -> str:
    """(page_id, base, scheme .. fragment, child, kind) of usable links of raw(page_id, base, data)."""
    p = with_parts(with_parts(f"({raw})", "data", "l_"), "base", "b_")
    full = "l_scheme <> '' AND l_netloc <> ''"
    scheme = f"CASE WHEN {full} THEN l_scheme ELSE b_scheme END" if dom else "CASE WHEN l_scheme IN ('http', 'https') THEN l_scheme ELSE b_scheme END"
    netloc = f"CASE WHEN {full} THEN l_netloc ELSE b_netloc END" if dom else "CASE WHEN l_netloc <> '' THEN l_netloc ELSE b_netloc END"
    rest = ", ".join(f"l_{n} AS {n}" for n in ("path", "params", "query", "fragment"))
    inner = f"SELECT page_id, base, {scheme} AS scheme, {netloc} AS netloc, {rest} FROM {p} WHERE data <> '' AND NOT {static('l_path')} AND ({sanitized('data')}) <> ''"
    return f"SELECT DISTINCT page_id, base, scheme, netloc, path, params, query, fragment, {joined()} AS child, {kind('path')} AS kind FROM ({inner})"
