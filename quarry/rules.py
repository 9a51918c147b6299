"""Rules: named patterns, the packs that come with the library, and rule files."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from quarry.errors import ConfigError


@dataclass(frozen=True)
class Rule:
    """A named pattern. With capture groups, its value is the first; without, the whole match."""

    name: str
    regex: str
    loaded: bool = True

    @property
    def groups(self) -> int:
        return re.compile(self.regex).groups


# Patterns that must equal those users run today.
DEFAULT_RULES = [
    Rule("Swagger", r'\b[\w/]+?((swagger-ui.html)|(\"swagger\":)|(Swagger UI)|(swaggerUi)|(swaggerVersion))\b'),
    Rule("ID Card", r"\b((\d{8}(0\d|10|11|12)([0-2]\d|30|31)\d{3})|(\d{6}(18|19|20)\d{2}(0[1-9]|10|11|12)([0-2]\d|30|31)\d{3}(\d|X|x)))\b"),
    Rule("Phone", r"""['"](1(3([0-35-9]\d|4[1-8])|4[14-9]\d|5([\d]\d|7[1-79])|66\d|7[2-35-8]\d|8\d{2}|9[89]\d)\d{7})['"]"""),
    Rule("JS Map", r"\b([\w/]+?\.js\.map)"),
    Rule("URL as a Value", r"(\b\w+?=(https?)(://|%3a%2f%2f))", False),
    Rule("Email", r"""['"]([\w]+(?:\.[\w]+)*@(?:[\w](?:[\w-]*[\w])?\.)+[\w](?:[\w-]*[\w])?)['"]"""),
    Rule("Internal IP", r"[^0-9]((127\.0\.0\.1)|(10\.\d{1,3}\.\d{1,3}\.\d{1,3})|(172\.((1[6-9])|(2\d)|(3[01]))\.\d{1,3}\.\d{1,3})|(192\.168\.\d{1,3}\.\d{1,3}))"),
    Rule("Cloud Key", r"\b((accesskeyid)|(accesskeysecret)|\b(LTAI[a-z0-9]{12,20}))\b"),
    Rule("Shiro", r"(=deleteMe|rememberMe=)"),
    Rule("Suspicious API Key", r"""["'][0-9a-zA-Z]{32}['"]"""),
    Rule("Jwt", r"""['"](ey[A-Za-z0-9_-]{10,}\.[A-Za-z0-9._-]{10,}|ey[A-Za-z0-9_\/+-]{10,}\.[A-Za-z0-9._\/+-]{10,})['"]"""),
]
#: The older pack: unquoted phones and addresses, all rules loaded, no Jwt.
LEGACY_RULES = [
    Rule("Swagger", r'\b[\w/]+?((swagger-ui.html)|(\"swagger\":)|(Swagger UI)|(swaggerUi)|(swaggerVersion))\b'),
    Rule("ID Card", r"\b((\d{8}(0\d|10|11|12)([0-2]\d|30|31)\d{3}\$)|(\d{6}(18|19|20)\d{2}(0[1-9]|10|11|12)([0-2]\d|30|31)\d{3}(\d|X|x)))\b"),
    Rule("Phone", r"\b((?:(?:\+|00)86)?1(?:(?:3[\d])|(?:4[5-79])|(?:5[0-35-9])|(?:6[5-7])|(?:7[0-8])|(?:8[\d])|(?:9[189]))\d{8})\b"),
    Rule("JS Map", r"\b([\w/]+?\.js\.map)"),
    Rule("URL as a Value", r"(\b\w+?=(https?)(://|%3a%2f%2f))"),
    Rule("Email", r"\b(([a-z0-9][_|\.])*[a-z0-9]+@([a-z0-9][-|_|\.])*[a-z0-9]+\.([a-z]{2,}))\b"),
    Rule("Internal IP", r"[^0-9]((127\.0\.0\.1)|(10\.\d{1,3}\.\d{1,3}\.\d{1,3})|(172\.((1[6-9])|(2\d)|(3[01]))\.\d{1,3}\.\d{1,3})|(192\.168\.\d{1,3}\.\d{1,3}))"),
    Rule("Cloud Key", r"\b((accesskeyid)|(accesskeysecret)|\b(LTAI[a-z0-9]{12,20}))\b"),
    Rule("Shiro", r"(=deleteMe|rememberMe=)"),
    Rule("Suspicious API Key", r"""["'][0-9a-zA-Z]{32}['"]"""),
]
URL_FIND = [
    r"""["'‘“`]\s{0,6}(https{0,1}:[-a-zA-Z0-9()@:%_\+.~#?&//={}]{2,250}?)\s{0,6}["'‘“`]""",
    r"=\s{0,6}(https{0,1}:[-a-zA-Z0-9()@:%_\+.~#?&//={}]{2,250})",
    r"""["'‘“`]\s{0,6}([#,.]{0,2}/[-a-zA-Z0-9()@:%_\+.~#?&//={}]{2,250}?)\s{0,6}["'‘“`]""",
    r'"([-a-zA-Z0-9()@:%_\+.~#?&//={}]+?[/]{1}[-a-zA-Z0-9()@:%_\+.~#?&//={}]+?)"',
    r"""href\s{0,6}=\s{0,6}["'‘“`]{0,1}\s{0,6}([-a-zA-Z0-9()@:%_\+.~#?&//={}]{2,250})|action\s{0,6}=\s{0,6}["'‘“`]{0,1}\s{0,6}([-a-zA-Z0-9()@:%_\+.~#?&//={}]{2,250})""",
]
JS_FIND = [
    r"(https{0,1}:[-a-zA-Z0-9（）@:%_\+.~#?&//=]{2,100}?[-a-zA-Z0-9（）@:%_\+.~#?&//=]{3}[.]js)",
    r"""["'‘“`]\s{0,6}(/{0,1}[-a-zA-Z0-9（）@:%_\+.~#?&//=]{2,100}?[-a-zA-Z0-9（）@:%_\+.~#?&//=]{3}[.]js)""",
    r"""=\s{0,6}[",',’,”]{0,1}\s{0,6}(/{0,1}[-a-zA-Z0-9（）@:%_\+.~#?&//=]{2,100}?[-a-zA-Z0-9（）@:%_\+.~#?&//=]{3}[.]js)""",
]
DANGEROUS_PATHS = ["logout", "update", "remove", "insert", "delete"]
# End of the fixed values.

#: Patterns of our own, of ASCII classes only, for corpora of prose.
PROSE_RULES = [
    Rule("Bare Email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    Rule("IPv4", r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"),
    Rule("Card Number", r"[0-9]{16}"),
    Rule("Token", r'token = "([0-9a-f]{40})"'),
    Rule("Password", r"(password)=([0-9a-z]+)"),
]


def link_rules(url_find: list[str] | None = None, js_find: list[str] | None = None) -> list[Rule]:
    """Link patterns as rules, numbered over both lists."""
    patterns = [*(URL_FIND if url_find is None else url_find), *(JS_FIND if js_find is None else js_find)]
    return [Rule(f"urlFinder_{i}", p) for i, p in enumerate(patterns)]


def loaded(rules: Iterable[Rule]) -> list[Rule]:
    """The rules that are loaded; of two with one name the later takes the earlier's place."""
    return list({r.name: r for r in rules if r.loaded is True}.values())


def rules_from(setting: object) -> list[Rule]:
    """Loaded rules from settings: a list of mappings with name, regex and loaded, or of groups, each with a list under `rule`."""
    if not isinstance(setting, list):
        raise ConfigError("rules are missing or are not a list")
    flat: list[Mapping] = []
    for item in setting:
        if not isinstance(item, Mapping):
            raise ConfigError(f"not a rule: {item!r}")
        flat += item["rule"] if isinstance(item.get("rule"), list) else [item]
    try:
        found = [Rule(str(item["name"]), str(item["regex"]), item["loaded"]) for item in flat]
        for rule in found:
            re.compile(rule.regex)
    except (KeyError, TypeError, re.error) as error:
        raise ConfigError(f"a rule cannot be used: {error}") from error
    return loaded(found)
