"""Patterns: dialect flags and glob translation."""

from __future__ import annotations

from functools import lru_cache

try:  # the reader of patterns is no public part of Python: without it nothing is known of a pattern, and all texts are matched
    from re import _constants as op
    from re import _parser as reader
except ImportError:
    op = reader = None

#: As Python reads a pattern without case: Unicode classes, and a dot that stops at a line feed only.
UNICODE = "(?iUd)"
#: The same for patterns of ASCII classes, which other engines read alike.
ASCII = "(?i)"


def glob_to_regex(glob: str) -> str:
    """A shell pattern (* ? [seq] [!seq]) as an anchored regular expression; case counts."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = glob.find("]", i + 1 if glob[i : i + 1] not in ("!",) else i + 2)
            if end < 0:
                out.append(r"\[")
                continue
            inner = glob[i:end].replace("\\", "\\\\").replace("[", "\\[")
            negated = inner.startswith("!")
            inner = inner[1:] if negated else inner
            inner = "\\" + inner if inner.startswith("^") else inner
            out.append(f"[{'^' if negated else ''}{inner}]")
            i = end + 1
        else:
            out.append(c if c.isalnum() or c == "_" or ord(c) > 127 else "\\" + c)
    return r"\A(?s:" + "".join(out) + r")\z"


def _runs(pattern) -> list[str]:
    """Strings of characters without case that each match of a parsed pattern holds."""
    out, run = [], ""

    def end() -> None:
        nonlocal run
        out.append(run)
        run = ""

    for code, value in pattern:
        if code is op.LITERAL and chr(value).lower() == chr(value).upper():
            run += chr(value)
        elif code is not op.AT:
            end()
            if code is op.SUBPATTERN:
                out += _runs(value[3])
            elif code in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] > 0:
                out += _runs(value[2])
            elif code is op.ATOMIC_GROUP:
                out += _runs(value)
    end()
    return out


@lru_cache(maxsize=4096)
def required(regex: str) -> str:
    """A string that every match of a pattern holds, whatever the case of letters; empty if none is known. A text without it needs no matching: looking for
    a plain string is many times cheaper."""
    return max(_runs(reader.parse(regex)), key=len, default="") if reader else ""


#: Characters beyond ASCII that a pattern without case takes for ASCII letters, in UTF-8: Kelvin sign, long s, dotted and dotless i.
_LETTERS = {"\u212a": "k", "\u017f": "s", "\u0130": "i", "\u0131": "i"}


def folded(text: str) -> str:
    """A text in which letters that a pattern without case takes for ASCII ones are lower ASCII letters, as UTF-8 bytes in a string."""
    raw = text.encode("utf-8", "surrogatepass")
    if not text.isascii():
        for other, letter in _LETTERS.items():
            raw = raw.replace(other.encode(), letter.encode())
    return raw.lower().decode("latin-1")


def _options(pattern, open_run: list[str], out: list[frozenset[str]]) -> None:
    """Sets of folded strings, of each of which every match of a parsed pattern holds one. open_run: the string that goes on at this place."""

    def end() -> None:
        if open_run[0]:
            out.append(frozenset([open_run[0]]))
        open_run[0] = ""

    for code, value in pattern:
        if code is op.LITERAL and (value < 128 or chr(value).lower() == chr(value).upper()) and chr(value) not in _LETTERS:
            open_run[0] += folded(chr(value))
        elif code in (op.AT, op.ASSERT, op.ASSERT_NOT):
            continue
        elif code is op.SUBPATTERN:
            _options(value[3], open_run, out)
        else:
            end()
            if code is op.BRANCH:
                each = [_best(branch) for branch in value[1]]
                if all(each):
                    out.append(frozenset().union(*each))
            elif code in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] > 0:
                _options(value[2], open_run, out)
                end()
            elif code is op.ATOMIC_GROUP:
                _options(value, open_run, out)


def _best(pattern) -> frozenset[str]:
    out: list[frozenset[str]] = []
    run = [""]
    _options(pattern, run, out)
    if run[0]:
        out.append(frozenset([run[0]]))
    return max(out, key=lambda s: (min(map(len, s)), -len(s)), default=frozenset())


@lru_cache(maxsize=65536)
def needed(regex: str) -> frozenset[str]:
    """Folded strings of which every match of a pattern without case holds at least one, letters included; empty if none are known."""
    return _best(reader.parse(regex)) if reader else frozenset()
