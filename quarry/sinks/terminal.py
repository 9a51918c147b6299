"""Text for a terminal: colours by status, and a copy to a file."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator
from typing import TextIO

from quarry.sinks.reports import write_text

_CODES = {"green": 32, "yellow": 33, "magenta": 35, "red": 31, "normal": 94}
_LINE = re.compile(r"^(.+ \[)([^\]\n]*)(\] \[Content-Length: .*)$", re.M)


def _in(colour: str, text: str) -> str:
    return f"\x1b[{_CODES[colour]}m{text}\x1b[0m" if text else ""


def colour_of(status: str) -> str | None:
    """The colour of a status, as status_class gives it; None for what is no number."""
    try:
        n = int(status)
    except ValueError:
        return None
    return "green" if n == 200 else "yellow" if 300 <= n < 400 else "magenta" if 400 <= n < 500 else "red"


def painted(text: str) -> str:
    """A report whose lines about pages have colours: the status its own, the rest the normal one."""

    def line(m: re.Match) -> str:
        colour = colour_of(m[2])
        return _in("normal", m[1]) + (_in(colour, m[2]) if colour else m[2]) + _in("normal", m[3])

    return _LINE.sub(line, text)


def tell(text: str | Iterable[str], file: str | None = None, out: TextIO | None = None) -> None:
    """Print a report, in colours if a terminal shows it, and write it plain to a file if there is one; a report in pieces is printed and written piece by piece."""
    out = out or sys.stdout

    def shown() -> Iterator[str]:
        for piece in [text] if isinstance(text, str) else text:
            out.write(painted(piece) if out.isatty() else piece)
            yield piece
        out.write("\n")

    if file:
        write_text(shown(), file)
    else:
        for _ in shown():
            pass
