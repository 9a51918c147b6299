"""Logging: level by name, short or long lines, to the terminal and to a file."""

from __future__ import annotations

import logging
from pathlib import Path

SHORT, LONG = "%(levelname)s: %(message)s", "%(asctime)s %(levelname)s %(name)s %(filename)s:%(lineno)d %(message)s"


def level_of(name: str, debug: bool = False) -> int:
    """The number of a level name, whatever its case; debug overrides it."""
    return logging.DEBUG if debug else getattr(logging, name.upper(), logging.CRITICAL)


def init_log(name: str = "critical", verbose: bool = False, debug: bool = False, folder: str | None = None) -> logging.Logger:
    """The library's logger with one handler for the terminal, and one for a file in folder if there is one."""
    logger = logging.getLogger("quarry")
    logger.setLevel(level_of(name, debug))
    logger.handlers.clear()
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if folder:
        Path(folder).mkdir(parents=True, exist_ok=True)
        handlers.append(logging.FileHandler(Path(folder) / "quarry.log", encoding="utf-8"))
    for handler in handlers:
        handler.setFormatter(logging.Formatter(LONG if verbose or debug else SHORT))
        logger.addHandler(handler)
    return logger
