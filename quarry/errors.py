"""Exceptions of the library."""


class QuarryError(Exception):
    """Any error of the library."""


class ConfigError(QuarryError):
    """Settings or rules that cannot be used."""


class HandlerError(QuarryError):
    """An extraction engine that cannot run."""


class CrawlError(QuarryError):
    """A crawl that cannot run."""


class ScanError(QuarryError):
    """A local scan whose path cannot be read."""
