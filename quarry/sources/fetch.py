"""Live fetches: requests by host, limited in number and pace."""

from __future__ import annotations

import contextlib
import http.client
import queue
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from urllib.parse import quote, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.errors import ConfigError
from quarry.schemas import ANSWER, PAGE
from quarry.session import ship_package
from quarry.sources.schedule import LaneClock, dealt

#: Characters of a path or query that are sent as they are.
_AS_IT_IS = "%/:=&?~#+!$,;'@()*[]|"
#: Answers of an Arrow batch, and code points of their bodies, about.
FLUSH_ROWS, FLUSH_BYTES = 64, 4 << 20
#: Answers of a task that wait to be taken.
WAITING = 32


@dataclass(frozen=True)
class FetchPolicy:
    """How pages are asked for."""

    headers: dict[str, str] = field(default_factory=dict)
    timeout: float = 5
    follow_redirects: bool = True
    proxy: str = ""
    per_domain: int = 5
    interval: float = 0.2
    connections: int = 100
    keepalive: int = 50
    #: A longer body is no answer: one page must fit into an Arrow batch.
    most_bytes: int = 1 << 28

    def __post_init__(self):
        if self.per_domain < 1 or self.connections < 1 or self.keepalive < 0:
            raise ConfigError("a fetch needs at least one connection, and keeps none or some")
        if self.interval < 0:
            raise ConfigError("the interval between requests is negative")


class RateLimiter:
    """At most `most` requests to a domain at a time, and `interval` seconds between their starts, among the threads of one process. A fetch by Spark keeps
    the same limits over all its tasks by lanes (see schedule)."""

    def __init__(self, most: int, interval: float):
        if most < 1 or interval < 0:
            raise ConfigError("a limiter needs room for one request and an interval of 0 or more")
        self.most, self.interval = most, interval
        self._lock = threading.Lock()
        self._room: dict[str, threading.Semaphore] = {}
        self._next: dict[str, float] = {}

    def run(self, domain: str, work):
        with self._lock:
            room = self._room.setdefault(domain, threading.Semaphore(self.most))
        with room:
            with self._lock:
                start = max(time.monotonic(), self._next.get(domain, 0.0))
                self._next[domain] = start + self.interval
            time.sleep(max(0.0, start - time.monotonic()))
            return work()


class Connections:
    """Requests over connections that are kept open for the next request to the same host, `keepalive` idle ones at most."""

    REDIRECTS = 20

    def __init__(self, policy: FetchPolicy):
        import ssl

        self.policy = policy
        self.context = ssl.create_default_context()
        self.context.check_hostname, self.context.verify_mode = False, ssl.CERT_NONE
        self._lock = threading.Lock()
        self._idle: list[tuple[tuple, http.client.HTTPConnection]] = []

    def _open(self, scheme: str, host: str, port: int | None) -> http.client.HTTPConnection:
        secure = {"context": self.context} if scheme == "https" else {}
        kind = http.client.HTTPSConnection if scheme == "https" else http.client.HTTPConnection
        if not self.policy.proxy:
            return kind(host, port, timeout=self.policy.timeout, **secure)
        proxy = urlsplit(self.policy.proxy)
        made = kind(proxy.hostname, proxy.port, timeout=self.policy.timeout, **secure)
        if scheme == "https":
            made.set_tunnel(host, port or 443)
        return made

    def _take(self, key: tuple) -> http.client.HTTPConnection | None:
        with self._lock:
            for i in range(len(self._idle) - 1, -1, -1):
                if self._idle[i][0] == key:
                    return self._idle.pop(i)[1]
        return None

    def _keep(self, key: tuple, connection: http.client.HTTPConnection) -> None:
        with self._lock:
            self._idle.append((key, connection))
            over = self._idle[: max(0, len(self._idle) - self.policy.keepalive)]
            del self._idle[: len(over)]
        for _, old in over:
            old.close()

    def ask(self, url: str) -> tuple[http.client.HTTPResponse, bytes]:
        """One request, without redirects. A kept connection that the host has closed meanwhile is replaced once."""
        parts = urlsplit(url)
        if parts.scheme not in ("http", "https") or not parts.hostname:
            raise ValueError(f"not a page's address: {url}")
        target = quote(parts.path or "/", safe=_AS_IT_IS) + (f"?{quote(parts.query, safe=_AS_IT_IS)}" if parts.query else "")
        if self.policy.proxy and parts.scheme == "http":
            target = f"http://{parts.netloc}{target}"
        key = (parts.scheme, parts.hostname, parts.port)
        kept = self._take(key)
        for connection in (kept, None) if kept else (None,):
            connection = connection or self._open(*key)
            try:
                connection.request("GET", target, headers=self.policy.headers)
                answer = connection.getresponse()
                raw = answer.read(self.policy.most_bytes + 1)
            except (http.client.HTTPException, OSError):
                connection.close()
                if connection is kept:
                    continue
                raise
            if len(raw) > self.policy.most_bytes:
                connection.close()
                raise ValueError(f"a body of more than {self.policy.most_bytes} bytes: {url}")
            if answer.will_close:
                connection.close()
            else:
                self._keep(key, connection)
            return answer, raw
        raise AssertionError

    def get(self, url: str) -> tuple[str, str | None, str | None, str] | None:
        """(status, content type, content length, body), or None if there is no response at all: as after more than REDIRECTS redirects."""
        try:
            for _ in range(self.REDIRECTS + 1):
                answer, raw = self.ask(url)
                to = answer.getheader("Location")
                if not (self.policy.follow_redirects and to and answer.status in (301, 302, 303, 307, 308)):
                    break
                url = urljoin(url, to)
            else:
                return None
            charset = answer.headers.get_content_charset() or "utf-8"
            try:
                body = raw.decode(charset, "replace")
            except LookupError:
                body = raw.decode("utf-8", "replace")
            return str(answer.status), answer.getheader("Content-Type"), answer.getheader("Content-Length"), body
        except Exception:  # any failure of a request is a page without a response
            return None

    def close(self) -> None:
        with self._lock:
            idle, self._idle = self._idle, []
        for _, connection in idle:
            connection.close()


def ask_lanes(lanes: dict[tuple, list[str]], policy: FetchPolicy, pool: ThreadPoolExecutor, get: Callable[[str], tuple | None]) -> Iterator[tuple]:
    """(url, answer) as they come; lanes: urls by (domain, lane), of which one after another is asked for in the lane's slots. Few answers wait at a time."""
    answers: queue.Queue = queue.Queue(WAITING)
    stopped = threading.Event()

    def ask(lane: int, urls: list[str]) -> None:
        clock = LaneClock(lane, policy.per_domain, policy.interval)
        for url in urls:
            if stopped.is_set():
                return
            clock.wait()
            answers.put((url, get(url)))

    asked = [pool.submit(ask, lane, urls) for (_, lane), urls in lanes.items()]
    try:
        for _ in range(sum(map(len, lanes.values()))):
            while True:
                try:
                    yield answers.get(timeout=1)
                    break
                except queue.Empty:
                    for f in asked:  # a lane that broke off would be waited for in vain
                        if f.done():
                            f.result()
    finally:
        stopped.set()
        while not all(f.done() for f in asked):
            with contextlib.suppress(queue.Empty):
                answers.get(timeout=0.05)


def live_fetch(policy: FetchPolicy, tasks: int | None = None):
    """A fetch over the network. A host's urls are dealt to as many lanes as it may have requests at a time, and lanes to `tasks` tasks (twice the session's cores if not
    given): a host that has nearly all urls keeps several tasks busy, and its limits hold over all of them (see schedule). A row for each distinct url, with the time of its answer."""

    def fetch(urls: DataFrame) -> DataFrame:
        ship_package(urls.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            connections = Connections(policy)
            rows: list[tuple] = []
            size = 0

            def flush() -> pa.RecordBatch:
                texts = [pa.array([r[i] for r in rows], pa.string()) for i in range(len(PAGE.names))]
                out = pa.RecordBatch.from_arrays([*texts, pa.array([r[-1] for r in rows], pa.timestamp("us", "UTC"))], ANSWER.names)
                rows.clear()
                return out

            with ThreadPoolExecutor(policy.connections) as pool:
                for batch in batches:
                    lanes: dict[tuple, list[str]] = {}
                    for url, domain, lane in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        lanes.setdefault((domain, lane), []).append(url)
                    for url, got in ask_lanes(lanes, policy, pool, connections.get):
                        rows.append((url, *(got or (None,) * 4), int(time.time() * 1_000_000)))
                        size += len(got[3]) if got else 0
                        if size > FLUSH_BYTES or len(rows) >= FLUSH_ROWS:
                            size = 0
                            yield flush()
            connections.close()
            if rows:
                yield flush()

        return dealt(urls, policy.per_domain, tasks or 2 * urls.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, ANSWER)

    return fetch
