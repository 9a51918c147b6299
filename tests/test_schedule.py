"""Starts of requests: ranks, lanes over tasks, slots, and a host's limits as its server sees them."""

import hashlib
import itertools
import threading
import time
from collections import Counter, defaultdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from quarry.sources import schedule
from quarry.sources.fetch import FetchPolicy, live_fetch


def table(spark, urls):
    return spark.createDataFrame([(u,) for u in urls], "url string")


def test_ranks_and_lanes(spark):
    urls = [f"http://hot.net/{i}" for i in range(700)] + [f"http://H{i % 9}.net:80/{i}" for i in range(60)] + ["no host", None, "http://hot.net/1"]
    got = schedule.start_schedule(table(spark, urls), 4, 0.5).collect()
    hosts = defaultdict(list)
    for u in {u for u in urls if u}:
        hosts["hot.net" if "hot" in u else u if u == "no host" else u[7:9].lower() + ".net"].append(u)
    expected = {(u, h, r % 4, r // 4, r * 0.5) for h, own in hosts.items() for r, u in enumerate(sorted(own, key=lambda u: (hashlib.md5(u.encode()).hexdigest(), u)))}
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_a_host_with_nearly_all_urls_takes_several_tasks(spark):
    urls = [f"http://hot.net/{i}" for i in range(900)] + [f"http://h{i}.net/" for i in range(100)]
    rows = schedule.dealt(table(spark, urls), 5, 16).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r["url"] for r in rows) == sorted(urls)
    tasks = defaultdict(set)
    for r in rows:
        tasks[r["domain"], r["lane"]].add(r["task"])
    assert all(len(t) == 1 for t in tasks.values()) and len({t for (d, _), own in tasks.items() if d == "hot.net" for t in own}) >= 3
    assert set(Counter(r["lane"] for r in rows if r["domain"] == "hot.net").values()) == {180}


def test_empty(spark):
    assert schedule.start_schedule(table(spark, []), 5, 1).collect() == [] == live_fetch(FetchPolicy())(table(spark, [])).collect()


def test_slots_of_lanes_never_meet():
    """Lanes whose requests take different times, each on a clock of its own; a lane that wakes too late waits for its next slot."""
    starts = []
    for lane, took in enumerate((0.0, 0.31, 0.07)):
        clock, late = [100.0 + lane / 7], itertools.cycle([False, True, False, False, False])

        def sleep(s, clock=clock, late=late):
            clock[0] += s + 1e-6 + (0.04 if next(late) else 0)

        own = schedule.LaneClock(lane, 3, 0.1, lambda clock=clock: clock[0], sleep)
        for _ in range(50):
            due = own.wait()
            assert due <= clock[0] <= due + schedule.LATE * 0.1 + 1e-9
            starts.append(clock[0])
            clock[0] += took
    starts.sort()
    assert min(b - a for a, b in zip(starts, starts[1:], strict=False)) >= 0.1 * (1 - schedule.LATE) - 1e-9
    assert schedule.LaneClock(0, 1, 0, lambda: 5.0).wait() == 5.0


@pytest.mark.parametrize(("most", "interval"), [(3, 0.1), (1, 0.05), (2, 0)])
def test_limits_hold_over_tasks(spark, most, interval):
    starts, active, peak, clients, lock = defaultdict(list), Counter(), Counter(), set(), threading.Lock()

    class Site(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_GET(self):
            host = self.headers["Host"]
            with lock:
                starts[host].append(time.monotonic())
                clients.add(self.client_address)
                active[host] += 1
                peak[host] = max(peak[host], active[host])
            time.sleep(0.12)
            with lock:
                active[host] -= 1
            self.send_response(200)
            self.send_header("Content-Length", "2")
            self.end_headers()
            self.wfile.write(b"ok")

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("localhost", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        hot, other = f"http://localhost:{server.server_port}", f"http://127.0.0.1:{server.server_port}"
        urls = [f"{hot}/{i}" for i in range(18)] + [f"{other}/{i}" for i in range(2)]
        got = live_fetch(FetchPolicy(per_domain=most, interval=interval), tasks=8)(table(spark, urls)).collect()
    finally:
        server.shutdown()
    assert sorted(r["url"] for r in got) == sorted(urls) and all(r["body"] == "ok" for r in got)
    assert max(peak.values()) <= most
    for times in starts.values():
        times.sort()
        assert all(b - a >= 0.6 * interval for a, b in zip(times, times[1:], strict=False))  # as the server sees them, which is later than the start by a connection's time
