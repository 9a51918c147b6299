"""Command line, settings, local scans, live fetches from a local server, streams."""

import threading
import time
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer

import pytest

from quarry import __version__
from quarry.cli import main, parser, settings_of
from quarry.config import Settings, default_yaml, from_environment, load_file, updated
from quarry.errors import ConfigError, ScanError
from quarry.operators.scan import local_scan
from quarry.rules import PROSE_RULES
from quarry.sources.fetch import FetchPolicy, RateLimiter, live_fetch
from quarry.streaming.scan import stream_secrets, watch_parquet


@pytest.fixture()
def tree(tmp_path):
    (tmp_path / "d" / ".hid").mkdir(parents=True)
    (tmp_path / "d" / "empty").mkdir()
    (tmp_path / "d" / "one.txt").write_text("a@b.net twice a@b.net")
    (tmp_path / "d" / ".env").write_bytes(b"\xff10.0.0.1\r\npassword=abc")
    (tmp_path / "d" / ".hid" / "two").write_text("nothing here")
    return tmp_path


def test_local_scan(spark, tree):
    rows = {(r["path"].rsplit("/", 1)[1], r["type"], r["data"]) for r in local_scan(spark, str(tree / "d"), PROSE_RULES).collect()}
    assert rows == {("one.txt", "Bare Email", "a@b.net"), (".env", "IPv4", "10.0.0.1"), (".env", "Password", "password")}
    with pytest.raises(ScanError):
        local_scan(spark, str(tree / "none"), PROSE_RULES)


def test_version_and_errors(spark, capsys, monkeypatch, tmp_path):
    monkeypatch.chdir(tmp_path)
    assert main(["-V"]) == 0 and capsys.readouterr().out.strip() == __version__
    assert main([], spark) == 1
    assert main(["-l", str(tmp_path / "none")], spark) == 1


def test_cli_scan_and_crawl(spark, tree, capsys, monkeypatch):
    monkeypatch.chdir(tree)
    (tree / "d" / "one.txt").write_text('"a@b.net" \'13273487666\'')
    assert main(["-l", str(tree / "d"), "-o", str(tree / "out.txt")], spark) == 0
    assert "2 Secrets found in" in (tree / "out.txt").read_text()
    assert main(["-l", str(tree / "d")], spark) == 0 and (tree / "scanner.log").read_text() == (tree / "out.txt").read_text()
    site = tree / "site"
    site.mkdir()
    (site / "index.html").write_text('<title>T</title><a href="x.html">x</a><link href="delete"/><script src="1.js"></script>')
    (site / "x.html").write_text("'me@mail.net'")
    (site / "1.js").write_text('k="eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0"')
    server = ThreadingHTTPServer(("localhost", 0), partial(SimpleHTTPRequestHandler, directory=str(site)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        host = f"http://localhost:{server.server_port}"
        assert main(["-u", f"{host}/index.html", "-o", str(tree / "out.csv"), "--min-request-interval", "0", "--detail", "--validate"], spark) == 0
        shown = capsys.readouterr().out
        assert "me@mail.net" in shown and "1.js" in shown and "Targets: 1 in localhost." in shown
        lines = (tree / "out.csv").read_text()
        assert lines.startswith("URL,Title,Response Code,Content Length,Content Type,Secrets") and f"{host}/index.html,T,200" in lines
        got = {r["url"]: r["status"] for r in live_fetch(FetchPolicy(interval=0))(spark.createDataFrame([(f"{host}/x.html",), (f"{host}/none",), ("http://localhost:1/",)], "url string")).collect()}
        assert got == {f"{host}/x.html": "200", f"{host}/none": "404", "http://localhost:1/": None}
    finally:
        server.shutdown()


def test_connections_are_kept_and_redirects_followed():
    from http.server import BaseHTTPRequestHandler

    from quarry.sources.fetch import Connections

    opened = []

    class Site(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def setup(self):
            super().setup()
            opened.append(1)

        def do_GET(self):
            to = {"/old": "/new%20place", "/loop": "/loop"}.get(self.path)
            body = b"" if to else f"at {self.path} \xe9".encode("latin-1")
            self.send_response(302 if to else 200)
            if to:
                self.send_header("Location", to)
            self.send_header("Content-Type", "text/plain; charset=latin-1")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("localhost", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        host = f"http://localhost:{server.server_port}"
        kept = Connections(FetchPolicy())
        assert [kept.get(f"{host}/{i}")[3] for i in range(3)] == [f"at /{i} é" for i in range(3)] and len(opened) == 1
        assert kept.get(f"{host}/old")[3] == "at /new%20place é" and kept.get(f"{host}/a b?q=ü")[3] == "at /a%20b?q=%C3%BC é" and len(opened) == 1
        assert kept.get(f"{host}/loop") is None and kept.get("ftp://x/") is None and kept.get("http://localhost:1/") is None
        kept._idle[0][1].sock.close()
        assert kept.get(f"{host}/again")[0] == "200" and len(opened) == 2
        kept.close()
        assert Connections(FetchPolicy(follow_redirects=False)).get(f"{host}/old")[0] == "302"
        alone = Connections(FetchPolicy(keepalive=0))
        assert alone.get(f"{host}/x") and alone.get(f"{host}/y") and not alone._idle and len(opened) == 5
        assert Connections(FetchPolicy(most_bytes=5)).get(f"{host}/x") is None
        through = Connections(FetchPolicy(proxy=host))
        assert through.get("http://other.host/p")[3] == "at http://other.host/p é"
    finally:
        server.shutdown()


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from quarry.session import shared_dir

    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master="spark://host:7077")))


def test_reports_have_colours_on_a_terminal(tmp_path):
    import io

    from quarry.sinks.terminal import painted, tell

    class Terminal(io.StringIO):
        def isatty(self):
            return True

    text = "1 URL from x:\nhttp://x/ [200] [Content-Length: 3] [Content-Type: ] [Title: T]\nhttp://y/ [Unknown] [Content-Length: ] [Content-Type: ] [Title: ]"
    shown = painted(text)
    assert "\x1b[94mhttp://x/ [\x1b[0m\x1b[32m200\x1b[0m\x1b[94m] [Content-Length" in shown and "\x1b[94mhttp://y/ [\x1b[0mUnknown\x1b[94m]" in shown
    assert [painted(f"u [{s}] [Content-Length: ").count(f"\x1b[{c}m") for s, c in ((302, 33), (404, 35), (500, 31), (204, 31))] == [1] * 4 and painted("plain [200] x") == "plain [200] x"
    terminal, plain = Terminal(), io.StringIO()
    tell(text, str(tmp_path / "t"), terminal)
    tell(text, None, plain)
    assert terminal.getvalue() == shown + "\n" and plain.getvalue() == text + "\n" and (tmp_path / "t").read_text() == text


def test_settings_layers(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "s.yml").write_text(default_yaml() + "max_depth: 7\n")
    s = load_file(Settings(), str(tmp_path / "s.yml"))
    assert s.max_depth == 7 and s.rules == Settings().rules
    s = from_environment(s, {"QUARRY_MAX_DEPTH": "3", "QUARRY_FOLLOW_REDIRECTS": "false"})
    assert s.max_depth == 3 and s.follow_redirects is False
    args = parser().parse_args(["-i", str(tmp_path / "s.yml"), "-m", "2", "--max-depth", "5", "-a", "agent", "-c", "k=v", "--max-page", "9", "-x", "http://p"])
    s = settings_of(args)
    assert (s.max_depth, s.max_page_num, s.proxy, s.headers["User-Agent"], s.headers["Cookie"]) == (5, 9, "http://p", "agent", "k=v")
    assert settings_of(parser().parse_args(["-m", "2"])).max_depth == 2 and (tmp_path / "settings.yml").is_file()
    for bad in ({"max_connections": 0}, {"urlFind": "x"}, {"rules": "x"}):
        with pytest.raises(ConfigError):
            updated(Settings(), bad)
    assert updated(Settings(), {"handler_type": "hyperscan"}).engine == "scan"


def test_rate_limiter():
    limiter, starts, active, most = RateLimiter(1, 0.05), [], [], []

    def work():
        starts.append(time.monotonic())
        active.append(1)
        most.append(len(active))
        time.sleep(0.01)
        active.pop()

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda _: limiter.run("h", work), range(3)))
    assert max(most) == 1 and all(b - a >= 0.045 for a, b in zip(starts, starts[1:], strict=False))
    for bad in ((0, 1), (1, -1)):
        with pytest.raises(ConfigError):
            RateLimiter(*bad)


def test_stream_finds_each_secret_once(spark, tmp_path):
    folder = tmp_path / "in"
    rows = spark.createDataFrame([(1, "a@b.net"), (1, "x a@b.net"), (2, "none")], "id long, text string").selectExpr("id", "text", "timestamp '2024-01-01 00:00:00' AS ts")
    rows.write.parquet(str(folder))
    stream = stream_secrets(watch_parquet(spark, str(folder), rows.schema), "text", PROSE_RULES, "ts")
    run = stream.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    assert [(r["id"], r["data"]) for r in spark.table("found").collect()] == [(1, "a@b.net")]
