"""Scheduled fetching: slots without gaps, pauses kept by several tasks, later slots for what failed or came late."""

from __future__ import annotations

import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from lexloom.sources import fetch


def test_slots_have_no_gaps_also_for_a_host_with_most_addresses(spark):
    urls = [f"http://hot.example/{i}" for i in range(600)] + [f"http://h{i % 7}.example/{i}" for i in range(50)] + ["no host"]
    rows = fetch.slots(spark.createDataFrame([(u, 0) for u in urls], "url string, attempt int").repartition(5)).collect()
    by = {}
    for r in rows:
        by.setdefault(r["host"], []).append(r["slot"])
    assert len(rows) == len(urls) and all(sorted(s) == list(range(len(s))) for s in by.values()) and len(by["hot.example"]) == 600


class Site(BaseHTTPRequestHandler):
    asked: list[tuple[float, str, int]] = []
    lock = threading.Lock()

    def do_GET(self):
        with self.lock:
            self.asked.append((time.time(), self.path, self.client_address[1]))
            n = sum(p == self.path for _, p, _ in self.asked)
        if "slow" in self.path:
            time.sleep(0.6)
        status = 404 if "gone" in self.path else 503 if "busy" in self.path and n < 2 or "down" in self.path else 200
        body = self.path.encode()
        self.send_response(status)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_tasks_keep_to_the_pauses_of_one_host(spark):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base, pause = f"http://127.0.0.1:{server.server_port}", 0.2
    paths = [f"/{i}" for i in range(10)] + ["/slow1", "/slow2", "/gone", "/busy", "/down"]
    try:
        asked = spark.createDataFrame([(base + p,) for p in paths] + [(None,), (base + "/1",)], "url string")
        rows = {r["url"].removeprefix(base): r for r in fetch.fetch_scheduled(asked, retries=2, pause=pause, first_wait=0.1, tasks=4, lead=3.0).collect()}
    finally:
        server.shutdown()
    assert set(rows) == set(paths)
    assert {p: rows[p]["outcome"] for p in ("/1", "/slow1", "/gone", "/busy", "/down")} == {"/1": "ok", "/slow1": "ok", "/gone": "refused", "/busy": "ok", "/down": "exhausted"}
    assert rows["/1"]["content"] == b"/1" and rows["/busy"]["attempts"] == 2 and rows["/down"]["attempts"] == 3 and rows["/down"]["content"] is None
    times = sorted(t for t, *_ in Site.asked)
    # What the way to the site takes is not the schedule's.
    assert min(b - a for a, b in zip(times, times[1:])) > 0.7 * pause
    assert Counter(p for _, p, _ in Site.asked)["/busy"] == 2 and Counter(p for _, p, _ in Site.asked)["/down"] == 3


def test_by_a_clock_that_waiting_moves(spark, tmp_path):
    log = str(tmp_path / "asked")

    def transport():
        def get(url):
            with open(log, "a") as f:
                f.write(url + "\n")
            return fetch.Reply(200, url.encode(), "text/plain", url)

        return get

    class Moved(fetch.Clock):
        """Only waiting moves it; the second wait of a task takes ten seconds more."""

        calls = 0

        def __init__(self):
            self.t = time.time()

        def now(self):
            return self.t

        def sleep(self, seconds):
            Moved.calls += 1
            self.t += seconds + (10.0 if Moved.calls == 2 else 0.0)  # a task that is held up misses slots

    asked = spark.createDataFrame([(f"http://a.example/{i}",) for i in range(20)], "url string")
    rows = fetch.fetch_scheduled(asked, transport, pause=1.0, tasks=4, lead=60.0, clock=Moved).collect()
    assert {r["outcome"] for r in rows} == {"ok"} and len(rows) == 20 and {r["attempts"] for r in rows} == {1}
    with open(log) as f:
        assert max(Counter(f.read().split()).values()) == 1  # late ones were not asked before
    assert fetch.fetch_scheduled(asked.filter("false"), transport).count() == 0
