"""A paged feed as a stream: retries, overlap, a replayed batch and a new validity."""

import http.server
import json
import threading
from pathlib import Path

import pytest

from siftwell.sources.paged import _Page, _Pages, paged_stream
from siftwell.streaming.ingest import ingest, ingested


@pytest.fixture
def feed():
    """Pages of three items; every third request fails."""
    state = {"validity": "a", "items": [], "requests": []}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            page = int(self.path.rsplit("/", 1)[1])
            state["requests"].append(page)
            items = state["items"]
            body = json.dumps({"validity": state["validity"], "total": len(items), "pages": -(-len(items) // 3), "items": items[3 * page : 3 * page + 3]}).encode()
            self.send_response(503 if len(state["requests"]) % 3 == 0 else 200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    state["url"] = f"http://127.0.0.1:{server.server_port}/{{page}}"
    yield state
    server.shutdown()


def test_nothing_is_lost_or_doubled(spark, feed, tmp_path):
    target, mark = f"{tmp_path}/rows", f"{tmp_path}/mark"

    def run():
        feed["requests"].clear()
        ingest(paged_stream(spark, feed["url"], pause="0.01", tries="6"), target, mark)
        return set(feed["requests"])

    def stored(validity="a"):
        rows = ingested(spark, target, "id").where(f"validity = '{validity}'").collect()
        return sorted((r.id, json.loads(r.item)["t"]) for r in rows)

    feed["items"] = [{"id": i, "t": "old"} for i in range(7)]
    assert run() == {0, 1, 2} and stored() == [(str(i), "old") for i in range(7)]
    # the last page is filled up, another one follows: only those are read, beside the head
    feed["items"] += [{"id": i, "t": "new"} for i in range(7, 11)]
    assert run() == {0, 2, 3} and len(stored()) == 11
    # a stop after the write and before the commit: the batch is read again and replaces itself
    last = max((p for p in Path(mark, "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    last.unlink()
    Path(mark, "commits", f".{last.name}.crc").unlink(missing_ok=True)
    run()
    assert stored() == sorted([(str(i), "old") for i in range(7)] + [(str(i), "new") for i in range(7, 11)])
    assert spark.read.parquet(target).count() == 7 + 5  # page 2 was read again
    # another validity: from the beginning
    feed["validity"], feed["items"] = "b", [{"id": f"x{i}", "t": "b"} for i in range(4)]
    assert run() == {0, 1} and len(stored("b")) == 4


def test_ranges(feed):
    own = _Pages(feed["url"], 2, 6, 0.01)
    at = lambda v, p, t: {"validity": v, "pages": p, "total": t}
    numbers = lambda a, b: [p.number for p in own.partitions(a, b)]
    assert numbers(own.initialOffset(), at("a", 3, 9)) == [0, 1, 2]
    assert numbers(at("a", 3, 9), at("a", 3, 9)) == [] and numbers(at("a", 5, 13), at("a", 5, 14)) == [3, 4]
    assert numbers(at("a", 5, 13), at("b", 2, 4)) == [0, 1] and numbers(at("a", 5, 13), at("a", 4, 12)) == [2, 3]
    feed["items"] = [{"t": "without id"}, {"id": 1}]
    assert [r[2] for r in own.read(_Page(0, "a"))] == [None, "1"] and list(own.read(_Page(0, "earlier"))) == []
    with pytest.raises(ValueError, match="positive"):
        _Pages(feed["url"], 0, 1, 0)
    with pytest.raises(OSError):
        _Pages("file:///nowhere/{page}", 1, 2, 0.01).latestOffset()
