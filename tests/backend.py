"""An in-process metrics backend: takes writes, answers series and range queries, can fail."""

import json
import re
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pyarrow as pa

from annulus.streaming import remote_write as rw


def _size(raw):
    n = shift = 0
    for b in raw:
        n |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            return n


class FakeBackend:
    def __init__(self):
        self.data, self.writes, self.answers, self.headers, self.lock = {}, 0, [], [], threading.Lock()
        fake = self

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *_):
                pass

            def _say(self, status, body=b""):
                self.send_response(status)
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def do_POST(self):
                raw = self.rfile.read(int(self.headers["Content-Length"]))
                with fake.lock:
                    fake.writes += 1
                    fake.headers.append({k.lower(): v for k, v in self.headers.items()})
                    if fake.answers and (status := fake.answers.pop(0)) != 204:
                        return self._say(status, b"no")
                    for labels, times, values in rw.decode(pa.decompress(raw, decompressed_size=_size(raw), codec="snappy", asbytes=True)):
                        fake.data.setdefault(tuple(sorted(labels.items())), {}).update(zip(times, values))
                self._say(204)

            def do_GET(self):
                url = urllib.parse.urlparse(self.path)
                q = {k: v[0] for k, v in urllib.parse.parse_qs(url.query).items()}
                chosen = fake.select(q.get("match[]") or q["query"].rsplit("[", 1)[0])
                if url.path.endswith("/series"):
                    lo, hi = int(q["start"]) * 1000, int(q["end"]) * 1000
                    found = [dict(k) for k in chosen if any(lo <= t <= hi for t in fake.data[k])]
                    return self._say(200, json.dumps({"status": "success", "data": found}).encode())
                at, span = int(q["time"]) * 1000, int(re.search(r"\[(\d+)s\]$", q["query"])[1]) * 1000
                result = [{"metric": dict(k), "values": [[t / 1000, repr(v)] for t, v in sorted(fake.data[k].items()) if at - span < t <= at]} for k in chosen]
                self._say(200, json.dumps({"status": "success", "data": {"resultType": "matrix", "result": [r for r in result if r["values"]]}}).encode())

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}"

    def select(self, selector):
        tests = re.findall(r'([a-zA-Z_]\w*)(=~?)"((?:[^"\\]|\\.)*)"', selector)
        plain = lambda s: re.sub(r"\\(.)", lambda m: {"n": "\n"}.get(m[1], m[1]), s)
        ok = lambda have, op, v: re.fullmatch(plain(v), have) if op == "=~" else have == plain(v)
        return [k for k in self.data if all(ok(dict(k).get(n, ""), op, v) for n, op, v in tests)]

    def close(self):
        self.server.shutdown()
