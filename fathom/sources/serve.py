"""A static server of a site's folder, for looking at what was written."""

from __future__ import annotations

import functools
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path


class _Handler(SimpleHTTPRequestHandler):
    """Only files below the folder, only GET and HEAD, no listings; a page that isn't there gets the site's own."""

    def list_directory(self, path):  # noqa: ARG002
        return self.send_error(404)

    def send_error(self, code, message=None, explain=None):
        page = Path(self.directory, "404.html")
        if code != 404 or not page.is_file():
            return super().send_error(code, message, explain)
        body = page.read_bytes()
        self.send_response(404)
        self.send_header("Content-Type", "text/html; charset=utf-8")
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        if self.command != "HEAD":
            self.wfile.write(body)
        return None

    def translate_path(self, path):
        found = Path(super().translate_path(path)).resolve()
        base = Path(self.directory).resolve()
        return str(found if found == base or base in found.parents else base / "404.html")

    def log_message(self, *args):
        pass


@contextmanager
def serving(root: str, port: int = 0, host: str = "127.0.0.1") -> Iterator[str]:
    """The address under which a folder is served while the context is open; port 0 takes a free one."""
    server = ThreadingHTTPServer((host, port), functools.partial(_Handler, directory=root))
    thread = threading.Thread(target=server.serve_forever, daemon=True)
    thread.start()
    try:
        yield f"http://{host}:{server.server_address[1]}"
    finally:
        server.shutdown()
        server.server_close()
        thread.join()
