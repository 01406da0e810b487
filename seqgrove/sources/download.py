"""Downloads to the driver: one request, or ranges in threads where a large file's server offers them."""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor
from urllib.request import Request, urlopen

LARGE = 50 << 20
CHUNK = 8 << 20


def _get(url: str, opener, start: int | None = None, end: int | None = None) -> bytes:
    head = {} if start is None else {"Range": f"bytes={start}-{end}"}
    with opener(Request(url, headers=head)) as r:
        return r.read()


def fetch(url: str, path: str, threads: int = 16, opener=urlopen) -> str:
    """Writes ``path`` by way of ``path``.part, so a broken download leaves nothing that looks whole."""
    with opener(Request(url, method="HEAD")) as r:
        size, ranged = int(r.headers.get("Content-Length") or 0), r.headers.get("Accept-Ranges") == "bytes"
    part = path + ".part"
    with open(part, "wb") as f:
        if size > LARGE and ranged and threads > 1:
            cuts = [(a, min(a + CHUNK, size) - 1) for a in range(0, size, CHUNK)]
            with ThreadPoolExecutor(threads) as pool:
                for data in pool.map(lambda c: _get(url, opener, *c), cuts):
                    f.write(data)
        else:
            f.write(_get(url, opener))
    if size and os.path.getsize(part) != size:
        os.remove(part)
        raise OSError(f"{url}: the length differs from the {size} bytes announced")
    os.replace(part, path)
    return path


def setup(sources: dict[str, str], folder: str, force: bool = False, dry_run: bool = False, threads: int = 16, opener=urlopen) -> list[str]:
    """Fetches what is missing (all with ``force``); returns the names fetched, or to fetch."""
    wanted = [n for n in sources if force or not os.path.exists(os.path.join(folder, n))]
    if not dry_run:
        os.makedirs(folder, exist_ok=True)
        for n in wanted:
            fetch(sources[n], os.path.join(folder, n), threads, opener)
    return wanted
