"""Fetching a dump; the only part that needs a network."""

from __future__ import annotations

import os
import shutil
import time
import urllib.request

from glossloom.sources.dump import served_date


def download(url: str, to: str, attempts: int = 3, wait: float = 5.0, timeout: float = 60.0) -> None:
    """Fetch a file beside its place and move it there when it is whole; a read that times out is tried again."""
    part = f"{to}.part"
    for n in range(attempts):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as source, open(part, "wb") as f:  # noqa: S310
                shutil.copyfileobj(source, f)
            os.replace(part, to)
            return
        except TimeoutError:
            if n + 1 == attempts:
                raise
            time.sleep(wait)
        finally:
            if os.path.exists(part):
                os.unlink(part)


def page(url: str, timeout: float = 60.0) -> str:
    with urllib.request.urlopen(url, timeout=timeout) as f:  # noqa: S310
        return f.read().decode()


def fetch_dump(page_url: str, file_url: str, folder: str) -> str:
    """The dump a page serves, in a folder, unless it is there already; refused if the page changed meanwhile."""
    date = served_date(page(page_url))
    to = os.path.join(folder, f"wiktextract-data-{date}.jsonl.gz")
    if not os.path.exists(to):
        download(file_url, to)
        if served_date(page(page_url)) != date:
            os.unlink(to)
            raise ValueError("another dump was put up during the download")
    return to
