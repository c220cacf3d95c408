"""Downloads of published lists on the driver, with redirects and retries."""

from __future__ import annotations

import random
import time
import urllib.error
import urllib.request

TRANSIENT = frozenset({403, 408, 425, 429, 500, 502, 503, 504})


def delay(attempt: int, retry_after: str | None = None, base: float = 1.0, most: float = 30.0) -> float:
    """Seconds before the next try: what the server asks for, else doubling with jitter."""
    if retry_after and retry_after.isdigit():
        return min(float(retry_after), most)
    return min(most, base * 2**attempt) * (0.5 + random.random() / 2)


def fetch(url: str, tries: int = 4, timeout: float = 60.0, opener=urllib.request.urlopen, sleep=time.sleep) -> bytes:
    for attempt in range(tries):
        try:
            with opener(url, timeout=timeout) as r:
                return r.read()
        except urllib.error.HTTPError as e:
            if e.code not in TRANSIENT or attempt == tries - 1:
                raise
            sleep(delay(attempt, e.headers.get("Retry-After") if e.headers else None))
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            if attempt == tries - 1:
                raise
            sleep(delay(attempt))
    raise ValueError("tries must be positive")
