"""Settings and secrets: the process's environment, and files of NAME=value lines beside it."""

from __future__ import annotations

import json
import os
import re
import urllib.request
from collections.abc import Callable, Mapping
from datetime import datetime, timezone

#: Names of the settings of the text service.
KEY, URL, MODEL, LOCAL = "TEXT_API_KEY", "TEXT_API_URL", "TEXT_MODEL", "TEXT_FORCE_LOCAL"


def parse_lines(text: str) -> dict[str, str]:
    """NAME=value lines; `export` in front, quotes around values, blank lines and # comments are allowed."""
    found = {}
    for line in text.splitlines():
        m = re.match(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*$", line)
        if m:
            value = m[2]
            quoted = re.match(r"""(['"])(.*?)\1""", value)
            found[m[1]] = quoted[2] if quoted else re.sub(r"(^|\s)#.*$", "", value).strip()
    return found


def load_settings(path: str | None = None, environ: Mapping[str, str] | None = None, override: bool = False) -> dict[str, str]:
    """The environment with what a file adds: a name that is set stands, unless `override`. A missing file adds nothing."""
    own = dict(os.environ if environ is None else environ)
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            read = parse_lines(f.read())
        own = own | read if override else read | own
    return own


def text_mode(settings: Mapping[str, str], force_local: bool = False) -> str:
    """`api` where there is a key and nothing forces local texts, else `local_fallback`."""
    forced = force_local or settings.get(LOCAL, "").strip().lower() in ("1", "true", "yes")
    return "api" if settings.get(KEY) and settings.get(URL) and not forced else "local_fallback"


def text_client(settings: Mapping[str, str], model: str | None = None, timeout: float = 60.0) -> Callable[[str], str]:
    """A client of a text service that takes {model, input, temperature} as JSON and answers with output_text."""
    url, key, name = settings[URL], settings[KEY], model or settings.get(MODEL, "default")

    def call(prompt: str) -> str:
        body = json.dumps({"model": name, "input": prompt, "temperature": 0.2}).encode()
        request = urllib.request.Request(url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.loads(answer.read())["output_text"].strip()

    return call


def run_key(now: datetime | None = None) -> str:
    """The time of a run in UTC, such as 20240101T000000Z."""
    return (now or datetime.now(timezone.utc)).strftime("%Y%m%dT%H%M%SZ")
