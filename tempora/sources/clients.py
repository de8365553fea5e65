"""Clients of services outside: chat models, annotation, geocoding. They are made where they are used and need no Spark.

Tests use fakes; nothing here is called unless a plan is given such a client.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable, Iterable
from urllib import error, parse, request

from tempora.functions.coords import backoff_seconds


def post_json(url: str, payload: dict, headers: dict | None = None, timeout: float = 1800) -> dict:
    """The reply of a service as an object; RuntimeError says what went wrong."""
    call = request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json", **(headers or {})})
    try:
        with request.urlopen(call, timeout=timeout) as reply:
            found = json.loads(reply.read())
    except error.HTTPError as bad:
        raise RuntimeError(f"HTTP {bad.code} from {url}: {bad.read().decode('utf-8', 'replace')[:500]}") from bad
    except (error.URLError, TimeoutError, json.JSONDecodeError) as bad:
        raise RuntimeError(f"no answer from {url}: {bad}") from bad
    if not isinstance(found, dict):
        raise RuntimeError(f"{url} did not answer with an object")
    return found


def page_fetcher(pause: float = 0.5, timeout: float = 30, agent: str = "tempora", opener: Callable = request.urlopen, sleep: Callable = time.sleep) -> Callable[[str], str]:
    """A function that gets the text of a page, with a pause between pages."""
    last = [float("-inf")]

    def fetch(url: str) -> str:
        sleep(max(0.0, last[0] + pause - time.monotonic()))
        last[0] = time.monotonic()
        with opener(request.Request(url, headers={"User-Agent": agent}), timeout=timeout) as reply:
            return reply.read().decode("utf-8", "replace")

    return fetch


class LocalChat:
    """A chat service with a /api/chat endpoint."""

    def __init__(self, base: str = "http://127.0.0.1:11434", timeout: float = 1800, post: Callable = post_json):
        self.url, self.timeout, self.post = base.rstrip("/") + "/api/chat", timeout, post

    def chat(self, *, model: str, messages: list[dict], response_format: dict | None = None, options: dict | None = None) -> dict:
        payload = {"model": model, "messages": messages, "stream": False} | ({"format": response_format} if response_format else {}) | ({"options": options} if options else {})
        found = self.post(self.url, payload, timeout=self.timeout)
        if not isinstance((found.get("message") or {}).get("content"), str):
            raise RuntimeError("the reply has no message content")
        return found


class Remembered:
    """A client that answers equal requests from a store (any mutable mapping), so that a task's retry doesn't ask again."""

    def __init__(self, client, store):
        self.client, self.store = client, store

    def chat(self, **asked) -> dict:
        key = hashlib.sha256(json.dumps(asked, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
        if key not in self.store:
            self.store[key] = self.client.chat(**asked)
        return self.store[key]


def model_name(name: str) -> str:
    """Without a provider's prefix."""
    return name.strip().rsplit("/", 1)[-1]


def response_text(reply: dict) -> str:
    """The text of an annotation service's reply, in either of its shapes."""
    if isinstance(reply.get("output_text"), str):
        return reply["output_text"]
    parts = [c["text"] for item in reply.get("output") or [] for c in (item.get("content") or []) if isinstance(c.get("text"), str)]
    if not parts:
        raise RuntimeError("the reply has no text")
    return "".join(parts)


def api_key(name: str, env_file: str | None = None) -> str:
    """From the environment, else from a file of NAME=value lines."""
    if os.environ.get(name):
        return os.environ[name]
    if env_file and os.path.exists(env_file):
        with open(env_file, encoding="utf-8") as lines:
            for line in lines:
                key, _, value = line.strip().partition("=")
                if key == name and value:
                    return value.strip("\"'")
    raise RuntimeError(f"{name} is not set")


def annotator(url: str, key: str, model: str, schema: dict, instructions: str, post: Callable = post_json) -> Callable[[str], dict]:
    """A function that has one packet annotated under a strict JSON schema."""

    def annotate(packet: str) -> dict:
        payload = {
            "model": model_name(model), "input": [{"role": "system", "content": instructions}, {"role": "user", "content": packet}],
            "text": {"format": {"type": "json_schema", "name": "annotation", "strict": True, "schema": schema}},
        }
        return json.loads(response_text(post(url, payload, {"Authorization": f"Bearer {key}"})))

    return annotate


class Nominatim:
    """Geocoding of names, one request at a time with pauses; a name that fails has a record that says why."""

    def __init__(self, agent: str, email: str | None = None, pause: float = 1.1, retries: int = 2, timeout: float = 30, opener: Callable = request.urlopen, sleep: Callable = time.sleep):
        self.agent, self.email, self.pause, self.retries, self.timeout, self.opener, self.sleep = agent, email, pause, retries, timeout, opener, sleep
        self.last = 0.0

    def __call__(self, names: Iterable[str]) -> list[dict]:
        return [self.one(name) for name in names]

    def one(self, name: str) -> dict:
        asked = {"q": name, "format": "jsonv2", "limit": "1"} | ({"email": self.email} if self.email else {})
        call = request.Request("https://nominatim.openstreetmap.org/search?" + parse.urlencode(asked), headers={"User-Agent": self.agent})
        missing = lambda notes: {"query": name, "source": "missing", "notes": notes}
        for attempt in range(self.retries + 1):
            wait = self.last + self.pause - time.monotonic()
            if wait > 0:
                self.sleep(wait)
            self.last = time.monotonic()
            final = attempt == self.retries
            try:
                with self.opener(call, timeout=self.timeout) as reply:
                    found = json.loads(reply.read())
            except error.HTTPError as bad:
                if bad.code != 429:
                    return missing(f"Nominatim HTTP error {bad.code}: {bad.reason}")
                if final:
                    return missing("Nominatim rate limit exceeded after retries.")
                self.sleep(self.retry_after(bad) or backoff_seconds(attempt))
            except (TimeoutError, error.URLError, json.JSONDecodeError) as bad:
                if final:
                    return missing(f"Nominatim request failed: {bad}")
                self.sleep(backoff_seconds(attempt))
            else:
                return self.record(name, found[0]) if found else missing("No Nominatim result.")
        return missing("Nominatim request failed.")

    @staticmethod
    def retry_after(bad: error.HTTPError) -> float | None:
        try:
            return max(0.0, float(bad.headers.get("Retry-After") or ""))
        except ValueError:
            return None

    @staticmethod
    def record(name: str, top: dict) -> dict:
        rank = top.get("importance")
        return {
            "query": name, "latitude": float(top["lat"]), "longitude": float(top["lon"]), "display_name": top.get("display_name"), "source": "nominatim", "osm_type": top.get("type"), "osm_category": top.get("class"),
            "osm_addresstype": top.get("addresstype"), "raw_importance": float(rank) if rank not in (None, "") else None, "notes": None,
        }
