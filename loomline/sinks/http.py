"""Events over HTTP: compressed, with a kept connection, told to wait by the server."""

from __future__ import annotations

import gzip
import http.client
import json
import time
import urllib.parse
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame


@dataclass
class HttpSink:
    """Posts wire text to <url>/journeys/<id>; use one for each partition.

    A connection that has gone is opened once more without a word.  On 429 the
    sink waits as long as Retry-After says, at most ``patience`` seconds in all;
    every other answer of 400 or more is an error of that journey alone.
    """

    url: str
    key: str | None = None
    timeout: float = 10.0
    patience: float = 60.0
    sleep: Callable[[float], None] = time.sleep
    _open: http.client.HTTPConnection | None = field(default=None, repr=False)

    def _connection(self) -> http.client.HTTPConnection:
        if self._open is None:
            parts = urllib.parse.urlsplit(self.url)
            kind = http.client.HTTPSConnection if parts.scheme == "https" else http.client.HTTPConnection
            self._open = kind(parts.netloc, timeout=self.timeout)
        return self._open

    def close(self) -> None:
        if self._open is not None:
            self._open.close()
            self._open = None

    def _post(self, path: str, body: bytes) -> tuple[int, dict, bytes]:
        head = {"Content-Type": "application/x-ndjson", "Content-Encoding": "gzip", **({"Authorization": f"Bearer {self.key}"} if self.key else {})}
        for last in (False, True):
            try:
                c = self._connection()
                c.request("POST", urllib.parse.urlsplit(self.url).path.rstrip("/") + path, body, head)
                answer = c.getresponse()
                return answer.status, {k.lower(): v for k, v in answer.getheaders()}, answer.read()
            except (ConnectionError, http.client.HTTPException, OSError):
                self.close()
                if last:
                    raise
        raise AssertionError

    def _sent(self, path: str, text: str) -> tuple[str | None, bytes]:
        """What went wrong, null if nothing did, and the answer."""
        body, waited = gzip.compress(text.encode()), 0.0
        while True:
            try:
                status, head, answer = self._post(path, body)
            except (http.client.HTTPException, OSError) as e:
                return f"{type(e).__name__}: {e}", b""
            if status != 429:
                return (f"HTTP {status}", answer) if status >= 400 else (None, answer)
            try:
                pause = max(0.0, float(head.get("retry-after", "1")))
            except ValueError:
                pause = 1.0
            if waited + pause > self.patience:
                return "HTTP 429", b""
            self.sleep(pause)
            waited += pause

    def send(self, journey: str, text: str) -> str | None:
        """Post one journey's lines; the error, or None."""
        return self._sent(f"/journeys/{urllib.parse.quote(journey, safe='')}", text)[0]

    def send_batch(self, parts: Iterable[tuple[str, str]]) -> dict[str, str | None]:
        """Post several journeys at once; the error of each, or None.  A batch that fails as a whole fails for each."""
        parts = list(parts)
        error, answer = self._sent("/batch", json.dumps([{"journey_id": j, "lines": t} for j, t in parts]))
        if error:
            return {j: error for j, _ in parts}
        try:
            said = {r["journey_id"]: r.get("error") for r in json.loads(answer)}
        except (ValueError, TypeError, KeyError):
            said = {}
        return {j: said.get(j) for j, _ in parts}


def send_all(contents: DataFrame, url: str, key: str | None = None, **options) -> DataFrame:
    """Post (journey_id, head, lines) from the tasks: (journey_id, error), a row a journey."""
    def run(frames):
        sink = HttpSink(url, key, **options)
        try:
            for frame in frames:
                errors = [sink.send(str(j), h + t) for j, h, t in zip(frame["journey_id"], frame["head"], frame["lines"], strict=True)]
                yield pd.DataFrame({"journey_id": frame["journey_id"], "error": pd.Series(errors, dtype=object)})
        finally:
            sink.close()

    kind = contents.schema["journey_id"].dataType.simpleString()
    return contents.select("journey_id", "head", "lines").mapInPandas(run, f"journey_id {kind}, error string")
