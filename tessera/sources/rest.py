"""The HTTP adapter of sync: strict checks of bodies, pull and push over an injected transport, and a push sink."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame

from tessera.functions.wire import class_of

# Where a server takes requests.
PULL, PUSH = "/sync/v1/pull", "/sync/v1/push"

Transport = Callable[[str, Mapping[str, str], bytes], tuple[int, bytes]]


class WireError(RuntimeError):
    """A transport or protocol failure; ``outcome`` is 'transient', 'schema' or 'permanent'."""

    def __init__(self, outcome: str, message: str) -> None:
        super().__init__(message)
        self.outcome = outcome


def http(url: str, headers: Mapping[str, str], body: bytes) -> tuple[int, bytes]:
    """Status and body of any answer; no answer is a transient failure."""
    request = urllib.request.Request(url, body, dict(headers), method="POST")
    try:
        with urllib.request.urlopen(request, timeout=30) as answer:
            return answer.status, answer.read()
    except urllib.error.HTTPError as error:
        with error:
            return error.code, error.read()
    except OSError as error:  # refused, unreachable, cut off, timed out
        raise WireError("transient", f"no answer from {url}: {error}") from error


def _need(good: bool, what: str) -> None:
    if not good:
        raise WireError("transient", f"malformed answer: {what}")


def _is_version(value: object) -> bool:
    return isinstance(value, str | int | float) and not isinstance(value, bool)


def checked_page(page: object) -> dict:
    """A pull page: changes with type, entityType, id and version; a cursor; complete. Further fields pass."""
    _need(isinstance(page, dict), "no object")
    _need(page.get("type") in ("changes", "reset"), "type")
    if page["type"] == "reset":
        _need(page.get("cursor") is None or isinstance(page["cursor"], str), "cursor")
        return page
    _need(isinstance(page.get("changes"), list), "changes")
    for change in page["changes"]:
        _need(isinstance(change, dict) and change.get("type") in ("set", "remove"), "change")
        _need(all(isinstance(change.get(k), str) for k in ("entityType", "id")), "key of a change")
        _need(_is_version(change.get("version")), "version of a change")
        _need(change["type"] == "remove" or isinstance(change.get("data"), dict), "data of a set")
    _need(isinstance(page.get("cursor"), str) and isinstance(page.get("complete"), bool), "cursor or complete")
    marks = page.get("confirmedMutations", {})
    _need(isinstance(marks, dict) and all(isinstance(v, int | float) and not isinstance(v, bool) for v in marks.values()), "confirmedMutations")
    return page


def checked_verdicts(answer: object) -> list[dict]:
    """The verdicts of an answer to a push. One on a mutation that wasn't asked about is the caller's to leave out."""
    _need(isinstance(answer, dict) and isinstance(answer.get("results"), list), "results")
    for verdict in answer["results"]:
        _need(isinstance(verdict, dict) and isinstance(verdict.get("mutationId"), str), "mutationId")
        _need(verdict.get("status") in ("ack", "reject", "transform"), "status")
        _need("version" not in verdict or _is_version(verdict["version"]), "version of a verdict")
        _need("data" not in verdict or isinstance(verdict["data"], dict), "data of a verdict")
        _need("remappedId" not in verdict or isinstance(verdict["remappedId"], str) and verdict["remappedId"] != "", "remappedId")
    return answer["results"]


class RestAdapter:
    """``headers`` may be a function, asked for each request; names in any case replace the adapter's own."""

    def __init__(
        self, url: str, *, headers: Mapping[str, str] | Callable[[], Mapping[str, str]] | None = None, transport: Transport = http,
        schema_version: str | None = None, limit: int | None = None,
    ) -> None:
        self.url, self.headers, self.transport, self.schema_version, self.limit = url.removesuffix("/"), headers or {}, transport, schema_version, limit

    def _post(self, path: str, body: dict) -> object:
        own = self.headers() if callable(self.headers) else self.headers
        headers = {"content-type": "application/json"} | {k.lower(): v for k, v in own.items()}
        if self.schema_version is not None:
            body = {**body, "schemaVersion": self.schema_version}
        status, answer = self.transport(self.url + path, headers, json.dumps(body).encode())
        if (kind := class_of(status)) != "verdict":
            raise WireError(kind, f"status {status} from {path}")
        try:
            return json.loads(answer)
        except ValueError as error:
            raise WireError("transient", f"malformed answer from {path}: no JSON") from error

    def pull(self, cursor: str | None, subscription: str | None = None) -> dict:
        asked = {"cursor": cursor, "limit": self.limit, "subscription": subscription}
        return checked_page(self._post(PULL, {k: v for k, v in asked.items() if v is not None or k == "cursor"}))

    def push(self, batch: Sequence[dict]) -> list[dict]:
        return checked_verdicts(self._post(PUSH, {"changes": list(batch)}))


def push_sink(adapter: RestAdapter, order: str = "client_seq", most: int = 1_000) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: pushes a client's outbox in order, at most ``most`` writes a request."""

    def sink(batch: DataFrame, _: int) -> None:
        held: list[dict] = []
        for row in batch.orderBy(order).select("mutation_id", "client_id", order, "op", "entity_type", "id", "data").toLocalIterator():
            own = {"mutationId": row[0], "clientId": row[1], "seq": row[2], "op": row[3], "entityType": row[4], "id": row[5]}
            held.append(own | {"data": json.loads(row[6])} if row[6] else own)
            if len(held) == most:
                adapter.push(held)
                held = []
        if held:
            adapter.push(held)

    return sink
