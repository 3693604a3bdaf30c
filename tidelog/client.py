"""SDK (K1-K3, K5): a client over an injected transport, its subscribe loop and a command line.

transport(method, path, body) returns (status, body) or raises OSError; nothing here opens a connection by itself. What
is sent has the fields that the service's strict decoder knows, and no others.
"""

from __future__ import annotations

import argparse
import itertools
import json
import sys
import time
from collections.abc import Callable, Iterator
from urllib.parse import quote, urlencode

from tidelog.shapes import Event, HistoryPage, Page, Published, Snapshot

RETRIED = {429, 502, 503, 504}
TRIES, FIRST_WAIT, LONGEST_WAIT = 3, 0.2, 5.0


class ClientError(Exception):
    """A refusal (status) or a transport failure (status 0); details is the service's answer."""

    def __init__(self, status: int, message: str, details=None):
        super().__init__(message)
        self.status, self.details = status, details

    @property
    def transient(self) -> bool:
        return not self.status or self.status in RETRIED


def _message(answer) -> str:
    return str(answer.get("error", answer)) if isinstance(answer, dict) else str(answer)


class Delivery:
    """A leased batch of one partition's events. One of ack, nack and commit ends the lease."""

    def __init__(self, client: Client, path: str, member: str, body: dict):
        self.client, self.path = client, path
        self.partition, self.events = body["partition"], body["events"]
        self.lease = {"member": member, "epoch": body["epoch"], "partition": body["partition"], "token": body["token"]}

    def ack(self) -> None:
        self.client.call("POST", f"{self.path}/ack", self.lease)

    def nack(self) -> None:
        self.client.call("POST", f"{self.path}/nack", self.lease)

    def commit(self, next_offset: int) -> None:
        """Settles the events before next_offset; the rest comes again."""
        self.client.call("POST", f"{self.path}/commit", self.lease | {"next_offset": next_offset})


class Client:
    def __init__(self, transport: Callable, sleep: Callable[[float], None] = time.sleep):
        self.transport, self.sleep = transport, sleep

    def call(self, method: str, path: str, body: dict | None = None):
        """Reads are tried TRIES times on transient failures; mutations once, as their outcome may be unknown. Redirects are errors."""
        tries = TRIES if method == "GET" else 1
        for n in itertools.count(1):
            try:
                status, answer = self.transport(method, path, body)
                if 200 <= status < 300:
                    return answer
                failure = ClientError(status, _message(answer), answer)
            except OSError as e:
                failure = ClientError(0, str(e))
            if n >= tries or not failure.transient:
                raise failure
            self.sleep(FIRST_WAIT * 2 ** (n - 1))

    @staticmethod
    def _topic(topic: str, *more: str) -> str:
        return "/".join(["/v1/topics", quote(topic, safe=""), *more])

    def _group(self, topic: str, group: str) -> str:
        return self._topic(topic, "groups", quote(group, safe=""))

    def publish(self, topic: str, kind: str, data, key: str = "", headers: dict | None = None, idempotency_key: str = "") -> Event:
        return self.call("POST", self._topic(topic, "events"), {"type": kind, "key": key, "data": data, "headers": headers or {}, "idempotency_key": idempotency_key})

    def publish_batch(self, topic: str, events: list[dict]) -> list[Published]:
        """One result an event, in order: the event or why it was refused. A refusal doesn't undo the others."""
        return self.call("POST", self._topic(topic, "events", "batch"), {"events": events})["results"]

    def scan(self, topic: str, partition: int, offset: int = 0, limit: int = 100, **filters) -> Page:
        """filters: end_offset, from_time, until_time (RFC 3339), type, key, id."""
        return self.call("GET", f"{self._topic(topic, 'events')}?{urlencode({'partition': partition, 'offset': offset, 'limit': limit, **filters})}")

    def scan_all(self, topic: str, partition: int, offset: int = 0, **filters) -> Iterator[Event]:
        """Pages until the first page's end; an empty page isn't the end."""
        page = None
        while page is None or not page["done"]:
            if page is not None:
                offset, filters = page["next_offset"], {**filters, "end_offset": page["end_offset"]}
            page = self.scan(topic, partition, offset, **filters)
            yield from page["events"]

    def webhook_history(self, subscription: str, after: int = 0, limit: int = 50) -> HistoryPage:
        return self.call("GET", f"/v1/webhooks/{quote(subscription, safe='')}/history?{urlencode({'after': after, 'limit': limit})}")

    def dead_letters(self, topic: str, partition: int = 0, offset: int = 0, **filters) -> Page:
        return self.call("GET", f"{self._topic(topic, 'dead-letters')}?{urlencode({'partition': partition, 'offset': offset, **filters})}")

    def resolve_dead_letter(self, topic: str, partition: int, offset: int, action: str):
        if action not in ("retry", "discard"):
            raise ValueError("a dead letter is retried or discarded")
        return self.call("POST", self._topic(topic, "dead-letters", action), {"partition": partition, "offset": offset, "confirm": True})

    def replay(self, topic: str, target: str, replay_id: str, partition: int, offset: int, end_offset: int, limit: int = 100, **filters):
        """One page of a replay; the same replay_id again copies nothing twice."""
        body = {"target": target, "replay_id": replay_id, "partition": partition, "offset": offset, "end_offset": end_offset, "limit": limit, "confirm": True}
        return self.call("POST", self._topic(topic, "replay"), body | filters)

    def join(self, topic: str, group: str, member: str) -> Snapshot:
        return self.call("POST", f"{self._group(topic, group)}/join", {"member": member})

    def leave(self, topic: str, group: str, member: str):
        return self.call("POST", f"{self._group(topic, group)}/leave", {"member": member})

    def reset(self, topic: str, group: str, partition: int, offset: int):
        return self.call("POST", f"{self._group(topic, group)}/reset", {"partition": partition, "offset": offset, "confirm": True})

    def pull(self, topic: str, group: str, member: str, epoch: int, limit: int = 100) -> list[Delivery]:
        path = self._group(topic, group)
        found = self.call("POST", f"{path}/pull", {"member": member, "epoch": epoch, "limit": limit})
        return [Delivery(self, path, member, x) for x in found or []]

    def subscribe(self, topic: str, group: str, member: str, callback: Callable[[Delivery], None], running: Callable[[], bool] = lambda: True, limit: int = 100) -> None:
        """Joins, pulls and calls back until running says no, then leaves.

        A fenced pull joins again; a busy service is waited for (LONGEST_WAIT at most); after a lost connection the
        member joins again, so leases of an answer that never came aren't taken for its own. The callback's errors
        and those of joining are the caller's, and leaving never hides them.
        """
        epoch, waits = self.join(topic, group, member)["epoch"], 0
        try:
            while running():
                try:
                    found = self.pull(topic, group, member, epoch, limit)
                except ClientError as e:
                    if e.status != 409 and not e.transient:
                        raise
                    if e.transient:
                        self.sleep(min(LONGEST_WAIT, FIRST_WAIT * 2**waits))
                        waits += 1
                    if e.status in (0, 409):
                        epoch = self.join(topic, group, member)["epoch"]
                    continue
                waits = 0
                for delivery in found:
                    callback(delivery)
                if not found:
                    self.sleep(FIRST_WAIT)
        except BaseException:
            try:
                self.leave(topic, group, member)
            except Exception:  # noqa: BLE001  the first error is the one to see
                pass
            raise
        self.leave(topic, group, member)


def _consume(client: Client, a: argparse.Namespace) -> list[Event]:
    """Subscribes and acknowledges batch by batch until so many events have come, or for ever (0)."""
    seen: list[Event] = []

    def take(delivery: Delivery) -> None:
        seen.extend(delivery.events)
        delivery.ack()

    client.subscribe(a.topic, a.group, a.member, take, running=lambda: not a.events or len(seen) < a.events)
    return seen


#: Command: its arguments (flags with their defaults), and what it does.
COMMANDS = {
    "topics list": ({}, lambda c, a: c.call("GET", "/v1/topics")),
    "topics create": ({"name": None, "--partitions": 4}, lambda c, a: c.call("POST", "/v1/topics", {"name": a.name, "partitions": a.partitions})),
    "topic inspect": ({"name": None}, lambda c, a: c.call("GET", c._topic(a.name))),
    "publish": ({"topic": None, "type": None, "data": None, "--key": ""}, lambda c, a: c.publish(a.topic, a.type, json.loads(a.data), a.key)),
    "consume": ({"topic": None, "group": None, "member": None, "--events": 0}, _consume),
}


def main(args: list[str], client: Client, out=sys.stdout) -> int:
    """topics list | topics create NAME | topic inspect NAME | publish TOPIC TYPE DATA | consume TOPIC GROUP MEMBER."""
    words = next((n for n in (2, 1) if " ".join(args[:n]) in COMMANDS), 0)
    if not words:
        print(main.__doc__, file=sys.stderr)
        return 2
    wanted, act = COMMANDS[" ".join(args[:words])]
    parser = argparse.ArgumentParser(prog="tidelog " + " ".join(args[:words]))
    for name, default in wanted.items():
        parser.add_argument(name, **({} if default is None else {"default": default, "type": type(default)}))
    print(json.dumps(act(client, parser.parse_args(args[words:]))), file=out)
    return 0
