"""Typed shapes of what the service answers (K4)."""

from __future__ import annotations

from typing import Any, NotRequired, TypedDict


class Event(TypedDict):
    id: str
    topic: str
    partition: int
    offset: int
    timestamp: str
    type: str
    key: NotRequired[str]
    headers: NotRequired[dict[str, str]]
    data: Any
    idempotency_key: NotRequired[str]


class Published(TypedDict):
    """One of a batch's results: the event, or why it was refused."""

    event: NotRequired[Event]
    error: NotRequired[str]


class Page(TypedDict):
    events: list[Event]
    next_offset: int
    end_offset: int
    scanned: int
    done: bool


class Attempt(TypedDict):
    subscription_id: str
    event_id: str
    attempt: int
    status: str
    http_status: NotRequired[int]
    error: NotRequired[str]


class HistoryPage(TypedDict):
    entries: list[Attempt]
    next_cursor: int
    has_more: bool


class Member(TypedDict):
    id: str
    expires_at: str
    partitions: list[int]


class Snapshot(TypedDict):
    """A group: its committed offsets and lag by partition, and its members."""

    topic: str
    name: str
    epoch: int
    offsets: dict[str, int]
    members: NotRequired[list[Member]]
    lag: NotRequired[dict[str, int]]
