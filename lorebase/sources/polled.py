"""Paged and polled message services as Spark data sources.

The services differ only in how a page is fetched, so that is a function named in the options
(``fetch = "package.module:function"``). No transport ships with the library.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


def named(name: str):
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _fetcher(options: dict):
    return named(options["fetch"])


def _pages(fetch, more=lambda items: True) -> Iterator[dict]:
    """Items of all pages, one page at a time, until the service or ``more`` says that the rest isn't needed."""
    token = ""
    while True:
        page = fetch(token)
        yield from page.get("items", [])
        token = page.get("page_token") or ""
        if not (page.get("has_more") and token and more(page.get("items", []))):
            return


def _chats(options: dict) -> list[str]:
    if "chatlist" not in options:
        return [c for c in options["chats"].split(",") if c]
    return [str(item["chat_id"]) for item in _pages(named(options["chatlist"]))]


class _Chat(InputPartition):
    def __init__(self, chat: str):
        super().__init__(chat)
        self.chat = chat


class _PageReader(DataSourceReader):
    """One partition per chat; pages are followed until the service has no more."""

    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Chat(chat) for chat in _chats(self.options)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fetch = _fetcher(self.options)
        for item in _pages(lambda token: fetch(partition.chat, token)):
            yield partition.chat, str(item.get("message_id", "")), json.dumps(item, ensure_ascii=False)


class _Range(InputPartition):
    """Positions ``start`` to ``end - 1`` of one chat."""

    def __init__(self, chat: str, start: int, end: int):
        super().__init__((chat, start, end))
        self.chat, self.start, self.end = chat, start, end


class _FeedReader(DataSourceStreamReader):
    """Messages between two offsets, fetched by the executors.

    An offset holds one position per chat, one past the last message, and lives in the query's checkpoint; a batch that is
    run again asks for the same positions. A chat is a partition, or several of ``positionsperpartition`` where ``between`` is
    named, a function that fetches a range of one chat (chat, start, end -> items). The driver only learns how far each chat goes: from the function named in
    ``heads`` (chats -> {chat: next position}), or else from the ids on each chat's first page. Chats come from ``chats``
    or page by page from the function in ``chatlist``, so a chat that appears later is read from ``startingoffset`` on:
    a number, ``earliest`` (the default) or ``latest`` (what is there before the first batch counts as seen).
    """

    def __init__(self, options: dict):
        self.options = options
        self.most = int(options.get("positionsperpartition", 10_000)) if "between" in options else 1 << 62
        self.seen: dict[str, int] = {}  # a chat that the service stops to list keeps its place

    def _heads(self) -> dict[str, int]:
        chats = _chats(self.options)
        if "heads" in self.options:
            found = {c: int(n) for c, n in named(self.options["heads"])(chats).items()}
        else:
            fetch = _fetcher(self.options)
            found = {c: 1 + max((int(i["message_id"]) for i in fetch(c, "").get("items", [])), default=-1) for c in chats}
        self.seen = {**self.seen, **found}
        return self.seen

    def initialOffset(self) -> dict:
        return self._heads() if self.options.get("startingoffset") == "latest" else {}

    def latestOffset(self) -> dict:
        return self._heads()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.seen = {**start, **self.seen}
        first = self.options.get("startingoffset", "earliest")
        first = int(first) if first.isdigit() else 0
        return [_Range(chat, at, min(at + self.most, stop)) for chat, stop in end.items() for at in range(start.get(chat, first), stop, self.most)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """Just the range, or pages newest first until one reaches back to its start."""
        if "between" in self.options:
            items = named(self.options["between"])(partition.chat, partition.start, partition.end)
        else:
            fetch = _fetcher(self.options)
            items = _pages(lambda token: fetch(partition.chat, token), lambda page: all(int(i["message_id"]) >= partition.start for i in page))
        for item in items:
            if partition.start <= int(item["message_id"]) < partition.end:
                yield partition.chat, str(item["message_id"]), json.dumps(item, ensure_ascii=False)


class PolledMessages(DataSource):
    """``spark.read.format("polled_messages")`` for paged history, ``spark.readStream`` for what is new, batch by batch.

    Rows: chat_id, message_id, payload (JSON).
    """

    @classmethod
    def name(cls) -> str:
        return "polled_messages"

    def schema(self) -> str:
        return "chat_id STRING, message_id STRING, payload STRING"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _FeedReader(dict(self.options))


def register(spark) -> None:
    spark.dataSource.register(PolledMessages)
