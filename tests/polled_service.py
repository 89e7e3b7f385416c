"""A stand-in for paged and long-poll message services."""

import json
import os

PAGES = {
    ("a", ""): {"items": [{"message_id": "a1"}, {"message_id": "a2"}], "has_more": True, "page_token": "n"},
    ("a", "n"): {"items": [{"message_id": "a3"}], "has_more": False, "page_token": "x"},
    ("b", ""): {"items": [{"message_id": "b1"}], "has_more": True, "page_token": ""},
}


def page(chat, token):
    return PAGES[(chat, token)]


# A service of several chats: messages numbered from 0 per chat, newest page first; its length is a file tests write.

def _sizes():
    with open(os.environ["POLLED_SIZES"]) as file:
        return json.load(file)


def chat_list(token):
    chats = sorted(_sizes())
    at = int(token or 0)
    return {"items": [{"chat_id": c} for c in chats[at:at + 2]], "has_more": at + 2 < len(chats), "page_token": str(at + 2)}


def heads(chats):
    sizes = _sizes()
    return {c: sizes[c] for c in chats}


def newest_first(chat, token):
    size = _sizes()[chat]
    top = int(token) if token else size
    items = [{"message_id": str(n), "text": f"{chat}{n}"} for n in range(top - 1, max(-1, top - 5), -1)]
    with open(os.environ["POLLED_SIZES"] + ".calls", "a") as file:
        file.write(f"{chat} {os.getpid()}\n")
    return {"items": items, "has_more": top - 4 > 0, "page_token": str(top - 4)}


def between(chat, start, end):
    return ({"message_id": str(n), "text": f"{chat}{n}"} for n in range(start, end))


def aged(chat, token):
    """Pages of two messages with times; chat c has none."""
    top = int(token) if token else 9
    items = [] if chat == "c" else [{"message_id": n, "ts": 1_700_000_000 + n} for n in (top, top - 1)]
    return {"items": items, "has_more": chat != "c" and top > 2, "page_token": str(top - 2)}
