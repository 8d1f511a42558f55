"""Collections that commands keep by id on the driver: $NI_ARRAY(action, id, ...) and its like.

Each kind is a class whose methods are its actions; an action that lacks arguments, or a collection that isn't there,
gives the empty string, a question after it "0". What grows with the data belongs in the log-based collections instead.
"""

from __future__ import annotations

import inspect
from bisect import bisect_left, insort
from collections import Counter, deque

#: What is asked of a missing collection and then answered by "0" instead of the empty string.
QUESTIONS = {"len", "has", "contains", "count", "destroy"}


def flag(b: bool) -> str:
    return "1" if b else "0"


class Kind:
    """What all collections can."""

    also: dict[str, str] = {}

    def __init__(self, items):
        self.items = items

    def len(self) -> str:
        return str(len(self.items))

    def clear(self) -> str:
        self.items.clear()
        return "1"


class Array(Kind):
    """Values at places from 0."""

    def __init__(self):
        super().__init__([])

    def _at(self, at: str) -> int | None:
        return int(at) if at.isdigit() and int(at) < len(self.items) else None

    def add(self, value: str) -> str:
        self.items.append(value)
        return self.len()

    def get(self, at: str) -> str:
        return "" if (i := self._at(at)) is None else self.items[i]

    def set(self, at: str, value: str) -> str:
        if (i := self._at(at)) is not None:
            self.items[i] = value
        return flag(i is not None)


class Map(Kind):
    """Values by key; keys and values in byte order of keys."""

    def __init__(self):
        super().__init__({})

    def set(self, key: str, value: str) -> str:
        self.items[key] = value
        return "1"

    def get(self, key: str) -> str:
        return self.items.get(key, "")

    def has(self, key: str) -> str:
        return flag(key in self.items)

    def delete(self, key: str) -> str:
        self.items.pop(key, None)
        return "1"

    def _sorted(self) -> list[tuple[str, str]]:
        return sorted(self.items.items(), key=lambda x: x[0].encode())

    def keys(self) -> str:
        return ",".join(k for k, _ in self._sorted())

    def values(self) -> str:
        return ",".join(v for _, v in self._sorted())


class Ends(Kind):
    """Values with two ends: stacks and queues use one of them for each action."""

    def __init__(self):
        super().__init__(deque())

    def addfirst(self, value: str) -> str:
        self.items.appendleft(value)
        return self.len()

    def addlast(self, value: str) -> str:
        self.items.append(value)
        return self.len()

    def popfirst(self) -> str:
        return self.items.popleft() if self.items else ""

    def poplast(self) -> str:
        return self.items.pop() if self.items else ""

    def peekfirst(self) -> str:
        return self.items[0] if self.items else ""

    def peeklast(self) -> str:
        return self.items[-1] if self.items else ""


class Stack(Ends):
    also = {"push": "addlast", "pop": "poplast", "peek": "peeklast"}


class Queue(Ends):
    also = {"enqueue": "addlast", "push": "addlast", "dequeue": "popfirst", "pop": "popfirst", "peek": "peekfirst"}


class Deque(Ends):
    also = {"pushfirst": "addfirst", "pushlast": "addlast"}


class Sorted(Kind):
    """Distinct values in byte order."""

    also = {"contains": "has", "remove": "delete", "del": "delete"}

    def __init__(self):
        super().__init__([])

    def _place(self, value: str) -> tuple[int, bool]:
        at = bisect_left(self.items, value.encode())
        return at, at < len(self.items) and self.items[at] == value.encode()

    def add(self, value: str) -> str:
        if not self._place(value)[1]:
            insort(self.items, value.encode())
        return self.len()

    def has(self, value: str) -> str:
        return flag(self._place(value)[1])

    def delete(self, value: str) -> str:
        at, there = self._place(value)
        del self.items[at : at + there]
        return "1"

    def toseq(self) -> str:
        return ",".join(x.decode() for x in self.items)


class Bag(Kind):
    """Values with how often they were added."""

    also = {"remove": "delete", "del": "delete"}

    def __init__(self):
        super().__init__(Counter())

    def add(self, value: str) -> str:
        self.items[value] += 1
        return self.count(value)

    def count(self, value: str) -> str:
        return str(self.items[value])

    def delete(self, value: str) -> str:
        if self.items[value] <= 1:
            del self.items[value]
        else:
            self.items[value] -= 1
        return "1"

    def len(self) -> str:
        return str(self.items.total())


Map.also = {"del": "delete"}
KINDS = {"ARRAY": Array, "OBJECT": Map, "MAP": Map, "STACK": Stack, "QUEUE": Queue, "SET": Sorted, "SORTED": Sorted, "DEQUE": Deque, "BAG": Bag}


class Collections:
    """All collections of a session, by kind and id."""

    def __init__(self):
        self.all: dict[tuple[str, str], Kind] = {}

    def call(self, kind: str, arguments: list[str]) -> str:
        """The value of $NI_kind(action, id, ...)."""
        if len(arguments) < 2:
            return ""
        action, who, rest = arguments[0].lower(), (kind, arguments[1]), arguments[2:]
        if action == "create":
            self.all[who] = KINDS[kind]()
            return arguments[1]
        held = self.all.get(who)
        if held is None:
            return "0" if action in QUESTIONS else ""
        if action == "destroy":
            del self.all[who]
            return "1"
        method = getattr(held, held.also.get(action, action), None)
        if action.startswith("_") or not inspect.ismethod(method):
            return ""
        wanted = len(inspect.signature(method).parameters)
        return method(*rest[:wanted]) if len(rest) >= wanted else ""
