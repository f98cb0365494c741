"""Things found by name."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Generic, TypeVar

T = TypeVar("T")


class Registry(Generic[T]):
    """Named things of one kind; a name is given once, an unknown one raises with those there are."""

    def __init__(self, kind: str):
        self.kind = kind
        self._items: dict[str, T] = {}

    def register(self, name: str, item: T) -> T:
        if name in self._items:
            raise ValueError(f"{self.kind} {name!r} is there already")
        self._items[name] = item
        return item

    def get(self, name: str) -> T:
        if name not in self._items:
            raise KeyError(f"no {self.kind} {name!r}; there are {', '.join(self.available())}")
        return self._items[name]

    def available(self) -> list[str]:
        return sorted(self._items)

    def __iter__(self) -> Iterator[str]:
        return iter(self._items)

    def __contains__(self, name: object) -> bool:
        return name in self._items
