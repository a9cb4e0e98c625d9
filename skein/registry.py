"""Components by name."""

from __future__ import annotations

from typing import Any


class Registry(dict):
    """Named components of one kind; an unknown name is an error that lists the known ones."""

    def __init__(self, kind: str, entries: dict[str, Any] | None = None):
        super().__init__(entries or {})
        self.kind = kind

    def named(self, name: str) -> Any:
        """The component ``name``."""
        if name not in self:
            raise ValueError(f"unknown {self.kind} {name!r}; known: {', '.join(sorted(self))}")
        return self[name]
