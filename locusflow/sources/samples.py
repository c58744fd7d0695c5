"""Sample arguments: ``name=path`` or a path."""

from __future__ import annotations

from pathlib import PurePath


def parse_sample(arg: str) -> tuple[str, str]:
    """(display name, path): split at the first '='; else the file's stem names it."""
    name, eq, path = arg.partition("=")
    return (name, path) if eq else (PurePath(arg).stem or "unknown", arg)
