"""Names and ids of units: stable across runs, free of collisions."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from pathlib import PurePath


def unit_id(*parts: str) -> str:
    """Ten hex digits over kind, path and locator."""
    return hashlib.sha256("||".join(parts).encode()).hexdigest()[:10]


def safe_identifier(name: str) -> str:
    out = re.sub(r"[^0-9A-Za-z]+", "_", str(name or "").strip()).strip("_")
    return out or "col"


def unique_headers(names: Iterable[str]) -> list[str]:
    """Safe column names; repeats, whatever their case, get _1, _2 and so on."""
    taken: set[str] = set()
    out = []
    for name in names:
        base = safe_identifier(name)
        found, k = base, 0
        while found.lower() in taken:
            k += 1
            found = f"{base}_{k}"
        taken.add(found.lower())
        out.append(found)
    return out


def table_name(path: str, locator: str = "") -> str:
    """<stem>_<six hex digits> of a file's table."""
    stem = safe_identifier(PurePath(path).stem + (f"_{locator}" if locator else ""))
    return f"{stem}_{hashlib.sha256(f'{path}||{locator}'.encode()).hexdigest()[:6]}"


def reserve(name: str, kind: str, taken: set[str]) -> str:
    """The name, or with its kind and a counter where it is taken in any case."""
    found, k = name, 0
    while found.lower() in taken:
        found = f"{name}_{kind}" if not k else f"{name}_{kind}_{k}"
        k += 1
    taken.add(found.lower())
    return found
