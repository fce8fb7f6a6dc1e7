"""Model calls behind a protocol. Nothing here reaches a network: replies are replayed."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Protocol


@dataclass
class Reply:
    text: str
    tokens: int = 0
    dollars: float = 0.0


class ModelClient(Protocol):
    def call(self, messages: list[dict], tier: str = "small", max_tokens: int = 2048) -> Reply: ...


@dataclass
class Replay:
    """Gives recorded replies in turn; raises when there are none, and callers then fail closed."""

    replies: list[str] = field(default_factory=list)
    calls: list[list[dict]] = field(default_factory=list)

    def call(self, messages: list[dict], tier: str = "small", max_tokens: int = 2048) -> Reply:
        self.calls.append(messages)
        if not self.replies:
            raise RuntimeError("no recorded reply is left")
        return Reply(self.replies.pop(0))


def first_object(text: str, need: str | None = None) -> dict | None:
    """The first balanced JSON object of a text (which has the key `need`, if named); None without one."""
    text = re.sub(r"(?s)<think>.*?</think>", "", text or "")
    decoder = json.JSONDecoder()
    for m in re.finditer(r"\{", text):
        try:
            found, _ = decoder.raw_decode(text[m.start() :])
        except ValueError:
            continue
        if isinstance(found, dict) and (need is None or need in found):
            return found
    return None


def first_string(text: str, fields: tuple[str, ...]) -> str | None:
    """A string field's value, from JSON that may be broken."""
    whole = first_object(text)
    for name in fields:
        if whole and isinstance(whole.get(name), str):
            return whole[name]
        if m := re.search(rf'"{re.escape(name)}"\s*:\s*"((?:[^"\\]|\\.)*)', text or ""):
            try:
                return json.loads(f'"{m[1]}"')
            except ValueError:
                return m[1]
    return None


def answer_text(text: str) -> str:
    """The final answer of a reply: its JSON answer field, else its visible text without a trailing tool call."""
    visible = re.sub(r"(?s)<think>.*?</think>", "", text or "").strip()
    visible = re.sub(r"^```\w*\s*|\s*```$", "", visible).strip()
    found = first_string(visible, ("answer", "visible_text")) if "{" in visible else None
    if found is not None:
        return found.strip()
    cut = re.search(r'\{[^{}]*"tool_name"', visible)
    return (visible[: cut.start()] if cut else visible).strip()


def tool_call(text: str) -> tuple[str, dict] | None:
    """The tool and arguments of a reply."""
    found = first_object(text, "tool_name")
    if not found:
        return None
    arguments = found.get("arguments") or found.get("args") or {}
    return str(found["tool_name"]), arguments if isinstance(arguments, dict) else {}
