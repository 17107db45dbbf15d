"""Rounds between a chat model and tools, both injected: how a name is held against an authority."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

Chat = Callable[[list[dict]], "dict | None"]
Tools = dict[str, Callable[..., object]]


def dispatch(call: dict, tools: Tools) -> str:
    """The answer of the tool that a call names, as text. Arguments may come as JSON; what can't be run is answered by an error and never raises."""
    said = call.get("function", call)
    name, arguments = said.get("name", ""), said.get("arguments") or {}
    if name not in tools:
        return f"ERROR: no tool {name}"
    try:
        given = json.loads(arguments) if isinstance(arguments, str) else dict(arguments)
        found = tools[name](**given)
    except Exception as e:  # a tool's failure is the model's to deal with
        return f"ERROR: {e}"
    return found if isinstance(found, str) else json.dumps(found, sort_keys=True)


NONE = {"authority": None, "label": None, "confidence": 0.0, "linked": False}
#: Confidence of an authority that only prose names.
PROSE = 0.7


def submitted(given: object) -> dict:
    """What a submission says: linked for an id with a confidence over 0, which is 1 at most; else nothing is known."""
    try:
        given = json.loads(given) if isinstance(given, str) else given
        found, sure = (given.get("qid") or "").strip(), float(given.get("confidence") or 0)
        label = (given.get("label") or "").strip() or None
    except (ValueError, TypeError, AttributeError):
        return dict(NONE)
    return {"authority": found, "label": label, "confidence": min(sure, 1.0), "linked": True} if found and sure > 0 else dict(NONE)


def spoken(content: object) -> dict | None:
    """A result in a reply without calls: JSON with a ``qid``, or an id in prose, with what follows it in capitals as label. None where there is neither."""
    said = content if isinstance(content, str) else ""
    try:
        read = json.loads(said)
        if isinstance(read, dict) and "qid" in read:
            return submitted(read)
    except ValueError:
        pass
    if found := re.search(r"\bQ[0-9]+\b", said):
        named = re.match(r"[:\s\-\u2014(]+([A-Z][^.,)\n]{2,40})", said[found.end() :])
        return submitted({"qid": found[0], "label": named[1] if named else "", "confidence": PROSE})
    return None


def resolve(text: str, kind: str, chat: Chat, tools: Tools, rounds: int = 4, passage: str = "", final: str = "submit_result") -> dict:
    """Search, verify, submit: at most so many rounds until the model calls the final tool, or says its result without a call.

    A reply with neither is answered by a reminder; no reply ends the talk.
    """
    about = f'\nContext: "{passage[:300]}"' if passage else ""
    talk: list[dict] = [{"role": "system", "content": f"Link names to an authority. Search once, then call {final}."}, {"role": "user", "content": f'Text: "{text}"\nType: {kind}{about}'}]
    for _ in range(rounds):
        reply = chat(talk)
        if reply is None:
            return dict(NONE)
        talk.append(reply)
        calls = reply.get("tool_calls") or []
        for call in calls:
            said = call.get("function", call)
            if said.get("name") == final:
                return submitted(said.get("arguments") or {})
            talk.append({"role": "tool", "content": dispatch(call, tools)})
        if not calls:
            if (result := spoken(reply.get("content"))) is not None:
                return result
            talk.append({"role": "user", "content": f"Call {final} now."})
    return dict(NONE)


def resolver(chat: Chat, tools: Tools, **how) -> Callable[[str, str], str | None]:
    """For ``ner.link``: name and kind to authority."""
    return lambda text, kind: resolve(text, kind, chat, tools, **how)["authority"]
