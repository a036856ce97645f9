"""Deterministic stand-ins for models, for registered queries, tests and offline
runs: their replies follow from the prompt, so SQL can state them."""

from __future__ import annotations

import hashlib
import json
import re


def length_rule_evaluator(batch: list) -> list[str]:
    """Deterministic stand-in evaluator: grade = 1 + (characters of the last
    user message mod 3). For tests and offline runs only."""
    out = []
    for msgs in batch:
        user = next((m.get("content") or "" for m in reversed(msgs) if m.get("role") == "user"), "")
        out.append(f"score: {1 + len(user) % 3}\nreason: rule of thumb")
    return out


def thinking_evaluator(batch: list) -> list[str]:
    """Stand-in evaluator that reasons first and names a wrong score there."""
    return ["maybe score: 9\n</think>\n" + r for r in length_rule_evaluator(batch)]


def failing_evaluator(batch: list) -> list[str]:
    """Stand-in evaluator that gives no reply to prompts of certain lengths."""
    replies = length_rule_evaluator(batch)
    return ["" if len(m[-1]["content"]) % 5 == 0 else r for m, r in zip(batch, replies)]


def label_echo_generator(attempt: int = 1):
    """Deterministic stand-in generator for one attempt: writes a question and
    copies the labels listed as evidence lines (``* Label -- ...``) in the
    prompt; on the first attempt, prompts of odd length get an unparseable
    reply."""
    def generate(batch: list) -> list[str]:
        out = []
        for msgs in batch:
            user = next((m.get("content") or "" for m in reversed(msgs) if m.get("role") == "user"), "")
            section = user.split("## Problems the new question must have", 1)[-1].split("## Material", 1)[0]
            labels = re.findall(r"^\* (.+?) -- ", section, flags=re.M)
            if attempt == 1 and len(user) % 2 == 1:
                out.append("I cannot do that.")
                continue
            q = f"What is said about item {len(user) % 97}?"
            out.append(json.dumps({"question": q, "error_label": "; ".join(labels)}))
        return out
    return generate


def hashed_reviewer(name: str):
    """Deterministic stand-in reviewer: confidence from a hash of the prompt."""
    def review(batch: list) -> list[str]:
        out = []
        for msgs in batch:
            user = next((m.get("content") or "" for m in reversed(msgs) if m.get("role") == "user"), "")
            h = int(hashlib.md5((name + "|" + user).encode("utf-8")).hexdigest()[:8], 16)
            out.append(f"{(h % 101) / 100:.2f}")
        return out
    return review
