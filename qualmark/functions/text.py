"""String expressions: stripping, slot filling, joined texts, chat rendering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab

WHITESPACE = vocab.WHITESPACE
#: One blank in a regular expression, Unicode blanks included.
BLANK = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITESPACE) + "]"


def ustrip(c: Column) -> Column:
    """Strip whitespace from both ends exactly like ``str.strip()``; NULL
    stays NULL. A plain character-set trim: no regex, codegen'd."""
    return F.btrim(c, F.lit(WHITESPACE))


def fill_slots(template: Column, slots: Sequence[tuple[str, Column]]) -> Column:
    """Literal, sequential slot replacement (``str.replace`` chained).

    Each replacement sees the result of the previous one, so a value that
    contains a later slot name is expanded too. A NULL value gives a NULL
    prompt.
    """
    out = template
    for name, value in slots:
        out = F.replace(out, F.lit(name), value)
    return out


def join_parts(parts: Sequence[Column], sep: str) -> Column:
    """``a SEP b SEP c``; NULL if any part is NULL (unlike ``concat_ws``)."""
    items: list[Column] = []
    for i, p in enumerate(parts):
        if i:
            items.append(F.lit(sep))
        items.append(p)
    return F.concat(*items)


def truncate_tokens(text: Column, max_tokens: int = vocab.MAX_TOKENS) -> Column:
    """Keep the first ``max_tokens`` whitespace tokens (approximate model cap)."""
    toks = F.split(ustrip(text), BLANK + "+")
    return F.array_join(F.slice(toks, 1, max_tokens), " ")


def few_shot_block(passage: Column, answer: Column, question: Column,
                   labels: Column) -> Column:
    """One example framed by ``---`` lines (fixed layout of the generator)."""
    # FIXED VALUES: line layout of a few-shot example.
    return F.concat(
        F.lit("---\n        Passage: "), passage,
        F.lit("\n        Answer: "), answer,
        F.lit("\n        Question: "), question,
        F.lit("\n        Error_label: "), labels,
        F.lit("\n    ---"),
    )


def message(role: str | Column, content: Column) -> Column:
    r = F.lit(role) if isinstance(role, str) else role
    return F.struct(r.alias("role"), content.alias("content"))


def build_messages(system_text: str, user_content: Column) -> Column:
    """``array<struct<role,content>>`` with a system then a user message."""
    return F.array(message("system", F.lit(system_text)), message("user", user_content))


def render_chat(messages: Column, add_generation_prompt: bool = True) -> Column:
    """Chat transcript: begin marker, per message header + stripped content +
    end marker, then an optional assistant cue."""
    body = F.array_join(
        F.transform(messages, lambda m: F.concat(
            F.lit(vocab.CHAT_HEADER_START), m["role"], F.lit(vocab.CHAT_HEADER_END),
            ustrip(m["content"]), F.lit(vocab.CHAT_TURN_END))),
        "")
    parts = [F.lit(vocab.CHAT_BEGIN), body]
    if add_generation_prompt:
        parts.append(F.lit(vocab.CHAT_HEADER_START + "assistant" + vocab.CHAT_HEADER_END))
    return F.concat(*parts)
