"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to a string. Nothing is known
about it: each turn's span is found by rendering successive prefixes of the
conversation. Where the new output continues the one before, the difference is the
turn's span. Where it does not, the template rewrites history (it drops, moves or
changes earlier turns), which is reported, and no span of the conversation is
trusted. Where in its span a turn's text lies is found in the same way: the
prefix is rendered once more with a probe in place of the text; what stands before
and after the probe is the template's own.

Loss covers the texts of the assistant's turns, nothing of the template.

The turns of a conversation are brought together by one shuffle and read as a
stream in order, so a task holds one conversation, the output of which is one row.
Rendering prefixes costs the square of a conversation's turns, the price of not
knowing the template.

Defined cases: a null text or role is empty; turns with equal numbers follow in the
order of role and text, null numbers come first; a null conversation id is a
conversation; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
LOSS_ROLE = "assistant"
#: Text that no template treats specially, in place of a turn's own.
PROBE = "qzxprobexzq"

_OPENS = re.compile(r"[\\<\[]")
_OPENED = re.compile(r"([\\<\[])\\")


def escape(text: str) -> str:
    """Control strings begin with ``<`` or ``[``: a backslash behind these, and behind itself, breaks them."""
    return _OPENS.sub(lambda m: m.group() + "\\", text)


def unescape(text: str) -> str:
    return _OPENED.sub(r"\1", text)


def bracket_template(turns: list[Turn]) -> str:
    """``[INST] text [/INST]`` for users, ``text </s>`` for assistants, ``<<role>> text <</role>>`` for all others."""
    parts = ["<s>"]
    for role, text in turns:
        text = escape(text)
        if role == "user":
            parts.append(f"[INST] {text} [/INST]")
        elif role == LOSS_ROLE:
            parts.append(f" {text} </s>")
        else:
            parts.append(f"<<{escape(role)}>> {text} <</>>")
    return "".join(parts)


def locate(turns: list[Turn], template: Template = bracket_template) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]], bool]:
    """The rendered conversation, each turn's span, the text's span within each, and whether history was rewritten."""
    before, spans, texts = template([]), [], []
    for k in range(len(turns)):
        after = template(turns[: k + 1])
        if not after.startswith(before):
            return template(turns), [], [], True
        role, _ = turns[k]
        probed = template([*turns[:k], (role, PROBE)])
        at = probed.find(PROBE, len(before)) if probed.startswith(before) else -1
        tail = len(probed) - at - len(PROBE)
        if at < 0 or after[:at] != probed[:at] or len(after) - tail < at or after[len(after) - tail :] != probed[at + len(PROBE) :]:
            return template(turns), [], [], True
        spans.append((len(before), len(after)))
        texts.append((at, len(after) - tail))
        before = after
    return before, spans, texts, False


_SCHEMA = "conv_id long, text string, roles array<string>, spans array<struct<start:int,end:int>>, texts array<struct<start:int,end:int>>, loss array<struct<start:int,end:int>>, rewrites_history boolean"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_KINDS = {"conv_id": pa.int64(), "text": pa.string(), "roles": pa.list_(pa.string()), "spans": _SPAN, "texts": _SPAN, "loss": _SPAN, "rewrites_history": pa.bool_()}


def _row(conv_id: int | None, turns: list[Turn], template: Template) -> dict:
    text, spans, texts, rewrites = locate(turns, template)
    named = lambda s: [{"start": a, "end": b} for a, b in s]
    loss = [s for s, (role, _) in zip(texts, turns, strict=True) if role == LOSS_ROLE] if texts else []
    return {"conv_id": conv_id, "text": text, "roles": [r for r, _ in turns], "spans": named(spans), "texts": named(texts), "loss": named(loss), "rewrites_history": rewrites}


def format_conversations(conversations: DataFrame, template: Template = bracket_template) -> DataFrame:
    """One row for each conversation: text, roles, spans, texts and loss (in code points), rewrites_history."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        current, turns, done, size = None, [], [], 0
        out = lambda rows: pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(_KINDS.items())))
        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if turns and conv_id != current:
                    done.append(_row(current, turns, template))
                    size += len(done[-1]["text"])
                    turns = []
                    if size > 4_000_000:
                        yield out(done)
                        done, size = [], 0
                current = conv_id
                turns.append((role or "", text or ""))
        if turns:
            done.append(_row(current, turns, template))
        yield out(done)

    ordered = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, _SCHEMA)


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted rows say when read back: turns, loss and size of each conversation."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites_history"]

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                text = row["text"]
                turns = "".join(f"{role}\n{unescape(text[s['start'] : s['end']])}\n" for role, s in zip(row["roles"], row["texts"], strict=False))
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in row["loss"])
                sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
                rows.append((row["conv_id"], len(row["roles"]), sha(turns), len(loss), sha(loss), len(text), row["rewrites_history"]))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean")
