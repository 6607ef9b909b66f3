"""Operator 5, chat formatting by schema fingerprint.

A record is a JSON object in one of several layouts. Its fingerprint is the hash of the sorted set of its nested field
paths (array elements share the path "name[]"); fields no layout cares about can be named as ignored. The fingerprint
selects a declarative mapping, data rather than code, that yields canonical turns (role, text). A record whose
fingerprint no mapping has comes out with status "unmapped" and no turns: nothing is guessed and nothing is dropped.

Turns are written as `<|im_start|>role\\ntext<|im_end|>\\n`. Inside a text or role every `<` followed by backslashes and
`|` gets one backslash more, so no control string survives in it, and removing one backslash restores it; in a role,
backslash and line feed are written \\\\ and \\n as well. The loss mask is the list of [start, end) code point spans of
the formatted string that hold assistant texts.

Defined cases: null text or role is empty; turns are sorted by turn (null first), then role and text; repeated rows are
turns each; an empty table gives no conversation; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)

#: Layouts: paths of the record, and where turns come from. "each" names an array of turns; "turns" lists fixed ones,
#: whose text joins the non-empty fields named. "roles" are the layout's own names of roles; others stay as they are.
LAYOUTS = [
    {"name": "rows", "paths": ["rows[].turn", "rows[].role", "rows[].text"], "each": "rows", "role": "role", "text": "text"},
    {"name": "messages", "paths": ["messages[].role", "messages[].content"], "each": "messages", "role": "role", "text": "content", "roles": {"model": "assistant"}},
    {"name": "conversations", "paths": ["conversations[].from", "conversations[].value"], "each": "conversations", "role": "from", "text": "value", "roles": {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}},
    {"name": "prompt", "paths": ["prompt", "completion"], "turns": [["user", ["prompt"]], ["assistant", ["completion"]]]},
    {"name": "prompt_response", "paths": ["prompt", "response"], "turns": [["user", ["prompt"]], ["assistant", ["response"]]]},
    {"name": "instruction", "paths": ["instruction", "input", "output"], "turns": [["user", ["instruction", "input"]], ["assistant", ["output"]]]},
    {"name": "instruction_only", "paths": ["instruction", "output"], "turns": [["user", ["instruction"]], ["assistant", ["output"]]]},
    {"name": "system_prompt", "paths": ["system", "prompt", "completion"], "turns": [["system", ["system"]], ["user", ["prompt"]], ["assistant", ["completion"]]]},
]
RESULT = "fingerprint string, layout string, status string, n_turns bigint, formatted string, loss_spans array<array<bigint>>"


def paths(value: object, at: str = "") -> set[str]:
    """The nested field paths of a record; a null or empty array counts as a field without inner paths."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {at}
    if isinstance(value, list):
        return set().union(*(paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def fingerprint(field_paths) -> str:
    return hashlib.sha256("\n".join(sorted(field_paths)).encode()).hexdigest()


def registry(layouts: list[dict]) -> dict[str, dict]:
    return {fingerprint(x["paths"]): x for x in layouts}


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def canonical_turns(record: dict, layout: dict) -> list[tuple[str, str]]:
    as_text = lambda x: "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)
    if "each" in layout:
        roles = layout.get("roles", {})
        found = [(as_text(x[layout["role"]]), as_text(x[layout["text"]])) for x in record[layout["each"]]]
        return [(roles.get(r, r), t) for r, t in found]
    return [(role, "\n".join(t for t in (as_text(record[f]) for f in fields) if t)) for role, fields in layout["turns"]]


def write_turns(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[list[int]]]:
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == learn:
            spans.append([at + len(head), at + len(head) + len(body)])
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation, as they were."""
    return [(unescape_role(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def format_records(records: DataFrame, layouts: list[dict] | None = None, ignore: tuple[str, ...] = ("id",)) -> DataFrame:
    """conv_id, record (JSON) to conv_id and RESULT, one row each."""
    known = registry(LAYOUTS if layouts is None else layouts)

    def one(text: str | None):
        try:
            record = json.loads(text) if text else {}
        except ValueError:
            return [None, None, "malformed", 0, "", []]
        if not isinstance(record, dict):
            return [None, None, "malformed", 0, "", []]
        mark = fingerprint(paths({k: v for k, v in record.items() if k not in ignore}))
        if mark not in known:
            return [mark, None, "unmapped", 0, "", []]
        turns = canonical_turns(record, known[mark])
        formatted, spans = write_turns(turns)
        return [mark, known[mark]["name"], "ok", len(turns), formatted, spans]

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RESULT.split(", ")]
        for pdf in it:
            out = pd.DataFrame([one(x) for x in pdf["record"]], columns=names)
            out.insert(0, "conv_id", pdf["conv_id"].to_numpy())
            yield out

    return records.select("conv_id", "record").mapInPandas(batches, f"conv_id bigint, {RESULT}")


def records_of_rows(conversations: DataFrame) -> DataFrame:
    """conv_id and a "rows" record for each conversation. A conversation is one output value, so its rows do meet in
    one task; they are packed there as they come, with nothing but the turn, role and text."""
    turn = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("rows"))
    return rows.select("conv_id", F.to_json(F.struct("rows"), {"ignoreNullFields": "false"}).alias("record"))


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from the formatted strings alone."""

    def one(text: str, spans) -> list:
        turns = read_turns(text)
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(unescape(text[a:b]) for a, b in spans)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        return [len(turns), sha(whole), len(loss), sha(loss), len(text)]

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [one(t, s) for t, s in zip(pdf["formatted"], pdf["loss_spans"], strict=True)]
            out = pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            out.insert(0, "conv_id", pdf["conv_id"].to_numpy())
            yield out

    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return formatted.select("conv_id", "formatted", "loss_spans").mapInPandas(batches, schema)
