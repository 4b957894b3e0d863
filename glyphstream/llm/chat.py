"""Chat formatting by schema fingerprints.

A layout is recognised by the hash of its sorted nested field paths; the registry maps each fingerprint to a declarative
rule that says where the turns, roles and texts are. All layouts become canonical turns (conv_id, turn, role, text), which
are formatted by one template, with control strings inside texts escaped so that the formatted text can be read back.

Template: ``<s>[ROLE]`` text ``</s>`` per turn, where ROLE is the escaped role. In roles and texts, ``\\`` becomes ``\\\\``,
``<`` becomes ``\\l``, ``[`` becomes ``\\b`` and ``]`` becomes ``\\e``; so ``<`` and ``[`` occur in the output in
control strings alone, and reading back is unambiguous.

Cases: a null text or role is empty; a null conv_id is a conversation of its own; turns with equal numbers are ordered by role and
text (null numbers first); repeated rows stay; an empty table gives an empty result (but for the added conversation).
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE, LEFT, RIGHT = "<s>", "</s>", "[", "]"


# ---------------------------------------------------------------- fingerprints and layouts


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a type; [] marks array elements."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, at + "[]")
    return [at]


def json_paths(value: object, at: str = "") -> set[str]:
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in json_paths(v, f"{at}.{k}" if at else str(k))}
    if isinstance(value, list):
        return {p for v in value for p in json_paths(v, at + "[]")} or {at + "[]"}
    return {at}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns: a list of messages with a role and a text field, single fields with fixed roles, or a row for each turn
    with its number, role and text (roles of rows stay as they are)."""

    messages: str | None = None
    role: str | None = None
    text: str | None = None
    fields: tuple[tuple[str, str], ...] = ()
    turn: str | None = None


ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
REGISTRY: dict[str, Mapping] = {}


def register(paths: list[str], mapping: Mapping) -> str:
    REGISTRY[key := fingerprint(paths)] = mapping
    return key


register(["messages[].role", "messages[].content"], Mapping("messages", "role", "content"))
register(["conversations[].from", "conversations[].value"], Mapping("conversations", "from", "value"))
register(["prompt", "completion"], Mapping(fields=(("user", "prompt"), ("assistant", "completion"))))
register(["prompt", "response"], Mapping(fields=(("user", "prompt"), ("assistant", "response"))))
register(["instruction", "output"], Mapping(fields=(("user", "instruction"), ("assistant", "output"))))
register(["instruction", "input", "output"], Mapping(fields=(("user", "instruction"), ("user", "input"), ("assistant", "output"))))
register(["system", "prompt", "response"], Mapping(fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))))
register(["turn", "role", "text"], Mapping(turn="turn", role="role", text="text"))
register(["turn", "role", "content"], Mapping(turn="turn", role="role", text="content"))
register(["question", "answer"], Mapping(fields=(("user", "question"), ("assistant", "answer"))))

TURNS = "array<struct<role:string,text:string>>"


def turns_of_table(df: DataFrame, id_column: str) -> DataFrame:
    """Canonical turns (conv_id, turn, role, text) of a table whose layout is registered; all columns but the id make the layout."""
    rest = T.StructType([f for f in df.schema.fields if f.name != id_column])
    key = fingerprint(field_paths(rest))
    if key not in REGISTRY:
        raise ValueError(f"no mapping for the layout {sorted(field_paths(rest))} (fingerprint {key})")
    m = REGISTRY[key]
    if m.turn:
        return df.select(F.col(id_column).alias("conv_id"), F.col(m.turn).cast("long").alias("turn"), F.col(m.role).cast("string").alias("role"), F.col(m.text).cast("string").alias("text"))
    if m.messages:
        turns = F.transform(F.col(m.messages), lambda x: F.struct(_role(x[m.role]).alias("role"), x[m.text].alias("text")))
    else:
        turns = F.filter(F.array(*[F.struct(F.lit(r).alias("role"), F.col(c).cast("string").alias("text")) for r, c in m.fields]), lambda x: x["text"].isNotNull())
    return df.select(F.col(id_column).alias("conv_id"), F.posexplode(turns).alias("turn", "t")).select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


def _role(role: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, role), role)


def turns_of_json(df: DataFrame, id_column: str, json_column: str, registry: dict[str, Mapping] | None = None) -> DataFrame:
    """Canonical turns of JSON rows, each with a layout of its own; adds the fingerprint. Rows with no mapping keep one null turn."""
    known = dict(REGISTRY if registry is None else registry)

    def read(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for cid, raw in zip(pdf["conv_id"], pdf["raw"]):
                try:
                    row = json.loads(raw)
                except (TypeError, ValueError):
                    row = None
                key = fingerprint(json_paths(row)) if isinstance(row, dict) else None
                m = known.get(key)
                if m is None:
                    turns = [(None, None)]
                elif m.turn:
                    turns = [(row[m.role], row[m.text])]
                elif m.messages:
                    turns = [(x.get(m.role), x.get(m.text)) for x in row[m.messages]]
                    turns = [(ROLES.get(r, r) if isinstance(r, str) else r, x) for r, x in turns]
                else:
                    turns = [(r, row[c]) for r, c in m.fields if row[c] is not None]
                of = lambda i: None if m is None else i if not m.turn else row[m.turn] if isinstance(row[m.turn], int) else None
                text = lambda x: None if x is None else str(x)
                out += [(cid, key, of(i), text(r), text(x)) for i, (r, x) in enumerate(turns)]
            yield pd.DataFrame(out, columns=["conv_id", "layout", "turn", "role", "text"]).astype({"turn": "Int64"})

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(F.col(id_column).alias("conv_id"), F.col(json_column).alias("raw")).mapInPandas(read, f"conv_id {kind}, layout string, turn long, role string, text string")


# ---------------------------------------------------------------- template


def escape(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ("<", "\\l"), ("[", "\\b"), ("]", "\\e")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape_text(s: str) -> str:
    """Undoes ``escape``: between escaped backslashes, the other escapes can be put back one after the other."""
    return "\\".join(x.replace("\\l", "<").replace("\\b", "[").replace("\\e", "]") for x in s.split("\\\\"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, formatted, mask: runs of code points (chars, loss), assistant texts having loss.

    One row per conversation is the result, so its turns must meet in one task and one row; no more than that is gathered."""
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    g = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("has"), "turn", "role", "text"))).alias("turns"))
    head = lambda x: F.concat(F.lit(OPEN + LEFT), escape(x["role"]), F.lit(RIGHT))
    parts = F.transform("turns", lambda x: F.struct(head(x).alias("head"), escape(x["text"]).alias("body"), (x["role"] == "assistant").alias("loss")))
    run = lambda n, loss: F.struct(n.cast("long").alias("chars"), loss.alias("loss"))
    mask = F.flatten(F.transform("parts", lambda p: F.array(run(F.length(p["head"]), F.lit(False)), run(F.length(p["body"]), p["loss"]), run(F.lit(len(CLOSE)), F.lit(False)))))
    formatted = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    return g.select("conv_id", parts.alias("parts")).select("conv_id", formatted.alias("formatted"), mask.alias("mask"))


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    turns = []
    for part in formatted.split(CLOSE)[:-1]:
        role, _, body = part[len(OPEN + LEFT) :].partition(RIGHT)
        turns.append((unescape_text(role), unescape_text(body)))
    return turns


def under_mask(formatted: str, chars: list[int], loss: list[bool]) -> str:
    """The unescaped text of all runs that count for the loss."""
    at, kept = 0, []
    for n, counts in zip(chars, loss):
        if counts:
            kept.append(unescape_text(formatted[at : at + n]))
        at += n
    return "".join(kept)


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say when read back: turns and text under the loss mask, as lengths and hashes."""

    def read(batches):
        import pyarrow as pa

        for b in batches:
            rows = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for text, mask in zip(b.column("formatted").to_pylist(), b.column("mask").to_pylist()):
                turns = read_back(text)
                loss = under_mask(text, [r["chars"] for r in mask], [r["loss"] for r in mask])
                h = hashlib.sha256()
                for role, body in turns:
                    h.update(f"{role}\n{body}\n".encode())
                rows["n_turns"].append(len(turns))
                rows["turns_sha256"].append(h.hexdigest())
                rows["loss_chars"].append(len(loss))
                rows["loss_sha256"].append(hashlib.sha256(loss.encode()).hexdigest())
                rows["formatted_chars"].append(len(text))
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *(pa.array(v, pa.string() if k.endswith("sha256") else pa.int64()) for k, v in rows.items())], names=["conv_id", *rows])

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
