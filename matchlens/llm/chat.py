"""Chat formatting: records of many layouts, told apart by schema fingerprints.

A record is a JSON text. Its fingerprint is the hash of its nested field paths,
whatever the values. A table of declared layouts maps fingerprints to mappings;
a mapping says where the roles and texts of the turns are. So records of any
declared layout become the same canonical turns in one pass of column
functions, and unknown layouts are seen as such instead of being guessed.

The template marks each turn by control strings. Inside texts and roles, control
strings are broken by a backslash and backslashes are doubled, so the formatted
text can be read back exactly. The loss mask lists the character ranges of the
assistant texts.

Records of unknown layouts or that are no JSON have null turns and no formatted
text. Null texts and roles are empty. Records without turns give empty text.
Repeated records stay. Extra columns stay; those named like a result give way.
"""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlens.llm.common import added

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
# Control strings of public chat templates.
CONTROL = (
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>",
)
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """One declared layout.

    ``paths`` are its field paths. Either ``turns`` names an array with the
    fields ``role`` and ``text``, or ``parts`` lists one field for each turn
    with its role; several fields of a turn are joined by ``joint``.
    """

    name: str
    paths: tuple[str, ...]
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    joint: str = "\n"
    roles: dict[str, str] = field(default_factory=dict, hash=False)


# Layouts of public instruction and chat data.
LAYOUTS = (
    Layout("messages", ("messages[].content", "messages[].role"), turns="messages"),
    Layout("conversations", ("conversations[].from", "conversations[].value"), turns="conversations",
           role="from", text="value", roles={"human": "user", "gpt": "assistant"}),
    Layout("prompt", ("prompt", "response"), parts=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt_system", ("prompt", "response", "system"),
           parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("instruction", ("instruction", "output"),
           parts=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction_input", ("input", "instruction", "output"),
           parts=(("user", ("instruction", "input")), ("assistant", ("output",)))),
)


def paths_of(record: Column) -> Column:
    """The field paths of a variant, sorted: from its schema, with the types of values left out."""
    schema = F.schema_of_variant(record)
    kinds = r"\b(STRING|VOID|BIGINT|BOOLEAN|DOUBLE|FLOAT|DATE|BINARY|VARIANT|DECIMAL\([0-9,]+\))"
    return F.regexp_replace(schema, kinds + r"(?=[,>]|$)", "_")


def _declared(layout: Layout) -> str:
    """What ``paths_of`` gives for a layout: nested objects, fields by name."""

    def nested(paths: list[list[str]]) -> str:
        if paths == [[]]:
            return "_"
        heads = sorted({p[0] for p in paths})
        inner = []
        for head in heads:
            rest = nested([p[1:] for p in paths if p[0] == head])
            name = head.removesuffix("[]")
            inner.append(f"{name}: " + (f"ARRAY<{rest}>" if head.endswith("[]") else rest))
        return f"OBJECT<{', '.join(inner)}>"

    return nested([p.split(".") for p in layout.paths])


def fingerprint(record: Column) -> Column:
    return F.xxhash64(paths_of(record))


def _turns(record: Column, layout: Layout) -> Column:
    if layout.turns:
        kind = f"array<struct<{layout.role}:string,{layout.text}:string>>"
        found = F.try_variant_get(record, f"$.{layout.turns}", kind)

        def one(t):
            role = F.coalesce(t[layout.role], F.lit(""))
            for old, new in layout.roles.items():
                role = F.when(t[layout.role] == old, F.lit(new)).otherwise(role)
            return F.struct(role.alias("role"), F.coalesce(t[layout.text], F.lit("")).alias("text"))

        return F.transform(found, one)
    turns = []
    for role, names in layout.parts:
        texts = [F.coalesce(F.try_variant_get(record, f"$.{n}", "string"), F.lit("")) for n in names]
        # An empty second field adds nothing, not even the joint.
        text = texts[0]
        for more in texts[1:]:
            text = F.when(more == "", text).otherwise(F.concat(text, F.lit(layout.joint), more))
        turns.append(F.struct(F.lit(role).alias("role"), text.alias("text")))
    return F.array(*turns)


def canonical(records: DataFrame, record: str = "record", layouts=LAYOUTS) -> DataFrame:
    """Adds ``fingerprint``, ``layout`` (null: unknown) and ``turns``."""
    rows = added(records, {"_variant": F.try_parse_json(F.col(record))})
    rows = added(rows, {"fingerprint": fingerprint(F.col("_variant"))})
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for layout in layouts:
        same = F.col("fingerprint") == F.xxhash64(F.lit(_declared(layout)))
        name = F.when(same, F.lit(layout.name)).otherwise(name)
        turns = F.when(same, _turns(F.col("_variant"), layout)).otherwise(turns)
    return added(rows, {"layout": name, "turns": turns}).drop("_variant")


def _quoted(s: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()<>*+-=!?^$|/" else c for c in s)


def escaped(text: Column) -> Column:
    """Control strings broken after their first character, backslashes doubled."""
    inside = "|".join(f"(?<={_quoted(c[0])})(?={_quoted(c[1:])})" for c in CONTROL)
    return F.regexp_replace(text, rf"\\|{inside}", r"\\$0")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(rows: DataFrame, turns: str = "turns") -> DataFrame:
    """Adds ``formatted`` and ``loss_mask``: ranges ``[start, end)`` of the assistant texts in characters."""
    role = lambda t: F.regexp_replace(escaped(t["role"]), "\n", "\\\\\n")
    parts = F.transform(
        F.col(turns),
        lambda t: F.struct(
            F.concat(F.lit(OPEN), role(t), F.lit("\n")).alias("head"),
            escaped(t["text"]).alias("body"),
            (t["role"] == "assistant").alias("learned"),
        ),
    )
    rows = added(rows, {"_parts": parts})
    tail = CLOSE + "\n"
    whole = F.array_join(
        F.transform("_parts", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), ""
    )
    sizes = F.transform(
        "_parts",
        lambda p: F.struct(
            F.length(p["head"]).alias("head"), F.length(p["body"]).alias("body"), p["learned"].alias("learned")
        ),
    )
    mask = "array<struct<start:int,end:int>>"
    spans = F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("at"), F.array().cast(mask).alias("spans")),
        lambda acc, s: F.struct(
            (acc["at"] + s["head"] + s["body"] + len(tail)).alias("at"),
            F.when(
                s["learned"],
                F.concat(
                    acc["spans"],
                    F.array(
                        F.struct(
                            (acc["at"] + s["head"]).alias("start"),
                            (acc["at"] + s["head"] + s["body"]).alias("end"),
                        )
                    ),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return added(rows, {"formatted": whole, "loss_mask": spans}).drop("_parts")


def read_back(text: Column) -> Column:
    """The canonical turns of a formatted text."""
    pieces = F.array_remove(F.split(text, _quoted(CLOSE) + "\n"), "")
    head = rf"(?s)^{_quoted(OPEN)}((?:[^\\\n]|\\.)*+)\n(.*)$"
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescaped(F.regexp_extract(p, head, 1)).alias("role"),
            unescaped(F.regexp_extract(p, head, 2)).alias("text"),
        ),
    )


def masked(text: Column, mask: Column) -> Column:
    """The texts under the loss mask, joined and without escapes."""
    parts = F.transform(mask, lambda m: unescaped(F.substring(text, m["start"] + 1, m["end"] - m["start"])))
    return F.array_join(parts, "")


def records_of(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"):
    """``conv_id, record``: rows by turn as one JSON record for each conversation.

    Turns are ordered by number, ties by role and text, nulls first. A lone
    exchange becomes a prompt record, with a system text if one stands before
    it; anything else becomes a list of messages. A conversation is one record
    by nature, so its turns come together in one row.
    """
    one = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("content"),
    )
    grouped = rows.groupBy(F.col(conv_id).alias("conv_id")).agg(F.array_sort(F.collect_list(one)).alias("m"))
    roles = F.transform("m", lambda x: x["role"])
    are = lambda *names: roles == F.array(*map(F.lit, names))
    at = lambda k: F.get("m", F.lit(k))["content"]
    prompt = F.to_json(F.struct(at(0).alias("prompt"), at(1).alias("response")))
    system = F.to_json(F.struct(at(0).alias("system"), at(1).alias("prompt"), at(2).alias("response")))
    messages = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    record = (
        F.when(are("user", "assistant"), prompt)
        .when(are("system", "user", "assistant"), system)
        .otherwise(F.to_json(F.struct(messages.alias("messages"))))
    )
    return grouped.select("conv_id", record.alias("record"))
