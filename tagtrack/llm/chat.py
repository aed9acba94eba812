"""Chat formatting: records of several layouts become canonical turns, then one text with a loss mask.

A record is a JSON text. Its *fingerprint* is a hash of its nested field paths (from
Spark's ``schema_of_variant``, without types). The fingerprint picks a declared
mapping: where the turns are and which roles they have. Records of an undeclared
layout or broken JSON get no turns and no mapping name; they are kept.

The template writes ``<|turn|>role<|text|>text<|end|>`` per turn. Control strings of
this and of common templates inside roles and texts get a backslash after their
first character (one more where there are some), which ``unescape`` takes back, so
the format is reversible for every text. ``loss`` lists the (start, length) spans,
in code points of the formatted text, of the assistant texts.

Defined results: NULL roles and texts are empty; turns are ordered by turn, role,
text, with NULL turns first; a NULL conversation id is a conversation; a conversation
is one record, as it is one training example.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: what the templates in use read as control: <|...|>, sentence marks, instruction and system marks
CONTROL = r"\||/?s>|/?INST\]|<SYS>>|</SYS>>"
TURNS = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(<|\[)(\\*)({CONTROL})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(<|\[)\\(\\*)({CONTROL})", "$1$2$3")


def _text(path: str) -> Column:
    return F.coalesce(F.variant_get(F.col("v"), path, "string"), F.lit(""))


def _turn(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), text.alias("text"))


def _list(path: str, role: str, text: str, names: dict[str, str] | None = None) -> Column:
    rows = F.variant_get(F.col("v"), path, f"array<struct<{role}:string,{text}:string>>")

    def turn(x: Column) -> Column:
        r = F.coalesce(x[role], F.lit(""))
        for old, new in (names or {}).items():
            r = F.when(x[role] == old, F.lit(new)).otherwise(r)
        return F.struct(r.alias("role"), F.coalesce(x[text], F.lit("")).alias("text"))

    return F.transform(rows, turn)


#: layout name: (nested field paths, the canonical turns)
LAYOUTS: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {
    "prompt": (
        ("prompt", "response"),
        lambda: F.array(_turn("user", _text("$.prompt")), _turn("assistant", _text("$.response"))),
    ),
    "question": (
        ("answer", "question"),
        lambda: F.array(_turn("user", _text("$.question")), _turn("assistant", _text("$.answer"))),
    ),
    "instruction": (
        ("input", "instruction", "output"),
        lambda: F.array(
            _turn("system", _text("$.instruction")), _turn("user", _text("$.input")), _turn("assistant", _text("$.output"))
        ),
    ),
    "messages": (("messages[].content", "messages[].role"), lambda: _list("$.messages", "role", "content")),
    "chat": (
        ("conversations[].from", "conversations[].value"),
        lambda: _list("$.conversations", "from", "value", {"human": "user", "gpt": "assistant"}),
    ),
}


def paths_text(paths: tuple[str, ...]) -> str:
    """The shape of declared paths as ``shape`` writes it: fields in order, lists as <...>."""
    top: dict[str, list[str]] = {}
    for p in sorted(paths):
        head, _, rest = p.partition("[].")
        top.setdefault(head, []).extend([rest] if rest else [])
    return "<" + ", ".join(h + (f"<<{', '.join(f)}>>" if f else "") for h, f in sorted(top.items())) + ">"


def shape(v: Column) -> Column:
    """Nested field paths of a variant, in order, without value types."""
    types = r": (?:STRING|BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|BOOLEAN|VOID|VARIANT|DECIMAL\([^)]*\)|DATE|TIMESTAMP(?:_NTZ)?|BINARY)(?=[,>])"
    return F.regexp_replace(F.regexp_replace(F.schema_of_variant(v), types, ""), r"(?:^|: )(?:OBJECT|ARRAY)<|(?<=<)OBJECT<", "<")


def fingerprint(v: Column) -> Column:
    return F.xxhash64(shape(v))


def canonical(records: DataFrame, layouts: dict | None = None) -> DataFrame:
    """``records`` (conv_id, record) with fingerprint, layout (NULL if undeclared) and turns.

    ``turns`` is an array of (role, text), empty for undeclared layouts and broken JSON.
    """
    layouts = layouts or LAYOUTS
    rows = records.select("*", F.try_parse_json("record").alias("v")).withColumn("fingerprint", fingerprint(F.col("v")))
    name, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for layout, (paths, build) in layouts.items():
        here = F.col("fingerprint") == F.xxhash64(F.lit(paths_text(paths)))
        name = F.when(here, F.lit(layout)).otherwise(name)
        turns = F.when(here, build().cast(TURNS)).otherwise(turns)
    return rows.withColumn("layout", name).withColumn("turns", turns).drop("v")


def formatted(rows: DataFrame, target: str = "assistant") -> DataFrame:
    """``rows`` with ``formatted`` and ``loss`` (spans of the texts of role ``target``)."""
    safe = F.transform("turns", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text"), (t["role"] == target).alias("on")))
    rows = rows.withColumn("_safe", safe)
    piece = F.transform(
        "_safe", lambda t: F.concat(F.lit(TURN), t["role"], F.lit(TEXT), t["text"], F.lit(END))
    )
    fixed = len(TURN) + len(TEXT) + len(END)
    lead = len(TURN) + len(TEXT)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,len:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        role, text = F.char_length(t["role"]), F.char_length(t["text"])
        span = F.array(F.struct((acc["at"] + lead + role).alias("start"), text.alias("len")))
        return F.struct(
            (acc["at"] + fixed + role + text).alias("at"),
            F.when(t["on"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    spans = F.aggregate("_safe", start, step, lambda acc: acc["spans"])
    return rows.withColumn("formatted", F.array_join(piece, "")).withColumn("loss", spans).drop("_safe")


def read_back(text: Column) -> Column:
    """The (role, text) turns of a formatted text."""

    def turn(p: Column) -> Column:
        halves = F.split(p, r"<\|text\|>", 2)
        body = F.get(halves, F.lit(1))
        return F.struct(
            unescape(F.get(halves, F.lit(0))).alias("role"),
            unescape(F.substring(body, F.lit(1), F.char_length(body) - len(END))).alias("text"),
        )

    pieces = F.split(text, r"<\|turn\|>")
    return F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def masked(text: Column, loss: Column) -> Column:
    """All text under the loss spans of a formatted text, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(text, s["start"] + 1, s["len"]))), "")


def as_records(conversations: DataFrame) -> DataFrame:
    """conv_id, record: a JSON record per conversation of a table of turns, in the narrowest layout that holds it.

    user-assistant pairs are prompt or question records (by the parity of the id),
    system-user-assistant triples are instruction records, conversations of only
    these roles with an odd id are chat records, all others are message records.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("set"), "turn", role.alias("role"), text.alias("text")))).alias("t")
    )
    roles = F.transform("t", lambda x: x["role"])
    known = F.size(F.array_except(roles, F.array(*map(F.lit, ("user", "assistant", "system"))))) == 0
    odd = F.coalesce(F.pmod("conv_id", F.lit(2)) == 1, F.lit(False))
    said = lambda i: F.get("t", F.lit(i))["text"]
    pair = roles == F.array(F.lit("user"), F.lit("assistant"))
    triple = roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))
    chat = F.transform(
        "t",
        lambda x: F.struct(
            F.when(x["role"] == "user", F.lit("human")).when(x["role"] == "assistant", F.lit("gpt")).otherwise(x["role"]).alias("from"),
            x["text"].alias("value"),
        ),
    )
    plain = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    record = (
        F.when(pair & odd, F.to_json(F.struct(said(0).alias("question"), said(1).alias("answer"))))
        .when(pair, F.to_json(F.struct(said(0).alias("prompt"), said(1).alias("response"))))
        .when(triple, F.to_json(F.struct(said(0).alias("instruction"), said(1).alias("input"), said(2).alias("output"))))
        .when(known & odd, F.to_json(F.struct(chat.alias("conversations"))))
        .otherwise(F.to_json(F.struct(plain.alias("messages"))))
    )
    return turns.select("conv_id", record.alias("record"))
