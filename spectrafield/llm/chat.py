"""Chat formatting: schema fingerprints choose declarative mappings to canonical turns.

A record is a JSON object of any of the registered layouts. The nested field
paths of a record, to any depth and over all elements of its arrays, hashed, are
its schema fingerprint; the fingerprint picks a mapping, which says where
prompt, instruction, messages and answers lie. All of it, and the template, are
SQL expressions.

Template of a turn: ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings
inside roles and texts are escaped by a backslash after their first character;
one that has backslashes there already gets one more, so that taking one away
restores the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import load

# Control strings of common chat templates.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"


def _quoted(s: str) -> str:
    return "".join("\\" + c if c in "\\[]|/<>" and c not in "<>/" else c for c in s)


_AHEAD = "(?=" + "|".join(_quoted(c[1:]) for c in CONTROL if c[0] == "<") + ")"
_AHEAD_SQUARE = "(?=" + "|".join(_quoted(c[1:]) for c in CONTROL if c[0] == "[") + ")"
_MARKED = rf"(<)(\\*){_AHEAD}|(\[)(\\*){_AHEAD_SQUARE}"
_ESCAPED = rf"(<)\\(\\*){_AHEAD}|(\[)\\(\\*){_AHEAD_SQUARE}"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _MARKED, r"$1$3\\$2$4")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, r"$1$3$2$4")


@dataclass(frozen=True)
class Mapping:
    """How a layout's fields become turns: ``paths`` are its field paths, ``turns`` a SQL expression over them.

    ``turns`` sees the record as the struct column ``r`` of type ``schema``.
    """

    name: str
    schema: str
    paths: tuple[str, ...]
    turns: str


def _messages(field: str, role: str, text: str) -> str:
    return f"transform(r.{field}, m -> named_struct('role', m.{role}, 'text', m.{text}))"


# Names that roles have in the layout of ``from`` and ``value``; all others keep their roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
_ROLE_NAMES = "map(" + ", ".join(f"'{k}', '{v}'" for k, v in ROLES.items()) + ")"

# The layouts in use.
MAPPINGS = (
    Mapping("turn", "role string, text string", ("role", "text"), "array(named_struct('role', r.role, 'text', r.text))"),
    Mapping("messages", "messages array<struct<role:string,content:string>>", ("messages[].content", "messages[].role"), _messages("messages", "role", "content")),
    Mapping("conversation", "conversations array<struct<`from`:string,value:string>>", ("conversations[].from", "conversations[].value"), "transform(r.conversations, m -> named_struct('role', coalesce(try_element_at(" + _ROLE_NAMES + ", m.`from`), m.`from`), 'text', m.value))"),
    Mapping("prompt", "prompt string, completion string", ("completion", "prompt"), "array(named_struct('role', 'user', 'text', r.prompt), named_struct('role', 'assistant', 'text', r.completion))"),
    Mapping("prompt_response", "prompt string, response string", ("prompt", "response"), "array(named_struct('role', 'user', 'text', r.prompt), named_struct('role', 'assistant', 'text', r.response))"),
    Mapping("prompt_system", "system string, prompt string, response string", ("prompt", "response", "system"), "array(named_struct('role', 'system', 'text', r.system), named_struct('role', 'user', 'text', r.prompt), named_struct('role', 'assistant', 'text', r.response))"),
    Mapping("instruction", "instruction string, input string, output string", ("input", "instruction", "output"), "array(named_struct('role', 'user', 'text', concat(r.instruction, if(coalesce(r.input, '') = '', '', concat('\n\n', r.input)))), named_struct('role', 'assistant', 'text', r.output))"),
    Mapping("instruction_only", "instruction string, output string", ("instruction", "output"), "array(named_struct('role', 'user', 'text', r.instruction), named_struct('role', 'assistant', 'text', r.output))"),
)

# Names of the types of JSON values that have no fields.
SCALARS = r": (?:STRING|VOID|BIGINT|DOUBLE|FLOAT|BOOLEAN|VARIANT|DECIMAL\(\d+,\d+\))(?=[,>])"


#: Characters from which a record's shape is told without its texts: JSON readers bound the strings they read.
LONG = 10_000_000
#: What records are read with: strings of any length, and an error instead of nulls where one cannot be read.
READER = {"maxStringLen": str(2**31 - 1), "mode": "FAILFAST"}


def without_values(record: Column) -> Column:
    """The record with all its strings empty but the names of fields; escapes inside names are lost."""
    plain = F.regexp_replace(record, r"(?s)\\(?:u[0-9a-fA-F]{4}|.)", "")
    return F.regexp_replace(plain, r'"(?:([^"]*+)(?="\s*+:))?+[^"]*+"', r'"$1"')


def field_paths(record: Column) -> Column:
    """Nested field paths of a JSON object as one string, ``OBJECT<a, b: ARRAY<OBJECT<c>>>``; null for all else.

    Fields stand in the order of their names. Those of an array's elements are
    united; fields count also where their value is null. A string is a string,
    whatever its text looks like.
    """
    long = F.length(record) > LONG
    shape = F.schema_of_variant(F.try_parse_json(F.when(long, without_values(record)).otherwise(record)))
    unread = F.raise_error(F.lit("a JSON object of over ten million characters has a shape that cannot be told"))
    shape = F.when(long & shape.isNull() & F.substring(F.ltrim(record), 1, 1).eqNullSafe("{"), unread).otherwise(shape)
    return F.when(shape.startswith("OBJECT<"), F.regexp_replace(shape, SCALARS, ""))


def schema_fingerprint(record: Column) -> Column:
    """xxHash64 of the field paths; null where the record is no JSON object."""
    paths = field_paths(record)
    return F.when(paths.isNotNull(), F.xxhash64(paths))


def _shape(paths: list[str]) -> str:
    """Field paths as ``field_paths`` writes them."""
    inside: dict[str, list[str]] = {}
    for p in paths:
        head, _, rest = p.partition(".")
        inside.setdefault(head, []).extend([rest] if rest else [])
    fields = []
    for head in sorted(inside, key=lambda h: h.removesuffix("[]")):
        name, below = head.removesuffix("[]"), f": {_shape(inside[head])}" if inside[head] else ""
        fields.append(f"{name}: ARRAY<{below[2:]}>" if head.endswith("[]") else name + below)
    return f"OBJECT<{', '.join(fields)}>"


def _fingerprints_of(m: Mapping) -> list[Column]:
    """Of a layout, and of the same with an empty list."""
    whole = _shape(list(m.paths))
    empty = re.sub(r"ARRAY<OBJECT<[^>]*>>", "ARRAY<VOID>", whole)
    return [F.xxhash64(F.lit(x)) for x in sorted({whole, empty})]


def canonical_turns(records: DataFrame, record: str = "record") -> DataFrame:
    """Add ``layout`` and ``turns`` (array of role and text) read from the JSON column ``record``.

    Records whose fingerprint no mapping has get layout and turns null; a record
    of a known layout that cannot be read is an error. Texts may have any
    length that Spark's strings have. Roles
    stay as they are, but where a layout has names of its own for them; null
    roles and texts are empty. Repeated records are mapped one by one; other
    columns stay, and columns named like the new ones are replaced.
    """
    print_, layout, turns = F.col("_print"), F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    out = records.drop("layout", "turns").withColumn("_print", schema_fingerprint(F.col(record)))
    for m in MAPPINGS:
        same = print_.isin(*_fingerprints_of(m))
        out = out.withColumn("r", F.when(same, F.from_json(record, m.schema, READER)))
        layout = F.when(same, F.lit(m.name)).otherwise(layout)
        out = out.withColumn(f"_t_{m.name}", F.expr(m.turns)).drop("r")
        turns = F.when(same, F.col(f"_t_{m.name}")).otherwise(turns)
    clean = F.transform(turns, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    return out.withColumns({"layout": layout, "turns": clean}).drop("_print", *[f"_t_{m.name}" for m in MAPPINGS])


def segments(turns: Column) -> Column:
    """Template pieces in order, each with its loss flag: assistants' texts carry loss, nothing else does."""
    def of(t: Column) -> Column:
        role = F.regexp_replace(escape(F.regexp_replace(t["role"], r"\\", r"\\\\")), "\n", r"\\n")
        return F.array(
            F.struct(F.concat(F.lit(START), role, F.lit("\n")).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), (t["role"] == "assistant").alias("loss")),
            F.struct(F.lit(END + "\n").alias("text"), F.lit(False).alias("loss")),
        )

    return F.flatten(F.transform(turns, of))


def format_turns(df: DataFrame, turns: str = "turns") -> DataFrame:
    """Add ``segments``, their concatenation ``formatted`` and the loss mask ``loss``.

    The mask lists what carries loss: the number of the turn from 0, and
    start (from 1) and length within its piece, all that lies before its end
    mark. A record of no turns gives an empty string and mask; null turns give null.
    """
    out = df.drop("segments", "formatted", "loss").withColumn("segments", segments(F.col(turns)))
    size = lambda i: F.length(F.get("segments", i)["text"])
    spans = F.transform(turns, lambda t, i: F.struct(i.alias("turn"), (size(3 * i) + 1).alias("start"), size(3 * i + 1).alias("chars"), F.get("segments", 3 * i + 1)["loss"].alias("loss")))
    return out.withColumns(
        {
            "formatted": F.array_join(F.transform("segments", lambda s: s["text"]), ""),
            "loss": F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["turn"].alias("turn"), s["start"].alias("start"), s["chars"].alias("chars"))),
        }
    )


def pieces_of(formatted: Column) -> Column:
    """A formatted string's turns without their end marks, and what follows the last of these."""
    return F.split(formatted, r"<\|im_end\|>\n")


def read_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, as they were before the template."""
    pieces = pieces_of(formatted)
    return F.transform(loss, lambda s: unescape(F.substring(F.get(pieces, s["turn"]), s["start"], s["chars"])))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted string, as they were before the template."""
    def turn(piece: Column) -> Column:
        body = F.substring(piece, F.lit(len(START) + 1), F.length(piece))
        cut = F.locate("\n", body)
        role = F.substring(body, F.lit(1), cut - 1)
        role = F.regexp_replace(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"), r"\\\\", r"\\")
        return F.struct(unescape(role).alias("role"), unescape(F.substring(body, cut + 1, F.length(body))).alias("text"))

    pieces = pieces_of(formatted)
    return F.transform(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def op4_chat(spark, sf_dir):
    """All conversations and conversation -7 in the template, digests read back from the output."""
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], rows.schema))
    # every turn is a record of its own, in one of two layouts that its hash chooses; told before conversations meet
    turn = F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"})
    listed = F.to_json(F.struct(F.array(F.struct("role", F.col("text").alias("content"))).alias("messages")), {"ignoreNullFields": "false"})
    records = rows.withColumn("record", F.when(F.xxhash64("conv_id", "turn") % 2 == 0, turn).otherwise(listed))
    turns = canonical_turns(records)
    turns = turns.select("conv_id", F.struct("turn", F.xxhash64("role", "text").alias("tie"), F.col("turns")[0].alias("t")).alias("x"))
    whole = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]).alias("turns"))
    done = format_turns(whole).select("conv_id", "formatted", "loss")
    done = done.withColumns({"back": read_back(F.col("formatted")), "loss": F.array_join(read_loss(F.col("formatted"), F.col("loss")), "")})
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
