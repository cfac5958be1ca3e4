"""Chat formatting: records of any declared layout become turns, and turns become marked text with a loss mask.

A record's layout is told by its fields: the paths that hold a value (`messages[].role`) are listed, sorted and hashed, and this
fingerprint selects the mapping that was declared for it. A mapping says where the turns are; it holds paths and names, no code.
Everything is built of SQL functions.

A turn is written as `<s>[INST]role[/INST]text</s>`. Where a role or text holds one of these marks itself, a backslash is put
behind the mark's first character, and one more where there are some already: `</s>` becomes `<\\/s>`, `<\\/s>` becomes
`<\\\\/s>`. So no mark is left in it, and taking one backslash away gives the text back.

Results in special cases:
- null texts and roles are empty; empty and very long ones are turns like others. A conversation is one value of a row, so it
  must stay below 2 GB, which holds for its digest anyway;
- rows of a conversation with the same turn are ordered by role, then text; a null turn comes first; repeated rows are turns;
- a null conv_id is a conversation; an empty table gives no rows;
- a record whose fingerprint isn't declared keeps its row, with a null layout, no turns and an empty output;
- columns that aren't paths of a mapping don't matter, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

# The marks of the template.
START, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
_REST = r"(/?s>|/?INST\])"
#: Roles whose text is learned.
LEARNED = ("assistant",)


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns: single fields with the role they speak as, or a list with a role and a text field.

    Fields in `optional` may be absent. `by` is the field that a list is ordered by; without it, it stays as it is. `names` gives
    the canonical name of a role.
    """

    name: str
    fields: tuple[tuple[str, str], ...] = ()  # (path, role), in order
    optional: tuple[str, ...] = ()
    items: str | None = None
    role: str | None = None
    text: str | None = None
    by: str | None = None
    names: tuple[tuple[str, str], ...] = field(default=())

    def paths(self) -> list[str]:
        inner = [f"{self.items}[].{f}" for f in (self.role, self.text, self.by) if f] if self.items else []
        return [path for path, _ in self.fields] + inner

    def layouts(self) -> list[str]:
        """Every set of paths that this mapping takes, as text: with and without the optional ones."""
        sure = [p for p in self.paths() if p not in self.optional]
        return ["\n".join(sorted([*sure, *some])) for n in range(len(self.optional) + 1) for some in combinations(self.optional, n)]


NAMES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
MAPPINGS = (
    Mapping("rows", items="turns", role="role", text="text", by="turn", optional=("turns[].turn",)),
    Mapping("messages", items="messages", role="role", text="content", optional=("messages[].content",), names=NAMES),
    Mapping("from_value", items="conversations", role="from", text="value", optional=("conversations[].value",), names=NAMES),
    Mapping("prompt_completion", fields=(("system", "system"), ("prompt", "user"), ("completion", "assistant")), optional=("system",)),
    Mapping("prompt_response", fields=(("system", "system"), ("prompt", "user"), ("response", "assistant")), optional=("system",)),
    Mapping("instruction", fields=(("system", "system"), ("instruction", "user"), ("input", "user"), ("output", "assistant")), optional=("system", "input")),
    Mapping("question_answer", fields=(("context", "system"), ("question", "user"), ("answer", "assistant")), optional=("context",)),
)


def record_schema(mappings: tuple[Mapping, ...] = MAPPINGS) -> str:
    """The schema that reads records of all mappings with from_json."""
    single = {path for m in mappings for path, _ in m.fields}
    lists: dict[str, dict[str, str]] = {}
    for m in mappings:
        if m.items:
            lists.setdefault(m.items, {}).update({f: "bigint" if f == m.by else "string" for f in (m.role, m.text, m.by) if f})
    inner = [f"`{name}` array<struct<{', '.join(f'`{f}`: {t}' for f, t in sorted(fields.items()))}>>" for name, fields in sorted(lists.items())]
    return ", ".join([f"`{p}` string" for p in sorted(single)] + inner)


def _has(schema: StructType, path: str) -> bool:
    items, _, inner = path.partition("[].")
    if items not in schema.fieldNames():
        return False
    kind = schema[items].dataType
    return not inner or isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType) and inner in kind.elementType.fieldNames()


def _present(path: str) -> Column:
    items, _, inner = path.partition("[].")
    held = F.exists(F.col(items), lambda m: m[inner].isNotNull()) if inner else F.col(items).isNotNull()
    return F.when(held, F.lit(path))


def fingerprint(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """The hash of the paths that hold a value in a record, among all that the mappings know."""
    paths = sorted({p for m in mappings for p in m.paths() if _has(records.schema, p)})
    return F.xxhash64(F.concat_ws("\n", *[_present(p) for p in paths]) if paths else F.lit(""))


def _turns(mapping: Mapping, schema: StructType) -> Column:
    """The turns (role, text) of a record of this mapping's layout."""
    if mapping.items:
        items = F.col(mapping.items)
        if mapping.by and _has(schema, f"{mapping.items}[].{mapping.by}"):
            items = F.sort_array(F.transform(items, lambda m: F.struct(m[mapping.by].alias("by"), _text(m[mapping.role]).alias("role"), _text(m[mapping.text]).alias("text"))))
            role, text = "role", "text"
        else:
            role, text = mapping.role, mapping.text
        return F.transform(items, lambda m: F.struct(_canonical(_text(m[role]), mapping.names).alias("role"), _text(m[text]).alias("text")))
    single = [F.when(F.col(p).isNotNull(), F.struct(F.lit(role).alias("role"), _text(F.col(p)).alias("text"))) for p, role in mapping.fields if _has(schema, p)]
    return F.filter(F.array(*single), lambda t: t.isNotNull())


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def _canonical(role: Column, names: tuple[tuple[str, str], ...]) -> Column:
    for given, name in names:
        role = F.when(role == given, F.lit(name)).otherwise(role)
    return role


def canonical_turns(records: DataFrame, key: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(key, layout, turns): records as turns (role, text), by the mapping that the record's fingerprint selects."""
    usable = [m for m in mappings if all(_has(records.schema, p) for p in m.paths() if p not in m.optional)]
    marked = records.withColumn("layout", F.lit(None).cast("string")) if not usable else records.withColumn("print_", fingerprint(records, mappings))
    layout, turns = F.lit(None).cast("string"), F.array().cast("array<struct<role:string,text:string>>")
    for m in reversed(usable):
        chosen = F.lit(False)
        for paths in m.layouts():
            chosen = chosen | (F.col("print_") == F.xxhash64(F.lit(paths)))
        layout, turns = F.when(chosen, F.lit(m.name)).otherwise(layout), F.when(chosen, _turns(m, records.schema)).otherwise(turns)
    return marked.select(key, layout.alias("layout"), turns.alias("turns"))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _REST, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _REST, r"$1$2$3")


def formatted(turns: DataFrame, key: str, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """(key, layout, segments, formatted): the marked text, and its segments (text, loss) of which a model learns those with loss.

    The text is the segments one after another.
    """
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                F.struct(F.concat(F.lit(START + OPEN), escaped(t["role"]), F.lit(CLOSE)).alias("text"), F.lit(False).alias("loss")),
                F.struct(escaped(t["text"]).alias("text"), t["role"].isin(*learned).alias("loss")),
                F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    return turns.select(key, "layout", segments.alias("segments")).withColumn("formatted", F.array_join("segments.text", ""))


def parsed(text: Column) -> Column:
    """The turns (role, text) that a marked text holds: what `formatted` wrote, read back."""
    pieces = F.split(text, END)
    whole = F.slice(pieces, 1, F.size(pieces) - 1)
    head = len(START + OPEN)
    return F.transform(
        whole,
        lambda p: F.struct(
            unescaped(F.substring_index(F.substring(p, head + 1, 2**31 - 1), CLOSE, 1)).alias("role"),
            unescaped(F.substring(p, F.instr(p, F.lit(CLOSE)) + len(CLOSE), 2**31 - 1)).alias("text"),
        ),
    )


def as_records(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): rows (conv_id, turn, role, text) of each conversation as one record."""
    return rows.groupBy("conv_id").agg(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("turns"))


def digest(output: DataFrame, key: str) -> DataFrame:
    """(key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, layout), read back from the formatted output."""
    learned = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    read = output.select(key, "layout", F.length("formatted").cast("long").alias("formatted_chars"), parsed(F.col("formatted")).alias("turns_"), learned.alias("learned_"))
    told = F.array_join(F.transform("turns_", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        key, F.size("turns_").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("learned_").cast("long").alias("loss_chars"), F.sha2("learned_", 256).alias("loss_sha256"), "formatted_chars", "layout",
    )


def format_conversations(rows: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """The digest of all conversations (conv_id, turn, role, text), and of records of other layouts (conv_id, ...)."""
    records = as_records(rows)
    if more is not None:
        records = records.unionByName(more, allowMissingColumns=True)
    return digest(formatted(canonical_turns(records, "conv_id"), "conv_id"), "conv_id")
