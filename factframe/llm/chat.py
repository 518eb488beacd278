"""Chat formatting with schema fingerprints.

The nested field paths of a table, as far as any known layout uses them, are
hashed; the fingerprint selects a declarative mapping to canonical turns
(conversation, turn, role, text). In a table that mixes layouts each row has a
fingerprint of its own, of the nested paths that hold a value in it, which
selects its mapping: a layout is known by its own paths or any part of them.
Canonical turns are then written in a template

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

in which control strings of this and other common templates (<|...|>, <s>,
</s>, [INST], [/INST], <<SYS>>, <</SYS>>) inside a role or text get a backslash
after their first character; runs of backslashes that stand there already are
lengthened by one, so unescape() restores every text exactly. Only DataFrame
functions are used. A conversation is formatted into one string, so its turns
meet in one task; nothing else does.

Defined results: null texts and roles are empty; turns are ordered by turn
(null first), then role, then text, and repeated rows are turns of their own;
a null conversation id is one conversation; a record with one side null (a
prompt without a response) keeps both turns; records of a mixed table without a
value, with an empty list of turns, or with values of two layouts have no
mapping: canonical_turns leaves them out and unmatched_records returns them.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
_FIRST, _REST = r"([<\[])", r"(\|[A-Za-z0-9_]+\|>|/?s>|<?/?SYS>>|/?INST\])"


@dataclass(frozen=True)
class Layout:
    """Field paths that mark a layout, and SQL for its turns: an array of (role, text), or None for one row per turn."""

    name: str
    paths: tuple[str, ...]
    turns: str | None


LAYOUTS = (
    Layout("turn_rows", ("conv_id", "turn", "role", "text"), None),
    Layout("messages", ("messages[].content", "messages[].role"), "transform(messages, m -> named_struct('role', m.role, 'text', m.content))"),
    Layout("from_value", ("conversations[].from", "conversations[].value"), "transform(conversations, m -> named_struct('role', CASE m.`from` WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.`from` END, 'text', m.value))"),
    Layout("prompt_response", ("prompt", "response"), "array(named_struct('role', 'user', 'text', prompt), named_struct('role', 'assistant', 'text', response))"),
    Layout("instruction", ("instruction", "input", "output"), "array(named_struct('role', 'user', 'text', concat_ws('\\n\\n', instruction, nullif(input, ''))), named_struct('role', 'assistant', 'text', output))"),
)


def field_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Paths of all leaves, with [] after arrays."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, prefix + "[]")
    return [prefix]


def fingerprint(paths) -> str:
    return sha256("\n".join(sorted(paths)).encode()).hexdigest()


REGISTRY = {fingerprint(x.paths): x for x in LAYOUTS}


def known_layouts(schema: T.StructType) -> list[Layout]:
    """Layouts whose paths the schema has; other columns don't matter. The exact fingerprint comes first, then longer layouts."""
    have = set(field_paths(schema))
    vocabulary = {p for x in LAYOUTS for p in x.paths}
    exact = REGISTRY.get(fingerprint(have & vocabulary))
    return [exact] if exact else sorted((x for x in LAYOUTS if have.issuperset(x.paths)), key=lambda x: -len(x.paths))


#: Paths that any layout's rows may have beside its own.
_NEUTRAL = {"conv_id", "turn"}


def _present(path: str) -> Column:
    """Whether a row has a value at a nested path: in an array, in any of its elements."""
    head, inside, field = path.partition("[].")
    return F.coalesce(F.exists(F.col(head), lambda m: m[field].isNotNull()), F.lit(False)) if inside else F.col(head).isNotNull()


def row_mappings(layouts: list[Layout]) -> dict[str, str]:
    """Fingerprint -> layout, for every part of each layout's own paths; a part of two layouts is neither's."""
    owners: dict[str, set[str]] = {}
    for x in layouts:
        own = [p for p in x.paths if p not in _NEUTRAL]
        for n in range(1, len(own) + 1):
            for part in combinations(own, n):
                owners.setdefault(fingerprint(part), set()).add(x.name)
    return {f: next(iter(names)) for f, names in owners.items() if len(names) == 1}


def row_layout(layouts: list[Layout]) -> Column:
    """The name of the layout that a row's fingerprint selects, null if none; a turn without role and text is told by its number."""
    own = sorted({p for x in layouts for p in x.paths} - _NEUTRAL)
    print_of_row = F.sha2(F.concat_ws("\n", *[F.when(_present(p), F.lit(p)) for p in own]).cast("binary"), 256)
    mapping = F.create_map(*[F.lit(x) for pair in row_mappings(layouts).items() for x in pair])
    chosen = mapping[print_of_row]
    if any(x.name == "turn_rows" for x in layouts):
        nothing = F.lit(fingerprint(()))
        chosen = F.when((print_of_row == nothing) & F.col("turn").isNotNull(), F.lit("turn_rows")).otherwise(chosen)
    return chosen


def _layouts(df: DataFrame) -> list[Layout]:
    layouts = known_layouts(df.schema)
    if not layouts:
        raise ValueError(f"no known layout among {sorted(set(field_paths(df.schema)))}")
    return layouts


def unmatched_records(df: DataFrame) -> DataFrame:
    """The rows, whole, that canonical_turns leaves out: their fingerprint selects no mapping."""
    layouts = _layouts(df)
    return df.where(F.lit(False)) if [x.turns for x in layouts] == [None] else df.where(row_layout(layouts).isNull())


def canonical_turns(df: DataFrame, record: str = "conv_id") -> DataFrame:
    """conv_id, turn, role, text: one row per turn, whatever the layout."""
    layouts = _layouts(df)
    shape = lambda x: x.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    if [x.turns for x in layouts] == [None]:
        return shape(df)
    chosen, turns, conversation = F.col("layout of a row"), None, F.col(record)
    for layout in layouts:
        mine = chosen == layout.name
        if layout.turns is None:
            made = F.array(F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")))
            if record != "conv_id":
                conversation = F.when(mine, F.col("conv_id")).otherwise(F.col(record))
        else:
            made = F.transform(F.expr(layout.turns), lambda m, i: F.struct(i.cast("long").alias("turn"), m["role"].cast("string").alias("role"), m["text"].cast("string").alias("text")))
        turns = F.when(mine, made) if turns is None else turns.when(mine, made)
    matched = df.withColumn("layout of a row", row_layout(layouts)).where(chosen.isNotNull())
    exploded = matched.select(conversation.alias("conv_id"), F.explode(turns).alias("_m"))
    return shape(exploded.select("conv_id", "_m.turn", "_m.role", "_m.text"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _FIRST + r"(\\*)" + _REST, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _FIRST + r"(\\*)\\" + _REST, r"$1$2$3")


def _role(role: Column) -> Column:
    """Roles stand before a line end, so a backslash becomes \\s and a line end \\n before control strings are escaped."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def _unrole(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def format_chat(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans: the string, and the (start, length) in code points of each assistant text in it."""
    head = F.concat(F.lit(START), _role(F.col("role")), F.lit("\n"))
    pieces = turns.select("conv_id", "turn", "role", "text", head.alias("_head"), escape(F.col("text")).alias("_text"))
    pieces = pieces.withColumn("_piece", F.concat("_head", "_text", F.lit(END + "\n")))
    ordered = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.coalesce(F.sum(F.char_length("_piece").cast("long")).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = pieces.select("conv_id", F.row_number().over(ordered).alias("_n"), "_piece", F.when(F.col("role") == "assistant", F.struct((before + F.char_length("_head")).alias("start"), F.char_length("_text").cast("long").alias("length"))).alias("_span"))
    together = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("_n", "_piece"))).alias("_pieces"), F.array_sort(F.collect_list("_span")).alias("loss_spans"))
    return together.select("conv_id", F.array_join("_pieces._piece", "").alias("formatted"), "loss_spans")


def read_turns(formatted: Column) -> Column:
    """The array of (role, text) in a formatted string."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")
    line = lambda p: F.locate("\n", p)
    return F.transform(parts, lambda p: F.struct(_unrole(F.substring_index(p, "\n", 1)).alias("role"), unescape(F.substr(p, line(p) + 1, F.char_length(p) - line(p) - len(END) - 1)).alias("text")))


def read_loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
