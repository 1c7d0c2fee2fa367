"""Chat formatting: layouts are told by a hash of their field paths, mapped to turns, and written with a template.

Only DataFrame functions; no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bind, pieces, sums_before

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns. paths: the field paths that tell it, `[]` for the elements of a list.

    parts: (role, path) for fields that are one turn each, in order; or listed: path of a list, and the paths of role and
    text in its elements; or rows, for tables with a row a turn: the columns of conversation, order, role and text.
    """

    name: str
    paths: tuple[str, ...]
    parts: tuple[tuple[str, str], ...] = ()
    listed: tuple[str, str, str] | None = None
    rows: tuple[str, str, str, str] | None = None


LAYOUTS = (
    Mapping("prompt_completion", ("prompt", "completion"), parts=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt_response", ("prompt", "response"), parts=(("user", "prompt"), ("assistant", "response"))),
    Mapping("system_prompt_completion", ("system", "prompt", "completion"), parts=(("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Mapping("system_prompt_response", ("system", "prompt", "response"), parts=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("instruction", ("instruction", "output"), parts=(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction_input", ("instruction", "input", "output"), parts=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("system_instruction", ("system", "instruction", "output"), parts=(("system", "system"), ("user", "instruction"), ("assistant", "output"))),
    Mapping("system_instruction_input", ("system", "instruction", "input", "output"), parts=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("question_answer", ("question", "answer"), parts=(("user", "question"), ("assistant", "answer"))),
    Mapping("messages", ("messages[].role", "messages[].content"), listed=("messages", "role", "content")),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), listed=("conversations", "from", "value")),
    Mapping("dialogue_turns", ("dialogue.turns[].speaker.role", "dialogue.turns[].text"), listed=("dialogue.turns", "speaker.role", "text")),
    Mapping("turn_rows", ("conv_id", "turn", "role", "text"), rows=("conv_id", "turn", "role", "text")),
    Mapping("message_rows", ("conversation_id", "position", "role", "content"), rows=("conversation_id", "position", "role", "content")),
)
#: Names of roles in other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Template:
    """Marks of a turn, and the control strings that texts must not hold as they are."""

    open: str = "<|im_start|>"
    close: str = "<|im_end|>\n"
    after_role: str = "\n"
    controls: tuple[str, ...] = field(default=("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]"))
    #: Starts a code of two characters: itself with e, or a control string's letter from A on.
    escape: str = "␛"


def _codes(t: Template, role: bool) -> list[tuple[str, str]]:
    strings = [*t.controls, *([t.after_role] if role else [])]
    return [(t.escape, t.escape + "e"), *((c, t.escape + chr(65 + i)) for i, c in enumerate(strings))]


def escaped(text: Column, t: Template, role: bool = False) -> Column:
    for plain, code in _codes(t, role):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, t: Template, role: bool = False) -> Column:
    for plain, code in reversed(_codes(t, role)):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def fingerprint(paths: Column, m: Mapping) -> Column:
    """Hash of those paths that the mapping names, in order; other fields do not count."""
    return F.xxhash64(F.array_join(F.array_sort(F.array_intersect(paths, F.array(*map(F.lit, m.paths)))), "\n"))


def selected(paths: Column, among: tuple[Mapping, ...]) -> Column:
    """Name of the mapping whose fingerprint the paths have, of several the one with the most paths, then the first; or null."""
    out = F.lit(None).cast("string")
    for m in sorted(reversed(among), key=lambda m: len(m.paths)):
        out = F.when(fingerprint(paths, m) == fingerprint(F.array(*map(F.lit, m.paths)), m), F.lit(m.name)).otherwise(out)
    return out


def paths_of_schema(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a type."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in (f"{at}{'.' * bool(at)}{f.name}", *paths_of_schema(f.dataType, f"{at}{'.' * bool(at)}{f.name}"))]
    if isinstance(kind, T.ArrayType):
        return paths_of_schema(kind.elementType, f"{at}[]")
    return []


def _tree(paths: Iterable[str]) -> dict[str, dict]:
    """Known paths by their steps; a step through a list ends in `[]`."""
    tree: dict[str, dict] = {}
    for path in paths:
        at = tree
        for step in path.split("."):
            at = at.setdefault(step, {})
    return tree


KNOWN = _tree(p for m in LAYOUTS if not m.rows for p in m.paths)


def paths_of_json(j: Column, tree: dict[str, dict] | None = None, at: str = "") -> Column:
    """Known field paths that stand in a JSON object, at any depth, in some element of a list at least."""
    tree = KNOWN if tree is None else tree
    none = F.array().cast("array<string>")
    leaves = [n for n, below in tree.items() if not below]
    keys = F.coalesce(F.json_object_keys(j), none)
    found = [F.transform(F.array_intersect(keys, F.array(*map(F.lit, leaves)) if leaves else none), lambda k: F.concat(F.lit(at), k))]

    def under(step: str) -> Callable[[Column], Column]:
        return lambda inner: paths_of_json(inner, tree[step], f"{at}{step}.")

    for step in (n for n, below in tree.items() if below):
        inner = F.get_json_object(j, f"$['{step.removesuffix('[]')}']")
        if step.endswith("[]"):
            found.append(F.array_distinct(F.flatten(F.transform(F.coalesce(F.from_json(inner, "array<string>"), none), under(step)))))
        else:
            found.append(bind(inner, under(step)))
    return F.concat(*found)


def _role(role: Column) -> Column:
    out = role
    for other, ours in ROLES.items():
        out = F.when(role == other, F.lit(ours)).otherwise(out)
    return F.coalesce(out, F.lit(""))


def turns_of_json(records: DataFrame, json_col: str, id_col: str) -> DataFrame:
    """conv_id, layout, turns: canonical turns of JSON records, by the mapping that each record's fingerprint selects.

    A mapping fits where all its paths are there; fields that it does not name do not matter. Unknown layouts, null,
    empty and broken records: layout null and no turns. Absent or null fields give no turn; list elements without a
    text give an empty one. Repeated rows stay. An empty table gives no rows.
    """
    j, none = F.col("j"), F.array().cast("array<string>")
    layouts = tuple(m for m in LAYOUTS if not m.rows)
    rows = records.select(F.col(id_col).alias("conv_id"), F.col(json_col).alias("j"))
    rows = rows.select("conv_id", "j", bind(paths_of_json(j), lambda p: selected(p, layouts)).alias("layout"))
    turns = F.array().cast(TURNS)
    for m in layouts:
        if m.listed:
            of, role, text = m.listed
            each = F.coalesce(F.from_json(F.get_json_object(j, f"$.{of}"), "array<string>"), none)
            made = F.transform(each, lambda e: F.struct(_role(F.get_json_object(e, f"$.{role}")).alias("role"), F.coalesce(F.get_json_object(e, f"$.{text}"), F.lit("")).alias("text")))  # noqa: B023
        else:
            made = F.filter(F.array(*[F.struct(F.lit(r).alias("role"), F.get_json_object(j, f"$.{p}").alias("text")) for r, p in m.parts]), lambda x: x["text"].isNotNull())
        turns = F.when(F.col("layout") == m.name, made.cast(TURNS)).otherwise(turns)
    return rows.select("conv_id", "layout", turns.alias("turns"))


def turns_of_rows(rows: DataFrame) -> DataFrame:
    """conv_id, layout, turns of a table with a row a turn, by the mapping that the fingerprint of its schema selects;
    ValueError if there is none.

    Turns are in the order of their column, then role and text (null first). Null texts and roles are empty, roles stay as
    they are; rows of a null conversation are one; repeated rows are repeated turns; other columns are not read.
    """
    paths = paths_of_schema(rows.schema)
    layouts = tuple(m for m in LAYOUTS if m.rows)
    name = rows.sparkSession.range(1).select(selected(F.array(*map(F.lit, paths)) if paths else F.array().cast("array<string>"), layouts)).first()[0]
    m = next((m for m in layouts if m.name == name), None)
    if m is None:
        raise ValueError(f"no layout has the fields {sorted(paths)}")
    conv, order, role, text = (F.col(f"`{c}`") for c in m.rows)
    one = F.struct(order.alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    kept = rows.groupBy(conv.alias("conv_id")).agg(F.array_sort(F.collect_list(one)).alias("t"))
    return kept.select("conv_id", F.lit(m.name).alias("layout"), F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def formatted(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Adds formatted (text with marked turns) and loss (spans of the assistant's texts in it: start from 0, length)."""
    t = template or Template()
    safe = turns.withColumn("safe", F.transform("turns", lambda x: F.struct(escaped(x["role"], t, True).alias("role"), escaped(x["text"], t).alias("text"), (x["role"] == "assistant").alias("loss"))))
    head = len(t.open) + len(t.after_role)
    sizes = F.transform("safe", lambda x: F.struct(F.length(x["role"]).alias("role"), F.length(x["text"]).alias("text"), x["loss"].alias("loss")))

    def placed(z: Column) -> Column:
        before = sums_before(F.transform(z, lambda x: x["role"] + x["text"] + head + len(t.close)))
        each = F.zip_with(z, before, lambda x, n: F.struct((n + head + x["role"]).cast("int").alias("start"), x["text"].alias("length"), x["loss"].alias("loss")))
        return F.transform(F.filter(each, lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))

    spans = bind(sizes, placed)
    text = F.array_join(F.transform("safe", lambda x: F.concat(F.lit(t.open), x["role"], F.lit(t.after_role), x["text"], F.lit(t.close))), "")
    return safe.select(*turns.columns, text.alias("formatted"), spans.alias("loss"))


def read_back(text: Column, template: Template | None = None) -> Column:
    """Turns of a formatted text."""
    t = template or Template()
    parts = F.filter(F.split(text, rf"\Q{t.close}\E", -1), lambda p: p != "")
    body = F.transform(parts, lambda p: F.substring(p, F.lit(len(t.open) + 1), F.length(p)))
    cut = F.transform(body, lambda p: F.struct(F.substring_index(p, t.after_role, 1).alias("r"), p.alias("p")))
    return F.transform(cut, lambda x: F.struct(unescaped(x["r"], t, True).alias("role"), unescaped(F.substring(x["p"], F.length(x["r"]) + len(t.after_role) + 1, F.length(x["p"])), t).alias("text")))


def digest(done: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id and what reading back `formatted` and its loss spans gives: counts and digests."""
    t = template or Template()
    cuts = pieces(F.col("formatted"), F.col("loss"))
    read = done.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), read_back(F.col("formatted"), t).alias("back"), F.array_join(F.transform(cuts, lambda c: unescaped(c, t)), "").alias("taught"))
    whole = F.array_join(F.transform("back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("taught").cast("long").alias("loss_chars"), F.sha2("taught", 256).alias("loss_sha256"), "formatted_chars")


def format_turn_rows(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """Formatted conversations of a turn-a-row table: conv_id, layout, turns, formatted, loss."""
    return formatted(turns_of_rows(rows), template)
