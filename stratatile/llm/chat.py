"""Chat formatting: schema fingerprints select declarative mappings to canonical turns.

A layout is known by the hash of its nested field paths. Typed tables are
matched once, when the plan is made; JSON records one by one. A mapping only
names paths: which field holds the messages, the role, the text, or which
fields are the prompt and the answer.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_slices, in_workers, table

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """One layout. Paths are dotted; ``messages`` is a path to a list.

    ``parts``: (role, path) in the order of the turns, for layouts without a
    list. ``order``: the field that orders rows of a conversation, for layouts
    with one row per turn. ``aliases`` renames roles.
    """

    name: str
    messages: str | None = None
    role: str | None = None
    text: str | None = None
    order: str | None = None
    parts: tuple[tuple[str, str], ...] = ()
    aliases: tuple[tuple[str, str], ...] = ()

    @property
    def paths(self) -> frozenset[str]:
        inside = f"{self.messages}[]." if self.messages else ""
        own = [inside + x for x in (self.role, self.text) if x]
        return frozenset([*own, *([self.order] if self.order else []), *(p for _, p in self.parts)])

    @property
    def fingerprint(self) -> str:
        return path_hash(self.paths)


def path_hash(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode("utf-8", "replace")).hexdigest()[:16]


SHARED = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
MAPPINGS = (
    Mapping("turn_rows", role="role", text="text", order="turn"),
    Mapping("messages", messages="messages", role="role", text="content"),
    Mapping("conversations", messages="conversations", role="from", text="value", aliases=SHARED),
    Mapping("prompt_response", parts=(("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt_completion", parts=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("instruction", parts=(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction_input", parts=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("system_prompt", parts=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("question_answer", parts=(("user", "data.question"), ("assistant", "data.answer"))),
)


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    """Nested field paths of a type; a list adds [] to its path."""
    if isinstance(kind, T.StructType):
        return {p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)}
    return schema_paths(kind.elementType, f"{at}[]") if isinstance(kind, T.ArrayType) else {at}


def value_paths(value) -> set[str]:
    """The same of a parsed JSON value, however deep; an empty list or object has its own path."""
    found, todo = set(), [(value, "")]
    while todo:
        x, at = todo.pop()
        if isinstance(x, dict) and x:
            todo += [(v, f"{at}.{k}" if at else k) for k, v in x.items()]
        elif isinstance(x, list) and x:
            todo += [(v, f"{at}[]") for v in x]
        else:
            found.add(f"{at}[]" if isinstance(x, list) else at)
    return found


def select_mapping(paths: Iterable[str], mappings: Sequence[Mapping] = MAPPINGS) -> Mapping | None:
    """The mapping with this fingerprint; with fields besides, the one that explains most of them (ties: the first)."""
    paths = frozenset(paths)
    by_hash = {m.fingerprint: m for m in mappings}
    if exact := by_hash.get(path_hash(paths)):
        return exact
    fitting = [m for m in mappings if m.paths <= paths]
    return max(fitting, key=lambda m: len(m.paths), default=None)


def _renamed(role: Column, mapping: Mapping) -> Column:
    role = F.coalesce(role.cast("string"), F.lit(""))
    for old, new in mapping.aliases:
        role = F.when(role == old, F.lit(new)).otherwise(role)
    return role


def canonical_turns(df: DataFrame, key: str, mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """(``key``, layout, turns) from a typed table, by the fingerprint of its schema.

    Null roles and texts are empty strings. Rows of one conversation are put
    in order of (turn, role, text), so ties and repeated rows have a defined
    place, and none is dropped. A layout that no mapping explains raises
    ValueError. In the row-per-turn layout a conversation becomes one value,
    as its formatted text is.
    """
    paths = schema_paths(df.schema) - {key}
    m = select_mapping(paths, mappings)
    if m is None:
        raise ValueError(f"no mapping for fields {sorted(paths)} (fingerprint {path_hash(paths)})")
    empty = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    if m.order:
        row = F.struct(F.col(m.order).alias("o"), _renamed(F.col(m.role), m).alias("role"), empty(F.col(m.text)).alias("text"))
        made = df.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("rows"))
        turns = F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text")))
        return made.select(key, F.lit(m.name).alias("layout"), turns.alias("turns"))
    if m.messages:
        field = lambda x, path: x.getField(path)
        turns = F.transform(F.coalesce(F.col(m.messages), F.array().cast(df.select(m.messages).schema[0].dataType)), lambda x: F.struct(_renamed(field(x, m.role), m).alias("role"), empty(field(x, m.text)).alias("text")))
    else:
        turns = F.array(*[F.struct(F.lit(role).alias("role"), empty(F.col(path)).alias("text")) for role, path in m.parts])
    return df.select(key, F.lit(m.name).alias("layout"), turns.cast(TURNS).alias("turns"))


def _walk(value, path: str):
    for name in path.split("."):
        value = value.get(name) if isinstance(value, dict) else None
    return value


def _said(x) -> str:
    """A field as text: null is empty, what isn't text is its JSON; half a surrogate pair is U+FFFD."""
    text = x if isinstance(x, str) else "" if x is None else json.dumps(x, ensure_ascii=False)
    return text if text.isascii() else text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def record_turns(record: str | None, mappings: Sequence[Mapping] = MAPPINGS) -> tuple[str | None, str | None, list[dict]]:
    """(fingerprint, layout, turns) of one JSON record.

    What is no JSON object, or nested too deep to be read, has none of the
    three; an unknown layout has a fingerprint and no turns. An empty list of
    messages has the layout whose list it is, and no turns, as in a typed table.
    """
    try:
        value = json.loads(record) if record else None
        if not isinstance(value, dict):
            return None, None, []
        paths = value_paths(value)
        given = [m for m in mappings if not m.order]
        m = select_mapping(paths, given) or next((m for m in given if m.messages and _walk(value, m.messages) == []), None)
        if m is None:
            return path_hash(paths), None, []
        alias = dict(m.aliases)
        if m.messages:
            found = [(_said(_walk(x, m.role)), _said(_walk(x, m.text))) for x in _walk(value, m.messages) or []]
        else:
            found = [(role, _said(_walk(value, path))) for role, path in m.parts]
    except (ValueError, RecursionError):
        return None, None, []
    return path_hash(paths), m.name, [{"role": alias.get(r, r), "text": t} for r, t in found]


def canonical_records(df: DataFrame, key: str, record: str, mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """(``key``, fingerprint, layout, turns) from a column of JSON records of mixed layouts."""
    kept = df.select(key, F.col(record).cast("string").alias("_record"))
    schema = T.StructType([kept.schema[0], T.StructField("fingerprint", T.StringType()), T.StructField("layout", T.StringType()), T.StructField("turns", T._parse_datatype_string(TURNS))])
    arrow = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            got = [record_turns(x, mappings) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.string()), pa.array([x[2] for x in got], arrow)], names=[f.name for f in schema])

    return in_workers(kept, run, schema)


# --- the template -----------------------------------------------------------
# <s>[ROLE]role[/ROLE]text</s> for each turn. In roles and texts a backslash
# becomes two, and one is put after every < and [, with which all control
# strings begin, so that none occurs inside; dropping the backslash before any
# character reads it back.
OPENING = r"([<\[])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), OPENING, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.?)", "$1")


def format_turns(chats: DataFrame, learn: str = "assistant") -> DataFrame:
    """Adds formatted (string) and mask (array of (chars, loss) runs that cover it, three for each turn).

    Null turns are none: an empty text and no runs. Null roles and texts inside
    are empty. Other columns stay; a column named formatted or mask is replaced.
    """
    name = "_escaped"
    while name in chats.columns:
        name += "_"
    empty = lambda c: F.coalesce(c, F.lit(""))
    escaped = F.transform(F.coalesce("turns", F.array().cast(TURNS)), lambda t: F.struct(escape(empty(t["role"])).alias("role"), escape(empty(t["text"])).alias("text"), t["role"].eqNullSafe(F.lit(learn)).alias("loss")))
    df = chats.withColumn(name, escaped)
    formatted = F.array_join(F.transform(name, lambda t: F.concat(F.lit("<s>[ROLE]"), t["role"], F.lit("[/ROLE]"), t["text"], F.lit("</s>"))), "")
    run = lambda n, loss: F.struct(n.cast("long").alias("chars"), loss.alias("loss"))
    mask = F.flatten(F.transform(name, lambda t: F.array(run(F.length(t["role"]) + 16, F.lit(False)), run(F.length(t["text"]), t["loss"]), run(F.lit(4), F.lit(False)))))
    return df.withColumn("formatted", formatted).withColumn("mask", mask).drop(name)


def _parts(formatted: Column) -> Column:
    """The formatted turns, without their ends."""
    return F.filter(F.split(formatted, "</s>"), lambda x: x != "")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text."""
    return F.transform(_parts(formatted), lambda x: F.struct(unescape(F.regexp_extract(x, r"(?s)^<s>\[ROLE\](.*?)\[/ROLE\]", 1)).alias("role"), unescape(F.regexp_extract(x, r"(?s)^<s>\[ROLE\].*?\[/ROLE\](.*)$", 1)).alias("text")))


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped; each turn's three runs are counted in its own part."""
    chars = lambda k: F.get(mask, k)["chars"].cast("int")
    cut = lambda x, i: F.when(F.get(mask, 3 * i + 1)["loss"], F.substring(x, chars(3 * i) + 1, chars(3 * i + 1))).otherwise(F.lit(""))
    return unescape(F.array_join(F.transform(_parts(formatted), cut), ""))


def op1_schema_fingerprint_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every formatted conversation, read back from the formatted text."""
    said = "</s>[INST] ok [/INST]"
    given = spark.createDataFrame([(-7, said, said)], "conv_id long, prompt string, response string")
    rows = table(spark, sf_dir, "conversations").withColumn("conv_id", F.col("conv_id").cast("long"))
    chats = canonical_turns(rows, "conv_id").unionByName(canonical_turns(given, "conv_id"))
    done = format_turns(chats).select("conv_id", "layout", "formatted", read_turns(F.col("formatted")).alias("back"), read_loss(F.col("formatted"), F.col("mask")).alias("loss"))
    whole = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select("conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "layout")
