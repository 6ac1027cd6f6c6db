"""Chat formatting: records of many layouts become canonical turns and one training string.

A record is a JSON text or a struct. Its nested field paths, without value types, are hashed; the
hash selects a declarative mapping (LAYOUTS) that reads the turns. A struct with just the fields of one
layout is of that layout; in another struct a record's fields are those that are not null, so that one
column holds records of many layouts. The template writes a turn as
``### role: text</turn>\n`` with every backslash, ``#`` and ``</`` inside a text escaped by a
backslash, so neither marker can occur inside a text and the text reads back unchanged.

Defined results: a null text or role is empty; a null, empty or malformed record and one of
an unknown layout has no turns (layout null) and an empty string; fields beside a layout's own
make another fingerprint unless the mapping lists them as optional; rows of one conversation
with the same turn number follow in order of role, then text, null turns first; repeated rows stay;
a column that has the name of an added one is replaced by it, and the other columns stay. Structs have no
limit but that of one value (2 GB, beyond which Spark fails); a JSON object that is too large for
Spark's parsers is an error, never an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

END = "</turn>\n"
TURNS = "array<struct<role:string,text:string>>"
#: A longer JSON text may be over a limit of try_parse_json (20 million characters a string, 128 MB in all).
LONG = 1 << 24
_ANY_LENGTH = {"maxStringLen": str((1 << 31) - 1)}


@dataclass(frozen=True)
class Layout:
    """paths: the field paths of a record; optional: top-level fields that may be there too.

    schema: for from_json; turns: SQL over column r that gives TURNS.
    """

    name: str
    paths: tuple[str, ...]
    schema: str
    turns: str
    optional: tuple[str, ...] = ("id", "source")


def _list(field: str, role: str, text: str) -> str:
    who = f"CASE lower(m.{role}) WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE coalesce(m.{role}, '') END" if role == "from" else f"coalesce(m.{role}, '')"
    return f"transform(r.{field}, m -> named_struct('role', {who.replace('m.from', 'm.`from`')}, 'text', coalesce(m.{text}, '')))"


def _flat(*parts: tuple[str, str], optional: tuple[str, ...] = ()) -> str:
    each = ", ".join(f"named_struct('role', '{role}', 'text', coalesce({text}, ''), 'keep', {'true' if text not in optional else f'coalesce({text}, {chr(39)*2}) <> {chr(39)*2}'})" for role, text in parts)
    return f"transform(filter(array({each}), t -> t.keep), t -> named_struct('role', t.role, 'text', t.text))"


_ASK = "CASE WHEN coalesce(r.input, '') = '' THEN r.instruction ELSE concat(coalesce(r.instruction, ''), '\\n\\n', r.input) END"
LAYOUTS = (
    Layout("messages", ("messages[].content", "messages[].role"), "struct<messages:array<struct<role:string,content:string>>>", _list("messages", "role", "content")),
    Layout("conversations", ("conversations[].from", "conversations[].value"), "struct<conversations:array<struct<`from`:string,value:string>>>", _list("conversations", "from", "value")),
    Layout("instruction", ("input", "instruction", "output"), "struct<instruction:string,input:string,output:string>", _flat(("user", _ASK), ("assistant", "r.output"))),
    Layout("instruction_only", ("instruction", "output"), "struct<instruction:string,output:string>", _flat(("user", "r.instruction"), ("assistant", "r.output"))),
    Layout("completion", ("completion", "prompt"), "struct<prompt:string,completion:string>", _flat(("user", "r.prompt"), ("assistant", "r.completion"))),
    Layout("response", ("prompt", "response"), "struct<prompt:string,response:string>", _flat(("user", "r.prompt"), ("assistant", "r.response"))),
    Layout("response_system", ("prompt", "response", "system"), "struct<system:string,prompt:string,response:string>", _flat(("system", "r.system"), ("user", "r.prompt"), ("assistant", "r.response"), optional=("r.system",))),
    Layout("answer", ("answer", "question"), "struct<question:string,answer:string>", _flat(("user", "r.question"), ("assistant", "r.answer"))),
)


def _shape(paths: tuple[str, ...]) -> str:
    """What fingerprint() hashes for a record with these paths."""
    top: dict[str, set[str]] = {}
    for p in paths:
        head, _, rest = p.partition("[].")
        top.setdefault(head, set()).update({rest} if rest else ())
    return "OBJECT<" + ", ".join(f"{k}: " + (f"ARRAY<OBJECT<{', '.join(f'{x}: _' for x in sorted(v))}>>" if v else "_") for k, v in sorted(top.items())) + ">"


def fingerprints(layouts: tuple[Layout, ...] = LAYOUTS) -> dict[str, Layout]:
    out = {}
    for x in layouts:
        for k in range(len(x.optional) + 1):
            for more in itertools.combinations(x.optional, k):
                out[hashlib.sha256(_shape((*x.paths, *more)).encode()).hexdigest()] = x
    return out


def fingerprint(record: Column) -> Column:
    """SHA-256 of a record's nested field paths; value types do not count. Null if it is no JSON."""
    long = F.char_length(record) > LONG
    shape = F.schema_of_variant(F.coalesce(F.try_parse_json(record), F.when(long, F.from_json(record, "variant", _ANY_LENGTH))))
    over = long & F.from_json(record, "map<string,string>", _ANY_LENGTH).isNotNull()
    shape = F.coalesce(shape, F.when(over, F.raise_error(F.lit("a JSON record is too large to be read")).cast("string")))
    return F.sha2(F.regexp_replace(shape, r"(: )(?:STRING|BIGINT|VOID|BOOLEAN|DOUBLE|FLOAT|DECIMAL\(\d+,\s*\d+\)|VARIANT)(?=[,>])", "$1_"), 256)


def struct_paths(kind: StructType) -> tuple[str, ...]:
    """Field paths of a record that is a struct, as in Layout."""
    return tuple(p for f in kind.fields for p in _paths(f))


def _paths(f: StructField) -> list[str]:
    inner = f.dataType.elementType if isinstance(f.dataType, ArrayType) else None
    return [f"{f.name}[].{x}" for x in inner.names] if isinstance(inner, StructType) else [f.name]


def _present(record: str, kind: StructType) -> Column:
    """Fingerprint of a struct's fields that are not null."""
    parts = [F.when(F.col(f"`{record}`.`{f.name}`").isNotNull(), _shape(tuple(_paths(f)))[len("OBJECT<") : -1]) for f in sorted(kind.fields, key=lambda f: f.name)]
    return F.sha2(F.concat(F.lit("OBJECT<"), F.concat_ws(", ", *parts), F.lit(">")), 256)


def _added(df: DataFrame, **columns: Column) -> DataFrame:
    """df with these columns, all worked out from df as it is."""
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in columns), *(v.alias(k) for k, v in columns.items()))


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit("#"), F.lit("\\#")), F.lit("</"), F.lit("<\\/"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def canonical(df: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds fingerprint, layout and turns (TURNS) to rows with a record (JSON text or struct)."""
    by = fingerprints(layouts)
    kind = df.schema[record].dataType
    if isinstance(kind, StructType):
        there = F.col(f"`{record}`").isNotNull()
        fixed = hashlib.sha256(_shape(struct_paths(kind)).encode()).hexdigest()
        key = F.when(there, F.lit(fixed) if fixed in by else _present(record, kind))
        top = lambda x: {p.partition("[].")[0] for p in x.paths}
        layouts = tuple(x for x in layouts if top(x) <= set(kind.names))
        read = lambda x: f"`{record}`"
    else:
        key = fingerprint(F.col(f"`{record}`"))
        read = lambda x: f"from_json(`{record}`, '{x.schema}', map('maxStringLen', '{_ANY_LENGTH['maxStringLen']}'))"
    name, turns = F.lit(None).cast("string"), F.expr(f"cast(array() as {TURNS})")
    for x in layouts:
        own = key.isin([k for k, v in by.items() if v is x])
        name = F.when(own, F.lit(x.name)).otherwise(name)
        turns = F.when(own, F.expr(f"transform(array({read(x)}), r -> {x.turns})[0]").cast(TURNS)).otherwise(turns)
    return _added(df, fingerprint=key, layout=name, turns=F.coalesce(turns, F.expr(f"cast(array() as {TURNS})")))


def _head(t: Column) -> Column:
    return F.concat(F.lit("### "), F.replace(escaped(t["role"]), F.lit(":"), F.lit("\\:")), F.lit(": "))


def _bound(value: Column, use) -> Column:
    """use(value), with value worked out once however often it occurs."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _chunks(items: Column, use) -> Column:
    """use(array of items' runs of about the square root of their number): what is quadratic in a run is not so in all."""
    width = F.greatest(F.ceil(F.sqrt(F.size(items))).cast("int"), F.lit(1))
    runs = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.slice(items, i * width + 1, width))
    return _bound(F.filter(runs, lambda x: F.size(x) > 0), use)


def _spans(sizes: Column) -> Column:
    """Spans of the bodies that are learned, from sizes of head and body (h, b) and whether it is (own)."""
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    size = lambda p: p["h"] + p["b"] + len(END)

    def step(acc, p):
        start = acc["at"] + p["h"]
        own = F.when(p["own"], F.array(F.struct(start.alias("start"), (start + p["b"]).alias("end")))).otherwise(none)
        return F.struct((acc["at"] + size(p)).alias("at"), F.concat(acc["spans"], own).alias("spans"))

    def placed(runs):
        totals = F.transform(runs, lambda x: F.aggregate(x, F.lit(0), lambda a, p: a + size(p)))
        first = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("starts"))
        starts = F.aggregate(totals, first, lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts")))["starts"]
        return F.flatten(F.zip_with(runs, starts, lambda x, at: F.aggregate(x, F.struct(at.alias("at"), none.alias("spans")), step)["spans"]))

    return _bound(sizes, lambda l: _chunks(l, placed))


def formatted(df: DataFrame) -> DataFrame:
    """Adds formatted and loss_spans (start, end in code points of formatted) to rows with turns."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(_head(t), escaped(t["text"]), F.lit(END))), "")
    sizes = F.transform("turns", lambda t: F.struct(F.char_length(_head(t)).alias("h"), F.char_length(escaped(t["text"])).alias("b"), (t["role"] == "assistant").alias("own")))
    return _added(df, formatted=whole, loss_spans=_spans(sizes))


def masked(text: Column, spans: Column) -> Column:
    """All text under a mask's spans, in order, unescaped; cut from runs of spans, so that a string is not counted through for each."""
    cut = lambda x, lo, hi: F.substring(x, lo + 1, hi - lo)

    def of(run):
        first = run[0]["start"]
        block = cut(text, first, F.element_at(run, -1)["end"])
        return _bound(block, lambda b: F.array_join(F.transform(run, lambda s: unescaped(cut(b, s["start"] - first, s["end"] - first))), ""))

    return _chunks(spans, lambda runs: F.array_join(F.transform(runs, of), ""))


def read_back(text: Column) -> Column:
    """The turns of a formatted string, as TURNS."""
    pieces = F.filter(F.split(text, END, -1), lambda p: p != "")
    head = r"(?s)^### ((?:[^:\\]|\\.)*+): (.*)$"
    return F.transform(pieces, lambda p: F.struct(unescaped(F.regexp_extract(p, head, 1)).alias("role"), unescaped(F.regexp_extract(p, head, 2)).alias("text")))


def records(conversations: DataFrame) -> DataFrame:
    """One record for each conv_id of rows (conv_id, turn, role, text), in the narrowest layout that holds its roles.

    system, user and assistant in this order (system not empty), and user and assistant, are one field
    each; longer ones of user and assistant alone are a list of `from` and `value`; all others are messages.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = F.col("t")
    roles = F.transform(t, lambda x: x["role"])
    is_ = lambda *names: roles == F.array(*map(F.lit, names))
    three, two = is_("system", "user", "assistant") & (t[0]["text"] != ""), is_("user", "assistant")
    pair = ~three & ~two & F.forall(roles, lambda r: r.isin("user", "assistant"))
    text = lambda i: F.get(t, i)["text"]
    record = F.struct(
        F.when(~three & ~two & ~pair, F.transform(t, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))).alias("messages"),
        F.when(pair, F.transform(t, lambda x: F.struct(F.when(x["role"] == "user", "human").otherwise("gpt").alias("from"), x["text"].alias("value")))).alias("conversations"),
        F.when(three, text(0)).alias("system"), F.when(three, text(1)).when(two, text(0)).alias("prompt"), F.when(three, text(2)).when(two, text(1)).alias("response"),
    )
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t")).select("conv_id", record.alias("record"))


def digest(df: DataFrame) -> DataFrame:
    """The contract's columns, from formatted and loss_spans alone."""
    df = df.select("conv_id", "formatted", "loss_spans").withColumn("turns", read_back(F.col("formatted")))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    df = df.withColumn("loss", masked(F.col("formatted"), F.col("loss_spans")))
    return df.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
