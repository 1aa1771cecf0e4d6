"""Chat formatting: schema fingerprints choose declarative mappings into canonical turns, then a template."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwave.llm.storage import let

TURNS = "array<struct<role:string,text:string>>"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
# Control characters of the template and of other common chat templates, and what stands for each
# inside a text. "&" comes first here and last when reading back.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))


# Strings of JSON, and the values among them: whatever lies before a value, its key included, is group 1.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_VALUE = rf'(\G[^"]*+(?:{_STRING}\s*+:[^"]*+)*+){_STRING}'
_REPEATED = r"(\{[^{}\[\]]*+\})(?:\s*+,\s*+\1)++"
# A turn may be longer than the JSON reader's usual limit of 20,000,000 characters.
_UNLIMITED = {"maxStringLen": str(2**31 - 1)}


@dataclass(frozen=True)
class Mapping:
    """One layout: the field paths it needs, those it can use, a schema, and SQL over `r` giving its turns.

    A list is written with [] and its elements' fields behind it, as in `messages[].role`.
    """

    name: str
    needs: tuple[str, ...]
    uses: tuple[str, ...]
    schema: str
    turns: str

    def path_sets(self) -> list[tuple[str, ...]]:
        """The needed paths with every choice of the others."""
        return [tuple(sorted((*self.needs, *some))) for n in range(len(self.uses) + 1) for some in combinations(self.uses, n)]


def _said(name: str, user: str, assistant: str, more: str | None = None) -> Mapping:
    """A layout with one field for each role, a system field and perhaps one that is added to the user's."""
    said = lambda role, text: f"named_struct('role', '{role}', 'text', {text})"
    asked = f"coalesce(r.`{user}`, '')" + (f" || if(coalesce(r.`{more}`, '') = '', '', '\\n\\n' || r.`{more}`)" if more else "")
    turns = f"filter(array(if(r.system IS NULL, NULL, {said('system', 'r.system')}), {said('user', asked)}, {said('assistant', f"coalesce(r.`{assistant}`, '')")}), t -> t IS NOT NULL)"
    others = ("system", more) if more else ("system",)
    return Mapping(name, (user, assistant), others, ", ".join(f"`{f}` string" for f in (user, assistant, *others)), turns)


def _listed(path: str, role: str, text: str) -> tuple[str, str]:
    """The type of a list of turns, and SQL that reads it; an element that is null is no turn."""
    turn = f"named_struct('role', coalesce(x.`{role}`, ''), 'text', coalesce(x.`{text}`, ''))"
    return f"array<struct<`{role}`:string,`{text}`:string>>", f"coalesce(transform(filter(r.{path}, x -> x IS NOT NULL), x -> {turn}), array())"


def _listing(name: str, field: str, role: str, text: str) -> Mapping:
    kind, turns = _listed(field, role, text)
    return Mapping(name, (f"{field}[]",), (f"{field}[].{role}", f"{field}[].{text}"), f"{field} {kind}", turns)


_CHAT = _listed("chat.turns", "speaker", "text")
MAPPINGS = (
    _said("prompt", "prompt", "completion"),
    _said("prompt_response", "prompt", "response"),
    _said("instruction", "instruction", "output", "input"),
    _listing("messages", "messages", "role", "content"),
    _listing("share", "conversations", "from", "value"),
    Mapping("chat", ("chat", "chat.turns[]"), ("chat.turns[].speaker", "chat.turns[].text"), f"chat struct<turns:{_CHAT[0]}>", _CHAT[1]),
)


def field_paths(record: Column, known: tuple[str, ...]) -> Column:
    """Those of the known field paths that a JSON record has, in their order; null for broken JSON and for what is no object.

    Only the shape is parsed: string values are emptied and runs of equal flat objects become one,
    so the length of a record's texts and lists does not matter. A field whose value is null is
    there; a null list is an empty one.
    """
    shape = F.regexp_replace(F.regexp_replace(record, _VALUE, '$1""'), _REPEATED, "$1")
    nothing = F.array().cast("array<string>")
    keys = lambda o: F.coalesce(F.json_object_keys(o), nothing)

    def inside(o: Column) -> Column:
        found = []
        for parent in dict.fromkeys(p.rpartition(".")[0] for p in known):
            place = parent.removesuffix("[]")
            value = F.get_json_object(o, f"$.{place}") if place else o
            if parent.endswith("[]"):
                names = F.array_distinct(F.flatten(F.transform(F.coalesce(F.from_json(value, "array<string>"), nothing), keys)))
            else:
                names = keys(value)
            for p in known:
                if p.rpartition(".")[0] == parent:
                    name = p.rpartition(".")[2]
                    there = F.array_contains(names, name.removesuffix("[]"))
                    if name.endswith("[]"):
                        listed = F.get_json_object(value, f"$.{name.removesuffix('[]')}")
                        there = there & (listed.isNull() | F.startswith(listed, F.lit("[")))
                    found.append(F.when(there, F.lit(p)))
        return F.array_compact(F.array(*found))

    return let(shape, lambda o: F.when(F.json_object_keys(o).isNotNull(), inside(o)))


def fingerprint(paths: Column) -> Column:
    """Hash of a set of field paths; their order, kinds of values and further fields do not matter. Null stays null."""
    return F.when(paths.isNotNull(), F.xxhash64(F.array_join(F.array_sort(paths), "\n")))


def canonical_turns(df: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS, out: str = "turns") -> DataFrame:
    """df, its JSON `record` read by the mapping that its fingerprint selects.

    The fingerprint is taken over the field paths that some mapping knows, so further fields do no
    harm; a record that has the paths of two mappings fits none. Adds `out` (array of role and text,
    null where no mapping fits, the record is null or its JSON is broken), `layout` (the mapping's
    name) and `schema_hash`. Null roles and texts are empty, an empty or null list of messages gives
    an empty list, and a value that is no string is taken as its JSON. Columns that already have
    these names are replaced; all others stay. An empty table gives an empty one.
    """
    spark = df.sparkSession
    known = tuple(dict.fromkeys(p for m in mappings for p in (*m.needs, *m.uses)))
    sets = [(m.name, paths) for m in mappings for paths in m.path_sets()]
    hashed = spark.range(1).select(*[fingerprint(F.lit(list(paths))).alias(f"h{i}") for i, (_, paths) in enumerate(sets)]).first()
    names: dict[int, str] = {}
    for (name, paths), h in zip(sets, hashed, strict=True):
        if names.setdefault(h, name) != name:
            raise ValueError(f"mappings {names[h]} and {name} can't be told apart by {paths}")
    turns, layout = F.lit(None).cast(TURNS), F.lit(None).cast("string")
    options = ", ".join(f"'{k}', '{v}'" for k, v in _UNLIMITED.items())
    for m in reversed(mappings):
        fits = F.col("_h").isin([h for h, name in names.items() if name == m.name])
        read = F.expr(f"transform(array(from_json(_json, '{m.schema}', map({options}))), r -> {m.turns})[0]")
        turns, layout = F.when(fits, read.cast(TURNS)).otherwise(turns), F.when(fits, F.lit(m.name)).otherwise(layout)
    kept = [c for c in df.columns if c not in (out, "layout", "schema_hash")]
    shaped = df.select(F.struct(*[df[c] for c in kept]).alias("_row"), df[record].alias("_json"), fingerprint(field_paths(df[record], known)).alias("_h"))
    return shaped.select(*[F.col(f"_row.`{c}`").alias(c) for c in kept], turns.alias(out), layout.alias("layout"), F.col("_h").alias("schema_hash"))


def layout_counts(read: DataFrame) -> DataFrame:
    """Records by layout and fingerprint; those without a layout are what no mapping takes."""
    return read.groupBy("layout", "schema_hash").agg(F.count(F.lit(1)).alias("n"))


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def format_turns(df: DataFrame, key: str, turns: str = "turns", trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per key: `formatted` text and `loss_spans`, the code-point ranges that are trained on.

    A turn is OPEN, its escaped role, a newline, its escaped text, CLOSE. Roles and texts that hold
    control strings are escaped and can be read back exactly; a null role or text counts as empty.
    A key with no turns gives an empty text. Keys should be unique: rows with the same key are
    formatted one after the other. Rows of one key meet in one task, since they become one text.
    """
    role = F.coalesce(F.col("t.role"), F.lit(""))
    head = F.concat(F.lit(OPEN), F.replace(escape(role), F.lit("\n"), F.lit("&nl;")), F.lit("\n"))
    body = escape(F.coalesce(F.col("t.text"), F.lit("")))
    flat = df.select(F.col(key).alias("k"), F.posexplode_outer(turns).alias("p", "t"))
    flat = flat.select("k", "p", head.alias("head"), body.alias("body"), role.isin(*trained_roles).alias("trained"))
    piece = F.when(F.col("p").isNull(), F.lit("")).otherwise(F.concat("head", "body", F.lit(CLOSE)))
    before = Window.partitionBy("k").orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = F.sum(F.length("piece").cast("long")).over(before)
    flat = flat.withColumn("piece", piece).withColumn("from", ends - F.length("piece") + F.length("head"))
    span = F.when(F.col("trained") & F.col("p").isNotNull(), F.struct(F.col("from").alias("start"), (F.col("from") + F.length("body")).alias("stop")))
    gathered = flat.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("p", "from", "piece", span.alias("span")))).alias("g"))
    return gathered.select(
        F.col("k").alias(key),
        F.array_join(F.transform("g", lambda x: x["piece"]), "").alias("formatted"),
        F.filter(F.transform("g", lambda x: x["span"]), F.isnotnull).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, unescaped."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")

    def turn(p: Column) -> Column:
        rest = F.substring(p, len(OPEN) + 1, 2**31 - 1)
        role = F.substring_index(rest, "\n", 1)
        text = F.substr(rest, F.length(role) + 2)
        return F.struct(unescape(F.replace(role, F.lit("&nl;"), F.lit("\n"))).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def records_of(conversations: DataFrame) -> DataFrame:
    """Conversations by row (conv_id, turn, role, text) as one JSON record each, in the layout their roles suit.

    A user and an assistant turn become an instruction, with a system turn before them an
    instruction with a system field; all others a list of messages. Null texts and roles become
    empty; equal turn numbers are ordered by role and text.
    """
    c = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    roles = F.transform("t", lambda x: x["role"])
    said = lambda *names: roles == F.array(*[F.lit(n) for n in names])
    text = lambda i: F.col("t")[i]["text"]
    messages = F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))
    record = (
        F.when(said("user", "assistant"), F.to_json(F.struct(text(0).alias("instruction"), text(1).alias("output"))))
        .when(said("system", "user", "assistant"), F.to_json(F.struct(text(0).alias("system"), text(1).alias("instruction"), text(2).alias("output"))))
        .otherwise(F.to_json(messages))
    )
    return g.select("conv_id", record.alias("record"))


def chat_rows(conversations: DataFrame) -> DataFrame:
    """The digest columns of op5, all read back from the formatted texts."""
    spark = conversations.sparkSession
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    records = records_of(conversations.select("conv_id", "turn", "role", "text").unionByName(extra))
    read = canonical_turns(records)
    unread = F.raise_error(F.concat(F.lit("no turns could be read of the record of conv_id "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    formatted = format_turns(read.withColumn("turns", F.when(F.col("turns").isNull(), unread).otherwise(F.col("turns"))), "conv_id")
    lost = F.transform("loss_spans", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))))
    read = formatted.select("conv_id", read_turns(F.col("formatted")).alias("turns"), F.array_join(lost, "").alias("lost"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"),
        F.sha2("lost", 256).alias("loss_sha256"),
        "formatted_chars",
    )
