"""Chat formatting by schema fingerprints, in DataFrame expressions alone.

A layout is known by its fingerprint: the hash of its sorted nested field paths (arrays add `[]`, over all their elements).
Only field names that some layout uses count, so scores, ids and the like beside them don't matter; a field that holds an object
or array where a layout has a text does. Each fingerprint selects a declarative mapping to canonical turns (conv_id, turn,
role, text). Canonical turns become one string per conversation:

    <turn user>
    text</turn>

`&` and `<` inside texts and roles are written `&amp;` and `&lt;`, and `>` inside roles `&gt;`, so the marks can't occur in them and reading back is
exact. The loss mask covers the escaped text of the assistant's turns, as spans of the formatted string.
A conversation is one string, so its turns meet in one task; conversations are dealt over all tasks by their id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldquery.llm.common import table, unused

OPEN, CLOSE = "<turn ", "</turn>"
ASSISTANT = "assistant"
# Other layouts' names for the roles.
ROLE_NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


def paths(kind: T.DataType, at: str = "") -> list[str]:
    """The leaf paths of a type, sorted."""
    if isinstance(kind, T.ArrayType):
        return paths(kind.elementType, at + "[]")
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    return [at]


def fingerprint_of(found: list[str]) -> str:
    import hashlib

    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


def _turn(n: int, role: str, text: Column) -> Column:
    return F.struct(F.lit(n).cast("long").alias("turn"), F.lit(role).alias("role"), text.cast("string").alias("text"))


def _listed(col: str, role: str, *texts: str) -> Column:
    return F.transform(F.col(col), lambda x, i: F.struct(i.cast("long").alias("turn"), x[role].cast("string").alias("role"), F.coalesce(*(x[t].cast("string") for t in texts), F.lit(None).cast("string")).alias("text")))


def _some(*turns: Column) -> Column:
    return F.filter(F.array(*turns), lambda x: x["text"].isNotNull())


#: Field paths of a layout besides conv_id, and the array of turns that they make.
LAYOUTS: dict[tuple[str, ...], object] = {
    ("prompt", "response"): lambda: _some(_turn(0, "user", F.col("prompt")), _turn(1, ASSISTANT, F.col("response"))),
    ("prompt", "completion"): lambda: _some(_turn(0, "user", F.col("prompt")), _turn(1, ASSISTANT, F.col("completion"))),
    ("question", "answer"): lambda: _some(_turn(0, "user", F.col("question")), _turn(1, ASSISTANT, F.col("answer"))),
    ("instruction", "output"): lambda: _some(_turn(0, "user", F.col("instruction")), _turn(1, ASSISTANT, F.col("output"))),
    ("input", "instruction", "output"): lambda: _some(_turn(0, "user", F.concat_ws("\n\n", "instruction", F.nullif(F.col("input"), F.lit("")))), _turn(1, ASSISTANT, F.col("output"))),
    ("input", "instruction", "output", "system"): lambda: _some(_turn(-1, "system", F.col("system")), _turn(0, "user", F.concat_ws("\n\n", "instruction", F.nullif(F.col("input"), F.lit("")))), _turn(1, ASSISTANT, F.col("output"))),
    ("messages[].content", "messages[].role"): lambda: _listed("messages", "role", "content"),
    ("conversations[].from", "conversations[].value"): lambda: _listed("conversations", "from", "value"),
    ("messages[].text", "messages[].role"): lambda: _listed("messages", "role", "text"),
    ("messages[].content", "messages[].role", "messages[].text"): lambda: _listed("messages", "role", "content", "text"),
}
ROWS = ("role", "text", "turn")  # one row a turn
FINGERPRINTS = {fingerprint_of(list(k)): k for k in [*LAYOUTS, ROWS]}
#: Every field path that some layout uses; others are passed over.
PATHS = sorted({p for k in [*LAYOUTS, ROWS] for p in k})


def fingerprint(df: DataFrame, id_col: str = "conv_id") -> str:
    """Of the columns that layouts use. One of them with other fields inside than layouts have keeps these, and is unknown."""
    tops = {p.split("[")[0] for p in PATHS}
    inside = {p.split("[].")[1] for p in PATHS if "[]." in p}
    mine = T.StructType([f for f in df.schema.fields if f.name != id_col and f.name in tops])
    return fingerprint_of([p for p in paths(mine) if p in PATHS or "[]." not in p or p.split("[].")[1].split(".")[0].split("[")[0] in inside])


def canonical(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) of a frame in any known layout; ValueError with its field paths for any other.

    Columns and fields that no layout uses are passed over. In prompt and instruction layouts a null side gives no turn. Roles
    are mapped to user, assistant and system where a layout has other names for them. An array that is null or empty gives
    no rows; equal rows all stay.
    """
    layout = FINGERPRINTS.get(fingerprint(df, id_col))
    if layout is None:
        raise ValueError(f"no layout has the fields {paths(df.schema)}")
    key = F.col(id_col).alias("conv_id")
    if layout == ROWS:
        return df.select(key, F.col("turn").cast("long").alias("turn"), "role", "text")
    out = df.select(key, F.explode(LAYOUTS[layout]()).alias("t")).select("conv_id", "t.turn", "t.role", "t.text")
    names = F.create_map(*(F.lit(x) for kv in ROLE_NAMES.items() for x in kv))
    return out.withColumn("role", F.coalesce(names[F.lower("role")], "role"))


def canonical_json(df: DataFrame, json_col: str = "json", id_col: str = "conv_id") -> DataFrame:
    """As canonical() for rows whose layouts differ: each JSON text is fingerprinted by its own field paths.

    Texts that are null, aren't JSON objects or are of no known layout give no rows; unknown() tells them.
    """
    found, print_col = _of_json(df, json_col)
    turns = None
    for print_, layout in FINGERPRINTS.items():
        if layout == ROWS:
            continue
        tops = sorted({p.split("[]")[0] for p in layout})
        kinds = {t: "string" if t in layout else "array<struct<" + ",".join(f"`{p.split('[].')[1]}`:string" for p in layout if p.startswith(f"{t}[]")) + ">>" for t in tops}
        part = found.where(F.col(print_col) == print_).select(F.col(id_col), F.from_json(json_col, ",".join(f"`{k}` {v}" for k, v in kinds.items())).alias("_j"))
        part = canonical(part.select(id_col, *(F.col(f"_j.{t}").alias(t) for t in tops)), id_col)
        turns = part if turns is None else turns.unionByName(part)
    return turns


def unknown(df: DataFrame, json_col: str = "json") -> DataFrame:
    """The rows of df whose JSON is null, no object or of no known layout; its count() says how many canonical_json() left out."""
    found, print_col = _of_json(df, json_col)
    layouts = [p for p, k in FINGERPRINTS.items() if k != ROWS]
    return found.where(F.col(print_col).isNull() | ~F.col(print_col).isin(*layouts)).drop(print_col)


def _paths(top: str, kind: Column) -> Column:
    """The paths of a field that holds a text, by its variant's type; none where it is missing."""
    return F.when(kind.rlike("^(ARRAY|OBJECT)"), F.array(F.lit(f"{top}.{{}}"))).when(kind.isNotNull(), F.array(F.lit(top))).otherwise(F.array().cast("array<string>"))


def _list_paths(json_col: str, top: str, inner: list[str], kind: Column) -> Column:
    """The paths of a field that holds turns, over all of them; a turn without its role or any text adds a path that no layout has."""
    turns = F.from_json(F.get_json_object(json_col, f"$.{top}"), "array<map<string,string>>")
    held = F.array_distinct(F.flatten(F.transform(turns, F.map_keys)))
    there = F.transform(F.array_intersect(F.array(*map(F.lit, inner)), held), lambda x: F.concat(F.lit(f"{top}[]."), x))
    roles, texts = ([i for i in inner if (i in ("role", "from")) == r] for r in (True, False))
    whole = F.forall(turns, lambda x: F.arrays_overlap(F.map_keys(x), F.array(*map(F.lit, roles))) & F.arrays_overlap(F.map_keys(x), F.array(*map(F.lit, texts))))
    odd = kind.rlike("\\b(" + "|".join(inner) + "): (ARRAY|OBJECT)") | ~F.coalesce(whole, F.lit(False))
    listed = F.concat(there, F.when(odd, F.array(F.lit(f"{top}[].{{}}"))).otherwise(F.array().cast("array<string>")))
    return F.when(kind.startswith("ARRAY<OBJECT"), listed).otherwise(_paths(top, kind))


def _of_json(df: DataFrame, json_col: str) -> tuple[DataFrame, str]:
    """df with the fingerprint of each JSON text, and that column's name. Every element of an array is looked at."""
    whole, out = unused("_v", df.columns), unused("_print", df.columns)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(whole, path, "variant"))
    parts = []
    for top in sorted({p.split("[")[0] for p in PATHS if p not in ROWS}):
        inner = [p.split("[].")[1] for p in PATHS if p.startswith(f"{top}[].")]
        parts.append(_list_paths(json_col, top, inner, kind(f"$.{top}")) if inner else _paths(top, kind(f"$.{top}")))
    every = F.array_sort(F.flatten(F.array(*parts)))
    print_ = F.when(F.schema_of_variant(whole).startswith("OBJECT"), F.substring(F.sha2(F.array_join(every, "\n"), 256), 1, 16))
    return df.withColumn(whole, F.try_parse_json(json_col)).withColumn(out, print_).drop(whole), out


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit(">"), F.lit("&gt;"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("&gt;"), F.lit(">")))


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): loss is the array of (start, length) spans, in characters from 0.

    Turns stand by turn, then role, then text; equal rows all stay; null roles and texts count as empty; a null turn comes
    first; rows with a null conv_id make one conversation. An empty table gives no rows. Other columns are ignored.
    """
    t = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    piece = t.select("conv_id", F.struct("turn", "role", "text").alias("o"))
    grouped = piece.groupBy("conv_id").agg(F.sort_array(F.collect_list("o")).alias("o"))
    marked = F.transform("o", lambda x: F.struct(F.concat(F.lit(OPEN), escape_role(x["role"]), F.lit(">\n")).alias("head"), escape(x["text"]).alias("body"), (x["role"] == ASSISTANT).alias("loss")))
    out = grouped.select("conv_id", marked.alias("p"))
    tail = len(CLOSE) + 1
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["head"])
        span = F.when(x["loss"], F.array(F.struct(start.alias("start"), F.length(x["body"]).alias("length")))).otherwise(F.array().cast("array<struct<start:int,length:int>>"))
        return F.struct((start + F.length(x["body"]) + tail).alias("at"), F.concat(acc["spans"], span).alias("spans"))

    text = F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(f"{CLOSE}\n"))), "")
    return out.select("conv_id", text.alias("formatted"), F.aggregate("p", zero, add)["spans"].alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with `turns` (role, text), read from the string alone, and `loss_text`, all text under the mask."""
    read = F.expr(f"transform(filter(split(formatted, '{CLOSE}\\n', -1), x -> x <> ''), x -> named_struct('role', substring(x, {len(OPEN) + 1}, locate('>\\n', x) - {len(OPEN) + 1}), 'text', substring(x, locate('>\\n', x) + 2)))")
    clean = F.transform(read, lambda x: F.struct(unescape_role(x["role"]).alias("role"), unescape(x["text"]).alias("text")))
    loss = F.expr("array_join(transform(loss, s -> substring(formatted, s.start + 1, s.length)), '')")
    return formatted.withColumn("turns", clean).withColumn("loss_text", unescape(loss))


def op10_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back from the formatted strings."""
    said = "\\### Assistant: </turn> ok"
    seven = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.array(*(F.struct(F.lit(r).alias("role"), F.lit(said).alias("content")) for r in ("user", ASSISTANT))).alias("messages"))
    rows = canonical(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")).unionByName(canonical(seven))
    out = read_back(format_turns(rows))
    turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql() -> str:
    said = "\\### Assistant: </turn> ok"
    esc = lambda c: f"replace(replace({c}, '&', '&amp;'), '<', '&lt;')"
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{said}' UNION ALL SELECT -7, 1, '{ASSISTANT}', '{said}'),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = '{ASSISTANT}'), '') AS loss,
    sum(length('{OPEN}' || replace({esc("role")}, '>', '&gt;') || '>' || chr(10) || {esc("text")} || '{CLOSE}' || chr(10))) AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g"""


SQL = _sql()
