r"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is the turns of one conv_id in order of ``turn`` and is rendered as one
text.  A turn is an opening mark, a space, its body, a space and a closing mark:

    [INST] … [/INST]    user              <s> … </s>          assistant
    [SYS] … [/SYS]      system            [ROLE] … [/ROLE]    any other role, named on the body's first line

The parser splits a text at its marks, takes them two by two and refuses a text whose
marks do not pair or that has anything between two turns; it then takes one backslash out
of every control string that has some after its first sign.  A conversation is rendered
with its texts as they are, parsed, and compared turn by turn with its source.  Where they
differ, some text holds a mark, or a mark with backslashes in it; that conversation is
rendered anew with one backslash more in each of its control strings (``[INST]`` becomes
``[\INST]``, ``[\INST]`` becomes ``[\\INST]``), which the parser undoes.  The new text is
parsed and compared as well; should it still differ, the job stops instead of returning it.

``loss_runs`` is the mask for training: for every turn the code points to skip, to learn
from and to skip again, in order over ``formatted``; only what assistants say is learnt.

Nulls in role and text are empty texts, a null turn comes before others, rows with a null
conv_id are one conversation, turns with equal numbers follow by role and text, and
repeated rows are turns of their own.  An empty table gives no rows.  A conversation is one
value of the result, so it has to fit into a row; conversations are otherwise independent.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("[SYS]", "[/SYS]")}
OTHER = ("[ROLE]", "[/ROLE]")
_MARK = r"[\[<]/?(?:INST\]|SYS\]|ROLE\]|s>)"
#: Control strings are marks with any number of backslashes after the first sign.  Either first sign goes with every mark; none is rendered that way.
_CONTROL = r"([\[<])(\\*/?(?:INST\]|SYS\]|ROLE\]|s>))"
_HELD = r"([\[<])\\(\\*/?(?:INST\]|SYS\]|ROLE\]|s>))"
TURN = "struct<role:string,text:string>"
PROBE = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _HELD, "$1$2")


def _line(role: Column) -> Column:
    """A role as one line: a backslash is ``\\b``, a line feed ``\\n``."""
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n"))


def _role(line: Column) -> Column:
    return F.replace(F.replace(line, F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def _by_role(role: Column, nth: int) -> Column:
    out = F.lit(OTHER[nth])
    for name, marks in MARKS.items():
        out = F.when(role == name, marks[nth]).otherwise(out)
    return out


def _body(turn: Column) -> Column:
    known = turn["role"].isin(*MARKS)
    return F.when(known, turn["text"]).otherwise(F.concat(_line(turn["role"]), F.lit("\n"), turn["text"]))


def render(turns: Column, escaped: bool) -> Column:
    """The text of an array of turns."""
    def one(turn: Column) -> Column:
        body = escape(_body(turn)) if escaped else _body(turn)
        return F.concat(_by_role(turn["role"], 0), F.lit(" "), body, F.lit(" "), _by_role(turn["role"], 1))
    return F.concat_ws("", F.transform(turns, one))


def _with(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often ``then`` refers to it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def turn_texts(formatted: Column) -> Column:
    """The rendered turns of a text, (open, body, close) each; null where the text does not follow the grammar."""
    def sound(t: Column) -> Column:
        pair = F.lit(False)
        for a, b in [*MARKS.values(), OTHER]:
            pair = pair | ((t["open"] == a) & (t["close"] == b))
        return F.coalesce(pair & (t["before"] == "") & (F.length(t["body"]) >= 2) & t["body"].startswith(" ") & t["body"].endswith(" "), F.lit(False))

    def paired(x: Column) -> Column:
        # Zipped, since what a lambda refers to outside itself is computed again for every element.
        every = lambda array, nth: F.filter(array, lambda _, i: i % 2 == nth)
        turns = F.arrays_zip(every(x["between"], 0).alias("before"), every(x["marks"], 0).alias("open"), every(x["between"], 1).alias("body"), every(x["marks"], 1).alias("close"))
        whole = (F.size(x["marks"]) > 0) & (F.size(x["marks"]) % 2 == 0) & (F.get(x["between"], F.size(x["marks"])) == "")
        return F.when(whole, F.slice(turns, F.lit(1), F.floor(F.size(x["marks"]) / 2).cast("int")))

    def checked(turns: Column) -> Column:
        return F.when(F.forall(turns, sound), F.transform(turns, lambda t: F.struct(t["open"].alias("open"), t["body"].alias("body"), t["close"].alias("close"))))
    tokens = F.struct(F.regexp_extract_all(formatted, F.lit(_MARK), F.lit(0)).alias("marks"), F.split(formatted, _MARK, -1).alias("between"))
    return _with(_with(tokens, paired), checked)


def parse(turns: Column) -> Column:
    """(role, text) of the turns that ``turn_texts`` found; null where the text does not follow the grammar."""
    def named(body: Column) -> Column:
        line = F.substring_index(body, "\n", 1)
        return F.struct(_role(line).alias("role"), F.substring(body, F.length(line) + 2, F.length(body)).alias("text"))

    def one(t: Column) -> Column:
        body = unescape(F.substring(t["body"], F.lit(2), F.length(t["body"]) - 2))
        out = _with(body, named)
        for name, marks in MARKS.items():
            out = F.when(t["open"] == marks[0], F.struct(F.lit(name).alias("role"), body.alias("text"))).otherwise(out)
        return out
    return F.transform(turns, one)


def loss_runs(turns: Column) -> Column:
    """(skip, learn, rest) in code points for every turn that ``turn_texts`` found."""
    def one(t: Column) -> Column:
        ahead, body, after = F.length(t["open"]), F.length(t["body"]), F.length(t["close"])
        run = lambda skip, learn, rest: F.struct(skip.cast("int").alias("skip"), learn.cast("int").alias("learn"), rest.cast("int").alias("rest"))
        return F.when(t["open"] == MARKS["assistant"][0], run(ahead + 1, body - 2, after + 1)).otherwise(run(ahead + body + after, F.lit(0), F.lit(0)))
    return F.transform(turns, one)


def learnt(turns: Column, runs: Column) -> Column:
    """What the mask leaves of each turn, without escapes."""
    def one(z: Column) -> Column:
        whole = F.concat(z["turn"]["open"], z["turn"]["body"], z["turn"]["close"])
        return F.when(z["run"]["learn"] > 0, unescape(F.substring(whole, z["run"]["skip"] + 1, z["run"]["learn"]))).otherwise("")
    return F.transform(F.arrays_zip(turns.alias("turn"), runs.alias("run")), one)


def formatted(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, escaped, loss_runs), one row a conversation."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = (conversations.select("conv_id", F.struct("turn", text("role").alias("role"), text("text").alias("text")).alias("row"))
             .groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
             .select("conv_id", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).cast(f"array<{TURN}>").alias("turns")))
    def tried(frame: DataFrame, escaped: bool) -> DataFrame:
        """A rendering, what the parser finds in it, and whether that is the source."""
        new = {"formatted": render(F.col("turns"), escaped), "found": turn_texts(F.col("formatted")), "same": F.coalesce(parse(F.col("found")) == F.col("turns"), F.lit(False))}
        for name, value in new.items():
            frame = frame.withColumn(name, F.when(F.col("done"), F.col(name)).otherwise(value) if escaped else value)
        return frame
    plain = tried(turns, False).withColumn("done", F.col("same"))
    sound = F.when(F.col("same"), F.col("formatted")).otherwise(F.raise_error(F.lit("a rendered conversation does not parse to its turns")))
    return tried(plain, True).select("conv_id", sound.alias("formatted"), (~F.col("done")).alias("escaped"), loss_runs(F.col("found")).alias("loss_runs"))


def recovered(frame: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) read back from ``formatted``; turns count from 0."""
    return frame.select("conv_id", F.posexplode(parse(turn_texts(F.col("formatted")))).alias("turn", "row")).select("conv_id", "turn", "row.role", "row.text")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and, as conversation -1, one of control strings only."""
    row = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))]))
    probe = conversations.sparkSession.range(1).select(F.lit(-1).cast("long").alias("conv_id"), row.alias("row"))
    return (conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
            .unionByName(probe.select("conv_id", "row.turn", "row.role", F.lit(PROBE).alias("text"))))


def query(conversations: DataFrame) -> DataFrame:
    """Digests of what ``formatted`` and its mask give back; the table's own rows of conversation -1 would join the added one."""
    rows = formatted(with_probe(conversations))
    read = rows.withColumn("found", turn_texts(F.col("formatted")))
    back = read.select("conv_id", "formatted", parse(F.col("found")).alias("turns"), F.concat_ws("", learnt(F.col("found"), F.col("loss_runs"))).alias("loss"))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
                       F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


SQL = r"""
with source as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
turns as (
    select *, case when role in ('user', 'assistant', 'system') then text
                   else replace(replace(role, '\', '\b'), chr(10), '\n') || chr(10) || text end as body,
           case role when 'user' then 15 when 'assistant' then 9 when 'system' then 13 else 15 end as frame
    from source)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(frame + length(body) + len(regexp_extract_all(body, '[\[<]\\*/?(?:INST\]|SYS\]|ROLE\]|s>)')))::bigint as formatted_chars
from turns group by conv_id
"""
