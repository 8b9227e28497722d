"""Preference formatting: chosen and rejected conversations as one prompt and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Turn numbers of a conversation that are formatted together.
TURNS = 1024


def _header(m: Column) -> Column:
    """A turn's role; line feeds and markers inside it are broken up, so that it can't end its line or the turn."""
    role = F.replace(F.replace(F.coalesce(m.role, F.lit("user")), F.lit("<|"), F.lit("< |")), F.lit("\n"), F.lit(" "))
    return F.concat(F.lit(OPEN), role, F.lit("\n"))


def _body(m: Column) -> Column:
    """A turn's text; markers inside it are broken up, so that they can't end the turn."""
    return F.replace(F.coalesce(m.text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda m: F.concat(_header(m), _body(m), F.lit(CLOSE))), "")


def _spans(turns: Column, role: str) -> Column:
    """[start, end) in code points of what is learned of a rendered completion: the bodies of `role` and their ends."""
    parts = F.transform(turns, lambda m: F.struct(F.char_length(_header(m)).alias("h"), F.char_length(F.concat(_body(m), F.lit(CLOSE))).alias("b"), (m.role == role).alias("on")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(a: Column, p: Column) -> Column:
        begin, end = a.at + p.h, a.at + p.h + p.b
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.coalesce(p.on, F.lit(False)), F.concat(a.out, span)).otherwise(a.out).alias("out"))

    return F.aggregate(parts, start, step, lambda a: a.out)


def preferences(pairs: DataFrame, learned: str = "assistant") -> DataFrame:
    """For each row of pairs(pair_id, part, chosen, rejected): pair_id, part, n_prompt_turns, prompt, and both completions with their masks.

    chosen and rejected are arrays of struct(role, text). Their longest common prefix of turns is rendered once, as
    the prompt; what follows in each is its completion. A mask holds the [start, end) spans, in code points of the
    completion, that a loss counts: the texts of `learned` and the markers that end them.

    A null array is an empty conversation, a null role "user" (never learned), a null text empty; for the prefix a null
    equals a null only. Equal conversations are all prompt, with empty completions. Repeated rows give repeated rows.
    Markers inside texts and roles, and line feeds inside roles, are broken up. An empty table gives no rows. part is
    null where pairs has none. Other columns are ignored, whatever their names.
    """
    part = F.col("part").cast("long") if "part" in pairs.columns else F.lit(None).cast("long")
    none = F.array().cast("array<struct<role:string,text:string>>")
    turns = lambda c: F.coalesce(F.transform(c, lambda m: F.struct(m.role.alias("role"), m.text.alias("text"))), none)
    rows = pairs.select("pair_id", part.alias("part"), turns("chosen").alias("chosen"), turns("rejected").alias("rejected"))
    both = F.least(F.size("chosen"), F.size("rejected"))
    same = F.zip_with(F.slice("chosen", 1, both), F.slice("rejected", 1, both), lambda a, b: a.role.eqNullSafe(b.role) & a.text.eqNullSafe(b.text))
    rows = rows.withColumn("_same", same).withColumn("_n", F.coalesce(F.nullif(F.array_position("_same", False), F.lit(0)) - 1, F.size("_same")).cast("int"))
    rest = {c: F.slice(c, F.col("_n") + 1, F.size(c)) for c in ("chosen", "rejected")}
    rows = rows.select("pair_id", "part", "_n", F.slice("chosen", 1, F.col("_n")).alias("_prompt"), *[x.alias(c) for c, x in rest.items()])
    return rows.select(
        "pair_id", "part", F.col("_n").cast("long").alias("n_prompt_turns"), _rendered(F.col("_prompt")).alias("prompt"),
        _rendered(F.col("chosen")).alias("chosen"), _spans(F.col("chosen"), learned).alias("chosen_mask"),
        _rendered(F.col("rejected")).alias("rejected"), _spans(F.col("rejected"), learned).alias("rejected_mask"),
    )


def derived_pairs(conversations: DataFrame) -> DataFrame:
    """(pair_id, part, chosen, rejected) from a table of turns (conv_id, turn, role, text) that holds no judgements.

    chosen is a conversation up to its last assistant turn; in rejected that turn's text is the one of the assistant
    turn before it (an answer to something else), or nothing if there is none. A conversation without an assistant
    turn is both. Turns stand in order of turn (null first), then role and text; repeated rows are repeated turns.

    A conversation is cut by its turn numbers: each TURNS numbers are a part, with rows of its own in the result, so a
    conversation of any length is spread over tasks. Turns without a number are a part of their own (null). A turn without a conv_id is a
    conversation by itself. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    part = F.floor(F.col("turn") / TURNS).cast("long")
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    turns = conversations.select("conv_id", part.alias("part"), alone.alias("_alone"), "turn", "role", "text")
    turns = turns.groupBy("conv_id", "part", "_alone").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    said = F.filter(F.transform("t", lambda m, i: F.struct(m.role.alias("role"), m.text.alias("text"), i.alias("i"))), lambda m: m.role == "assistant")
    turns = turns.withColumn("a", said).withColumn("last", F.get("a", F.size("a") - 1)).withColumn("other", F.coalesce(F.get("a", F.size("a") - 2).text, F.lit("")))
    kept = F.transform("t", lambda m: F.struct(m.role.alias("role"), m.text.alias("text")))
    upto = F.when(F.size("a") > 0, F.slice(kept, 1, F.col("last.i") + 1)).otherwise(kept)
    before = F.concat(F.slice(kept, 1, F.coalesce("last.i", F.lit(0))), F.array(F.struct(F.lit("assistant").alias("role"), F.col("other").alias("text"))))
    return turns.select(F.col("conv_id").alias("pair_id"), "part", upto.alias("chosen"), F.when(F.size("a") > 0, before).otherwise(kept).alias("rejected"))


def mask_text(mask: Column) -> Column:
    return F.array_join(F.transform(mask, lambda s: F.concat_ws(":", s.start.cast("string"), s.end.cast("string"))), ",")


_ROLE = "replace(replace(coalesce({}, 'user'), '<|', '< |'), chr(10), ' ')"
_BODY = "replace(coalesce({}, ''), '<|', '< |')"
_R = f"array_to_string(list_transform({{}}, lambda m: '<|im_start|>' || {_ROLE.format('m.role')} || chr(10) || {_BODY.format('m.text')} || '<|im_end|>' || chr(10)), '')"


def _mask_sql(x: str) -> str:
    ends = f"list_transform({x}, lambda m: length({_ROLE.format('m.role')}) + length({_BODY.format('m.text')}) + 24)"
    to = f"list_sum({ends}[1:i])"
    return f"array_to_string(list_transform(list_filter(range(1, len({x}) + 1), lambda i: {x}[i].role = 'assistant'), lambda i: ({to} - length({_BODY.format(f'{x}[i].text')}) - 11)::INT || ':' || {to}::INT), ',')"


QUERY_SQL = f"""
WITH c AS (SELECT *, CAST(floor(turn / {TURNS}.0) AS BIGINT) AS part, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations),
t AS (SELECT conv_id, part, alone, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS t
      FROM c GROUP BY conv_id, part, alone),
a AS (SELECT *, list_filter(range(1, len(t) + 1), lambda i: t[i].role = 'assistant') AS a FROM t),
b AS (SELECT conv_id, part, CASE WHEN len(a) > 0 THEN t[1:a[-1]] ELSE t END AS c,
             CASE WHEN len(a) > 0 THEN list_append(t[1:a[-1] - 1], {{'role': 'assistant', 'text': CASE WHEN len(a) > 1 THEN coalesce(t[a[-2]].text, '') ELSE '' END}}) ELSE t END AS r FROM a),
n AS (SELECT *, coalesce(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[i] IS DISTINCT FROM r[i])[1] - 1, least(len(c), len(r))) AS n FROM b),
s AS (SELECT conv_id, part, n, c[1:n] AS p, c[n + 1:len(c)] AS c, r[n + 1:len(r)] AS r FROM n)
SELECT conv_id AS pair_id, part, CAST(n AS BIGINT) AS n_prompt_turns, {_R.format('p')} AS prompt, {_R.format('c')} AS chosen, {_mask_sql('c')} AS chosen_mask,
       {_R.format('r')} AS rejected, {_mask_sql('r')} AS rejected_mask
FROM s
"""
