"""Preference formatting: the longest common turn prefix of a chosen and a rejected conversation, and masked completions.

A pair's turns are put in order of their number. The turns before the first at which the conversations differ (in number, role
or text, or that only one side has) are the prompt, which is rendered once; what follows on either side are the completions.
The result is a row for each pair: the prompt, both completions, and the spans of each completion that are trained, those of
assistant turns.

Conversations are paired with the first of those with the same opening (a star, not all pairs), and each even one with the odd
one after it. The texts are shuffled once, by the pair of neighbours; what a conversation with a common opening is compared
with travels to it from there, in as many copies of the common one as keep its partners in groups of a bounded size.

A conversation with turns beyond 0 to 4,095 isn't put together whole: its pairs are matched turn by turn, and they give a row
for each block of 4,096 turn numbers (`piece`; 0 for all others), whose texts follow each other.

A null text is empty, a null role is `unknown`. Of rows that repeat a conversation's turn, the least (role, text) counts. Rows
without conversation or turn are ignored; ids and turns are whole numbers. Equal conversations give a prompt and empty
completions. Further columns, whatever their names, are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphshift.llm._shared import hot_limit, join_back, write_cut

START, END = "<|turn|>", "<|end|>"
#: Turns of a piece are 2 ** PIECE_BITS numbers.
PIECE_BITS = 12


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn and said (role, text) of every row that has both numbers."""
    own = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.struct(F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("said"),
    )
    return own.where("conv_id is not null and turn is not null")


def pairs_by_opening(turns: DataFrame) -> DataFrame:
    """chosen, rejected, members: the first conversation of those with the same turn 0, with each of the others, and how many
    these are. A star, not all pairs."""
    first = turns.where("turn = 0").groupBy("conv_id").agg(F.min("said").alias("said"))
    opening = write_cut(first.select("conv_id", F.sha2(F.concat_ws("\n", "said.role", "said.text"), 256).alias("opening")))
    least = opening.groupBy("opening").agg(F.min("conv_id").alias("chosen"), F.count(F.lit(1)).alias("n")).where("n > 1").withColumns({"members": F.col("n"), "use": F.lit(True)})
    return join_back(opening, least, ["opening"], hot_limit(opening.count())).where("conv_id > chosen").select("chosen", F.col("conv_id").alias("rejected"), "members")


def pairs_by_number(turns: DataFrame) -> DataFrame:
    """chosen, rejected: each even conversation with the odd one after it."""
    halves = turns.groupBy(F.shiftright("conv_id", 1).alias("half")).agg(F.min("conv_id").alias("chosen"), F.max("conv_id").alias("rejected"))
    return halves.where("chosen < rejected").select("chosen", "rejected")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END))


def joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: rendered(t["said"]["role"], t["said"]["text"])), "")


def trained(turns: Column) -> Column:
    """The spans (start, end) of the assistant's turns in the joined text."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        end = acc["at"] + F.length(rendered(t["said"]["role"], t["said"]["text"]))
        span = F.array(F.struct(acc["at"].alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["said"]["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def formatted(parted: DataFrame) -> DataFrame:
    """chosen, rejected, piece with the turns of the prompt and of both completions (common, c, r) as texts and trained spans."""
    return parted.select(
        "chosen", "rejected", "piece", joined(F.col("common")).alias("prompt"), joined(F.col("c")).alias("chosen_text"), trained(F.col("c")).alias("chosen_trained"),
        joined(F.col("r")).alias("rejected_text"), trained(F.col("r")).alias("rejected_trained"),
    )


def conversations_by(turns: DataFrame, key: str) -> DataFrame:
    """key and turns, in order: the conversations of each key, from one shuffle of their rows."""
    once = turns.repartition(key).groupBy(key, "conv_id", "turn").agg(F.min("said").alias("said"))
    return once.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("conv_id", "turn", "said"))).alias("turns"))


def whole_pairs(turns: DataFrame, star: DataFrame) -> DataFrame:
    """The pairs of neighbours and those of `star` (chosen, rejected, members), of conversations that are put together whole."""
    limit = hot_limit(star.count())
    said = lambda x: F.struct(x["turn"].alias("turn"), x["said"].alias("said"))
    copies = F.ceil(F.col("members") / limit).cast("int")
    centres = write_cut(star.groupBy("chosen").agg(F.max("members").alias("members")))
    centre = conversations_by(turns.join(centres.select(F.col("chosen").alias("conv_id")), "conv_id", "left_semi").withColumn("chosen", F.col("conv_id")), "chosen")
    dealt = centre.join(centres, "chosen").select("chosen", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"), F.transform("turns", said).alias("c"))
    sent = star.withColumn("copy", F.pmod(F.xxhash64("rejected"), copies).cast("int")).join(dealt, ["chosen", "copy"])
    stars = sent.groupBy(F.shiftright("rejected", 1).alias("half")).agg(F.collect_list(F.struct("chosen", "rejected", "c")).alias("stars"))
    talks = conversations_by(turns.withColumn("half", F.shiftright("conv_id", 1)), "half").join(stars, "half", "left")
    own = lambda conv: F.transform(F.filter("turns", lambda t: t["conv_id"] == conv), said)
    even, odd = F.shiftleft("half", 1), F.shiftleft("half", 1) + 1
    pair = lambda chosen, rejected, c: F.struct(chosen.alias("chosen"), rejected.alias("rejected"), c.alias("c"), own(rejected).alias("r"))
    both = F.filter(F.array(pair(even, odd, own(even))), lambda p: (F.size(p["c"]) > 0) & (F.size(p["r"]) > 0))
    # A pair that is also one of neighbours counts once.
    others = F.transform(F.filter("stars", lambda s: F.shiftright(s["chosen"], 1) != F.col("half")), lambda s: pair(s["chosen"], s["rejected"], s["c"]))
    every = talks.select(F.explode(F.when(F.col("stars").isNull(), both).otherwise(F.concat(both, others))).alias("p")).select("p.*")
    # The first place at which the turns differ; places that one side lacks are null there.
    apart = every.withColumn("at", F.array_position(F.zip_with("c", "r", lambda x, y: x.eqNullSafe(y)), False).cast("int"))
    rest = lambda side: F.when(F.col("at") > 0, F.slice(side, F.col("at"), F.greatest(F.size(side) - F.col("at") + 1, F.lit(0)))).otherwise(F.slice(side, 1, 0))
    common = F.when(F.col("at") > 0, F.slice("c", F.lit(1), F.col("at") - 1)).otherwise(F.col("c"))
    return apart.select("chosen", "rejected", F.lit(0).cast("long").alias("piece"), common.alias("common"), rest("c").alias("c"), rest("r").alias("r"))


def pairs_by_turn(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """The given pairs (chosen, rejected, members), matched turn by turn and put together by piece. Partners of one conversation
    are dealt to copies of its turns, so none holds more than a bounded number of them."""
    once = turns.groupBy("conv_id", "turn").agg(F.min("said").alias("said"))
    copies = F.ceil(F.col("members") / hot_limit(pairs.count())).cast("int")

    def side(name: str, other: str) -> DataFrame:
        many = pairs.groupBy(name).agg(F.max(copies).alias("copies"))
        dealt = once.withColumnRenamed("conv_id", name).join(many, name).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        sent = pairs.withColumn("copy", F.pmod(F.xxhash64(other), copies).cast("int")) if name == "chosen" else pairs.withColumn("copy", F.lit(0))
        return sent.join(dealt, [name, "copy"]).select("chosen", "rejected", "turn", F.col("said").alias(f"{name}_said"))

    both = side("chosen", "rejected").join(side("rejected", "chosen"), ["chosen", "rejected", "turn"], "full")
    apart = ~F.col("chosen_said").eqNullSafe(F.col("rejected_said"))
    parting = both.groupBy("chosen", "rejected").agg(F.min(F.when(apart, F.col("turn"))).alias("parting"))
    marked = both.join(parting, ["chosen", "rejected"]).withColumn("common", F.coalesce(F.col("turn") < F.col("parting"), F.lit(True)))
    said = lambda wanted, name: F.array_sort(F.collect_list(F.when(wanted & F.col(name).isNotNull(), F.struct("turn", F.col(name).alias("said")))))
    return marked.groupBy("chosen", "rejected", F.shiftright("turn", PIECE_BITS).alias("piece")).agg(
        said(F.col("common"), "chosen_said").alias("common"), said(~F.col("common"), "chosen_said").alias("c"), said(~F.col("common"), "rejected_said").alias("r")
    )


def preferences(conversations: DataFrame) -> DataFrame:
    """chosen, rejected, piece, prompt, and of both sides text and trained spans: all pairs by opening and by number, formatted."""
    turns = turns_of(conversations)
    star = write_cut(pairs_by_opening(turns))
    long = write_cut(turns.where(F.shiftright("turn", PIECE_BITS) != 0).select("conv_id").distinct())
    if long.isEmpty():
        return formatted(whole_pairs(turns, star))
    is_long = lambda name: long.select(F.col("conv_id").alias(name), F.lit(True).alias(f"{name}_long"))
    marked = lambda pairs: pairs.join(is_long("chosen"), "chosen", "left").join(is_long("rejected"), "rejected", "left")
    neighbours = pairs_by_number(turns).withColumn("members", F.lit(1).cast("long"))
    either = F.coalesce("chosen_long", "rejected_long").isNotNull()
    every = marked(star.unionByName(neighbours)).where(either).groupBy("chosen", "rejected").agg(F.max("members").alias("members"))
    short = turns.join(long, "conv_id", "left_anti")
    whole = whole_pairs(short, write_cut(marked(star).where(~either).select("chosen", "rejected", "members")))
    return formatted(whole).unionByName(formatted(pairs_by_turn(turns, write_cut(every))))


def report(conversations: DataFrame) -> DataFrame:
    """The formatted pairs, with their spans as text: start:end, comma-joined."""
    spans = lambda name: F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias(name)
    return preferences(conversations).select("chosen", "rejected", "piece", "prompt", "chosen_text", spans("chosen_trained"), "rejected_text", spans("rejected_trained"))


ORACLE = """
WITH t AS (SELECT conv_id, turn, min(struct_pack(r := coalesce(role, 'unknown'), x := coalesce(text, ''))) AS s FROM conversations
           WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
o AS (SELECT conv_id, min(conv_id) OVER (PARTITION BY s) AS chosen FROM t WHERE turn = 0),
n AS (SELECT min(conv_id) AS chosen, max(conv_id) AS rejected FROM (SELECT DISTINCT conv_id FROM t) GROUP BY conv_id // 2 HAVING count(*) > 1),
p AS (SELECT chosen, conv_id AS rejected FROM o WHERE conv_id > chosen UNION SELECT chosen, rejected FROM n),
a AS (SELECT chosen, rejected, turn, s FROM p JOIN t ON chosen = conv_id),
b AS (SELECT chosen, rejected, turn, s FROM p JOIN t ON rejected = conv_id),
m AS (SELECT chosen, rejected, turn, a.s AS c, b.s AS r FROM a FULL JOIN b USING (chosen, rejected, turn)),
d AS (SELECT *, min(CASE WHEN c IS DISTINCT FROM r THEN turn END) OVER (PARTITION BY chosen, rejected) AS parting FROM m),
e AS (SELECT chosen, rejected, turn // 4096 AS piece, 'prompt' AS part, turn, c AS s FROM d WHERE parting IS NULL OR turn < parting
      UNION ALL SELECT chosen, rejected, turn // 4096, 'chosen', turn, c FROM d WHERE turn >= parting AND c IS NOT NULL
      UNION ALL SELECT chosen, rejected, turn // 4096, 'rejected', turn, r FROM d WHERE turn >= parting AND r IS NOT NULL),
f AS (SELECT chosen, rejected, piece, part, turn, s.r AS role, '<|turn|>' || s.r || chr(10) || s.x || '<|end|>' AS said FROM e),
g AS (SELECT *, sum(length(said)) OVER (PARTITION BY chosen, rejected, piece, part ORDER BY turn) AS ends FROM f)
SELECT chosen, rejected, CAST(piece AS BIGINT) AS piece,
       coalesce(string_agg(said, '' ORDER BY turn) FILTER (part = 'prompt'), '') AS prompt,
       coalesce(string_agg(said, '' ORDER BY turn) FILTER (part = 'chosen'), '') AS chosen_text,
       coalesce(string_agg(CAST(ends - length(said) AS VARCHAR) || ':' || CAST(ends AS VARCHAR), ',' ORDER BY turn) FILTER (part = 'chosen' AND role = 'assistant'), '') AS chosen_trained,
       coalesce(string_agg(said, '' ORDER BY turn) FILTER (part = 'rejected'), '') AS rejected_text,
       coalesce(string_agg(CAST(ends - length(said) AS VARCHAR) || ':' || CAST(ends AS VARCHAR), ',' ORDER BY turn) FILTER (part = 'rejected' AND role = 'assistant'), '') AS rejected_trained
FROM g GROUP BY chosen, rejected, piece
"""
