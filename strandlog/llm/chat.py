"""Multi-party perspective rotation of conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns of a conversation that make one part; a part is what one group holds.
PART_TURNS = 512
HEAD, USER, MIDDLE, END = "<|im_start|>assistant\n", "<|im_start|>user name=", "\n", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    """text with a backslash more in each `<|`, `<\\|`, ... of it, so that it holds no mark; taking one away restores it."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def rotate(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """The whole dialogue once for every participant: that speaker as assistant, the others as named users.

    turns has conv_id, turn, role (the speaker) and text. The result has a row for each
    (conv_id, perspective, part): n_turns, text (the turns in order, each as
    `<|im_start|>assistant\\n...<|im_end|>\\n` or `<|im_start|>user name=SPEAKER\\n...<|im_end|>\\n`),
    and mask (the character spans `start-end,...` to learn: what the perspective says, with
    its end mark).

    Turns numbered 0 to part_turns - 1 are part 0, and so on. The texts of a perspective's
    parts, joined in the order of part, are its rendering of the whole dialogue, and so are
    the masks: their spans count from the dialogue's start, whatever part_turns is. A dialogue
    of up to part_turns turns is one row. A group holds the rows of part_turns turn numbers;
    rows that share one turn number, or have none, are not dealt to several.

    Names and texts cannot forge a mark (see `escaped`), and line ends in names become spaces.
    Equal turn numbers are ordered by speaker, then text; rows that repeat are repeated turns. A
    null speaker is `unknown`; a null text is empty; a null turn number is part 0's first; a null
    conv_id is one conversation. Texts may be of any length that a string can have with its
    part's others. A conversation of one speaker has one perspective, without users. No turns
    give no rows. Columns besides these four are ignored. Text is shuffled once, by (conv_id,
    part); perspectives and the lengths of parts are found from their speakers' sums alone.
    """
    speaker = F.regexp_replace(escaped(F.coalesce(F.col("role").cast("string"), F.lit("unknown"))), "[\\r\\n]", " ")
    part = F.floor(F.coalesce(F.col("turn"), F.lit(0)) / F.lit(part_turns)).cast("long")
    # never null, so that the joins are on plain equal keys
    conv = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n"))
    t = turns.select(conv.alias("c"), "conv_id", part.alias("part"), "turn", speaker.alias("who"), escaped(F.coalesce(F.col("text"), F.lit(""))).alias("text"))
    parts = t.groupBy("c", "part").agg(
        F.first("conv_id", True).alias("conv_id"), F.sort_array(F.collect_list(F.struct("turn", "who", "text"))).alias("said")
    )
    # characters of each speaker's turns in each part, as assistant and as user
    each = t.groupBy("c", "part", "who").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    as_user = F.col("chars") + F.col("n") * (F.length("who") + len(USER + MIDDLE + END))
    each = each.select("c", "part", "who", as_user.alias("as_user"), (F.col("chars") + F.col("n") * len(HEAD + END) - as_user).alias("own"))
    sums = each.groupBy("c", "part").agg(F.sum("as_user").alias("all"))
    roles = each.select("c", F.col("who").alias("perspective")).distinct()
    own = each.select(F.col("c").alias("c3"), F.col("part").alias("p3"), "who", "own")
    seats = sums.join(roles, "c").join(own, (F.col("c") == F.col("c3")) & (F.col("part") == F.col("p3")) & (F.col("perspective") == F.col("who")), "left")
    ahead = Window.partitionBy("c", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("all") + F.coalesce("own", F.lit(0))).over(ahead), F.lit(0))
    seats = seats.select(F.col("c").alias("c2"), F.col("part").alias("p2"), "perspective", start.alias("start"))
    out = parts.join(seats, (F.col("c") == F.col("c2")) & (F.col("part") == F.col("p2")))
    mine = F.expr(
        "transform(said, x -> if(x.who = perspective, concat('<|im_start|>assistant\\n', x.text, '<|im_end|>\\n'),"
        " concat('<|im_start|>user name=', x.who, '\\n', x.text, '<|im_end|>\\n')))"
    )
    out = out.withColumn("lines", mine)
    # running ends of the turns; a learnt span is the content and its end mark, without the line end
    ends = F.expr("aggregate(lines, array(start), (a, x) -> array_append(a, element_at(a, -1) + length(x)))")
    out = out.withColumn("ends", ends)
    mask = F.expr(
        "array_join(filter(transform(said, (x, i) -> if(x.who = perspective,"
        f" concat(cast(ends[i] + {len(HEAD)} as string), '-', cast(ends[i + 1] - 1 as string)), null)), y -> y is not null), ',')"
    )
    return out.select("conv_id", "perspective", "part", F.size("said").cast("long").alias("n_turns"), F.array_join("lines", "").alias("text"), mask.alias("mask"))
