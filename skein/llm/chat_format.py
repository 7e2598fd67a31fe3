"""Chat formatting by quotation linking, in DataFrame functions only.

A line's quote level is the number of `>` before its text. Neighbouring lines of one level are a passage; passages and their lines
are normalised (lower case, single spaces) and hashed (128 bits and the length). A quoted hash belongs to the last earlier turn of the
conversation that says the same in its own words, as a passage or a line. The lines of a quoted passage count only where the passage as a
whole is not found, so that each quoted character counts once. A message replies to the turn that most of its quoted characters belong
to (ties: the later turn); without such a turn it replies to the last turn before it, if there is one; turns may have gaps. The first turn of a chain of
replies is its root. Messages come without quotes and without the line that introduces one ("... wrote:"), in the
order of conversation, root and turn, so that each reply follows what it answers.

Quotes and own words of a conversation meet in running windows, which hold one value, not in a many-to-many join: one per
(conversation, hash) and thousand turns, and one over the thousands, so that a very common line of a very long conversation is
dealt. Own words that nobody quotes are left out before. Roots are found by doubling: each round replaces a message's ancestor by the ancestor's ancestor.
A long conversation is never gathered: all keys hold the turn or a hash, and the final order is a range sort.

Edge cases. Null text is empty. Rows with one conversation and turn are one message in parts: they share links. A null
conversation or turn has no links and is its own root. Rows equal in conversation, root and turn come in the order of role and text. An
empty table gives an empty result. Extra columns are ignored. A very long text is one row of arrays, some three times its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut, drop

PREFIX = r"^[ \t]*(?:>[ \t]*)+"


def parsed(text: Column) -> Column:
    """Lines as structs of level and body."""
    lines = F.split(F.coalesce(text, F.lit("")), "\r?\n")

    def line(x: Column) -> Column:
        prefix = F.regexp_extract(x, PREFIX, 0)
        return F.struct((F.length(prefix) - F.length(F.replace(prefix, F.lit(">"), F.lit("")))).alias("level"), F.substr(x, F.length(prefix) + 1).alias("body"))

    return F.transform(lines, line)


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def with_passages(messages: DataFrame) -> DataFrame:
    """Adds passages: level, lines (bodies) and text of each run of lines of one level."""
    starts = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: (i == 1) | (F.element_at("lines", i)["level"] != F.element_at("lines", F.greatest(i - 1, F.lit(1)))["level"]))
    with_starts = messages.withColumn("skein_starts", starts)

    def passage(s: Column, k: Column) -> Column:
        after = F.coalesce(F.get("skein_starts", k + 1), F.size("lines") + 1)
        body = F.transform(F.slice("lines", s, after - s), lambda x: x["body"])
        return F.struct(F.element_at("lines", s)["level"].alias("level"), body.alias("bodies"), F.array_join(body, "\n").alias("text"))

    return with_starts.withColumn("passages", F.transform("skein_starts", passage)).drop("skein_starts")


def conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: str = "<|%s|>\n%s<|end|>\n", most_rounds: int = 64) -> DataFrame:
    """One row per message: conversation, turn, role, reply_to, root, n_quoted (lines), n_linked (quoted characters that
    were found), text (own words) and formatted; see the module's text for order and rules."""
    def read(rows: DataFrame) -> DataFrame:
        return with_passages(rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), parsed(F.col(text_col)).alias("lines"), F.xxhash64(role_col, text_col).alias("part")))

    base = read(messages)

    # every passage (i = 0) and, of passages of several lines, every line; level 0 is what a message says itself
    def units_of(p: Column, k: Column) -> Column:
        texts = F.concat(F.array(p["text"]), F.when(F.size(p["bodies"]) > 1, p["bodies"]).otherwise(F.array().cast("array<string>")))
        return F.transform(texts, lambda t, i: F.struct((p["level"] > 0).alias("quoted"), k.alias("p"), i.alias("i"), normalised(t).alias("norm")))

    def units(rows: DataFrame) -> DataFrame:
        each = rows.where("conv IS NOT NULL AND turn IS NOT NULL").select("conv", "turn", "part", F.explode(F.filter(F.flatten(F.transform("passages", units_of)), lambda u: u["norm"] != "")).alias("u"))
        return each.select("conv", "turn", "part", "u.quoted", "u.p", "u.i", F.xxhash64("u.norm").alias("h"), F.xxhash64(F.lit(1), "u.norm").alias("g"), F.length("u.norm").alias("size"), F.floor(F.col("turn") / 1000).alias("stretch"))

    same = ["conv", "h", "g", "size"]
    asked = units(read(messages.where(F.contains(F.col(text_col), F.lit(">"))))).where("quoted").select(*same).distinct()
    live = cut(units(base).join(asked, same, "left_semi"))
    said = F.max(F.when(~F.col("quoted"), F.col("turn")))
    inside = said.over(W.partitionBy(*same, "stretch").orderBy("turn").rangeBetween(W.unboundedPreceding, -1))
    before = F.max("last").over(W.partitionBy(*same).orderBy("stretch").rowsBetween(W.unboundedPreceding, -1))
    stretches = live.groupBy(*same, "stretch").agg(said.alias("last")).withColumn("earlier", before).drop("last")
    quotes = live.withColumn("inside", inside).where("quoted").join(stretches, [*same, "stretch"]).withColumn("said", F.coalesce("inside", "earlier")).where("said IS NOT NULL")
    quotes = quotes.withColumn("whole", F.min("i").over(W.partitionBy("conv", "turn", "part", "p")) == 0).where("i = 0 OR NOT whole")
    votes = quotes.groupBy("conv", "turn", "said").agg(F.sum("size").alias("size"))
    linked = votes.groupBy("conv", "turn").agg(F.max_by("said", F.struct("size", "said")).alias("said"), F.sum("size").alias("n_linked"))

    turns = base.where("conv IS NOT NULL AND turn IS NOT NULL").select("conv", "turn").distinct()
    # the last turn before each, in its stretch or else in an earlier one
    turns = turns.withColumn("stretch", F.floor(F.col("turn") / 1000))
    ends = turns.groupBy("conv", "stretch").agg(F.max("turn").alias("end")).select("conv", "stretch", F.max("end").over(W.partitionBy("conv").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)).alias("end"))
    turns = turns.withColumn("near", F.lag("turn").over(W.partitionBy("conv", "stretch").orderBy("turn"))).join(ends, ["conv", "stretch"])
    turns = turns.select("conv", "turn", F.coalesce("near", "end").alias("before"))
    replies = turns.join(linked, ["conv", "turn"], "left")
    replies = cut(replies.select("conv", "turn", F.coalesce("said", "before").alias("reply_to"), F.coalesce("n_linked", F.lit(0)).alias("n_linked")))

    # only messages whose ancestor is not yet a root are joined again
    root = F.col("reply_to").isNull()
    now = cut(replies.select("conv", "turn", F.coalesce("reply_to", "turn").alias("root"), root.alias("done")))
    for _ in range(most_rounds):
        if now.where("NOT done").isEmpty():
            break
        up = now.select("conv", F.col("turn").alias("root"), F.col("root").alias("above"), F.col("done").alias("above_done"))
        moved = now.where("NOT done").join(up, ["conv", "root"]).select("conv", "turn", F.col("above").alias("root"), F.col("above_done").alias("done"))
        after = cut(now.where("done").unionByName(moved))
        drop(now)
        now = after
    else:
        raise RuntimeError("reply chains are longer than the rounds allow")
    now = now.drop("done")

    # the line before a quote that only introduces it goes with the quote
    size = F.size("lines")
    own = F.filter("lines", lambda x, i: (x["level"] == 0) & ~(x["body"].rlike(r"(?i)\bwrote:\s*$") & (F.coalesce(F.get("lines", i + 1)["level"], F.lit(0)) > 0)))
    text = F.regexp_replace(F.array_join(F.transform(own, lambda x: x["body"]), "\n"), r"^\s+|\s+$", "")
    quoted = size - F.size(F.filter("lines", lambda x: x["level"] == 0))
    done = base.select("conv", "turn", "role", text.alias("text"), quoted.cast("long").alias("n_quoted"))
    done = done.join(replies, ["conv", "turn"], "left").join(now, ["conv", "turn"], "left")
    done = done.withColumn("root", F.coalesce("root", "turn")).withColumn("formatted", F.format_string(template, F.coalesce("role", F.lit("")), "text"))
    ordered = done.orderBy("conv", "root", "turn", "role", "text")
    return ordered.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), "reply_to", "root", "n_quoted", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.col("text").alias(text_col), "formatted")
