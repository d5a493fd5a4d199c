"""Chat formatting: link quotations to the messages they quote.

Each line's quote level is the number of its leading ``>`` marks.  Runs of
lines of one level are passages.  A passage, its paragraphs and its lines are
normalised (lower case, single spaces) and hashed; so are those of every
message's own text (level 0).  A quoted passage is joined by conversation and
hash to the message that says it first, and counts if that is an earlier one.
A message answers the message found for its outermost quotes; of several, the
one quoted with the most characters, then the latest.  A message that quotes
nothing known answers the one before it.  Quotes, and the line that announces
one (``... wrote:``), go.

Every row keeps a place in its conversation: turns in order, and a parent
always comes before its replies.  Rows are dealt by ranges of conversation,
turn, role and text, equal rows by their number, and the rows of the ranges
before are summed up per conversation; so a conversation that holds a third of
all rows is spread over many tasks whatever its turns are.  The first sayings
are found by partial aggregates, and no conversation is ever gathered into
one row.

Defined results: a null text has no lines and gives an empty message; an
empty line says nothing and links nothing; null turns come last; rows with
equal turns are ordered by role and text, so equal rows are exchangeable;
rows with a null ``conv_id`` form one conversation; an empty table gives an
empty one; extra columns are ignored.  Built-in DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardwatch.session import cut_lineage

#: The mark of a quote and the words that announce one.
QUOTE = r"^((?:[ \t]*>)+)[ \t]?"
ANNOUNCES = r"(?i)\b(wrote|schrieb|a écrit|escribió)\s?:\s*$"


def _step(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a one-row generator, so that later uses read them instead of computing them anew."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _numbered(messages: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, ranges: int | None) -> DataFrame:
    """conv_id, conv, turn, role, text, block (the range a row is in) and at (its number there), in order."""
    rows = messages.select(
        F.col(f"`{conv_col}`").alias("conv_id"),
        F.coalesce(F.concat(F.lit("v"), F.col(f"`{conv_col}`").cast("string")), F.lit("null")).alias("conv"),
        F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.col(f"`{role_col}`").cast("string").alias("role"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = [F.col("conv"), F.col("turn").asc_nulls_last(), F.col("role"), F.xxhash64("text"), F.col("text"), F.col("row")]
    keys = [*order[:4], F.col("row")]  # equal rows are dealt apart, and texts don't enter the bounds of the ranges
    dealt = rows.repartitionByRange(*([ranges] if ranges else []), *keys).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    return cut_lineage(dealt.select("conv_id", "conv", "turn", "role", "text", F.shiftright(number, 33).alias("block"), number.alias("at")))


def placed(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """conv_id, conv (a key that is never null), turn, role, text, position (from 0 in the conversation)."""
    rows = _numbered(messages, conv_col, turn_col, role_col, text_col, ranges)
    sizes = rows.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("conv", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(sizes, ["conv", "block"]).select("conv_id", "conv", "turn", "role", "text", (F.col("before") + F.col("at") - F.col("first")).alias("position"))


def _keys(passages: Column) -> Column:
    """Distinct (hash, length) of normalised passages, their paragraphs and their lines."""
    parts = F.flatten(F.transform(passages, lambda p: F.concat(F.array(p), F.split(p, r"\n[ \t]*\n"), F.split(p, r"\n"))))
    even = F.transform(parts, lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " ")))
    said = F.array_distinct(F.filter(even, lambda x: x != ""))
    return F.transform(said, lambda x: F.struct(F.md5(x.cast("binary")).alias("hash"), F.length(x).cast("long").alias("chars")))


def parsed(rows: DataFrame) -> DataFrame:
    """``rows`` with own (text without quotes), depth (deepest quote level) and quotes (array of level, hash, chars) and keys of the own text."""
    lines = F.split(F.coalesce("text", F.lit("")), r"\r?\n")
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, QUOTE, 1), "[^>]", ""))
    cut = _step(rows, lines_=F.transform(lines, lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, QUOTE, "").alias("body"))))
    at = F.col("lines_")
    n = F.size(at)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(at, i)["level"] != F.get(at, i - 1)["level"]))
    cut = _step(cut, starts_=starts)
    begin = F.col("starts_")

    def passage(i: Column, k: Column) -> Column:
        inside = F.slice(at, i + 1, F.coalesce(F.get(begin, k + 1), n) - i)
        last = F.element_at(inside, -1)["body"]
        quoted_next = F.get(begin, k + 1).isNotNull()
        announces = (F.get(at, i)["level"] == 0) & quoted_next & last.rlike(ANNOUNCES)
        bodies = F.transform(F.when(announces, F.slice(inside, 1, F.size(inside) - 1)).otherwise(inside), lambda x: x["body"])
        return F.struct(F.get(at, i)["level"].alias("level"), F.array_join(bodies, "\n").alias("body"))

    cut = _step(cut, passages_=F.transform(begin, passage))
    own = F.transform(F.filter("passages_", lambda p: p["level"] == 0), lambda p: p["body"])
    quoted = F.filter("passages_", lambda p: p["level"] > 0)
    hits = F.flatten(
        F.transform(quoted, lambda p: F.transform(_keys(F.array(p["body"])), lambda k: F.struct(p["level"].alias("level"), k["hash"].alias("hash"), k["chars"].alias("chars"))))
    )
    whole = F.trim(F.array_join(F.filter(own, lambda p: F.trim(p, F.lit(" \t\n")) != ""), "\n"), F.lit(" \t\n"))
    return cut.select(
        *rows.columns,
        whole.alias("own"),
        F.coalesce(F.array_max(F.transform("passages_", lambda p: p["level"])), F.lit(0)).alias("depth"),
        F.array_distinct(hits).alias("quotes"),
        _keys(F.array_append(own, F.array_join(own, "\n"))).alias("keys"),
    )


def links(rows: DataFrame) -> DataFrame:
    """(conv, position, parent): the message that a quoting message answers."""
    quotes = rows.where(F.size("quotes") > 0).select("conv", "position", F.inline("quotes"))
    first = rows.select("conv", "position", F.explode("keys.hash").alias("hash")).groupBy("conv", "hash").agg(F.min("position").alias("origin"))
    # One row per hash on the right: a passage quoted however often makes no pairs.
    found = quotes.join(first, ["conv", "hash"]).where("origin < position")
    votes = found.groupBy("conv", "position", "origin", "level").agg(F.sum("chars").alias("chars"))
    return votes.groupBy("conv", "position").agg(F.max_by("origin", F.struct(-F.col("level"), "chars", "origin")).alias("parent"))


def format_chats(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """One row per message: conv_id, position, turn, role, text (without quotes), parent, linked, depth."""
    rows = cut_lineage(parsed(placed(messages, conv_col, turn_col, role_col, text_col, ranges)))
    parent = F.coalesce("parent", F.when(F.col("position") > 0, F.col("position") - 1))
    return (
        rows.drop("quotes", "keys", "text")
        .join(links(rows), ["conv", "position"], "left")
        .select("conv_id", "position", "turn", "role", F.col("own").alias("text"), parent.alias("parent"), F.col("parent").isNotNull().alias("linked"), "depth")
    )


def rendered(chats: DataFrame, template: str = "<|%s|>\n%s\n") -> DataFrame:
    """``chats`` with each message written as a chat turn; a null role is a user's."""
    return chats.withColumn("rendered", F.format_string(template, F.coalesce("role", F.lit("user")), F.col("text")))
