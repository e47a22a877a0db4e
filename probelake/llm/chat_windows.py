r"""Conversations as budgeted training windows, in DataFrame functions only.

A turn is written ``<s>[INST] role [/INST]\ntext</s>\n``.  Where a role or text holds
one of the control strings ``<s>``, ``</s>``, ``[INST]`` and ``[/INST]``, with any number of
backslashes after its bracket, it gets one more there; reading takes one away, so
the way back is exact and no control string inside a text is ever one.

Prefix sums of the turns' tokens choose the spans.  A window holds the system turn
(the first turn, if its role is system; where turn numbers leave out a whole block
of a conversation without one, also the first turn after that), then history, then new turns.  History are
the whole turns that end where the new ones begin and come to ``history`` tokens at
most: their begin is the least prefix sum in a range.  New turns are taken as long
as the whole stays within the budget; a turn that does not fit behind its history goes
without it, and one that does not fit at all stands alone with the system turn.
Every turn is new in one window only; the loss mask holds the texts of new assistant
turns, so what is repeated, as history or as system turn, is never a target again.

A long conversation is dealt in blocks of ``block_turns`` turn numbers, each with
its last turns as history to the next and the system turn to all; windows end at blocks' ends.  So
one conversation, however long, is spread over many tasks, and no row holds more than a block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The control strings of the template.
OPEN, ROLE_END, TEXT_END = "<s>[INST] ", " [/INST]\n", "</s>\n"
_CONTROL = r"(\\*/?(?:s>|INST\]))"
#: Tokens that the template adds to a turn, at least.
OVERHEAD = 6


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])" + _CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\" + _CONTROL, "$1$2")


def estimated_tokens(text: Column) -> Column:
    """Four letters, three digits, a mark or a line end count as a token."""
    return F.regexp_count(text, F.lit(r"\p{L}{1,4}|\p{N}{1,3}|[^\s\p{L}\p{N}]|\n"))


def _turns(conversations: DataFrame, tokens: Callable[[Column], Column], block_turns: int) -> DataFrame:
    """Turns with a key that is never null, their block and their tokens."""
    text = F.coalesce("text", F.lit(""))
    return conversations.select(
        F.coalesce(F.concat(F.lit("#"), F.col("conv_id").cast("string")), F.lit("")).alias("key"),
        F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-(2**40))).cast("long").alias("block"),
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        text.alias("text"),
        (tokens(text) + OVERHEAD).cast("long").alias("tokens"),
    )


def _spans(turns: DataFrame) -> DataFrame:
    """key, block, first_block and n_blocks of every block: numbers only, one row per block."""
    blocks = turns.select("key", "block").distinct()
    return blocks.join(blocks.groupBy("key").agg(F.min("block").alias("first_block"), F.count("*").alias("n_blocks")), "key")


def _dealt(turns: DataFrame, spans: DataFrame, history: int, block_turns: int) -> DataFrame:
    """Turns by the blocks that need them.  kind: 0 the system turn of an earlier block, 1 history from the block before, 2 the block's own."""
    later = spans.where("block > first_block").select("key", F.col("block").alias("to"), "first_block")
    longer = spans.where("n_blocks > 1 and block = first_block").select("key", "block")
    # Only the first row of the first block can be the system turn.
    order = Window.partitionBy("key", "block").orderBy("turn", "role", "text")
    heads = turns.join(longer, ["key", "block"], "left_semi").withColumn("place", F.row_number().over(order)).where("place = 1 and role = 'system'").drop("place")
    sent = heads.join(later.drop("first_block"), "key").withColumn("block", F.col("to")).drop("to")
    # A turn can be history of the next block only if so few turns lie between that they may fit.
    near_end = F.pmod("turn", F.lit(block_turns)) >= block_turns - history // OVERHEAD
    late = turns.where(near_end).withColumn("block", F.col("block") + 1)
    cols = [*turns.columns]
    parts = [df.select(*cols, F.lit(kind).alias("kind")) for kind, df in enumerate((sent, late, turns))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _window_starts(budget: int) -> Column:
    """(start, base) of a block's windows, from its turns in order: new turns begin at the prefix sum start, history at base."""
    room = F.lit(budget).cast("long") - F.col("system_tokens")
    none = F.array().cast("array<struct<start:bigint,base:bigint>>")

    def step(found: Column, t: Column) -> Column:
        fits = (F.size(found) > 0) & (t["until"] - F.element_at(found, -1)["base"] <= room)
        base = F.when(t["until"] - t["reach"] <= room, t["reach"]).otherwise(t["begin"])
        return F.when(fits, found).otherwise(F.concat(found, F.array(F.struct(t["begin"].alias("start"), base.alias("base")))))

    own = F.aggregate(F.filter("turns", lambda t: t["kind"] == 2), none, step)
    # A conversation of a system turn alone is one window of it.
    alone = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("base")))
    return F.when((F.size("turns") == 0) & (F.col("system_kind") == 2), alone).otherwise(own)


def windows(conversations: DataFrame, budget: int = 1024, history: int = 128, block_turns: int = 256, tokens: Callable[[Column], Column] = estimated_tokens) -> DataFrame:
    """Training windows of ``conversations`` (conv_id, turn, role, text).

    key (of the conversation), conv_id, block, window (their order), n_blocks, text (formatted), loss
    (array of start and end in code points of text), n_turns, n_repeated (its first
    turns, which earlier windows have too), tokens and over_budget.

    Turns are ordered by turn, then role and text; a null turn comes first.  A null
    role or text is empty; rows with a null conv_id are one conversation.  Repeated rows are
    turns of their own.  Other columns are ignored; no rows give no rows.  ``tokens``
    gives the tokens of a text column.
    """
    turns = _turns(conversations, tokens, block_turns)
    spans = _spans(turns)
    own = Window.partitionBy("key", "block")
    order = own.orderBy("kind", "turn", "role", "text")
    rows = _dealt(turns, spans, history, block_turns).withColumn("place", F.row_number().over(order))
    # A system turn near the end of its block comes to the next one twice; there it is no history.
    twice = (F.col("kind") == 1) & (F.lag("kind").over(order) == 0) & F.lag("turn").over(order).eqNullSafe(F.col("turn")) & (F.lag("role").over(order) == F.col("role")) & (F.lag("text").over(order) == F.col("text"))
    rows = rows.withColumn("twice", F.coalesce(twice, F.lit(False))).where("not twice").drop("twice")
    system = (F.col("kind") == 0) | (F.col("place") == 1) & (F.col("kind") == 2) & (F.col("role") == "system")
    size = F.when(F.col("system"), 0).otherwise(F.col("tokens"))
    placed = rows.withColumn("system", system).withColumn("until", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("begin", F.col("until") - size)
    reach = F.min(F.when(~F.col("system"), F.col("begin"))).over(own.orderBy("begin").rangeBetween(-history, 0))
    turn = F.struct("place", "kind", "begin", "until", "reach", "role", "text")
    packed = placed.withColumn("reach", reach).groupBy("key", "block").agg(
        F.first("conv_id").alias("conv_id"),
        F.array_sort(F.collect_list(F.when(~F.col("system"), turn))).alias("turns"),
        F.max(F.when(F.col("system"), F.struct("role", "text"))).alias("system"),
        F.coalesce(F.sum(F.when(F.col("system"), F.col("tokens"))), F.lit(0)).alias("system_tokens"),
        F.max(F.when(F.col("system"), F.col("kind"))).alias("system_kind"),
    )
    # Blocks stay where they are: what is known of them comes to them.
    known = packed.join(spans.select("key", "block", "n_blocks").hint("shuffle_hash"), ["key", "block"])
    planned = known.withColumn("starts", _window_starts(budget))
    ends = F.transform("starts", lambda s, i: s.withField("end", F.get("starts", i + 1)["start"]))
    one = planned.select("key", "conv_id", "block", "n_blocks", "turns", "system", "system_tokens", "system_kind", F.posexplode(ends).alias("window", "span"))
    held = F.filter("turns", lambda t: (t["begin"] >= F.col("span.base")) & (F.col("span.end").isNull() | (t["begin"] < F.col("span.end"))))
    held = F.transform(held, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), (t["begin"] >= F.col("span.start")).alias("new"), (t["until"] - t["begin"]).alias("tokens")))
    first = (F.col("window") == 0) & (F.col("system_kind") == 2)
    head = F.when(F.col("system").isNotNull(), F.array(F.struct(F.col("system.role").alias("role"), F.col("system.text").alias("text"), first.alias("new"), F.col("system_tokens").alias("tokens"))))
    held = F.concat(F.coalesce(head, F.array().cast("array<struct<role:string,text:string,new:boolean,tokens:bigint>>")), held)
    full = one.select("key", "conv_id", "block", "n_blocks", "window", held.alias("held"))
    return full.select("key", "conv_id", "block", "n_blocks", "window", *_formatted(F.col("held"), budget))


def _formatted(turns: Column, budget: int) -> list[Column]:
    """The template's text of these turns (role, text, new, tokens), its mask and sizes."""
    opened = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(ROLE_END))
    pieces = F.transform(turns, lambda t: F.struct(opened(t).alias("before"), escape(t["text"]).alias("body"), (t["new"] & (t["role"] == "assistant")).alias("target")))
    shown = F.array_join(F.transform(pieces, lambda p: F.concat(p["before"], p["body"], F.lit(TEXT_END))), "")
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))

    def step(done: Column, p: Column) -> Column:
        start = done["at"] + F.char_length(p["before"])
        end = start + F.char_length(p["body"])
        loss = F.when(p["target"], F.concat(done["loss"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(done["loss"])
        return F.struct((end + len(TEXT_END)).alias("at"), loss.alias("loss"))

    tokens = F.aggregate(turns, F.lit(0).cast("long"), lambda n, t: n + t["tokens"])
    repeated = F.size(F.filter(turns, lambda t: ~t["new"]))
    return [shown.alias("text"), F.aggregate(pieces, none, step)["loss"].alias("loss"), F.size(turns).alias("n_turns"), repeated.alias("n_repeated"), tokens.alias("tokens"), (tokens > budget).alias("over_budget")]


def read_back(window: Column, n_repeated: Column) -> Column:
    """An array of (role, text): the new turns of a formatted window."""
    turns = F.split(window, TEXT_END, -1)
    mine = F.slice(turns, n_repeated + 1, F.greatest(F.size(turns) - 1 - n_repeated, F.lit(0)))
    role = lambda t: F.substring_index(F.substring(t, F.lit(len(OPEN) + 1), F.char_length(t)), ROLE_END, 1)

    def turn(t: Column) -> Column:
        r = role(t)
        return F.struct(unescape(r).alias("role"), unescape(F.substring(t, F.char_length(r) + len(OPEN) + len(ROLE_END) + 1, F.char_length(t))).alias("text"))

    return F.transform(mine, turn)


def targets(window: Column, loss: Column) -> Column:
    """The texts under the loss mask."""
    return F.transform(loss, lambda s: unescape(F.substring(window, s["start"] + 1, s["end"] - s["start"])))


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of every conversation, read back from its windows.

    Windows meet by block first, in the partitions where they are; a conversation of one
    block ends there, and only the texts of longer ones are shuffled.  A digest needs
    a conversation's whole text in one row.
    """
    turns = F.array_join(F.transform(read_back(F.col("text"), F.col("n_repeated")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(targets(F.col("text"), F.col("loss")), "")
    read = formatted.select("key", "conv_id", "block", "n_blocks", "window", (F.col("n_turns") - F.col("n_repeated")).cast("long").alias("n_turns"), turns.alias("turns"), loss.alias("loss"), F.char_length("text").cast("long").alias("chars"))

    def together(rows: DataFrame, keys: list[str], place: str) -> DataFrame:
        joined = F.array_sort(F.collect_list(F.struct(place, "turns", "loss"))).alias("x")
        text = lambda c: F.array_join(F.transform("x", lambda p: p[c]), "").alias(c)
        grouped = rows.groupBy(*keys).agg(joined, *[F.first(c).alias(c) for c in ("conv_id", "n_blocks")], *[F.sum(c).alias(c) for c in ("n_turns", "chars")])
        return grouped.select(*keys, "conv_id", "n_blocks", "n_turns", "chars", text("turns"), text("loss"))

    blocks = together(read, ["key", "block"], "window")
    long = together(blocks.where("n_blocks > 1"), ["key"], "block")
    whole = blocks.where("n_blocks = 1").drop("block").unionByName(long)
    sha = lambda c: F.sha2(c, 256).alias(f"{c}_sha256")
    return whole.select("conv_id", "n_turns", sha("turns"), F.char_length("loss").cast("long").alias("loss_chars"), sha("loss"), F.col("chars").alias("formatted_chars"))
