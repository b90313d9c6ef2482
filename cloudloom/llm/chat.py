"""Chat formatting in budgeted windows, and reading the turns back. Only DataFrame functions.

A turn is written `<s>role\ntext</s>`; control strings inside texts get a backslash after their first character
(backslashes are doubled), so no text can end or begin a turn, and the reader takes the backslashes out again.

Windows: the rows of all conversations are sorted by range, and prefix sums of turn tokens are taken in two levels (inside
a range, then over the ranges of a conversation), so a conversation that holds a third of all rows is many tasks. What the
budget leaves beside the system turn and the history is the room of a window. A turn belongs to the window in whose
half room it begins; one that would carry its window beyond the room makes a window of its own. So a window holds whole turns,
never more than its room unless it is a single turn, and its place follows from the prefix sums alone.

Every window after the first repeats the system turn (the first turn, if that is its role) and as many whole turns
before its own as the history allows. The loss mask covers the assistant texts of a window's own turns; repeated ones are
masked, so each target is learnt once.

Defined cases: null text or role is empty; a null conv_id is a conversation of its own; turns are ordered by turn (null
first), then role, then a hash of the text; rows that repeat are turns like any other; a system turn or a single turn
larger than the budget is kept whole, its window is then larger; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, parallelism

#: The marks of the template, and control strings of common chat templates that texts may not hold as they are.
START, END = "<s>", "</s>"
CONTROL = (START, END, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>")
#: Tokens counted for a turn's marks and role.
TURN_TOKENS = 4
_CONTROLS = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL)


def words_and_marks(text: Column) -> Column:
    """A count of tokens that needs no vocabulary: runs of letters and digits, and each other character that is not white space."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]"))


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROLS, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _with(a: DataFrame, b: DataFrame, *names: str, how: str = "inner") -> DataFrame:
    """a joined with the columns of b on columns of these names, null like null."""
    right = b.withColumnsRenamed({n: f"__{n}" for n in names})
    on = F.lit(True)
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"__{n}"))
    return a.join(right, on, how).drop(*(f"__{n}" for n in names))


def _placed(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """mid, seq (place in the conversation), start (tokens before it), cell, alone of every turn; first: it is a system turn at the front."""
    small = turns.select("conv", "part", "mid", "role", "tokens")
    local = Window.partitionBy("part", "conv").orderBy("mid").rowsBetween(Window.unboundedPreceding, -1)
    inside = small.withColumns({"seq": F.count("*").over(local), "start": F.coalesce(F.sum("tokens").over(local), F.lit(0))})
    # one row for each range of a conversation
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = small.groupBy("conv", "part").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    base = ranges.select("conv", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("seq0"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("start0"))
    both = _with(inside, base, "conv", "part").select("conv", "mid", "role", "tokens", (F.col("seq") + F.col("seq0")).alias("seq"), (F.col("start") + F.col("start0")).alias("start"))
    both = materialize(both, "placed")
    system = both.filter("seq = 0 and role = 'system'").select("conv", F.col("tokens").alias("held"))
    known = _with(both, system, "conv", how="left").withColumn("held", F.coalesce("held", F.lit(0)))
    known = known.withColumn("first", (F.col("seq") == 0) & (F.col("held") > 0))
    known = known.withColumns({"start": F.when(F.col("first"), F.lit(0)).otherwise(F.col("start") - F.col("held")), "room": F.greatest(F.lit(budget - history) - F.col("held"), F.lit(max(2 * history, 2)))})
    half = F.floor(F.col("room") / 2)
    offset = F.col("start") % half
    return known.select("mid", "seq", "start", "first", F.floor(F.col("start") / half).alias("cell"), (~F.col("first") & (offset > 0) & (offset + F.col("tokens") > F.col("room"))).alias("alone"))


def format(df: DataFrame, budget: int = 1024, history: int = 128, tokens: Callable[[Column], Column] = words_and_marks, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:  # noqa: A001
    """One row per window: conv, first_turn (place of its first own turn), n_turns (own ones), n_repeated (turns before them), n_tokens, text, loss (spans start, end in code points)."""
    if budget <= 0 or history < 0:
        raise ValueError("budget must be positive and history not negative")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = df.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), body.alias("text"))
    by = ["conv", "turn", "role", F.xxhash64("text")]
    ranged = rows.repartitionByRange(parallelism(df.sparkSession), *by).sortWithinPartitions(*by)
    head = F.concat(F.lit(START), F.url_encode("role"), F.lit("\n"))
    made = ranged.select("conv", "role", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("mid"), (tokens(F.col("text")) + TURN_TOKENS).cast("long").alias("tokens"), head.alias("head"), escape(F.col("text")).alias("body"))
    turns = materialize(made, "turns")
    placed = _placed(turns, budget, history)
    part = F.struct("seq", "start", "tokens", "first", F.col("role").eqNullSafe("assistant").alias("target"), "head", "body")
    place = ["conv", "cell", "alone"]
    windows = turns.drop("part").join(placed, "mid").groupBy(*place).agg(F.array_sort(F.collect_list(part)).alias("own"))
    windows = materialize(windows, "windows")

    # the turns that a later window may repeat: the last of a window, not more than the history; they can be wanted in two cells
    end = F.element_at("own", -1)["start"] + F.element_at("own", -1)["tokens"]
    tails = windows.select("conv", "cell", F.explode(F.filter("own", lambda t: (t["start"] >= end - history) & ~t["first"])).alias("t"), F.explode(F.array(F.lit(0), F.lit(1))).alias("on"))
    tails = tails.select("conv", (F.col("cell") + F.col("on")).alias("cell"), "t")
    begins = F.filter("own", lambda t: ~t["first"])  # a front system turn repeats nothing
    starts = windows.filter(F.size(begins) > 0).select(*place, begins[0]["start"].alias("begin"))
    near = (F.col("t.start") < F.col("begin")) & (F.col("t.start") >= F.col("begin") - history)
    past = _with(starts, tails, "conv", "cell").filter(near).groupBy(*place).agg(F.array_sort(F.collect_list("t")).alias("past"))
    system = windows.filter("own[0].first").select("conv", F.col("own")[0].alias("system"))

    whole = _with(_with(windows, past, *place, how="left"), system, "conv", how="left")
    none = F.array().cast(windows.schema["own"].dataType)
    again = F.when(F.col("system").isNotNull() & (F.col("own")[0]["seq"] > 0), F.array("system")).otherwise(none)
    whole = whole.withColumn("again", F.concat(again, F.coalesce("past", none)))
    parts = F.concat(F.transform("again", lambda t: t.withField("target", F.lit(False))), F.col("own"))
    size = lambda t: F.length(t["head"]) + F.length(t["body"]) + len(END)
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        low = acc["at"] + F.length(t["head"])
        span = F.struct(low.alias("start"), (low + F.length(t["body"])).alias("end"))
        return F.struct((acc["at"] + size(t)).alias("at"), F.when(t["target"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return whole.withColumn("parts", parts).select(
        F.col("conv").alias(conv), F.col("own")[0]["seq"].alias("first_turn"), F.size("own").cast("long").alias("n_turns"), F.size("again").cast("long").alias("n_repeated"),
        F.aggregate("parts", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("n_tokens"),
        F.array_join(F.transform("parts", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("text"), F.aggregate("parts", begin, step)["spans"].alias("loss"),
    )


def _own(formatted: DataFrame) -> Column:
    """The turns of a window that it does not repeat, as an array of (role, text)."""
    pieces = F.split("text", re.escape(END), -1)
    own = F.slice(pieces, F.col("n_repeated").cast("int") + 1, F.col("n_turns").cast("int"))

    def turn(p: Column) -> Column:
        cut = F.instr(p, F.lit("\n"))
        return F.struct(F.url_decode(F.substring(p, F.lit(len(START) + 1), cut - len(START) - 1)).alias("role"), unescape(F.substring(p, cut + 1, F.length(p))).alias("text"))

    return F.transform(own, turn)


def parse(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """conv, turn (place in the conversation), role, text of every turn, from the windows."""
    return formatted.select(conv, "first_turn", F.posexplode(_own(formatted)).alias("at", "t")).select(conv, (F.col("first_turn") + F.col("at")).alias("turn"), "t.role", "t.text")


def targets(formatted: DataFrame) -> Column:
    """The text under the loss mask of a window, unescaped."""
    return F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("text"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def digest(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Counts and digests of each conversation as read back from its windows. A digest is of one string, so this report (not format or parse) puts a conversation together in one row."""
    read = formatted.select(
        conv, "first_turn", "n_turns", F.length("text").cast("long").alias("chars"), targets(formatted).alias("loss"),
        F.array_join(F.transform(_own(formatted), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
    )
    got = read.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct("first_turn", "turns", "loss"))).alias("w"), F.sum("n_turns").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    joined = lambda name: F.array_join(F.col("w")[name], "")
    return got.select(conv, "n_turns", F.sha2(joined("turns"), 256).alias("turns_sha256"), F.length(joined("loss")).cast("long").alias("loss_chars"), F.sha2(joined("loss"), 256).alias("loss_sha256"), "formatted_chars")


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts are made of control strings."""
    ask = F.lit("</s>[INST] ok [/INST]")
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), ask.alias("text"))
