"""Chat formatting: conversations as budgeted windows of marked turns with a loss mask, in DataFrame operations.

A turn is written as ``<|turn|>role<|text|>text<|end|>``. In roles and texts a backslash is doubled, and each control
string (the template's own and those of common chat templates) gets a backslash after its first character, so no text
can open or close a turn; unescaping drops one backslash of each pair or before each character.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .sharding import prefix_sums

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What must not appear unescaped, as alternatives after the first character.
_CONTROL = r"(<(?=\|[^|<>]*\|>|/?s>|</?SYS>>)|\[(?=/?INST\]))"
_TOKENS = r"\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]+|\s+"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _rendered(rows: DataFrame, target_role: str) -> DataFrame:
    """rows with ``part``: the marked turn, where its body begins and, for a target's role, how long it is."""
    role, text = escape(F.col("role")), escape(F.col("text"))
    part = F.struct(F.concat(F.lit(TURN), role, F.lit(TEXT), text, F.lit(END)).alias("shown"), (F.length(role) + len(TURN) + len(TEXT)).alias("lead"), F.when(F.col("role") == target_role, F.length(text)).alias("target"))
    return rows.withColumn("part", part)


def _assembled(windows: DataFrame) -> DataFrame:
    """windows (conv, window, parts: array of (kind, number, part)) as rows of format_chats(); repeated parts carry no loss."""
    parts = F.transform(F.array_sort("parts"), lambda p: F.struct(p["kind"].alias("kind"), p["part"]["shown"].alias("shown"), p["part"]["lead"].alias("lead"), F.when(p["kind"] == 2, p["part"]["target"]).alias("target")))
    listed = windows.select("conv", "window", parts.alias("parts"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("spans"))
    spans = F.aggregate(
        "parts",
        start,
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["shown"])).alias("at"),
            F.when(p["target"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(F.struct((acc["at"] + p["lead"]).alias("start"), (acc["at"] + p["lead"] + p["target"]).alias("end"))))).alias("spans"),
        ),
    )["spans"]
    formatted = F.array_join(F.transform("parts", lambda p: p["shown"]), "")
    repeated = F.size(F.filter("parts", lambda p: p["kind"] < 2))
    return listed.select("conv", "window", formatted.alias("formatted"), F.size("parts").alias("n_turns"), repeated.alias("n_repeated"), spans.alias("loss"))


def _grouped(rows: DataFrame, target_tokens: int, history_tokens: int, target_role: str) -> DataFrame:
    """Windows of conversations that fit a task: the one shuffle, by conversation, serves the prefix sums, the windows and whatever a caller groups by conversation."""
    order = Window.partitionBy("conv").orderBy("turn", "h0", "h1")
    before = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    placed = rows.withColumns({"before": before, "number": F.row_number().over(order).cast("long")})
    placed = placed.withColumns({"window": F.floor(F.col("before") / target_tokens), "is_system": (F.col("role") == "system") & (F.col("number") == 1)})
    opens = F.min("before").over(Window.partitionBy("conv").orderBy("window").rangeBetween(1, 1))  # where the next window begins, if there is one
    placed = _rendered(placed.withColumn("opens", opens), target_role)
    again = ~F.col("is_system") & (F.col("before") >= F.col("opens") - history_tokens)
    own, next_ = F.struct(F.col("window").alias("of"), F.lit(2).alias("kind")), F.struct((F.col("window") + 1).alias("of"), F.lit(1).alias("kind"))
    shown = placed.select("conv", "number", "part", "is_system", F.explode(F.when(again, F.array(own, next_)).otherwise(F.array(own))).alias("w"))
    item = F.struct("w.kind", "number", "part")
    windows = shown.groupBy("conv", F.col("w.of").alias("window")).agg(F.collect_list(item).alias("parts"), F.max(F.when(F.col("is_system"), F.col("part"))).alias("own_system"))
    system = F.first("own_system").over(Window.partitionBy("conv").orderBy("window"))
    windows = windows.withColumn("system", system)
    lead = F.array(F.struct(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("number"), F.col("system").alias("part")))
    parts = F.when(F.col("system").isNotNull() & F.col("own_system").isNull(), F.concat(lead, "parts")).otherwise(F.col("parts"))
    return _assembled(windows.select("conv", "window", parts.alias("parts")))


def _dealt(rows: DataFrame, target_tokens: int, history_tokens: int, target_role: str) -> DataFrame:
    """Windows of conversations of any length, dealt over tasks: global prefix sums over rows without texts say which turn is in which windows; texts then join their rows' keys."""
    summed = written(prefix_sums(rows.select("conv", "turn", "h0", "h1", "tokens", (F.col("role") == "system").alias("system")), ["conv", "turn", "h0", "h1"], "tokens"), "turns")
    firsts = F.broadcast(summed.groupBy(F.col("conv").alias("of")).agg(F.min("before").alias("base"), F.min("number").alias("first")))  # hot conversations are few
    placed = summed.join(firsts, F.col("conv").eqNullSafe(F.col("of"))).withColumn("before", F.col("before") - F.col("base"))
    placed = placed.withColumns({"window": F.floor(F.col("before") / target_tokens), "is_system": F.col("system") & (F.col("number") == F.col("first"))})
    starts = placed.groupBy(F.col("conv").alias("of"), F.col("window").alias("own")).agg(F.min("before").alias("opens"))
    same = F.col("conv").eqNullSafe(F.col("of"))
    key = ["conv", "turn", "h0", "h1", "number"]
    targets = placed.select(*key, "window", F.lit(2).alias("kind"))
    history = placed.where("not is_system").drop("of").join(starts, same & (F.col("window") + 1 == F.col("own"))).where(F.col("before") >= F.col("opens") - history_tokens)
    system = F.broadcast(placed.where("is_system").drop("of"))  # one row a hot conversation at most
    repeated = system.join(starts.where("own > 0"), same)
    wanted = targets.union(history.select(*key, "own", F.lit(1))).union(repeated.select(*key, "own", F.lit(0)))
    texts = rows.groupBy(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("h0").alias("x"), F.col("h1").alias("y")).agg(F.first("role").alias("role"), F.first("text").alias("text"))
    met = wanted.join(texts, F.col("conv").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("h0") == F.col("x")) & (F.col("h1") == F.col("y")))
    parts = _rendered(met, target_role).groupBy("conv", "window").agg(F.collect_list(F.struct("kind", "number", "part")).alias("parts"))
    return _assembled(parts)


def format_parts(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target_tokens: int = 1024, history_tokens: int = 256, target_role: str = "assistant", fits: int = 5000, hot: int = 100_000) -> list[DataFrame]:
    """format_chats() in two tables: of conversations that fit a task, and of the others, which have over `fits` rows and over one in `hot` of all rows (so they are fewer than `hot`).

    The first is hash-partitioned by conv.
    """
    assert history_tokens <= target_tokens
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    counts = rows.groupBy("conv").agg(F.count("*").alias("n"))
    total = rows.count()
    large = counts.where((F.col("n") > fits) & (F.col("n") * hot > total)).select(F.struct("conv").alias("large")).collect()  # fewer than `hot` by their share
    rows = rows.withColumns({"tokens": F.regexp_count("text", F.lit(_TOKENS)).cast("long") + F.regexp_count("role", F.lit(_TOKENS)) + 3, "h0": F.xxhash64("role", "text"), "h1": F.xxhash64(F.lit(20_011), "role", "text")})
    if not large:
        return [_grouped(rows, target_tokens, history_tokens, target_role)]
    ids = turns.sparkSession.createDataFrame([(r["large"]["conv"],) for r in large], f"large {rows.schema['conv'].dataType.simpleString()}")
    is_large = F.col("conv").eqNullSafe(F.col("large"))
    apart = [rows.join(F.broadcast(ids), is_large, kind) for kind in ("left_anti", "left_semi")]
    return [f(r, target_tokens, history_tokens, target_role) for f, r in zip((_grouped, _dealt), apart)]


def format_chats(turns: DataFrame, **options) -> DataFrame:
    """(conv, window, formatted, n_turns, n_repeated, loss): one row for each window of each conversation; options as in format_parts().

    A prefix sum of the turns' token counts deals a conversation's turns to windows: the turns that begin within the
    same target_tokens are one window's targets, so windows are cut between turns only (a turn longer than the budget is
    whole). Each later window repeats, before its targets, the conversation's leading system turn and then the last turns
    within history_tokens (at most target_tokens) before its first target. loss: spans [start, end) in characters of
    formatted, the escaped texts of target_role turns among the targets; repeated turns are masked, so each such text
    is under the mask once. Tokens are counted as runs of letters, of up to three digits, of other characters, of blanks.

    Turns are ordered by turn, those of one number by a hash of role and text; null roles and texts are empty, a null turn
    comes first, a null conversation id is a conversation. Equal rows are turns of their own. Texts cross one shuffle, by
    conversation; one of over `fits` rows that are over one in `hot` of all rows is dealt over tasks instead, and only a
    window's turns meet in one row.
    """
    return reduce(DataFrame.unionByName, format_parts(turns, **options))


def read_back(windows: DataFrame) -> DataFrame:
    """(conv, window, turns, targets, n_chars) parsed from the formatted text and its mask alone: turns that aren't repeats as (role, text), and the texts under the mask, all unescaped."""
    marked = F.regexp_extract_all("formatted", F.lit(r"(?s)<\|turn\|>(.*?)<\|end\|>"), F.lit(1))
    new = F.slice(marked, F.col("n_repeated") + 1, F.size(marked))
    pairs = F.transform(new, lambda t: F.struct(unescape(F.substring_index(t, TEXT, 1)).alias("role"), unescape(F.substring_index(t, TEXT, -1)).alias("text")))
    under = F.transform("loss", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["end"] - s["start"])))
    return windows.select("conv", "window", pairs.alias("turns"), under.alias("targets"), F.length("formatted").cast("long").alias("n_chars"))
