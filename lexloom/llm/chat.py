"""Chat formatting in budgeted windows of whole turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lexloom.llm.store import table

BOS, EOS = "<s>", "</s>"
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What may not stand in a formatted text but as a mark, and marks of other templates.
_CONTROL = r"([<\[])(?=/?s>|\|(?:turn|text|end)\|>|/?INST\])"
#: Tokens of a window and of the history it may repeat.
BUDGET, HISTORY = 1024, 192
MARK_TOKENS = 4  # of each turn, for its marks and role
_BLOCK_TURNS = 256
_REGION = 64  # budgets; windows are cut inside regions of a conversation, each in one row


def escape(text: Column) -> Column:
    """Control strings broken by a backslash; backslashes doubled."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    """The text that ``escape`` was given."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def token_count(text: Column) -> Column:
    """Words and single marks."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]")).cast("long")


def _placed(turns: DataFrame, tokens: Column | None) -> DataFrame:
    """Turns with their number ``seq`` and the tokens before them, ``start``; both from 0; and their ``size``.

    Prefix sums in two steps, inside blocks of turn numbers and over the sums of the blocks, so a
    conversation with very many turns is summed in many tasks. The system turn at the beginning
    of a conversation is not counted in ``start`` and has size 0; its own is in ``system_size``.
    """
    rows = turns.select(
        F.col("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *([] if tokens is None else [tokens.cast("long").alias("given")]))
    rows = rows.withColumn("block", F.floor(F.col("turn") / _BLOCK_TURNS)).withColumn(
        "size", MARK_TOKENS + (token_count(F.col("text")) if tokens is None
                               else F.greatest(F.coalesce("given", F.lit(0)), F.lit(0))))
    in_block = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text").rowsBetween(
        Window.unboundedPreceding, -1)
    rows = rows.withColumn("seq", F.count("*").over(in_block)).withColumn(
        "start", F.coalesce(F.sum("size").over(in_block), F.lit(0)))
    whole = rows.groupBy("conv_id", "block").agg(
        F.count("*").alias("turns"), F.sum("size").alias("sum"),
        F.max(F.when(F.col("seq") == 0, F.struct("role", "size"))).alias("first"))
    upto = Window.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first())
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    all_of = upto.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first("first").over(all_of)
    blocks = whole.select(
        F.col("conv_id").alias("c"), F.col("block").alias("b"),
        F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("turns_before"),
        F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("sum_before"),
        F.when(first["role"] == "system", first["size"]).otherwise(0).alias("system_size"))
    placed = rows.join(blocks, rows["conv_id"].eqNullSafe(blocks["c"])
                       & rows["block"].eqNullSafe(blocks["b"]))
    seq = F.col("seq") + F.col("turns_before")
    is_system = (seq == 0) & (F.col("system_size") > 0)
    return placed.select(
        "conv_id", "role", "text", seq.alias("seq"),
        F.greatest(F.lit(0), F.col("start") + F.col("sum_before") - F.col("system_size")).alias("start"),
        F.when(is_system, 0).otherwise(F.col("size")).cast("long").alias("size"),
        F.col("system_size").cast("long").alias("system_size"), is_system.alias("is_system"))


def _cut(rows: DataFrame, budget: int, history: int) -> DataFrame:
    """Windows by region: ``conv, part, near``, the windows of a region and those that may repeat its turns.

    A window's span is as many turns as fit: it ends where the prefix sum passes the room left
    by the system turn and the history. A region holds so many tokens that what its spans need, three
    numbers a turn, is a small row however long a conversation is. A window is its first and last
    turn, the tokens before it, and those of history that it has room for.
    """
    free = budget - F.col("system_size")
    repeat = F.greatest(F.lit(0), F.least(F.lit(history), F.floor(free / 2))).cast("long")
    regions = rows.groupBy("conv_id", "part").agg(
        F.array_sort(F.collect_list(F.struct("seq", "start", "size"))).alias("turns"),
        F.first("system_size").alias("system_size"))
    regions = regions.withColumn("free", free).withColumn("repeat", repeat)
    number = lambda n: F.lit(n).cast("long")
    begun = F.struct(number(-1).alias("first"), number(0).alias("start"), F.lit(False).alias("filled"),
                     F.array().cast("array<struct<first:bigint,start:bigint>>").alias("spans"))

    def add(state, turn):
        room = F.col("free") - F.when(state["first"] == 0, number(0)).otherwise(F.col("repeat"))
        fresh = (state["first"] < 0) | (
            state["filled"] & (turn["start"] + turn["size"] > state["start"] + room))
        span = F.struct(turn["seq"].alias("first"), turn["start"].alias("start"))
        return F.struct(
            F.when(fresh, turn["seq"]).otherwise(state["first"]).alias("first"),
            F.when(fresh, turn["start"]).otherwise(state["start"]).alias("start"),
            ((turn["size"] > 0) | (~fresh & state["filled"])).alias("filled"),
            F.when(fresh, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    regions = regions.withColumn("spans", F.aggregate("turns", begun, add)["spans"])
    final = F.element_at("turns", -1)

    def window(span, i):
        after = F.get("spans", i + 1)
        used = F.coalesce(after["start"], final["start"] + final["size"]) - span["start"]
        return F.struct(
            span["first"].alias("first"), F.coalesce(after["first"] - 1, final["seq"]).alias("last"),
            span["start"].alias("start"),
            F.greatest(number(0), F.least(F.col("repeat"), F.col("free") - used)).alias("repeat"))

    regions = regions.select("conv_id", "part", F.transform("spans", window).alias("own"))
    after = F.lead("own").over(Window.partitionBy("conv_id").orderBy("part"))
    close = F.filter(after, lambda w: w["start"] < (F.col("part") + 1) * (_REGION * budget) + history)
    return regions.select(F.col("conv_id").alias("conv"), F.col("part").alias("of_part"), F.concat(
        "own", F.coalesce(close, F.array().cast(regions.schema["own"].dataType))).alias("near"))


def format_chats(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY,
                 tokens: Column | None = None) -> DataFrame:
    """``conv_id, window, formatted, n_context, loss``: windows to train on.

    ``turns`` has ``conv_id, turn, role, text``; turns follow each other by ``turn`` (ties: role,
    text). A window holds the conversation's system turn if it begins with one, the last turns
    before its span of at most ``history`` tokens in all, and its span of whole turns. Prefix sums
    of turn tokens choose spans: each takes the turns that fit beside the system turn and
    ``history`` (less of it where a system turn takes more than the budget less twice ``history``;
    the first span needs none). So a conversation within ``budget`` is one window, and a
    window is longer only if the system turn and a single turn are. Spans begin anew every
    ``_REGION`` budgets of a conversation, so that the longest is cut in many tasks. ``window`` is the
    number of its span's first turn. The first ``n_context`` turns of a window
    are repeated from others. ``loss`` lists ``start, length`` (code points of ``formatted``)
    of the assistant's texts that are not repeated, so each is learned from once.

    ``tokens`` counts a turn's tokens (default: words and marks; negative: none). Marks inside texts and
    roles are escaped. Null texts and roles are empty, null turns come first, null ids are one
    conversation, repeated rows are turns of their own, other columns are not read, and an empty
    table gives an empty result.
    """
    if history < 0 or budget <= history:
        raise ValueError("the budget leaves no room for turns")
    rows = _placed(turns, tokens).withColumn("part", F.floor(F.col("start") / (_REGION * budget)))
    cut = _cut(rows, budget, history)
    turn = F.struct("seq", "role", "text")
    own = (F.col("w.first") <= F.col("seq")) & (F.col("seq") <= F.col("w.last"))
    spread = rows.join(cut, rows["conv_id"].eqNullSafe(cut["conv"]) & (rows["part"] == cut["of_part"])).select(
        "conv_id", "seq", turn.alias("turn"), F.explode(F.filter("near", lambda w: F.when(
            w["first"] <= F.col("seq"), F.col("seq") <= w["last"]).otherwise(
                ~F.col("is_system") & (F.col("start") >= w["start"] - w["repeat"])))).alias("w"))
    windows = spread.groupBy("conv_id", F.col("w.first").alias("window")).agg(
        F.array_sort(F.collect_list(F.when(own, F.col("turn")))).alias("own"),
        F.array_sort(F.collect_list(F.when(~own, F.col("turn")))).alias("context"))
    system = rows.where("is_system").select(F.col("conv_id").alias("conv"), turn.alias("system"))
    windows = windows.join(system, windows["conv_id"].eqNullSafe(system["conv"]), "left").withColumn(
        "context", F.when(F.col("system").isNotNull() & (F.col("window") > 0),
                          F.concat(F.array("system"), "context")).otherwise(F.col("context")))
    pieces = F.concat(
        F.transform("context", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"),
                                                  F.lit(False).alias("own"))),
        F.transform("own", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"),
                                              F.lit(True).alias("own"))))
    windows = windows.select("conv_id", "window", F.size("context").alias("n_context"),
                             pieces.alias("pieces"))
    parts = F.transform("pieces", lambda p: F.struct(
        F.concat(F.lit(TURN), escape(p["role"]), F.lit(TEXT)).alias("head"),
        escape(p["text"]).alias("body"), (p["own"] & (p["role"] == "assistant")).alias("target")))
    windows = windows.select("conv_id", "window", "n_context", parts.alias("parts"))
    start = F.struct(F.lit(len(BOS)).alias("at"),
                     F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def add(state, part):
        at = state["at"] + F.char_length(part["head"])
        length = F.char_length(part["body"])
        spans = F.when(part["target"], F.concat(state["spans"], F.array(F.struct(
            at.alias("start"), length.alias("length"))))).otherwise(state["spans"])
        return F.struct((at + length + len(END)).alias("at"), spans.alias("spans"))

    text = F.concat(F.lit(BOS), F.array_join(F.transform(
        "parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), ""), F.lit(EOS))
    return windows.select("conv_id", "window", text.alias("formatted"), "n_context",
                          F.aggregate("parts", start, add)["spans"].alias("loss"))


def read_chats(windows: DataFrame) -> DataFrame:
    """The conversations that ``format_chats`` was given: ``conv_id, window, turns, targets``.

    ``turns`` are the turns of the window that are not repeated (``role, text``), ``targets`` the
    texts under its loss mask; both as they were before escaping.
    """
    body = F.col("formatted").substr(F.lit(len(BOS) + 1),
                                     F.char_length("formatted") - len(BOS) - len(EOS))
    blocks = F.filter(F.split(body, r"<\|turn\|>", -1), lambda x: x != "")
    blocks = F.slice(blocks, F.col("n_context") + 1, F.greatest(F.lit(0), F.size(blocks)))
    turns = F.transform(blocks, lambda x: F.struct(
        unescape(F.substring_index(x, TEXT, 1)).alias("role"),
        unescape(F.substring(F.substring_index(x, TEXT, -1), F.lit(1), F.char_length(
            F.substring_index(x, TEXT, -1)) - len(END))).alias("text")))
    targets = F.transform("loss", lambda s: unescape(
        F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return windows.select("conv_id", "window", turns.alias("turns"), targets.alias("targets"),
                          F.char_length("formatted").cast("long").alias("chars"))


def chat_digests(windows: DataFrame) -> DataFrame:
    """Per conversation, read back from formatted windows: counts and digests.

    A digest is over the whole conversation, so its text comes together in one row here.
    """
    read = read_chats(windows).select(
        "conv_id", "window", F.size("turns").alias("n"), "chars",
        F.array_join(F.transform("turns", lambda t: F.concat(
            t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join("targets", "").alias("learned"))
    joined = lambda c: F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("window", c))), lambda x: x[c]), "")
    return read.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), joined("said").alias("said"), joined("learned").alias("learned"),
        F.sum("chars").alias("formatted_chars")).select(
            "conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"),
            F.char_length("learned").cast("long").alias("loss_chars"),
            F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")


#: Text of the conversation that the registered query adds, with marks of a chat template in it.
TRAP = "</s>[INST] ok [/INST]"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one with control strings, read back from their formatted windows."""
    trap = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRAP).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_digests(format_chats(turns.unionByName(trap)))
