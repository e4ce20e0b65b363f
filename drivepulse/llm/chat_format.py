"""Chat formatting in budgeted windows, all in DataFrame functions.

A turn is written ``<s>role``, a line end, its text, ``</s>``. Control strings inside roles and texts
are escaped reversibly, so they never stand for a mark. The tokens of the turns before a turn (prefix
sums along the conversation) decide its window: a window holds the turns that end in the same half
of the token capacity, whole turns only. The capacity is the budget less the system turn and the
history. A further window repeats the first system turn and the last turns of the window before it,
as many as ``HISTORY`` tokens allow; what is repeated is masked, so that every assistant text is a
target exactly once. A system turn of over half of budget less history is not repeated and takes
nothing off the capacity: it stands in its own place once. So a window goes beyond the budget only by
a turn of over half of its capacity.

Null text counts as empty, a null role as the empty role. Turns are in order of ``turn``, then role,
then text; null turns come first and repeated rows stay. Rows with a null ``conv_id`` form one
conversation. The conversation is the unit of work, as its digest is of the whole of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 1024
HISTORY = 256
# Tokens that the marks of a turn cost.
MARKS = 4
# Control strings, and what their first sign becomes. The escape sign comes first, and last when undone.
ESCAPE = (("\\", "\\e"), ("<s>", "\\ls>"), ("</s>", "\\l/s>"), ("[INST]", "\\bINST]"), ("[/INST]", "\\b/INST]"))
UNDO = (("\\l", "<"), ("\\b", "["), ("\\n", "\n"), ("\\e", "\\"))
OPEN, CLOSE = "<s>", "</s>"
WORD = r"[^ \t\n\r\f\x0B]+"


def _replaced(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape(text: Column) -> Column:
    return _replaced(text, ESCAPE)


def escape_role(role: Column) -> Column:
    """A role is one line."""
    return _replaced(escape(role), (("\n", "\\n"),))


def unescape(text: Column) -> Column:
    return _replaced(text, UNDO)


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Rows ``conv_id, window, n_repeated, formatted, loss`` from ``conv_id, turn, role, text``.

    ``loss`` lists spans ``start, length`` in code points of ``formatted``, from 0. The first
    ``n_repeated`` turns of a window are repeated.
    """
    clean = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    along = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("conv_id")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    placed = clean.select(
        "conv_id", "role", place.alias("pos"), (F.regexp_count("text", F.lit(WORD)) + MARKS).cast("long").alias("n"),
        escape_role(F.col("role")).alias("r"), escape(F.col("text")).alias("t"),
        F.sum((F.regexp_count("text", F.lit(WORD)) + MARKS).cast("long")).over(along).alias("after"))
    system = F.min(F.when(F.col("role") == "system", F.struct("pos", "n", "r", "t"))).over(whole)
    fits = F.col("system.n") * 2 <= budget - history
    half = F.greatest(F.lit(1), F.floor((budget - history - F.when(fits, F.col("system.n")).otherwise(0)) / 2))
    celled = placed.withColumn("system", system).withColumn("window", F.floor((F.col("after") - 1) / half))
    # Only the row that opens a window carries the system turn on.
    opens = ~F.col("window").eqNullSafe(F.lag("window").over(Window.partitionBy("conv_id").orderBy("pos")))
    celled = celled.withColumn("opens", opens).withColumn("system", F.when(F.col("opens") & fits, F.col("system")))
    following = Window.partitionBy("conv_id").orderBy("window").rangeBetween(1, Window.unboundedFollowing)
    ahead = F.min("window").over(following)
    closes = F.max("after").over(Window.partitionBy("conv_id", "window"))
    celled = celled.withColumn("ahead", ahead).withColumn("closes", closes)
    again = F.col("ahead").isNotNull() & (F.col("closes") - F.col("after") + F.col("n") <= history)
    uses = F.when(again, F.array(F.struct(F.col("window").alias("w"), F.lit(True).alias("new")), F.struct(F.col("ahead").alias("w"), F.lit(False).alias("new"))))
    uses = uses.otherwise(F.array(F.struct(F.col("window").alias("w"), F.lit(True).alias("new"))))
    spread = celled.select("conv_id", "system", "pos", "r", "t", F.explode(uses).alias("use"))
    spread = spread.withColumn("system", F.when(F.col("use.new"), F.col("system")))
    gathered = spread.groupBy("conv_id", F.col("use.w").alias("window")).agg(
        F.sort_array(F.collect_list(F.struct("pos", F.col("use.new").alias("new"), "r", "t"))).alias("items"), F.first("system", ignorenulls=True).alias("system"))
    lead = F.struct(F.col("system.pos").alias("pos"), F.lit(False).alias("new"), F.col("system.r").alias("r"), F.col("system.t").alias("t"))
    held = F.exists("items", lambda x: x["pos"] == F.col("system.pos"))
    items = F.when(F.col("system").isNull() | held, F.col("items")).otherwise(F.concat(F.array(lead), F.col("items")))
    items = gathered.select("conv_id", "window", items.alias("items"))
    texts = F.transform("items", lambda x: F.concat(F.lit(OPEN), x["r"], F.lit("\n"), x["t"], F.lit(CLOSE)))
    parts = items.withColumn("parts", texts).withColumn("sizes", F.transform("parts", F.length))
    before = F.transform("sizes", lambda _, i: F.aggregate(F.slice("sizes", F.lit(1), i), F.lit(0), lambda a, s: a + s))
    spans = F.transform(F.arrays_zip("items", before.alias("at")), lambda z: F.struct(
        (z["at"] + len(OPEN) + 1 + F.length(z["items"]["r"])).alias("start"), F.length(z["items"]["t"]).alias("length"),
        (z["items"]["new"] & (z["items"]["r"] == "assistant")).alias("target")))
    loss = F.transform(F.filter(spans, lambda s: s["target"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
    return parts.select(
        "conv_id", "window", F.size(F.filter("items", lambda x: ~x["new"])).alias("n_repeated"),
        F.array_join("parts", "").alias("formatted"), loss.alias("loss"))


def read_windows(windows: DataFrame) -> DataFrame:
    """Rows ``conv_id, turns, loss, formatted_chars`` read back from the windows: every turn once, unescaped."""
    cut = F.split("formatted", CLOSE)
    turns = F.slice(cut, F.col("n_repeated") + 1, F.size(cut) - 1 - F.col("n_repeated"))

    def turn(x):
        head = F.instr(x, F.lit("\n"))
        role = F.substring(x, F.lit(len(OPEN) + 1), head - len(OPEN) - 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(x, head + 1, F.length(x))).alias("text"))

    targets = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    read = windows.select("conv_id", "window", F.transform(turns, turn).alias("turns"), targets.alias("loss"), F.length("formatted").alias("chars"))
    gathered = read.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    return gathered.select(
        "conv_id", F.flatten(F.transform("w", lambda x: x["turns"])).alias("turns"),
        F.flatten(F.transform("w", lambda x: x["loss"])).alias("loss"), "formatted_chars")


def digests(windows: DataFrame) -> DataFrame:
    """Counts and digests per conversation of what the windows hold."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return read_windows(windows).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"))
