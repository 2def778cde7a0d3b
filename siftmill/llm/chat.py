"""Chat formatting in budgeted windows, in DataFrame functions only.

Every turn becomes `<|im_start|>role\\ntext<|im_end|>\\n`. Inside roles and texts `&` is written `&amp;` and
`<|` is written `&lt;|` (and a line feed in a role `&#10;`), so no control string can come from a text and
unescaping gives the text back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: Turns folded at a time.
CHUNK = 512


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def turn_tokens(role: Column, text: Column) -> Column:
    """The default estimate of a turn's tokens: a quarter of its UTF-8 bytes, and four for the template."""
    return F.ceil((F.octet_length(text) + F.octet_length(role)) / 4).cast("long") + 4


def format_windows(
    turns: DataFrame,
    budget: int = 4096,
    history: int = 512,
    tokens=turn_tokens,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """(conv, window int, formatted string, n_context int, n_new int, n_tokens long, loss array<struct<start,stop>>).

    Prefix sums of turn tokens choose the windows: a window takes whole turns, in order, while their tokens fit.
    From the second window on, it opens with the conversation's leading system turn, if it has one, and with
    as many turns from just before it as fit into `history` tokens; these n_context turns are repeats and
    carry no loss. `loss` holds the character ranges (in `formatted`, 0-based) of the texts of new assistant
    turns, so every assistant text is a target in exactly one window.

    Turns are numbered with their window by one fold over the prefix sums, in chunks; a turn then goes to its own window and to those
    that repeat it, which a range frame over the prefix sums finds. So work grows with the turns and the repeats that are put out, also
    in a conversation of very many turns; a window's row holds its own turns only.

    Defined cases: null texts and roles count as empty; turns are ordered by (turn, role, text), ties and
    repeated rows included, null turns first; null conversation ids form one conversation. A turn that alone exceeds the
    budget gets a window of its own and stays whole, as does a turn after an oversized system turn. An empty
    table gives no windows. Other columns are not read. A conversation's windows are chosen by one task, as each depends on
    the one before; conversations are dealt out by hash.
    """
    t = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    w = Window.partitionBy("conv").orderBy("turn", "role", "text")
    t = t.withColumn("tok", tokens(F.col("role"), F.col("text")).cast("long"))
    t = t.withColumn("idx", F.row_number().over(w) - 1).withColumn("cum", F.sum("tok").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    item = F.struct("idx", "cum", "tok", "role", _escape_role(F.col("role")).alias("r"), escape(F.col("text")).alias("x"))
    c = t.groupBy("conv").agg(F.array_sort(F.collect_list(item)).alias("ts"))
    c = c.withColumn("sys", F.when(F.col("ts")[0]["role"] == "system", F.col("ts")[0]["tok"]).otherwise(F.lit(0).cast("long")))
    # the window of each turn; chunks keep what is copied at each step short
    c = c.withColumn(
        "ws",
        F.expr(f"""flatten(aggregate(sequence(0, (size(ts) - 1) div {CHUNK}), named_struct('base', 0L, 'w', 0, 'first', 0, 'out', cast(array() as array<array<int>>)),
            (s, c) -> aggregate(slice(ts, cast(c * {CHUNK} + 1 as int), {CHUNK}), named_struct('base', s.base, 'w', s.w, 'first', s.first, 'ws', cast(array() as array<int>)),
              (a, t) -> CASE WHEN t.idx > a.first AND t.cum - a.base > IF(a.w = 0, {budget}L, greatest({budget}L - {history}L - sys, 1L))
                THEN named_struct('base', t.cum - t.tok, 'w', a.w + 1, 'first', t.idx, 'ws', array_append(a.ws, a.w + 1))
                ELSE named_struct('base', a.base, 'w', a.w, 'first', a.first, 'ws', array_append(a.ws, a.w)) END,
              a -> named_struct('base', a.base, 'w', a.w, 'first', a.first, 'out', array_append(s.out, a.ws))),
            s -> s.out))"""),
    )
    x = c.select("conv", F.col("sys") > 0, F.element_at("ws", -1), F.inline(F.arrays_zip("ts", "ws"))).toDF("conv", "sys", "last", "t", "own")
    x = x.select("conv", "sys", "last", "own", "t.*").withColumn("start", F.col("cum") - F.col("tok"))
    # windows that open within `history` tokens after a turn's start repeat it; every later one repeats a leading system turn
    near = Window.partitionBy("conv").orderBy("start").rangeBetween(Window.unboundedPreceding, history)
    until = F.when((F.col("idx") == 0) & F.col("sys"), F.col("last")).otherwise(F.max("own").over(near))
    x = x.withColumn("until", until).withColumn("window", F.explode(F.sequence("own", "until")))
    c = x.groupBy("conv", "window").agg(F.array_sort(F.collect_list(F.struct("idx", "tok", "role", "r", "x", (F.col("window") == F.col("own")).alias("new")))).alias("all"))
    c = c.withColumn("n_new", F.size(F.filter("all", lambda t: t["new"]))).withColumn("n_context", F.size("all") - F.col("n_new"))
    head, tail = len(START) + 1, len(END)
    return c.select(
        F.col("conv").alias(conv_col),
        "window",
        F.array_join(F.transform("all", lambda x: F.concat(F.lit(START), x["r"], F.lit("\n"), x["x"], F.lit(END))), "").alias("formatted"),
        "n_context",
        "n_new",
        F.aggregate("all", F.lit(0).cast("long"), lambda s, x: s + x["tok"]).alias("n_tokens"),
        F.expr(f"""aggregate(all, named_struct('at', 0, 'loss', cast(array() as array<struct<start:int,stop:int>>)),
            (s, t) -> named_struct('at', s.at + {head + tail} + length(t.r) + length(t.x), 'loss',
              IF(t.new AND t.role = 'assistant', array_append(s.loss, named_struct('start', s.at + {head} + length(t.r), 'stop', s.at + {head} + length(t.r) + length(t.x))), s.loss)),
            s -> s.loss)""").alias("loss"),
    )


def read_back(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv, n_turns, turns array<struct<role,text>>, loss_text, formatted_chars): what formatted windows say.

    Parses `formatted` alone for turns, skips each window's repeated context, and takes the text under the
    loss mask from its ranges. Takes windows as `format_windows` makes them: none of their columns is null; a null conversation id is
    a conversation; repeated rows of a window count as often as they occur, and rows of one window are ordered by their turns. No windows give
    no rows. A conversation's turns and loss text are one row, as any digest of it needs. Other columns are not read.
    """
    w = windows.withColumn("parts", F.expr(r"slice(split(formatted, '<\\|im_end\\|>\n', -1), n_context + 1, n_new)"))
    body = lambda p: F.substr(p, F.lit(len(START) + 1))
    w = w.withColumn(
        "turns",
        F.transform(
            "parts",
            lambda p: F.struct(
                _unescape_role(F.substring_index(body(p), "\n", 1)).alias("role"),
                unescape(F.substr(body(p), F.instr(body(p), "\n") + 1)).alias("text"),
            ),
        ),
    )
    w = w.withColumn("lost", F.transform("loss", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["stop"] - s["start"]))))
    g = w.groupBy(conv_col).agg(
        F.array_sort(F.collect_list(F.struct("window", "turns", "lost"))).alias("ws"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    return g.select(
        conv_col,
        F.flatten(F.transform("ws", lambda x: x["turns"])).alias("turns"),
        F.array_join(F.flatten(F.transform("ws", lambda x: x["lost"])), "").alias("loss_text"),
        "formatted_chars",
    ).withColumn("n_turns", F.size("turns").cast("long"))
