"""Chat formatting in budgeted windows, in DataFrame functions only.

Each turn is written as `<|im_start|>role\\ntext<|im_end|>\\n`, with control strings inside role and text escaped
reversibly. Turns get token estimates, and prefix sums over a conversation's turns choose the windows: a window's step is the budget less the
system turn and the history allowance (64 at least); turns that lie inside one step's cell form a window, and a turn that crosses
into the next cell is one of its own, so a window never cuts a turn. It exceeds the budget only where a single turn is longer than a step, or
the system turn leaves less than the history allowance and 64. Every later window starts with the conversation's system turn and as much of the preceding turns as the
allowance holds (at most `history_turns`); these are repeated targets and are masked, so each assistant text is under the loss mask once.

The turns of a conversation are dealt out by runs of 256 turn numbers, so a very long one is spread over tasks. What a run needs of the runs
before it, their number of turns and tokens, their last turns and the conversation's system turn, is worked out from one row for each run and
carried into it: the windows are those of the whole conversation, whatever its length. Texts are shuffled by (conversation, run) and by
(conversation, window).

Nulls and edge cases: a null text or role is empty; a null turn sorts first; a null conversation id is a conversation of its own; rows that
repeat a turn number follow each other by role and text; the system turn is the first one in order whose role is `system`, other
system turns are plain turns; a conversation without assistant turns has an empty mask; a turn longer than the budget is
kept whole in its own window; other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
RUN = 256  # turn numbers
#: So many ids of long conversations at most are broadcast.
FEW_LONG = 100_000
#: Control strings of common chat templates, as (first character, rest); none overlaps another.
CONTROL = r"(<)(/?s>|<SYS>>|</SYS>>|\|[a-z_]+\|>)|(\[)(/?INST\])"


def escape(text: Column) -> Column:
    """Doubles backslashes, then parts each control string behind its first character by a backslash and a hyphen."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$1$3\\-$2$4")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\)|\\-", "$1")


def _role(role: Column) -> Column:
    """A role has no line break: it is written as a backslash and an n."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unrole(role: Column) -> Column:
    parts = F.split(role, r"\\\\", -1)  # what stands between doubled backslashes
    return F.array_join(F.transform(parts, lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\-"), F.lit(""))), "\\")


def tokens(text: Column) -> Column:
    """A turn's estimated tokens: a quarter of its characters, rounded up, and four for the marks."""
    return (F.ceil(F.length(text) / 4) + 4).cast("long")


def _carried(rows: DataFrame, last: int) -> DataFrame:
    """rows of turns -> for each run of a conversation with several: (key, run, ord0, begin0: turns and tokens before it, sys: the system turn, prev: the last turns before it)."""
    spans = rows.groupBy("key").agg(F.min("run").alias("lo"), F.max("run").alias("hi")).filter("lo <> hi").select("key")
    several = F.broadcast(spans) if spans.count() <= FEW_LONG else spans
    inside = Window.partitionBy("key", "run")
    order = inside.orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(several, "key", "left_semi").select("*", F.row_number().over(order).alias("o"), F.coalesce(F.sum("n").over(past), F.lit(0)).alias("b"), F.count("*").over(inside).alias("c"), F.sum("n").over(inside).alias("t"))
    placed = placed.withColumn("s", F.min(F.when(F.col("role") == "system", F.col("o"))).over(inside)).filter((F.col("o") > F.col("c") - last) | (F.col("o") == F.col("s")))
    runs = placed.groupBy("key", "run").agg(
        F.max("c").alias("c"),
        F.max("t").alias("t"),
        F.array_sort(F.collect_list(F.when(F.col("o") > F.col("c") - last, F.struct("o", "b", "n", "role", "head", "body")))).alias("tail"),
        F.max(F.when(F.col("o") == F.col("s"), F.struct("o", "n", "head", "body"))).alias("s"),
    )
    along = Window.partitionBy("key").orderBy("run")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("ord0", F.coalesce(F.sum("c").over(before), F.lit(0))).withColumn("begin0", F.coalesce(F.sum("t").over(before), F.lit(0)))
    tail = F.transform("tail", lambda x: F.struct((x["o"] + F.col("ord0")).alias("o"), (x["b"] + F.col("begin0")).alias("b"), x["n"].alias("n"), x["role"].alias("role"), x["head"].alias("head"), x["body"].alias("body")))
    first = F.when(F.col("s").isNotNull(), F.struct((F.col("s.o") + F.col("ord0")).alias("o"), F.col("s.n").alias("n"), F.col("s.head").alias("head"), F.col("s.body").alias("body")))
    runs = runs.select("key", "run", "ord0", "begin0", tail.alias("tail"), first.alias("s"))
    prev = F.array_sort(F.flatten(F.collect_list("tail").over(along.rowsBetween(-last, -1))))  # a run has a turn at least
    return runs.select("key", "run", "ord0", "begin0", F.first("s", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("sys"), prev.alias("prev")).withColumn(
        "prev", F.slice("prev", F.greatest(F.size("prev") - last + 1, F.lit(1)), F.lit(last))
    )


def windows(turns: DataFrame, budget: int = 1024, history: int = 256, history_turns: int = 4, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, window, formatted, loss array of (start, end) in code points, repeated: how many leading turns are repeats). Windows ascend along a conversation."""
    rows = turns.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit("n")).alias("key"),
        F.coalesce(F.floor(F.col(turn_col) / RUN).cast("long"), F.lit(-(1 << 62))).alias("run"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(role_col, F.lit("")).alias("role"),
        F.coalesce(text_col, F.lit("")).alias("text"),
    )
    head = F.concat(F.lit(START), _role(F.col("role")), F.lit("\n"))
    rows = rows.select("*", head.alias("head"), escape(F.col("text")).alias("body")).withColumn("n", tokens(F.concat("head", "body")))
    carried = _carried(rows, max(1, history_turns))

    # kinds of rows in a run: 2 what is carried, 1 the turns before it, 0 its own
    own = rows.select("*", F.lit(0).alias("kind"))
    more = carried.select("key", "run", "ord0", "begin0", "sys", F.lit(2).alias("kind"))
    ghosts = carried.select("key", "run", F.explode("prev").alias("p")).select("key", "run", F.col("p.o").alias("o"), F.col("p.b").alias("b"), "p.n", "p.role", "p.head", "p.body", F.lit(1).alias("kind"))
    rows = own.unionByName(more, allowMissingColumns=True).unionByName(ghosts, allowMissingColumns=True)

    inside = Window.partitionBy("key", "run")
    order = inside.orderBy(F.desc("kind"), "o", F.col("turn").asc_nulls_first(), "role", "text")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    is_own, lead = F.col("kind") == 0, lambda c, d: F.lead(c, d).over(order)
    spent = F.coalesce(F.sum(F.when(is_own, F.col("n"))).over(past), F.lit(0)) + F.coalesce(F.max("begin0").over(inside), F.lit(0))
    nth = F.count(F.when(is_own, 1)).over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.max("ord0").over(inside), F.lit(0))
    rows = rows.withColumn("begin", F.coalesce("b", spent)).withColumn("ord", F.coalesce("o", nth))
    alone = F.min(F.when(is_own & (F.col("role") == "system"), F.struct(F.col("ord").alias("o"), "n", "head", "body"))).over(inside)
    rows = rows.withColumn("sys", F.coalesce(F.max("sys").over(inside), alone))
    rows = rows.withColumn("step", F.greatest(F.lit(budget - history) - F.coalesce("sys.n", F.lit(0)), F.lit(64))).withColumn("cell", F.floor(F.col("begin") / F.col("step")))
    window = F.col("cell") * 2 + (F.floor((F.col("begin") + F.col("n") - 1) / F.col("step")) > F.col("cell")).cast("long")
    rows = rows.withColumn("window", F.when(F.col("kind") < 2, window))
    rows = rows.withColumn("opens", is_own & ~F.col("window").eqNullSafe(F.lag("window").over(order)))

    def later(d: int) -> Column:
        """The window that opens d turns on, if this turn is in its history."""
        fits = lead("opens", d) & (lead("begin", d) - F.col("begin") <= history) & (F.col("kind") < 2) & ~F.col("ord").eqNullSafe(F.col("sys.o"))
        return F.when(fits, F.struct(lead("window", d).alias("window"), F.lit(1).alias("kind"), "ord", "role", "head", "body"))

    self_ = F.when(is_own, F.struct("window", F.lit(2).alias("kind"), "ord", "role", "head", "body"))
    first = F.when(F.col("opens") & (F.col("sys.o") < F.col("ord")), F.struct("window", F.lit(0).alias("kind"), F.col("sys.o").alias("ord"), F.lit("system").alias("role"), F.col("sys.head").alias("head"), F.col("sys.body").alias("body")))
    parts = rows.select("id", "key", F.array(first, self_, *(later(d) for d in range(1, history_turns + 1))).alias("parts"))
    parts = parts.select("id", "key", F.explode(F.filter("parts", lambda p: p.isNotNull())).alias("p")).select("id", "key", "p.*")
    along = Window.partitionBy("key", "window").orderBy("kind", "ord")
    piece = F.concat("head", "body", F.lit(END))
    at = F.coalesce(F.sum(F.length(piece)).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("head")
    parts = parts.withColumn("start", at)
    loss = F.when((F.col("kind") == 2) & (F.col("role") == "assistant"), F.struct("start", (F.col("start") + F.length("body")).alias("end")))
    out = parts.groupBy("key", "window").agg(
        F.first("id", ignorenulls=True).alias("id"),
        F.array_sort(F.collect_list(F.struct("kind", "ord", piece.alias("piece")))).alias("pieces"),
        F.array_sort(F.collect_list(loss)).alias("loss"),
        F.count(F.when(F.col("kind") < 2, 1)).alias("repeated"),
    )
    return out.select(F.col("id").alias(id_col), "window", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), "loss", "repeated")


def read_back(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, window, chars, turns: array of (role, text) without repeats, targets: array of texts under the loss mask), from windows' output alone."""
    found = F.transform(
        F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda t: t != ""),
        lambda t: F.struct(
            _unrole(F.substring_index(F.substr(t, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
            unescape(F.substr(t, F.locate("\n", t) + 1)).alias("text"),
        ),
    )
    fresh = F.slice(found, F.col("repeated").cast("int") + 1, F.greatest(F.size(found) - F.col("repeated").cast("int"), F.lit(0)))
    targets = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))))
    return formatted.select(id_col, "window", F.length("formatted").alias("chars"), fresh.alias("turns"), targets.alias("targets"))
