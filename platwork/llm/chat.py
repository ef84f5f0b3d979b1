"""Transcript parsing: roles of plain transcripts by a hidden Markov model, then canonical turns.

A state is a role together with whether a line opens a turn or continues it. A line is observed
by its speaker marker, its length and how it ends. Chances are counted on labelled turns.
Viterbi's best path needs a transcript in order, yet a long one need not sit in one task: each
chunk of lines (bounded in lines, whatever the transcript) is first reduced to the best score between every state before and after it, these
small matrices are chained per transcript, and then every chunk is decoded between the states
that the chain has fixed, which gives the very path of the whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platwork.llm.frames import written

ROLES = ("system", "user", "assistant")
#: Names that transcripts give the roles.
NAMES = {
    "system": ("system", "sys", "instructions"),
    "user": ("user", "human", "customer", "q", "question"),
    "assistant": ("assistant", "ai", "bot", "model", "a", "answer"),
}
LENGTHS = (0, 40, 160)
#: Lines in a chunk of a transcript at most.
CHUNK = 1 << 16
STATES = 2 * len(ROLES)

MARKER = (
    r"^\s*(?:#{1,4} *|<\|?|\[|\*\*)?(" + "|".join(n for names in NAMES.values() for n in names) + r")(?:\|?>|\]|\*\*)?\s*(?::|$|(?<=[>\]*]))\s*"
)


def marker(line: Column) -> Column:
    """0 without a speaker marker, else 1 more than the role's place."""
    name = F.lower(F.regexp_extract(line, "(?i)" + MARKER, 1))
    out = F.lit(0)
    for i, role in enumerate(ROLES):
        out = F.when(name.isin(*NAMES[role]), i + 1).otherwise(out)
    return out


def observation(line: Column) -> Column:
    """One number for marker, length class and a question mark at the end."""
    length = sum((F.when(F.length(line) > n, 1).otherwise(0) for n in LENGTHS), F.lit(0))
    asks = F.when(F.rtrim(line).endswith("?"), 1).otherwise(0)
    return ((marker(line) * (len(LENGTHS) + 1) + length) * 2 + asks).cast("int")


OBSERVATIONS = (len(ROLES) + 1) * (len(LENGTHS) + 1) * 2


def numbered(df: DataFrame, by: list[str], name: str, label: str) -> DataFrame:
    """The rows with their places in the order of some columns, from 0 and without gaps.

    Ranges of the order are sorted in tasks of their own and counted; equal rows are dealt out by where
    they were read, so no number of them meets in one task. Only a row per task is summed in one place.
    """
    salted = df.withColumn("__salt", F.monotonically_increasing_id())
    keys = [*by, "__salt"]
    rows = written(
        salted.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__place", F.monotonically_increasing_id()).drop("__salt"),
        label,
    )
    # The first bits of a place are the number of its task.
    task = F.shiftright("__place", 33)
    before = F.sum("count").over(Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1))
    counts = rows.groupBy(task.alias("__task")).count().select("__task", F.coalesce(before, F.lit(0)).alias("__before"))
    # A row per task of the sort, so small whatever the data.
    placed = rows.join(F.broadcast(counts), task == F.col("__task"))
    return placed.withColumn(name, F.col("__before") + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))).drop("__task", "__before", "__place")


def _role(column: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ROLES)), column).cast("int") - 1


def fit(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Log chances of starts, transitions and observations, from lines as `transcripts` makes them
    (line_no: the place of the line's turn among all; i: the line's place in its turn). Every count is
    one more than seen; rows without a known role are left out, repeated turns count each. Only a few
    dozen sums reach the driver.
    """
    rows = labelled.select(
        "conv_id", "turn", "line_no", _role(F.col("role")).alias("role"), "i", observation(F.col("line")).alias("seen")
    ).where("role >= 0")
    seen = np.ones((STATES, OBSERVATIONS))
    state = F.col("role") * 2 + F.when(F.col("i") > 0, 1).otherwise(0)
    for r in rows.groupBy(state.alias("s"), "seen").count().collect():
        seen[r["s"], r["seen"]] += r["count"]
    turns = rows.groupBy("line_no", "conv_id", "turn", "role").agg((F.max("i") + 1).alias("n"))
    move, start = np.ones((STATES, STATES)), np.full(STATES, 1e-3)
    start[::2] = 1
    for r in turns.groupBy("role").agg(
        F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("more"), F.sum(F.greatest(F.col("n") - 2, F.lit(0))).alias("on"),
        F.sum(F.when(F.col("turn") == 0, 1).otherwise(0)).alias("first"),
    ).collect():
        a = 2 * r["role"]
        move[a, a + 1] += r["more"]
        move[a + 1, a + 1] += r["on"]
        start[a] += r["first"]
    # Turns lie one behind the other, so each meets one next turn at most.
    after = turns.select((F.col("line_no") - 1).alias("before"), F.col("conv_id").alias("of_conv"), F.col("role").alias("next"))
    met = turns.join(after, (F.col("line_no") == F.col("before")) & F.col("conv_id").eqNullSafe(F.col("of_conv")))
    for r in met.groupBy("role", "next", (F.col("n") > 1).alias("long")).count().collect():
        move[2 * r["role"] + r["long"], 2 * r["next"]] += r["count"]
    # A line can only continue a turn of its own role.
    for s in range(STATES):
        for t in range(1, STATES, 2):
            if t // 2 != s // 2:
                move[s, t] = 1e-9
    return {
        "start": np.log(start / start.sum()),
        "move": np.log(move / move.sum(axis=1, keepdims=True)),
        "seen": np.log(seen / seen.sum(axis=1, keepdims=True)).T,
    }


def best_path(seen: np.ndarray, move: np.ndarray, before: np.ndarray, last: int | None = None) -> np.ndarray:
    """Viterbi's states for lines of log chances `seen`, from the scores of states before them."""
    score, back = before, np.empty(seen.shape, np.int64)
    for i, line in enumerate(seen):
        step = score[:, None] + move
        back[i] = step.argmax(axis=0)
        score = step.max(axis=0) + line
    out = np.empty(len(seen), np.int64)
    state = int(score.argmax()) if last is None else last
    for i in range(len(seen) - 1, -1, -1):
        out[i] = state
        state = back[i][state]
    return out


def recovered_lines(lines: DataFrame, model: dict[str, np.ndarray], chunk: int = CHUNK) -> DataFrame:
    """conv_id, line_no, i, line with the role found, whether the line opens a turn, and `at`, the line's
    place among all lines in order.

    Needs conv_id, line_no and line; line_no, and i (0 if there is no such column), order a transcript,
    gaps allowed. Every row comes out: lines under one number, repeated ones too, are lines of their own, put in order
    of their text's hash. Null lines are empty ones, rows without line_no are left out, null conv_ids make
    one transcript. However long a transcript or a turn is, a task decodes `chunk` lines at once. No rows
    give no rows; other columns are not looked at.
    """
    shared = lines.sparkSession.sparkContext.broadcast(model)
    i = F.coalesce(F.col("i").cast("long"), F.lit(0)) if "i" in lines.columns else F.lit(0).cast("long")
    plain = lines.where("line_no IS NOT NULL").select(
        "conv_id", F.col("line_no").cast("long").alias("line_no"), i.alias("i"), F.coalesce("line", F.lit("")).alias("line")
    )
    keyed = plain.withColumn("__text", F.xxhash64("line"))
    rows = numbered(keyed, ["conv_id", "line_no", "i", "__text"], "at", "transcript-lines").drop("__text").select(
        "*", F.expr(f"at DIV {chunk}").alias("chunk"), observation(F.col("line")).alias("seen")
    )
    conv = rows.schema["conv_id"].dataType.simpleString()

    def scores(part: pa.Table) -> np.ndarray:
        return shared.value["seen"][part.column("seen").to_numpy()]

    def ordered(part: pa.Table) -> pa.Table:
        return part.sort_by("at")

    def reduced(key: tuple, part: pa.Table) -> pa.Table:
        m, move = np.where(np.eye(STATES, dtype=bool), 0.0, -np.inf), shared.value["move"]
        for line in scores(ordered(part)):
            m = (m[:, :, None] + move[None]).max(axis=1) + line
        return pa.table({"conv_id": part.column("conv_id")[:1], "chunk": part.column("chunk")[:1], "best": [m.reshape(-1)]})

    def chained(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("chunk")
        best = np.array(part.column("best").to_pylist()).reshape(-1, STATES, STATES)
        # Before the first line stands a state that only the start's chances know of.
        score, back = None, []
        for m in best:
            step = m + (_entry(shared.value)[:, None] if score is None else score[:, None])
            back.append(step.argmax(axis=0))
            score = step.max(axis=0)
        last = [int(score.argmax())]
        for b in back[:0:-1]:
            last.append(int(b[last[-1]]))
        last = last[::-1]
        return pa.table(
            {
                "conv_id": part.column("conv_id"), "chunk": part.column("chunk"),
                "enters": pa.array([None, *last[:-1]], pa.int32()), "leaves": pa.array(last, pa.int32()),
            }
        )

    def decoded(key: tuple, part: pa.Table, ends: pa.Table) -> pa.Table:
        part = ordered(part)
        enters, leaves = ends.column("enters")[0].as_py(), ends.column("leaves")[0].as_py()
        before = _entry(shared.value) if enters is None else np.where(np.arange(STATES) == enters, 0.0, -np.inf)
        path = best_path(scores(part), shared.value["move"], before, leaves)
        return part.select(["conv_id", "line_no", "i", "line", "at", "chunk"]).append_column(
            "role", pa.array(np.array(ROLES)[path // 2])
        ).append_column("opens", pa.array(path % 2 == 0))

    keys = ["conv_id", "chunk"]
    ends = (
        rows.groupBy(*keys).applyInArrow(reduced, f"conv_id {conv}, chunk long, best array<double>")
        .groupBy("conv_id").applyInArrow(chained, f"conv_id {conv}, chunk long, enters int, leaves int")
    )
    return rows.groupBy(*keys).cogroup(ends.groupBy(*keys)).applyInArrow(
        decoded, f"conv_id {conv}, line_no long, i long, line string, at long, chunk long, role string, opens boolean"
    )


def _entry(model: dict[str, np.ndarray]) -> np.ndarray:
    """Scores before the first line that make the first step come out as the start's chances."""
    move, start = np.exp(model["move"]), np.exp(model["start"])
    return np.log(np.maximum(np.linalg.lstsq(move.T, start, rcond=None)[0], 1e-12))


def turns(found: DataFrame) -> DataFrame:
    """conv_id, line_no and i (of the first line), role, n_lines, text without its marker, rendered.

    A line before any opening one belongs to a turn that opens with it. Lines without a conv_id make one transcript.
    """
    chunks = found.groupBy("conv_id", "chunk").agg(
        F.max(F.when(F.col("opens"), F.col("at"))).alias("last"), F.min("at").alias("low")
    )
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy("conv_id")
    carried = chunks.select(
        "conv_id", "chunk", F.coalesce(F.max("last").over(earlier), F.min("low").over(everything)).alias("carried")
    ).withColumnsRenamed({"conv_id": "of_conv", "chunk": "of_chunk"})
    within = Window.partitionBy("conv_id", "chunk").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = found.withColumn("own", F.max(F.when(F.col("opens"), F.col("at"))).over(within)).join(
        carried, F.col("conv_id").eqNullSafe(F.col("of_conv")) & (F.col("chunk") == F.col("of_chunk"))
    )
    # A marker that stands alone leaves no line behind.
    bare = F.nullif(F.regexp_replace(F.col("line"), "(?i)" + MARKER, ""), F.lit(""))
    line = F.when(F.col("opens") & (marker(F.col("line")) > 0), bare).otherwise(F.col("line"))
    return (
        placed.groupBy("conv_id", F.coalesce("own", "carried").alias("start"), "role")
        .agg(F.sort_array(F.collect_list(F.struct("at", "line_no", "i", line.alias("line")))).alias("held"))
        .select(
            "conv_id", F.col("held")[0]["line_no"].alias("line_no"), F.col("held")[0]["i"].alias("i"), "role", F.size("held").alias("n_lines"),
            F.array_join(F.col("held.line"), "\n").alias("text"),
        )
        .withColumn("rendered", F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>\n")))
    )


#: How transcripts of different origin mark who speaks.
STYLES = (
    ("System: ", "User: ", "Assistant: "),
    ("### Instructions:\n", "### Human:\n", "### Assistant:\n"),
    ("[system] ", "[user] ", "[assistant] "),
    ("<|system|>\n", "<|user|>\n", "<|assistant|>\n"),
)
#: One turn in so many has lost its marker.
UNMARKED = 8


def transcripts(conversations: DataFrame) -> DataFrame:
    """Plain transcripts of conversation rows: lines with conv_id, turn, role, i, line_no, line.

    A line is placed by line_no, its row's place among all rows in the order of conversations and turns,
    and by i, its place in the row's text. Each conversation has a style of markers, each turn keeps or
    loses its own, both by hash. Rows without a turn are left out; rows of one turn, repeated ones too,
    stand one behind the other in order of role and text hash; null texts are empty, unknown roles have no marker.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES)))
    marks = F.array(*[F.array(*map(F.lit, s)) for s in STYLES])
    lost = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(UNMARKED)) == 0
    mark = F.when(lost, "").otherwise(F.coalesce(F.get(F.get(marks, style), _role(F.col("role"))), F.lit("")))
    rows = conversations.where("turn IS NOT NULL").select("conv_id", "turn", "role", "text", F.xxhash64("text").alias("__text"))
    return numbered(rows, ["conv_id", "turn", "role", "__text"], "line_no", "transcript-rows").select(
        "conv_id", "turn", "role", "line_no",
        F.posexplode(F.split(F.concat(mark, F.coalesce("text", F.lit(""))), "\n", -1)).alias("i", "line"),
    )


#: One conversation in so many, by the crc32 of its id, is never counted.
HELD_OUT = 5


def held_out(conv_id: Column) -> Column:
    """Conversations that a model is to be tried on; those without an id are among them."""
    return F.coalesce(F.crc32(conv_id.cast("string")) % HELD_OUT == 0, F.lit(True))
