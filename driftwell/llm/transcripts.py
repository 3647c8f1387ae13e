"""Chat formatting of raw transcripts by a hidden Markov model (operator 1).

A transcript is a text of lines, some with speaker markers of any style, some
without. Hidden states are the roles, each opening or going on with a turn;
what is seen of a line is its marker, length, ending and layout. The tables
are counts over labelled transcripts, summed by Spark; every count is kept, for marker words fall into
``MARKER_BUCKETS`` by hash. Viterbi recovers the roles; turns are then rendered in one canonical form.

A conversation is one row, up to ``PART_TURNS`` turns. A longer one is several rows, its parts, decoded as one chain:
each part's best scores from any state to any other are a small matrix, the
matrices of a conversation together tell the states at the parts' borders, and between these each part
is decoded. Parts' texts, one after another, are the whole rendering, so that no task ever holds all of a long conversation.

A null transcript counts as empty and has one empty line. Lines that carry no
marker take their role from the model alone. Turns of a role that is not system, user or assistant, null included, are of the
role ``other``. Rows without an id are left
out; equal rows are one turn. A null turn number counts as 0; turns of one number go by a hash of role and text. Columns other than those named are ignored. An
empty table gives no rows. ``<|`` within a turn is written ``< |``, so that no text can
pass for a marker.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.functions.columns import running_sums

from .chains import best_between, best_steps, viterbi
from .common import materialise, on_executors, slices, table

ROLES = ("system", "user", "assistant", "other")
#: Each role opens a turn (even) or goes on with it (odd).
STATES = tuple((r, opens) for r in ROLES for opens in (True, False))
#: Turns in a row of the result; a conversation of more is several rows, decoded as one.
PART_TURNS = 8192
MARKER_BUCKETS = 4096
_MARKER = re.compile(r"\s*(?:\[([A-Za-z]{1,20})\]:?|<\|([A-Za-z]{1,20})\|>|#{2,4} ([A-Za-z]{1,20}):?|([A-Za-z]{1,20}):)(?:\s+|$)")
#: Styles of speaker markers in which raw transcripts are written: system, user, assistant, other.
STYLES = [
    ("System: ", "User: ", "Assistant: ", "Tool: "),
    ("SYSTEM: ", "Human: ", "AI: ", "TOOL: "),
    ("[system] ", "[user] ", "[assistant] ", "[tool] "),
    ("<|system|> ", "<|user|> ", "<|assistant|> ", "<|tool|> "),
    ("### Context: ", "### Instruction: ", "### Response: ", "### Result: "),
    ("", "Q: ", "A: ", "R: "),
]


def marker(line: str) -> tuple[str, str]:
    """(the marker's word in lower case or "", the line without it)."""
    m = _MARKER.match(line)
    return (next(filter(None, m.groups())).lower(), line[m.end() :]) if m else ("", line)


def features(line: str) -> tuple[str, ...]:
    word, rest = marker(line)
    return (
        "m:" + (str(zlib.crc32(word.encode()) % MARKER_BUCKETS) if word else ""),
        "l:" + str(len(rest).bit_length()),
        "e:" + (rest[-1] if rest[-1:] in (".", "?", "!", ":", ",") else "x" if rest else "-"),
        "b:" + ("-" if not rest.strip() else "u" if rest[:1].isupper() else "l" if rest[:1].islower() else "o"),
    )


def states_of(turns: list[tuple[str, int]]) -> list[int]:
    """The state of each line of turns given as (role, number of lines)."""
    return [2 * ROLES.index(role) + (k > 0) for role, n in turns for k in range(n)]


@dataclass(frozen=True)
class RoleModel:
    """Log tables of the hidden Markov model. Values not seen in training share one smoothed count."""

    first: np.ndarray
    steps: np.ndarray
    emit: dict[str, np.ndarray]
    unseen: dict[str, np.ndarray]

    def lines(self, lines: list[str]) -> np.ndarray:
        """Log scores (line, state) of what is seen; lines with the same features are looked up once."""
        seen: dict[tuple[str, ...], np.ndarray] = {}
        out = np.empty((len(lines), len(STATES)))
        for k, x in enumerate(lines):
            f = features(x)
            if f not in seen:
                seen[f] = sum(self.emit.get(y, self.unseen[y[0]]) for y in f)
            out[k] = seen[f]
        return out

    def roles(self, transcripts: list[list[str]]) -> list[np.ndarray]:
        return viterbi([self.lines(x) for x in transcripts], self.first, self.steps)


def model_of(counts: dict[tuple[str, str, int], int], smooth: float = 0.5) -> RoleModel:
    """Tables from counts of ("first", "", state), ("step", earlier state, state) and ("seen", feature, state)."""
    n = len(STATES)
    possible = np.array([[(b[1] or a[0] == b[0]) for b in STATES] for a in STATES])
    first, steps = np.full(n, smooth), np.where(possible, smooth, 0.0)
    seen: dict[str, np.ndarray] = {}
    for (kind, key, state), k in counts.items():
        if kind == "first":
            first[state] += k
        elif kind == "step":
            steps[int(key), state] += k
        else:
            seen.setdefault(key, np.zeros(n))[state] += k
    first = np.where([s[1] for s in STATES], first, 0)
    emit, unseen = {}, {}
    for f in "mleb":
        values = {k: v for k, v in seen.items() if k[0] == f}
        total = sum(values.values(), np.zeros(n)) + smooth * (len(values) + 1)
        unseen[f] = np.log(smooth / total)
        emit |= {k: np.log((v + smooth) / total) for k, v in values.items()}
    with np.errstate(divide="ignore"):
        return RoleModel(np.maximum(np.log(first / first.sum()), -1e4), np.maximum(np.log(steps / steps.sum(1, keepdims=True)), -1e4), emit, unseen)


def train(labelled: DataFrame) -> RoleModel:
    """A model from labelled transcripts: ``text`` and ``turns`` (array of struct role, lines)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, str, int]] = Counter()
        for batch in batches:
            for part in slices(batch):
                for text, turns in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    states = states_of([(t["role"], t["lines"]) for t in turns])
                    if not states:
                        continue
                    counts["first", "", states[0]] += 1
                    counts.update(("step", str(a), b) for a, b in zip(states, states[1:]))
                    counts.update(("seen", f, s) for x, s in zip((text or "").split("\n"), states) for f in features(x))
                    if len(counts) > 50_000:
                        yield _rows(counts)
                        counts.clear()
        yield _rows(counts)

    # Features come from fixed sets (buckets of marker words, lengths in bits, endings, layouts), so that the counts are few however many the lines.
    found = on_executors(labelled).select("text", "turns").mapInArrow(run, "kind string, key string, state int, n long").groupBy("kind", "key", "state").agg(F.sum("n").alias("n"))
    return model_of({(r["kind"], r["key"], r["state"]): r["n"] for r in found.collect()})


def _rows(counts: Counter) -> pa.RecordBatch:
    keys = list(counts)
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())], ["kind", "key", "state", "n"])


def turns_from(lines: list[str], states: np.ndarray, goes_on: bool = False) -> list[tuple[str, str]]:
    """(role, content) of each turn; markers go, and a line that opens a turn begins one.

    With ``goes_on``, the first turn may be the rest of one that an earlier part began; its role is then "".
    """
    out: list[tuple[str, list[str]]] = []
    for line, s in zip(lines, states.tolist(), strict=True):
        role, opens = STATES[s]
        if opens or not out and not goes_on:
            out.append((role, [marker(line)[1]]))
        elif not out:
            out.append(("", [line]))
        else:
            out[-1][1].append(line)
    return [(role, "\n".join(x)) for role, x in out]


def render(turns: list[tuple[str, str]], goes_on: bool = False, ends: bool = True) -> str:
    """Turns in canonical form. A part that goes on first ends the turn before it, unless its own first lines belong to that; only the last part ends its last turn."""
    out = []
    for k, (role, content) in enumerate(turns):
        if k or goes_on:
            out.append("\n<|end|>\n" if role else "\n")
        out.append((f"<|{role}|>\n" if role else "") + content.replace("<|", "< |"))
    return "".join(out) + ("\n<|end|>\n" if ends and (turns or goes_on) else "")


SCHEMA = "id long, part long, line_roles array<string>, turn_roles array<string>, rendered string"


def _parsed(ids: pa.Array, parts: pa.Array, lines: list[list[str]], paths: list[np.ndarray], later: list[bool], last: list[bool]) -> pa.RecordBatch:
    turns = [turns_from(x, p, on) for x, p, on in zip(lines, paths, later, strict=True)]
    roles = pa.array([[STATES[s][0] for s in p.tolist()] for p in paths], pa.list_(pa.string()))
    begun = pa.array([[r for r, _ in t if r] for t in turns], pa.list_(pa.string()))
    texts = pa.array([render(t, on, end) for t, on, end in zip(turns, later, last, strict=True)], pa.string())
    return pa.RecordBatch.from_arrays([ids, parts, roles, begun, texts], ["id", "part", "line_roles", "turn_roles", "rendered"])


def parse(transcripts: DataFrame, model: RoleModel) -> DataFrame:
    """(id, part, line_roles, turn_roles, rendered) for transcripts (id long, part long, n_parts long, text).

    ``turn_roles`` has the turns that begin in the part.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                lines = [(t or "").split("\n") for t in part.column(2).to_pylist()]
                yield _parsed(part.column(0), part.column(1), lines, model.roles(lines), [False] * len(lines), [True] * len(lines))

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                k, n, before, after = (part.column(c)[0].as_py() for c in ("part", "n_parts", "before", "after"))
                lines = (part.column("text")[0].as_py() or "").split("\n")
                path = best_between(model.lines(lines), model.first if k == 0 else model.steps[before], model.steps, after)
                yield _parsed(part.column(0), part.column(1), [lines], [path], [k > 0], [k == n - 1])

    rows = on_executors(transcripts).select(F.col("id").cast("long"), F.col("part").cast("long"), "text", F.col("n_parts").cast("long"))
    one, many = rows.where("n_parts = 1").select("id", "part", "text"), rows.where("n_parts > 1")
    return one.mapInArrow(whole, SCHEMA).unionByName(many.join(borders(many, model), ["id", "part"]).mapInArrow(between, SCHEMA))


def borders(parts: DataFrame, model: RoleModel) -> DataFrame:
    """(id, part, before, after): the states of the last line before each part (-1 for the first part) and of its own last line.

    A conversation's group holds a matrix of numbers for each part, not the part's text.
    """
    n = len(STATES)

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                k = part.column("part")[0].as_py()
                found = best_steps(model.lines((part.column("text")[0].as_py() or "").split("\n")), np.repeat(model.first[None, :], n, 0) if k == 0 else model.steps, model.steps)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("part"), pa.array([found.ravel().tolist()], pa.list_(pa.float64()))], ["id", "part", "best"])

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part", ignore_index=True)
        best = [np.asarray(x).reshape(n, n) for x in rows["best"]]
        score, back = best[0][0], [np.full(n, -1)]
        for m in best[1:]:
            moves = score[:, None] + m
            back.append(moves.argmax(0))
            score = moves.max(0)
        after = [int(score.argmax())]
        for b in back[:0:-1]:
            after.append(int(b[after[-1]]))
        after = after[::-1]
        return rows[["id", "part"]].assign(before=[-1, *after[:-1]], after=after)

    return parts.mapInArrow(steps, "id long, part long, best array<double>").groupBy("id").applyInPandas(join, "id long, part long, before int, after int")


def raw_transcripts(conversations: DataFrame, unmarked: int = 4, part_turns: int = PART_TURNS) -> DataFrame:
    """Conversations as raw transcripts (id, part, n_parts, text, turns): markers in one of ``STYLES`` by conversation.

    One turn in ``unmarked``, by a hash of conversation and turn, has no marker. A part holds at most
    ``part_turns`` turns; turns of long conversations get their numbers by running sums over ranges, so that no task holds such a conversation.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES))).cast("int")
    table_of = F.array(*(F.array(*map(F.lit, s)) for s in STYLES))
    mark = F.get(F.get(table_of, style), F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")).cast("int") - 1)
    said = F.coalesce("text", F.lit(""))
    role = F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise("other")
    rows = materialise(
        conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), role.alias("role"), "text").distinct()
        .select("conv_id", F.struct("turn", F.xxhash64("role", "text").alias("tie"), "role").alias("at"), "role", F.when(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(unmarked)) == 0, said).otherwise(F.concat(mark, said)).alias("marked"))
    )
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    long = materialise(sizes.where(F.col("n") > part_turns))
    placed = rows.join(long, "conv_id", "left_anti").withColumns({"part": F.lit(0).cast("long"), "n_parts": F.lit(1).cast("long")})
    if long.head(1):
        ranks = running_sums(rows.join(long, "conv_id").select("conv_id", "at", "n", F.lit(1).alias("one")), ["conv_id"], "at", ["one"])
        numbered = ranks.select("conv_id", "at", F.floor((F.col("cum_one") - 1) / part_turns).alias("part"), F.ceil(F.col("n") / part_turns).alias("n_parts"))
        placed = placed.unionByName(rows.join(numbered, ["conv_id", "at"]).select(*placed.columns))
    grouped = placed.groupBy(F.col("conv_id").alias("id"), "part", "n_parts").agg(
        F.array_sort(F.collect_list(F.struct("at", "marked", "role", F.size(F.split("marked", "\n", -1)).alias("lines")))).alias("t")
    )
    return grouped.select("id", "part", "n_parts", F.array_join("t.marked", "\n").alias("text"), F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["lines"].alias("lines"))).alias("turns"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's raw transcript parsed and rendered, with the lines whose role was recovered rightly.

    The model is trained on the conversations whose crc32(conv_id as text) mod 4 is not 2.
    """
    raw = materialise(raw_transcripts(table(spark, sf_dir, "conversations")))
    held_out = F.pmod(F.crc32(F.col("id").cast("string")), F.lit(4)) == 2
    model = train(raw.where(~held_out))
    true = F.flatten(F.transform("turns", lambda t: F.array_repeat(t["role"], t["lines"])))
    right = F.size(F.filter(F.zip_with("line_roles", true, lambda a, b: a == b), lambda x: x)).cast("long")
    told = raw.select("id", "part", "turns", held_out.alias("held_out"))
    return parse(raw, model).join(told, ["id", "part"]).select(
        F.col("id").alias("conv_id"), "part", "held_out", F.size("line_roles").cast("long").alias("n_lines"), right.alias("n_right"),
        F.size("turn_roles").cast("long").alias("n_turns"), F.array_join("turn_roles", ",").alias("roles"), F.col("rendered").alias("text"),
    )
