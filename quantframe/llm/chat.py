"""Transcript parsing: a hidden Markov model recovers who speaks, then turns are rendered in one form.

Hidden states are roles; what is seen of a line is its speaker marker ("User:", "AI -", "### System" ...),
whether it begins a row, its length class and whether it ends with a question mark. Emissions and two
transition tables (within a row, into a new row) are smoothed counts over all labelled rows.

Rows are range-partitioned by conversation and turn, so a conversation of any length is cut into fragments of about
`fragment_rows` rows. Texts are turned into one symbol a line once; what follows handles symbols. Each fragment yields
its max-plus matrix (best score from any role before it to any role at its end); the few matrices of a conversation
are composed in order, which gives the best role at each cut, and every fragment then backtracks alone: exactly the
Viterbi path of the whole conversation. Fragments of a batch go through each step side by side.

Defined cases: null text is one empty line; rows of one conversation with equal turn follow each other by text
hash; a null conv_id is one conversation; unknown or null roles teach nothing but are recovered; without
labelled rows markers and alternation decide; other columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

ROLES = ("system", "user", "assistant")
K = len(ROLES)
# fixed values: names that mark a speaker
NAMES = {"system": ("system", "instructions"), "user": ("user", "human", "customer", "question", "q"), "assistant": ("assistant", "ai", "bot", "model", "answer", "a")}
_BY_NAME = {n: r for r, role in enumerate(ROLES) for n in NAMES[role]}
_MARKER = re.compile(r"^\s*(?:#+\s*|<\|?|\[|\*\*)?(" + "|".join(sorted(_BY_NAME, key=len, reverse=True)) + r")(?:\|?>|\]|\*\*)?\s*(?:[:>-]|$)(?:\*\*)?\s*", re.IGNORECASE)
SYMBOLS = 4 * 2 * 4 * 2


def observe(line: str, first: bool) -> tuple[int, str]:
    """Symbol of a line and the line without its marker."""
    found = _MARKER.match(line)
    mark = 0 if not found else 1 + _BY_NAME[found[1].lower()]
    body = line[found.end() :] if found else line
    size = 0 if not body.strip() else 1 + (len(body) > 40) + (len(body) > 200)
    return ((mark * 2 + first) * 4 + size) * 2 + body.rstrip().endswith("?"), body


def is_start(symbol: int) -> bool:
    return symbol // 8 % 2 == 1 or symbol // 16 > 0


class RoleModel:
    """Log tables: start [K], cont [K, K], turn [K, K], emit [K, SYMBOLS]."""

    def __init__(self, start: np.ndarray, cont: np.ndarray, turn: np.ndarray, emit: np.ndarray):
        log = lambda x, prior: np.log((x + prior) / (x + prior).sum(-1, keepdims=True))
        speak = 1.0 - 0.95 * np.eye(K)
        speak[:, 0] = 0.05
        self.start = log(start, np.array([1.0, 1.0, 0.2]))
        self.cont = log(cont, 20.0 * np.eye(K) + 0.01)
        self.turn = log(turn, speak)
        prior = np.full((K, SYMBOLS), 0.05)
        for s in range(16, SYMBOLS):
            prior[s // 16 - 1, s] = 2.0
        self.emit = log(emit, prior)

    def step(self, symbol: int) -> np.ndarray:
        """Scores [from, to] of one line."""
        return (self.turn if is_start(symbol) else self.cont) + self.emit[None, :, symbol]

    def steps(self) -> np.ndarray:
        """Scores [symbol, from, to] of a line."""
        return np.stack([self.step(s) for s in range(SYMBOLS)])

    def matrices(self, symbols: np.ndarray, sizes: np.ndarray, opening: np.ndarray) -> np.ndarray:
        """Max-plus product over the lines of each fragment (sizes, in a row in symbols); opening: its first line begins a conversation."""
        lanes = _Lanes(symbols, sizes)
        steps, first = self.steps(), lanes.at(0)
        out = np.where(opening[lanes.order][:, None, None], (self.start + self.emit[:, first].T)[:, None, :], steps[first])
        for t in range(1, lanes.longest):
            s = lanes.at(t)
            out[: len(s)] = (out[: len(s), :, :, None] + steps[s][:, None]).max(2)
        return lanes.given_order(out)

    def paths(self, symbols: np.ndarray, sizes: np.ndarray, opening: np.ndarray, before: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Best roles of the lines of each fragment, given the role before its first and of its last line."""
        lanes = _Lanes(symbols, sizes)
        steps, order = self.steps(), lanes.order
        first = lanes.at(0)
        score = np.where(opening[order][:, None], self.start + self.emit[:, first].T, steps[first, before[order]])
        back = [np.empty((0, K), np.uint8)]
        for t in range(1, lanes.longest):
            s = lanes.at(t)
            total = score[: len(s), :, None] + steps[s]
            back.append(total.argmax(1).astype(np.uint8))
            score[: len(s)] = total.max(1)
        roles, now = np.empty(len(symbols), np.uint8), end[order].astype(np.int64)
        for t in range(lanes.longest - 1, -1, -1):
            n = lanes.open(t)
            roles[lanes.begins[:n] + t] = now[:n]
            if t:
                now[:n] = back[t][np.arange(n), now[:n]]
        return roles

    def path(self, symbols: list[int], opening: bool, before: int, end: int) -> list[int]:
        """Best roles of the lines of one fragment."""
        return self.paths(np.array(symbols), np.array([len(symbols)]), np.array([opening]), np.array([before]), np.array([end])).tolist()


class _Lanes:
    """Fragments of a batch from long to short, so that those with a line t are the first ones."""

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray):
        self.order = np.argsort(-sizes, kind="stable")
        self.symbols, self.sizes = symbols, sizes[self.order]
        self.begins = (np.cumsum(sizes) - sizes)[self.order]
        self.longest = int(self.sizes[0]) if len(sizes) else 0

    def open(self, t: int) -> int:
        return int(np.searchsorted(-self.sizes, -t, "left"))

    def at(self, t: int) -> np.ndarray:
        return self.symbols[self.begins[: self.open(t)] + t]

    def given_order(self, x: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        out[self.order] = x
        return out


def _numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a sorted partition with their number and the symbols of their lines."""
    at = 0
    for batch in batches:
        symbols = [bytes(observe(line, k == 0)[0] for k, line in enumerate(text.split("\n"))) for text in batch["text"]]
        yield batch.assign(idx=np.arange(at, at + len(batch)), symbols=symbols)
        at += len(batch)


def ordered_rows(conversations: DataFrame, fragment_rows: int = 20_000) -> DataFrame:
    """(conv, turn, th, text, role number, frag, idx, symbols) sorted by conversation and turn within range partitions (frag)."""
    known = F.when(F.lower("role").isin(*_BY_NAME), F.create_map(*[F.lit(x) for p in _BY_NAME.items() for x in p])[F.lower("role")])
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(-(2**63))).alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("text", F.lit("")).alias("text"), known.alias("role"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    parts = max(int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-conversations.count() // fragment_rows))
    order = ["conv", F.col("turn").asc_nulls_first(), "th"]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("frag", F.spark_partition_id())
    return rows.select("conv", "turn", "th", "text", "role", "frag").mapInPandas(_numbered, "conv long, turn long, th long, text string, role int, frag int, idx long, symbols binary")


def _whole_fragments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows in frames that cut no fragment."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        conv, frag = batch["conv"].to_numpy(), batch["frag"].to_numpy()
        other = np.flatnonzero((conv != conv[-1]) | (frag != frag[-1]))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield pd.concat([*held, batch.iloc[:cut]])
            held = [batch.iloc[cut:]]
        elif held and (held[0]["conv"].iloc[-1] != conv[0] or held[0]["frag"].iloc[-1] != frag[0]):
            yield pd.concat(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pd.concat(held)


_FRAGMENT = "kind string, conv long, frag int, a int, b int, n long, sizes array<int>, symbols binary"


def _fragments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row (kind 'end') for each fragment: first and last role (-1 where it is not known), number of its first row,
    lines of each row, symbols of all; and the counts of the task."""
    emit, cont, turn = np.zeros((K, SYMBOLS), np.int64), np.zeros((K, K), np.int64), np.zeros((K, K), np.int64)
    for rows in _whole_fragments(batches):
        conv, frag, known = rows["conv"].to_numpy(), rows["frag"].to_numpy(), rows["role"].fillna(-1).to_numpy().astype(np.int64)
        sizes = rows["symbols"].map(len).to_numpy()
        raw = b"".join(rows["symbols"])
        role = np.repeat(known, sizes)
        emit += np.bincount((role * SYMBOLS + np.frombuffer(raw, np.uint8))[role >= 0], minlength=K * SYMBOLS).reshape(K, SYMBOLS)
        cont += np.diag(np.bincount(known[known >= 0], (sizes - 1)[known >= 0], K).astype(np.int64))
        new = np.concatenate([[True], (conv[1:] != conv[:-1]) | (frag[1:] != frag[:-1])])
        said = np.flatnonzero(~new & (known >= 0) & (np.roll(known, 1) >= 0))
        turn += np.bincount(known[said - 1] * K + known[said], minlength=K * K).reshape(K, K)
        starts = np.flatnonzero(new)
        ends = np.concatenate([starts[1:], [len(rows)]])
        at = np.concatenate([[0], np.cumsum(sizes)])
        pieces = [raw[x:y] for x, y in zip(at[starts].tolist(), at[ends].tolist(), strict=True)]
        lines = [sizes[x:y].astype(np.int32) for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]
        yield pd.DataFrame({"kind": "end", "conv": conv[starts], "frag": frag[starts], "a": known[starts], "b": known[ends - 1], "n": rows["idx"].to_numpy()[starts], "sizes": pd.Series(lines, dtype=object), "symbols": pieces})
    found = [(kind, 0, 0, int(a), int(b), int(x[a, b]), None, None) for kind, x in (("emit", emit), ("cont", cont), ("turn", turn)) for a, b in zip(*np.nonzero(x), strict=True)]
    yield pd.DataFrame(found, columns=["kind", "conv", "frag", "a", "b", "n", "sizes", "symbols"])


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int, int, int]]:
    """Best role before and at the end of each fragment; the fragments of a conversation come one after another, in order."""
    rows = (row for batch in batches for row in zip(batch["conv"].tolist(), batch["frag"].tolist(), batch["m"], strict=True))
    for conv, parts in groupby(rows, key=lambda row: row[0]):
        score, back, frags = np.zeros(K), [], []
        for _, frag, m in parts:
            total = score[:, None] + np.asarray(m).reshape(K, K)
            back.append(total.argmax(0))
            score = total.max(0)
            frags.append(frag)
        ends = [int(score.argmax())]
        for b in reversed(back[1:]):
            ends.append(int(b[ends[-1]]))
        ends = ends[::-1]
        yield from zip([conv] * len(frags), frags, [0, *ends[:-1]], ends, strict=True)


def _compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    found = _ends(batches)
    while some := list(islice(found, 10_000)):
        yield pd.DataFrame(some, columns=["conv", "frag", "before_role", "end_role"])


def _turns(conv: int, turn: object, given: object, text: str, roles: bytes) -> Iterator[tuple]:
    """The rendered turns of one row."""
    out: list[tuple[int, list[str]]] = []
    for line, r in zip(text.split("\n"), roles, strict=True):
        body = observe(line, False)[1]
        if out and out[-1][0] == r:
            out[-1][1].append(body)
        else:
            out.append((r, [body]))
    turn, said = (None if pd.isna(x) else int(x) for x in (turn, given))
    for p, (r, body) in enumerate(out):
        yield None if conv == -(2**63) else conv, turn, p, ROLES[r], None if said is None else ROLES[said], len(body), f"<|{ROLES[r]}|>\n" + "\n".join(body)


def _render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [t for row in zip(*(batch[c].tolist() for c in ("conv", "turn", "role", "text", "roles")), strict=True) for t in _turns(*row)]
        yield pd.DataFrame(found, columns=["conv_id", "turn", "part", "role", "given_role", "n_lines", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})


def parse(conversations: DataFrame, fragment_rows: int = 20_000) -> DataFrame:
    """One row per recovered turn: conv_id, turn (of the row), part (run of one role in that row), role, given_role, n_lines, text (rendered)."""
    small_batches(conversations.sparkSession)
    rows = materialize(ordered_rows(conversations, fragment_rows), "chat")
    # the folder keeps neither partitions nor order; texts stay behind from here
    light = rows.select("conv", "frag", "idx", "role", "symbols").repartition("conv", "frag").sortWithinPartitions("conv", "frag", "idx")
    found = materialize(light.mapInPandas(_fragments, _FRAGMENT), "chat-fragments")
    tables = {"cont": np.zeros((K, K)), "turn": np.zeros((K, K)), "emit": np.zeros((K, SYMBOLS))}
    start = np.zeros(K)
    for kind, a, b, n in found.where("kind in ('cont', 'turn', 'emit')").groupBy("kind", "a", "b").agg(F.sum("n")).collect():
        tables[kind][a, b] += n
    fragments = found.where("kind = 'end'")
    cut = fragments.selectExpr("conv", "frag", "a", "lag(b) over (partition by conv order by frag) as before", "row_number() over (partition by conv order by frag) as k")
    for k1, before, a, n in cut.groupBy(F.col("k") == 1, "before", "a").agg(F.count(F.lit(1))).collect():
        if a >= 0 and k1:
            start[a] += n
        elif a >= 0 and before is not None and before >= 0:
            tables["turn"][before, a] += n
    shared = conversations.sparkSession.sparkContext.broadcast(RoleModel(start, tables["cont"], tables["turn"], tables["emit"]))
    openings = cut.select(F.col("conv").alias("c"), F.col("frag").alias("f"), (F.col("k") == 1).alias("opening"))
    opened = fragments.join(openings, (F.col("conv") == F.col("c")) & (F.col("frag") == F.col("f")))

    def lanes(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(batch["symbols"]), np.uint8), batch["symbols"].map(len).to_numpy(), batch["opening"].to_numpy().astype(bool)

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch[["conv", "frag"]].assign(m=list(shared.value.matrices(*lanes(batch)).reshape(len(batch), K * K)))

    def paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                roles = shared.value.paths(*lanes(batch), batch["before_role"].to_numpy(), batch["end_role"].to_numpy()).tobytes()
                lines = np.concatenate(list(batch["sizes"]))
                n_rows = batch["sizes"].map(len).to_numpy()
                at = np.concatenate([[0], np.cumsum(lines)]).tolist()
                idx = np.arange(len(lines)) + np.repeat(batch["n"].to_numpy() - (np.cumsum(n_rows) - n_rows), n_rows)
                yield pd.DataFrame({"f": np.repeat(batch["frag"].to_numpy(), n_rows), "i": idx, "roles": [roles[x:y] for x, y in zip(at, at[1:], strict=False)]})

    pieces = opened.select("conv", "frag", "symbols", "opening").mapInPandas(matrices, "conv long, frag int, m array<double>")
    ends = pieces.repartition("conv").sortWithinPartitions("conv", "frag").mapInPandas(_compose, "conv long, frag int, before_role int, end_role int")
    ends = materialize(ends.withColumnsRenamed({"conv": "ec", "frag": "ef"}), "chat-ends")
    both = opened.join(ends, (F.col("conv") == F.col("ec")) & (F.col("frag") == F.col("ef"))).select("frag", "n", "sizes", "symbols", "opening", "before_role", "end_role")
    roles = materialize(both.mapInPandas(paths, "f int, i long, roles binary"), "chat-roles")
    texts = rows.select("conv", "turn", "role", "text", "frag", "idx")
    dealt = texts.join(roles, (F.col("frag") == F.col("f")) & (F.col("idx") == F.col("i"))).select("conv", "turn", "role", "text", "roles")
    return dealt.mapInPandas(_render, "conv_id long, turn long, part long, role string, given_role string, n_lines long, text string")
