"""Token counts by a finite-state tokenizer.

Byte-pair encoding of a word is compiled into a deterministic transducer. Reading left to right, the last
token of every prefix is unique: it is the one token that ends there and may stand behind the last token of the
prefix before it. A state therefore holds, for each place where a token still open may have begun, its node in
the vocabulary trie, the last token before it and the tokens counted so far; a transition is annotated
with the change in that count. States are compiled on first use and dropped, to be made again, at `max_states`.

A batch of texts is one stream of symbols (bytes, marked at the end of a word), cut into equal chunks that are
read side by side, one table step for all of them. A word's end leads to the start state whatever came before, so
the map of a chunk that holds one is constant. A chunk without one gets its map over all states that can enter it:
each map starts with one state, and the states that a map gives are added to what the next map is asked, until
nothing new comes. The maps are then composed by a parallel prefix scan (doubling), which gives the state that enters
each chunk, and all chunks are read once more from there.

Normalization and the classes of characters are asked of the tokenizers library itself, so both follow its version of
Unicode, not Python's. Words are contractions, runs of letters, single numerals and runs of other signs; white space
is dropped; special strings of the vocabulary file count as one token each.

Defined cases: null and empty texts have no bytes and no tokens; repeated rows are counted one by one.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer, pre_tokenizers

from .common import small_batches

FINAL = 256
SPACE, LETTER, NUMBER, OTHER, SPECIAL = range(5)
_SPECIAL_CHAR = "\ud800"  # a lone surrogate: no text holds it
_BEYOND_LATIN = re.compile("[^\x00-\u02ff]")


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, the rest follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def char_classes() -> np.ndarray:
    """Class of every code point, as the library's patterns see it."""
    out = np.full(0x110000, OTHER, np.uint8)
    for first, end in ((0, 0xD800), (0xE000, 0x110000)):
        every = "".join(map(chr, range(first, end)))
        for pattern, kind in ((r"\s+", SPACE), (r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
            for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every):
                out[first + a : first + b] = kind
    out[ord(_SPECIAL_CHAR)] = SPECIAL
    return out


class Transducer:
    """Lazily built transition table over compact symbols."""

    def __init__(self, path: str, max_states: int = 100_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        letters, suffix = byte_letters(), spec["model"]["end_of_word_suffix"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]

        def symbols(token: str) -> tuple[int, ...]:
            final = token.endswith(suffix)
            s = [letters[c] for c in (token[: -len(suffix)] if final else token)]
            return (*s[:-1], s[-1] + FINAL) if final else tuple(s)

        self.rank = {(symbols(a), symbols(b)): r for r, (a, b) in enumerate(merges)}
        tokens = {a + b for a, b in self.rank} | {(s,) for s in range(2 * FINAL)}
        # trie: node -> {symbol: node}; token_at: node -> token number, 0 where none ends
        self.trie: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [0]
        self.tokens: list[tuple[int, ...]] = [()]
        for t in sorted(tokens):
            node = 0
            for s in t:
                if s not in self.trie[node]:
                    self.trie[node][s] = len(self.trie)
                    self.trie.append({})
                    self.token_at.append(0)
                node = self.trie[node][s]
            self.token_at[node] = len(self.tokens)
            self.tokens.append(t)
        self.max_states = max_states
        self.pairs: dict[tuple[int, int], bool] = {}
        self.column = np.full(2 * FINAL, -1, np.int32)
        self.symbol: list[int] = []
        self.reset(64)

    def encode(self, s: tuple[int, ...]) -> list[tuple[int, ...]]:
        parts = [(x,) for x in s]
        while len(parts) > 1:
            ranks = [self.rank.get(p, sys.maxsize) for p in zip(parts, parts[1:], strict=False)]
            k = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[k] == sys.maxsize:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def follows(self, before: int, token: int) -> bool:
        """Whether `token` stays whole behind `before` (0: at a word's start)."""
        known = self.pairs.get((before, token))
        if known is None:
            a, b = self.tokens[before], self.tokens[token]
            known = self.encode(a + b) == ([a, b] if a else [b])
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            self.pairs[before, token] = known
        return known

    def reset(self, width: int) -> None:
        self.width = width
        self.states: dict[tuple, int] = {}
        self.config: list[tuple] = []
        self.next = np.full(256 * width, -1, np.int32)
        self.emit = np.zeros(256 * width, np.int8)
        self.start = self.state(((0, 0, 0),))

    def state(self, config: tuple) -> int:
        k = self.states.get(config)
        if k is None:
            k = self.states[config] = len(self.config)
            self.config.append(config)
            if (k + 1) * self.width > len(self.next):
                self.next = np.concatenate([self.next, np.full(len(self.next), -1, np.int32)])
                self.emit = np.concatenate([self.emit, np.zeros(len(self.emit), np.int8)])
        return k

    def step(self, config: tuple, symbol: int) -> tuple[tuple, int]:
        """The configuration behind a symbol and the change in tokens."""
        token, gain, open_ = 0, 0, []
        for node, before, count in config:
            child = self.trie[node].get(symbol)
            if child is None:
                continue
            t = self.token_at[child]
            if t and not token and self.follows(before, t):
                token, gain = t, count + 1
            if self.trie[child]:
                open_.append((child, before, count))
        if symbol >= FINAL:
            return ((0, 0, 0),), gain
        return (*((n, b, c - gain) for n, b, c in open_), (0, token, 0)), gain

    def columns(self, stream: np.ndarray) -> np.ndarray:
        """Compact symbols; the table is made wider where new ones come."""
        for s in np.flatnonzero(np.bincount(stream, minlength=2 * FINAL) * (self.column < 0)):
            self.column[s] = len(self.symbol)
            self.symbol.append(int(s))
        if len(self.symbol) > self.width:
            self.reset(min(2 * FINAL, len(self.symbol) + 32))
        return self.column[stream]

    def advance(self, state: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and emitted counts of all lanes."""
        at = state * self.width + column
        to = self.next[at]
        if (to < 0).any():
            for x in np.unique(at[to < 0]).tolist():
                config, gain = self.step(self.config[x // self.width], self.symbol[x % self.width])
                self.next[x] = self.state(config)  # may enlarge the tables first
                self.emit[x] = gain
            to = self.next[at]
        return to, self.emit[at]

    def read(self, stream: np.ndarray, chunk: int = 256, block: int = 1 << 20) -> np.ndarray:
        """Tokens emitted at each symbol of a stream that begins at a word's start."""
        out, config = [np.empty(0, np.int16)], self.config[self.start]
        for at in range(0, len(stream), block):
            if len(self.config) > self.max_states:
                self.reset(self.width)
            column = self.columns(stream[at : at + block])
            emitted, state = self._read_block(column, stream[at : at + block] >= FINAL, self.state(config), chunk)
            out.append(emitted)
            config = self.config[state]
        return np.concatenate(out)

    def _read_block(self, column: np.ndarray, final: np.ndarray, entry: int, chunk: int) -> tuple[np.ndarray, int]:
        """Emitted tokens and the last state."""
        n = len(column)
        lanes = -(-n // chunk)
        grid = np.zeros(lanes * chunk, np.int64)
        grid[:n] = column
        grid = np.ascontiguousarray(grid.reshape(lanes, chunk).T)
        live = np.minimum(chunk, n - chunk * np.arange(lanes))
        padded = np.zeros(lanes * chunk, bool)
        padded[:n] = final
        ends = padded.reshape(lanes, chunk)
        closed = ends.any(1)
        first = np.where(closed, ends.argmax(1), live)  # place of the first word end of each chunk
        out = np.zeros((chunk, lanes), np.int16)
        # behind its first word end a chunk's map is constant: read that part of all chunks from the start state
        state = np.full(lanes, self.start, np.int64)
        for t in range(chunk):
            on = np.flatnonzero((first < t) & (t < live))
            if len(on):
                state[on], out[t, on] = self.advance(state[on], grid[t, on])
        enter = np.concatenate([[entry], np.where(closed, state, -1)[:-1]])
        if (enter < 0).any():
            self._enter(enter, np.flatnonzero(~closed), grid, live)
        last, most = enter.copy(), np.where(closed, first, live - 1)
        for t in range(int(most.max()) + 1):
            on = np.flatnonzero(t <= most)
            last[on], out[t, on] = self.advance(last[on], grid[t, on])
        return out.T.ravel()[:n], int(state[-1] if closed[-1] and first[-1] < live[-1] - 1 else last[-1])

    def _enter(self, enter: np.ndarray, open_: np.ndarray, grid: np.ndarray, live: np.ndarray) -> None:
        """Fill in what enters the chunks behind chunks without a word end (open_), by composing the maps of those."""
        lanes = len(enter)
        maps: dict[int, dict[int, int]] = {int(k): {} for k in open_}
        lane, asked = open_, np.where(enter[open_] >= 0, enter[open_], self.start)
        while len(lane):
            now = asked
            for t in range(len(grid)):
                on = np.flatnonzero(t < live[lane])
                moved = now.copy()
                moved[on] = self.advance(now[on], grid[t, lane[on]])[0]
                now = moved
            more: set[tuple[int, int]] = set()
            for k, s, e in zip(lane.tolist(), asked.tolist(), now.tolist(), strict=True):
                maps[k][s] = e
                if k + 1 in maps and enter[k + 1] < 0:
                    more.add((k + 1, e))
            more = {(k, s) for k, s in more if s not in maps[k]}
            lane, asked = np.array([k for k, _ in more], np.int64), np.array([s for _, s in more], np.int64)
        # maps as arrays over numbered states: row r maps the states of open chunk r to those of the next one
        known = [list(maps[int(k)]) for k in open_]
        after = [list(dict.fromkeys(maps[int(k)].values())) if k + 1 not in maps or enter[k + 1] >= 0 else list(maps[k + 1]) for k in open_.tolist()]
        place = [{s: i for i, s in enumerate(x)} for x in after]
        step = np.zeros((len(open_), max(map(len, known))), np.int64)
        for r, k in enumerate(open_.tolist()):
            step[r, : len(known[r])] = [place[r][maps[k][s]] for s in known[r]]
        # a run of open chunks begins where the state is known
        head = enter[open_] >= 0
        offset = np.arange(len(open_)) - np.maximum.accumulate(np.where(head, np.arange(len(open_)), 0))
        begin = np.array([known[r].index(enter[k]) if head[r] else 0 for r, k in enumerate(open_.tolist())])
        span = 1
        while span <= offset.max():
            on = np.flatnonzero(offset >= span)
            step[on] = np.take_along_axis(step[on], step[on - span], 1)
            span *= 2
        for r, k in enumerate(open_.tolist()):
            if k + 1 < lanes:
                enter[k + 1] = after[r][step[r, begin[r - offset[r]]]]


class Counter:
    """Counts the tokens of many texts at once."""

    def __init__(self, path: str, classes: np.ndarray | None = None):
        self.transducer = Transducer(path)
        self.classes = char_classes() if classes is None else classes
        self.special = re.compile("|".join(map(re.escape, self.transducer.specials)))
        self.library = Tokenizer.from_file(path).normalizer

    def normal(self, text: str) -> str:
        if "<|" in text:  # special strings stand apart before anything is normalized
            return _SPECIAL_CHAR.join(map(self._normal, self.special.split(text)))
        return self._normal(text)

    def _normal(self, text: str) -> str:
        if _BEYOND_LATIN.search(text):
            return self.library.normalize_str(text)
        return text.lower()  # letters up to U+02FF are composed already

    def count(self, texts: list[str]) -> np.ndarray:
        normal = [self.normal(x) for x in texts]
        whole = "\n".join(normal) + "\n"
        point = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.classes[point]
        before = np.concatenate([[SPACE], kind[:-1]]).astype(np.uint8)
        begin = (kind != before) | (kind == NUMBER) | (kind == SPECIAL)
        after = np.concatenate([kind[1:], [SPACE]])
        quote = np.flatnonzero((point == 39) & (before != OTHER) & (after == LETTER))
        if len(quote):
            padded = np.concatenate([point, np.zeros(3, np.uint32)])
            a, b = padded[quote + 1], padded[quote + 2]
            size = np.where(np.isin(a, [ord(c) for c in "stmd"]), 1, 0)
            for x, y in ("re", "ve", "ll"):
                size[(a == ord(x)) & (b == ord(y))] = 2
            quote, size = quote[size > 0], size[size > 0]
            begin[quote + 1] = False
            rest = quote + 1 + size
            begin[rest[kind[rest] == LETTER]] = True
        last = np.concatenate([begin[1:], [True]]) & (kind != SPACE)
        data = np.frombuffer(whole.encode("utf-8", "surrogatepass"), np.uint8)
        lead = (data & 0xC0) != 0x80
        owner = np.cumsum(lead) - 1
        closes = np.concatenate([lead[1:], [True]]) & last[owner]
        keep = (kind[owner] != SPACE) & (kind[owner] != SPECIAL)
        tokens = np.zeros(len(data) + 1, np.int64)
        tokens[:-1][keep] = self.transducer.read(data[keep].astype(np.int64) + FINAL * closes[keep])
        tokens[:-1][lead] += kind == SPECIAL
        bounds = np.concatenate([[0], np.cumsum([len(x.encode("utf-8", "surrogatepass")) + 1 for x in normal])]).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(tokens)])
        return total[bounds[1:]] - total[bounds[:-1]]


_COUNTERS: dict[str, Counter] = {}


def counter(path: str, classes: np.ndarray) -> Counter:
    """One compiled transducer a worker process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path, classes)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, batch_chars: int = 1_000_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), one row per row of docs."""
    small_batches(docs.sparkSession)
    classes = docs.sparkSession.sparkContext.broadcast(char_classes())  # a byte for each code point

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = counter(path, classes.value)
        for batch in batches:
            texts = [x or "" for x in batch["text"]]
            n, at = [], 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= batch_chars):
                    size += len(texts[end])
                    end += 1
                n.append(c.count(texts[at:end]))
                at = end
            n_tokens = np.concatenate(n) if n else np.empty(0, np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_bytes": np.array([len(x.encode("utf-8", "surrogatepass")) for x in texts], np.int64), "n_tokens": n_tokens, "over_limit": n_tokens > limit})

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInPandas(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
