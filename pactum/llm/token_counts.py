"""Token counts by a tokenizer compiled into a deterministic finite-state transducer.

A BPE encoding of a prefix changes only near its end: the encoding of text[:i] is that of text[:p] and one last
token text[p:i], and two neighbours are possible only if encoding both together gives just these two. So a state
need hold no more than the places p from which a vocabulary string can still grow: for each the node in the trie of
the vocabulary, the last token before p, and the count of tokens before p against the count at i. A transition reads
a byte, and its annotation is the change of the count. States and transitions are compiled when first needed.

Texts are cut into chunks of ``CHUNK`` bytes, wherever that falls. A chunk's state map takes each state it may start
in to the state at its end and the tokens emitted on the way; the maps of a text are composed pairwise in a tree. At
pretoken borders all states go to the start state, so of what lies between a chunk's first and last border only a count
is needed, and pretokens that lie in one chunk are counted once for all their places.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pactum.llm.buffers import pieces
from pactum.llm.pretokens import Encoder, Vocabulary, vocabulary

CHUNK = 1024
#: Bytes before a chunk that are read to guess the states it may start in within a pretoken, and from how many places.
LOOK_BACK, GUESSES = 64, 8
START = 0
NEVER = 1 << 60


class StateMap(dict):
    """What a chunk does to some states: (state at its end, tokens emitted). Others are worked out when they are asked for."""

    def __init__(self, states: set[int], run: Callable[[int], tuple[int, int]]):
        super().__init__((s, run(s)) for s in states)
        self.run = run

    def __missing__(self, state: int) -> tuple[int, int]:
        return self.setdefault(state, self.run(state))


def compose(one: StateMap, two: StateMap) -> StateMap:
    """The map of two chunks in a row."""

    def both(state: int) -> tuple[int, int]:
        mid, n = one[state]
        end, m = two[mid]
        return end, n + m

    return StateMap(set(one), both)


class Transducer:
    """State 0 is the start of a pretoken. ``limit`` bounds the transitions that are held; beyond it they are compiled anew."""

    def __init__(self, vocab: Vocabulary, limit: int = 600_000):
        self.limit = limit
        self.strings = vocab.strings
        self.merges = vocab.merges
        self.parts: dict[int, tuple[int, int, int]] = {}
        for pair, (rank, both) in vocab.merges.items():
            if both in self.parts:
                raise ValueError("a vocabulary string with two merge rules can't be compiled")
            self.parts[both] = (rank, *pair)
        self.right = functools.cache(lambda t: self._spine(t, 2))
        self.left = functools.cache(lambda t: self._spine(t, 1))
        self.fit = functools.cache(self._fit) if limit > 1 << 40 else functools.lru_cache(limit)(self._fit)
        self.child: dict[int, int] = {}
        self.token = [-1]
        self.grows = [True]
        special = set(vocab.special.values())
        for t, s in enumerate(vocab.strings):
            if s and t not in special and self._reachable(t):
                self._add(s, t)
        self._reset()

    def _reset(self):
        first = ((0, -1, 0),)
        self.states, self.number, self.steps = [first], {first: START}, {}

    def _add(self, string: bytes, t: int):
        node = 0
        for b in string:
            self.grows[node] = True
            key = node << 8 | b
            if key not in self.child:
                self.child[key] = len(self.token)
                self.token.append(-1)
                self.grows.append(False)
            node = self.child[key]
        self.token[node] = t

    def _spine(self, t: int, side: int) -> list[tuple[int, int]]:
        """From the token inwards: (symbol at that edge, rank of the merge that made it)."""
        out = []
        while t in self.parts:
            out.append((t, self.parts[t][0]))
            t = self.parts[t][side]
        return [*out, (t, -1)]

    def _fit(self, a: int, b: int, until: int = NEVER) -> bool:
        """Whether no merge of lower rank than ``until`` crosses the border of the neighbours a and b."""
        xs, ys = self.right(a), self.left(b)
        i, j = len(xs) - 1, len(ys) - 1
        while True:
            grow_x, grow_y = xs[i - 1][1] if i else NEVER, ys[j - 1][1] if j else NEVER
            if got := self.merges.get((xs[i][0], ys[j][0])):
                # of equal ranks the leftmost goes first
                if got[0] < min(grow_x, until) and got[0] <= grow_y:
                    return False
            if min(grow_x, grow_y) >= until:
                return True
            if grow_x <= grow_y:
                i -= 1
            else:
                j -= 1

    def _reachable(self, t: int) -> bool:
        """Whether encoding the token's own string gives the token."""
        todo = [t]
        while todo:
            if (p := self.parts.get(todo.pop())) is not None:
                if not self._fit(p[1], p[2], p[0]):
                    return False
                todo += p[1:]
        return True

    def step(self, state: int, byte: int) -> int:
        """Compiles one transition: next state << 8 | change of the count + 128."""
        alive, found = [], None
        for node, last, count in self.states[state]:
            node = self.child.get(node << 8 | byte, -1)
            if node < 0:
                continue
            t = self.token[node]
            if t >= 0 and found is None and (last < 0 or self.fit(last, t)):
                found = (t, count + 1)
            if self.grows[node]:
                alive.append((node, last, count))
        t, count = found
        key = (*((n, last, c - count) for n, last, c in alive), (0, t, 0))
        to = self.number.setdefault(key, len(self.states))
        if to == len(self.states):
            self.states.append(key)
        out = self.steps[state << 8 | byte] = to << 8 | count + 128
        return out

    def run(self, body: bytes, state: int = START) -> tuple[int, int]:
        """(end state, tokens emitted)."""
        steps, total = self.steps, 0
        for b in body:
            got = steps.get(state << 8 | b)
            if got is None:
                got = self.step(state, b)
            state = got >> 8
            total += (got & 255) - 128
        return state, total

    def before(self, pretoken: bytes) -> set[int]:
        """States that a chunk may start in after this part of a pretoken: the one it ends in or, if it is long, guesses from its last bytes."""
        if len(pretoken) <= LOOK_BACK:
            return {self.run(pretoken)[0]}
        return {self.run(pretoken[-LOOK_BACK + k :])[0] for k in range(GUESSES)}

    def counts(self, pretokens: list[bytes]) -> list[list[int]]:
        if len(self.steps) > self.limit:
            self._reset()
        return [[self.run(w)[1]] for w in pretokens]


def state_map(machine: Transducer, first: bytes, entered: set[int], between: int, last: bytes | None) -> StateMap:
    """The map of a chunk: the rest of a pretoken that began before it, a count of whole ones, the begin of one that goes on.

    ``last`` is None if the chunk lies within one pretoken, of which ``first`` is the part.
    """
    if last is None:
        return StateMap(entered, functools.partial(machine.run, first))
    end, n = machine.run(last)
    return StateMap(entered, lambda state: (end, machine.run(first, state)[1] + between + n))


def text_counts(machine: Transducer, encoder: Encoder, data: np.ndarray, offsets: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Tokens of each text, from the state maps of its chunks."""
    starts, lens = encoder.split(data, offsets)
    cuts = np.maximum(np.diff(offsets) - 1, 0) // chunk
    own = np.repeat(np.arange(len(cuts)), cuts)
    at = offsets[own] + chunk * (1 + np.arange(len(own)) - np.repeat(np.cumsum(cuts) - cuts, cuts))
    holder = np.searchsorted(starts, at, side="right") - 1
    inside = starts[holder] < at
    special = np.array([data[a : a + n].tobytes() in encoder.special for a, n in zip(starts[holder[inside]].tolist(), lens[holder[inside]].tolist())], bool)
    inside[np.flatnonzero(inside)[special]] = False  # a special string counts where it begins
    whole = np.ones(len(starts), bool)
    whole[holder[inside]] = False
    total = np.zeros(len(starts) + 1, np.int64)
    total[1:][whole] = encoder.solved(data, starts[whole], lens[whole])[0]
    total = np.cumsum(total)
    counts = np.diff(total[np.searchsorted(starts, offsets)])
    # (place, begin and end of the pretoken that is cut there) of the cuts of each text that has some
    places = list(zip(at.tolist(), np.where(inside, starts[holder], at).tolist(), np.where(inside, starts[holder] + lens[holder], at).tolist()))
    upto = total[np.searchsorted(starts, at)].tolist()
    body, done = data.tobytes(), 0
    for text in np.flatnonzero(cuts).tolist():
        here = slice(done, done + int(cuts[text]))
        done = here.stop
        begin, stop = int(offsets[text]), int(offsets[text + 1])
        edges = [(begin, begin, begin), *places[here], (stop, stop, stop)]
        sums = [int(total[np.searchsorted(starts, begin)]), *upto[here], int(total[np.searchsorted(starts, stop)])]
        maps = []
        for (a, head, tail), (b, head_b, _), low, high in zip(edges, edges[1:], sums, sums[1:]):
            first, entered = body[a : min(tail, b)], machine.before(body[head:a]) if head < a else {START}
            maps.append(state_map(machine, first, entered, high - low, None if head_b < a else body[head_b:b]))
        while len(maps) > 1:
            maps = [compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        counts[text] = maps[0][START][1]
    return counts


def count_tokens(docs: DataFrame, vocabulary_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) of every whole text.

    Null and empty texts have 0 bytes and 0 tokens. Special strings inside texts count as one token, as the library
    does. Rows are independent: repeated rows and null ids stay. Other columns are not carried. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocabulary_path)
        transducer = Transducer(vocab)
        encoder = Encoder({s.encode(): 1 for s in vocab.special}, transducer.counts)
        for batch in batches:
            for i, j, data, offsets in pieces(batch.column(1)):
                n = text_counts(transducer, encoder, data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
