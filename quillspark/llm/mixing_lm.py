"""Language-model scores by online logistic context mixing.

A text is a sequence of tokens: words (between white space, A-Z lower-cased) and an end. A token is
given by binary decisions:

* whether it is what followed the token before most often in the training texts, where anything did;
* if not, its path in a static Huffman code of the words that occur most (at most VOCAB), an escape
  and the end; words outside the code are spelled in a Huffman code of bytes;
* whether the white space before it is the usual one; other white space is spelled.

A decision is predicted as log-odds by several hashed contexts: on the path by the node alone and by
the node with the last word before that is among the COMMON most frequent; in a spelled piece by the
node alone, with the last two bytes and with the last three; the first decision by how sure the
training texts are of what follows and by the outcome of the last such decision. Gates (the sort of
decision and how much is known of the contexts) pick the weights with which the log-odds are mixed.
A factor on each input is refined after every STEP decisions from a text's start to its end, many
texts at once (not in spelled pieces, which cost the same wherever they stand). The sum of the
decisions' log-probabilities is that of the text (with A-Z lower-cased).

What follows each word of the training texts is counted over all of them and held in a table with a
row for each distinct word, which grows with the corpus; texts meet it by a join on the words that
are not in the code. The code and the node contexts are of a constant size and sent to all tasks: of
COMMON words, or bytes, and nodes there are only so many, so further texts make them surer but not
more. Their counts cover all training texts too, and the gates' weights are learned on every decision
of all training texts, each against the counts without itself. For that, decisions are not made
text by text: how often each symbol came in each context is counted once, and those that pass a node
of the code together are one decision with a number.

Beside it stands a word-unigram base with add-one smoothing from exact counts.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import release, written
from .textkit import SPACED, Words, binaries, hashes, mix, pieces_of, same_bytes, slices

#: log2 of the slots of the tables: nodes with a common word, with two bytes, with three bytes.
SLOTS = (21, 18, 20)
#: Slots whose counts travel together.
CHUNK = 1 << 14
#: Decisions whose slots for one context lie in one line (of 2 ** LINE slots).
LINE = 4
#: Tokens whose decisions are laid out at once.
TOKENS = 1 << 13
PACK_BYTES, SCORED_BYTES = 4 << 20, 2 << 20
#: Counts of so many packs are merged at once, and handed on beyond so many words.
HELD, HELD_WORDS = 4, 1_000_000
#: Counts of so many pairs are merged at once.
HELD_PAIRS = 1_000_000
RATE = 0.003
#: The same for decisions on what follows.
NEXT_RATE = 0.05
#: Decisions of a text between refinements of its factors.
STEP = 64
#: Words in the code at most; all others are spelled.
VOCAB = 1 << 18
#: Most frequent words, of which the last before a token is a context.
COMMON = 128
#: Sorts of decisions on a token: of a word's code, of white space; 4 gates each. A spelled byte's has 16.
WORD, SPACE = range(2)
END = 256
WEIGHT_ROUNDS = 3
#: Counts of so many symbols in their contexts are merged at once.
HELD_SYMBOLS = 2_000_000
#: Merges of these counts happen in two steps, in so many parts first.
SALTS = 64
#: Symbols in common contexts have a part for each, those of spelled pieces so many; tasks that merge parts.
SPELLED_PARTS, MERGES = 64, 16
#: Contexts of spelled pieces whose decisions are laid out at once.
LANES = 1 << 10
_EDGE = np.float32(12.0)
_SPACE_NODE, _BASE = np.uint32(0xB5297A4D), np.uint32(0x3C6EF372)
#: What follows is told by so many bits of its hash; the end and a text's start have marks.
NEXT_BITS = 36
_END, _START = 0x51ED270B, -0x7F4A7C15


class Code:
    """Huffman code of symbols 0, 1, ... The decisions of symbol s are first[s]:first[s + 1] of
    ``bit``, ``odds`` (of a one, by the node alone), ``group`` (hash of the node four or fewer
    decisions above at which a table's line begins) and ``place`` (in that line)."""

    def __init__(self, counts: np.ndarray):
        n = len(counts)
        order = np.argsort(counts, kind="stable")
        leaves, inner = deque(zip((counts[order] + 1).tolist(), order.tolist())), deque()
        above = np.full(2 * n - 1, -1, np.int64)
        side = np.zeros(2 * n - 1, np.uint8)
        weights = []
        for fresh in range(n, 2 * n - 1):
            pair = []
            for b in range(2):
                weight, at = (inner if not leaves or (inner and inner[0][0] < leaves[0][0]) else leaves).popleft()
                above[at], side[at] = fresh, b
                pair.append(weight)
            weights.append(pair)
            inner.append((sum(pair), fresh))
        zero, one = np.array(weights, np.float64).reshape(-1, 2).T
        self.tree = above.astype(np.int32), side, np.log(one / zero).astype(np.float32)

    def __reduce__(self):
        return _code, self.tree

    def __getattr__(self, name: str) -> np.ndarray:
        # Paths are several times larger than the tree: laid where one is first asked for.
        if name not in ("first", "bit", "odds", "group", "place", "packed"):
            raise AttributeError(name)
        self._lay(*self.tree)
        return self.__dict__[name]

    def _lay(self, above: np.ndarray, side: np.ndarray, odds: np.ndarray) -> None:
        n = len(odds) + 1
        paths, at, size = [], np.arange(n, dtype=np.int32), np.full(n, -1)
        while (at >= 0).any():
            paths.append(at)
            size += at >= 0
            at = np.where(at >= 0, above[at], np.int32(-1))
        self.first = np.concatenate([[0], np.cumsum(size)])
        node, self.bit = np.zeros(self.first[-1], np.int32), np.zeros(self.first[-1], np.uint8)
        for k in range(len(paths) - 1):
            own = np.flatnonzero(size > k)
            to = self.first[own + 1] - 1 - k
            node[to], self.bit[to] = paths[k + 1][own] - n, side[paths[k][own]]
        self.odds = odds[node] if len(odds) else np.zeros(0, np.float32)
        self.group, self.place = node.astype(np.uint32) * np.uint32(0x9E3779B1), np.ones(len(node), np.uint8)
        for d in range(len(paths) - 1):
            if d % LINE:
                to = self.first[:-1][size > d] + d
                self.group[to], self.place[to] = self.group[to - 1], 2 * self.place[to - 1] + self.bit[to - 1]
        # The three in one number, for one look-up.
        self.packed = self.group.astype(np.uint64) << np.uint64(32) | self.place.astype(np.uint64) << np.uint64(8) | self.bit.astype(np.uint64)


def _code(*tree: np.ndarray) -> Code:
    """From what is sent."""
    code = Code.__new__(Code)
    code.tree = tree
    return code


class Nodes:
    """The nodes of a code, of which symbols in like contexts pass many together: ``odds``, ``group``
    and ``place`` are what a path has there."""

    def __init__(self, code: Code):
        above, side, self.odds = code.tree
        self.symbols = n = len(self.odds) + 1
        own = np.flatnonzero(above >= 0)
        # What stands on either side of each: a symbol, or a node (numbered on from the symbols).
        self.below = np.zeros((n - 1, 2), np.int64)
        self.below[above[own] - n, side[own]] = own
        self.group, self.place = np.arange(n - 1).astype(np.uint32) * np.uint32(0x9E3779B1), np.ones(n - 1, np.uint8)
        self.levels = [np.array([n - 2])]
        while len(self.levels[-1]):
            at, bit = np.nonzero(self.below[self.levels[-1]] >= n)
            parent = self.levels[-1][at]
            node = self.below[parent, bit] - n
            if len(self.levels) % LINE:
                self.group[node], self.place[node] = self.group[parent], 2 * self.place[parent] + bit
            self.levels.append(node)

    def passed(self, symbol: np.ndarray, lane: np.ndarray, times: np.ndarray, lanes: int) -> tuple[np.ndarray, ...]:
        """Of symbols that came so often in the context of each lane: the decisions' nodes, lanes
        and bits, and how often each was made."""
        total = np.zeros((2 * self.symbols - 1, lanes), np.int64)
        total[symbol, lane] = times
        for node in reversed(self.levels):
            total[node + self.symbols] = total[self.below[node, 0]] + total[self.below[node, 1]]
        sides = [total[self.below[:, bit]] for bit in range(2)]
        found = [np.nonzero(x) for x in sides]
        bit = np.repeat(np.arange(2, dtype=np.uint8), [len(node) for node, _ in found])
        return *(np.concatenate(x) for x in zip(*found)), bit, np.concatenate([x[at] for x, at in zip(sides, found)])


def _scatter(x: np.ndarray) -> np.ndarray:
    """Mixes the bits of 32-bit values in place."""
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    return x


def _spread(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs first[i] .. first[i] + size[i]: each element's run and its number."""
    ends = np.cumsum(size)
    run = np.repeat(np.arange(len(size), dtype=np.int32), size)
    return run, np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - first, size)


def _slots(context: np.ndarray, group: np.ndarray, place: np.ndarray, bits: int) -> np.ndarray:
    """A line of a table of 2 ** bits slots by hash, and the place in it turned by the hash's last bits."""
    x = context ^ group
    x *= np.uint32(0x2C1B3C6D)
    x >>= np.uint32(32 - bits)
    x ^= place
    return x


@dataclass
class Decisions:
    """Decisions of some tokens (or pieces), in order, ``size`` of each; ``slots`` of each hashed
    context."""

    size: np.ndarray
    sort: np.ndarray
    bit: np.ndarray
    odds: np.ndarray
    slots: tuple[np.ndarray, ...]

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)


class Codes:
    """What the tokens are coded with. Symbols are places in ``names``; the escape and the end follow.
    ``counts`` are the words' counts, ``follow`` and ``level`` what follows a symbol most (bits of a
    hash) and how sure that is (0: nothing is known); a text's start is the last of both.
    ``sure`` has the log-odds of each level."""

    def __init__(self, names: pa.Array, counts: np.ndarray, escapes: int, ends: int, letters: np.ndarray, follow: np.ndarray, level: np.ndarray, sure: np.ndarray):
        self.names, self.counts, self.follow, self.level, self.sure = names, counts, follow, level, sure
        self.escape, self.end, self.start = len(names), len(names) + 1, len(names) + 2
        self.words = Code(np.concatenate([counts, [escapes, ends]]).astype(np.int64))
        self.letters = Code(letters)
        self.common = np.full(len(names) + 3, -1, np.int32)
        top = np.argsort(-counts, kind="stable")[:COMMON]
        self.common[top] = np.arange(len(top))
        self.common[self.start] = COMMON

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "sorted"}

    def symbols(self, names: pa.Array) -> np.ndarray:
        """Of distinct words, told by their bytes; those of one hash stand side by side."""
        out = np.full(len(names), self.escape, np.int32)
        if not len(self.names) or not len(names):
            return out
        if "sorted" not in self.__dict__:
            known, at = pieces_of(self.names)
            hashed = hashes(known, at[:-1], at[1:])
            order = np.argsort(hashed, kind="stable")
            self.sorted = known, at, order.astype(np.int32), hashed[order]
        known, at, order, hashed = self.sorted
        data, place = pieces_of(names)
        own = hashes(data, place[:-1], place[1:])
        near = np.searchsorted(hashed, own)
        open_ = np.arange(len(own))
        while len(open_):
            open_ = open_[near[open_] < len(hashed)]
            open_ = open_[hashed[near[open_]] == own[open_]]
            symbol, size = order[near[open_]], place[open_ + 1] - place[open_]
            right = at[symbol + 1] - at[symbol] == size
            right[right] = same_bytes(data, place[open_[right]], known, at[symbol[right]], size[right])
            out[open_[right]] = symbol[right]
            open_ = open_[~right]
            near[open_] += 1
        return out


def _decided(codes: Codes, symbol: np.ndarray, common: np.ndarray, odd: np.ndarray, given: np.ndarray | None = None) -> Decisions:
    """Of tokens with these symbols, contexts and unusual white space; ``given`` words need no code."""
    code = codes.words
    first = code.first[symbol]
    size = code.first[symbol + 1] - first + 1
    if given is not None:
        size[given] = 1
    last = np.cumsum(size) - 1
    at = np.arange(last[-1] + 1 if len(last) else 0)
    at += np.repeat(first - (last + 1 - size), size)
    at[last] = 0
    packed, odds = code.packed[at], code.odds[at]
    packed[last], odds[last] = np.uint64(int(_SPACE_NODE) << 32) | odd.astype(np.uint64), 0
    sort = np.zeros(len(at), np.uint8)
    sort[last] = SPACE
    slots = _slots(np.repeat(common, size), (packed >> np.uint64(32)).astype(np.uint32), (packed >> np.uint64(8)).astype(np.uint8), SLOTS[0])
    return Decisions(size, sort, packed.astype(np.uint8) & np.uint8(1), odds, (slots,))


def _behind(held: list[np.ndarray], space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The contexts of two and of three bytes, of pieces that are words or white space."""
    salt = np.where(space, 0x1234567, 0x7654321).astype(np.uint32)
    two = held[0] | held[1] << np.uint32(10)
    three = _scatter((two | held[2] << np.uint32(20)) + salt * np.uint32(3))
    return _scatter(two ^ salt), three


class Tokens:
    """Tokens of a slice of rows (rows are first[r]:first[r + 1]), their contexts, and the distinct
    pieces that are spelled with the token of each use."""

    def __init__(self, column: pa.Array, codes: Codes):
        words = Words(column, SPACED)
        rows = len(words.offsets) - 1
        self.words, n = words, len(words.start)
        self.first = words.first + np.arange(rows + 1)
        self.ends = ends = self.first[1:] - 1
        total = n + rows
        self.body = body = np.ones(total, bool)
        body[ends] = False
        self.at, self.names = words.distinct()
        self.symbols = symbols = codes.symbols(self.names)
        self.symbol = np.full(total, codes.end, np.int32)
        self.symbol[body] = symbols[self.at]
        self.before = np.full(total, codes.start, np.int32)
        self.before[1:] = self.symbol[:-1]
        self.before[self.first[:-1]] = codes.start
        # What each token is to the table of what follows.
        self.next = np.full(total, _END, np.int64)
        self.next[body] = (words.hash >> np.uint64(64 - NEXT_BITS)).astype(np.int64)
        # The last common word before each token, or the row's start.
        last = np.zeros(total, np.int64)
        last[1:] = np.where(codes.common[self.before[1:]] >= 0, np.arange(1, total), 0)
        last[self.first[:-1]] = self.first[:-1]
        self.rank = codes.common[self.before[np.maximum.accumulate(last)]]
        self.common = _scatter(self.rank.astype(np.uint32) + _BASE)
        # White space before each token; one space is usual inside a row, none at its ends.
        left, right = np.empty(total, np.int64), np.empty(total, np.int64)
        right[body], right[ends] = words.start, words.offsets[1:]
        after = np.empty(total, np.int64)
        after[body], after[ends] = words.end, words.offsets[1:]
        left[1:] = after[:-1]
        left[self.first[:-1]] = words.offsets[:-1]
        inside = body.copy()
        inside[self.first[:-1]] = False
        size = right - left
        one = np.zeros(total, bool)
        full = np.flatnonzero(inside & (size == 1))
        one[full] = words.buf[left[full]] == 0x20
        self.odd = np.where(inside, ~one, size > 0)
        # Pieces: words outside the code, then white space.
        strange = np.flatnonzero(symbols == codes.escape)
        piece_of = np.full(len(symbols), -1)
        piece_of[strange] = np.arange(len(strange))
        spelled = np.flatnonzero(body & (self.symbol == codes.escape))
        index = np.zeros(len(symbols), np.int64)
        index[self.at[::-1]] = np.arange(n)[::-1]
        odd = np.flatnonzero(self.odd)
        _, byte = _spread(left[odd], size[odd])
        coded = binaries(words.buf[byte], size[odd]).dictionary_encode()
        space_at = coded.indices.to_numpy()
        space_index = np.zeros(len(coded.dictionary), np.int64)
        space_index[space_at[::-1]] = np.arange(len(odd))[::-1]
        self.piece_start = np.concatenate([words.start[index[strange]], left[odd][space_index]])
        self.piece_end = np.concatenate([words.end[index[strange]], right[odd][space_index]])
        self.piece_space = np.arange(len(self.piece_start)) >= len(strange)
        which = np.empty(total, np.int64)
        which[body] = piece_of[self.at] if n else 0
        #: Tokens whose word is spelled, and with what; those whose white space is.
        self.spelled, self.spelled_as = spelled, which[spelled]
        self.spaced, self.spaced_as = odd, len(strange) + space_at

    def decisions(self, codes: Codes, a: int, b: int, given: np.ndarray | None = None) -> Decisions:
        """Of the tokens in [a, b): of the word's code where it is not given, then of the white space."""
        return _decided(codes, self.symbol[a:b], self.common[a:b], self.odd[a:b], None if given is None else given[a:b])

    def spelling(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of the distinct pieces [a, b): the piece of each byte and end, its symbol, and the three
        before it in the piece, the last first (0: none, else the symbol and one)."""
        start, size = self.piece_start[a:b], self.piece_end[a:b] - self.piece_start[a:b]
        piece, at = _spread(start, size + 1)
        ends = np.cumsum(size + 1) - 1
        begins = ends - size
        at[ends] = 0
        symbol = self.words.buf[at].astype(np.int32) if len(self.words.buf) else np.zeros(len(at), np.int32)
        symbol[ends] = END
        behind, held = symbol.astype(np.uint32) + np.uint32(1), []
        for _ in range(3):
            older = np.zeros(len(behind), np.uint32)
            older[1:] = behind[:-1]
            older[begins] = 0
            held.append(older)
            behind = older
        return piece, symbol, held

    def letters(self, codes: Codes, a: int, b: int) -> Decisions:
        """Of the distinct pieces [a, b): their bytes and an end."""
        piece, symbol, held = self.spelling(a, b)
        two, three = _behind(held, self.piece_space[a:b][piece])
        code = codes.letters
        first = code.first[symbol]
        byte, path = _spread(first, code.first[symbol + 1] - first)
        group, place = code.group[path], code.place[path]
        many = np.bincount(piece, code.first[symbol + 1] - first, b - a).astype(np.int64)
        return Decisions(many, np.zeros(len(byte), np.uint8), code.bit[path], code.odds[path], (_slots(two[byte], group, place, SLOTS[1]), _slots(three[byte], group, place, SLOTS[2])))

    def runs(self) -> Iterator[tuple[int, int]]:
        return ((a, min(a + TOKENS, len(self.symbol))) for a in range(0, len(self.symbol), TOKENS))

    def pieces(self) -> Iterator[tuple[int, int]]:
        """Runs of pieces of about 32 KB."""
        size = self.piece_end - self.piece_start + 1
        group = (np.cumsum(size) - size) >> 15
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(size)]
        return zip(cuts, cuts[1:]) if len(size) else iter(())

    def uses(self) -> np.ndarray:
        """How often each piece is used."""
        return np.bincount(np.concatenate([self.spelled_as, self.spaced_as]), minlength=len(self.piece_start))


def adapted(inputs: np.ndarray, first: np.ndarray, rate: float) -> np.ndarray:
    """Natural log-probability of each decision: column i of ``inputs`` has the weighted log-odds of
    the bit that came (and STEP columns of room follow), row r's are first[r]:first[r + 1]. The
    factor on each input begins at one in each row and goes up the gradient after every STEP of
    the row's decisions."""
    kinds, n, lanes = len(inputs), inputs.shape[1] - STEP, len(first) - 1
    out = np.zeros(n + STEP, np.float32)
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    order = order[: np.count_nonzero(count)]
    begin, left = first[:-1][order], count[order]
    if not len(order):
        return out[:n]
    # Rows by falling number of decisions, so that those with a t-th are a prefix.
    turns = np.arange(0, int(left[0]), STEP)
    active = np.searchsorted(-left, -turns, side="left")
    whole = np.searchsorted(-left, -turns - STEP, side="right")
    after = np.lib.stride_tricks.sliding_window_view(inputs, STEP, axis=1)
    scale = np.ones((kinds, lanes, 1), np.float32)
    steps = np.arange(STEP)
    for t, m, w in zip(turns.tolist(), active.tolist(), whole.tolist()):
        x = after[:, begin[:m] + t]
        z = (x * scale[:, :m]).sum(axis=0)
        np.clip(z, -_EDGE, _EDGE, out=z)
        e = np.exp(np.negative(z, out=z), out=z)
        # The last, short turn of a row would reach into the next.
        short = steps >= (left[w:m] - t)[:, None]
        e[w:][short] = 0
        one = e + np.float32(1)
        cost = np.log(one)
        at = (begin[:m] + t)[:, None] + steps
        if w < m:
            keep = np.ones(at.shape, bool)
            keep[w:] = ~short
            out[at[keep]] = cost[keep]
        else:
            out[at] = cost
        e /= one
        scale[:, :m, 0] += np.float32(rate) * np.einsum("lt,klt->kl", e, x)
    return -out[:n]


@dataclass
class Model:
    codes: Codes
    #: For each hashed context and slot the log-odds in sixteenths times 4, plus how much is known (0 to 3).
    tables: list[np.ndarray]
    #: Of tokens' decisions [2 * 4, 2], of spelled bytes [4 * 4, 3].
    weights: tuple[np.ndarray, np.ndarray]

    def inputs(self, made: Decisions, spelled: bool) -> np.ndarray:
        """Weighted log-odds of the bits that come."""
        gate, odds = self.looked_up(made, spelled)
        table = self.weights[spelled].astype(np.float32)
        for k, x in enumerate(odds):
            x *= table[:, k][gate]
        return odds

    def looked_up(self, made: Decisions, spelled: bool) -> tuple[np.ndarray, np.ndarray]:
        """Gates, and log-odds of the bits that come from each context."""
        found = [t[slot] for t, slot in zip(self.tables[1:] if spelled else self.tables, made.slots)]
        sign = made.bit.astype(np.float32) * np.float32(2) - np.float32(1)
        odds = np.empty((1 + len(found), len(sign)), np.float32)
        np.multiply(made.odds, sign, out=odds[0])
        sign *= np.float32(1 / 16)
        gate = made.sort.astype(np.int16)
        for k, x in enumerate(found):
            gate = gate * np.int16(4) + (x & 3)
            np.multiply(x >> 2, sign, out=odds[k + 1])
        return gate, odds

    def pieces(self, tokens: Tokens) -> np.ndarray:
        """Natural log-probability of each distinct spelled piece."""
        out = np.zeros(len(tokens.piece_start))
        for a, b in tokens.pieces():
            made = tokens.letters(self.codes, a, b)
            z = np.clip(self.inputs(made, True).sum(axis=0), -_EDGE, _EDGE)
            out[a:b] = np.bincount(made.owner, -np.log1p(np.exp(-z)), b - a)
        return out

    def costs(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Natural log-probability of each token's word, of the white space before it, and of the
        letters of each spelled word. A word may be given by what follows a word of the code or
        the start of a text; otherwise it is coded."""
        own = self.codes
        open_ = np.flatnonzero(own.level[tokens.before] > 0)
        before = tokens.before[open_]
        right = own.follow[before] == tokens.next[open_]
        given = np.zeros(len(tokens.symbol), bool)
        given[open_[right]] = True
        size = np.diff(own.words.first)[tokens.symbol] + 1
        size[given] = 1
        ends = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=ends[1:])
        flat = np.zeros((2, ends[-1] + STEP), np.float32)
        for a, b in tokens.runs():
            flat[:, ends[a] : ends[b]] = self.inputs(tokens.decisions(own, a, b, given), False)
        each = adapted(flat, ends[tokens.first], RATE)
        space = each[ends[1:] - 1].astype(np.float64)
        word = np.add.reduceat(each, ends[:-1], dtype=np.float64) - space if len(size) else space.copy()
        pieces = self.pieces(tokens)
        letters = pieces[tokens.spelled_as]
        word[tokens.spelled] += np.where(given[tokens.spelled], 0.0, letters)
        space[tokens.spaced] += pieces[tokens.spaced_as]
        word[open_] += following(right, own.sure[own.level[before]], np.searchsorted(open_, tokens.first))
        return word, space, letters


#: Weights of how sure the training texts are and of one, where the last such decision was
#: unknown (a text's first), wrong, right.
_NEXT = np.array([[1.0, 0.0], [1.0, -0.5], [1.0, 1.5]], np.float32)


def following(right: np.ndarray, sure: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Natural log-probability of each decision whether a token is what follows most: ``right``,
    with log-odds ``sure``; row r's are first[r]:first[r + 1]."""
    last = np.zeros(len(right), np.int64)
    last[1:] = 1 + right[:-1]
    last[first[:-1][first[:-1] < len(right)]] = 0
    weights = _NEXT[last].T
    sign = right.astype(np.float32) * 2 - 1
    inputs = np.zeros((2, len(right) + STEP), np.float32)
    inputs[0, : len(right)], inputs[1, : len(right)] = weights[0] * sure * sign, weights[1] * sign
    return adapted(inputs, first, NEXT_RATE)


@dataclass
class Sent:
    """A model whose codes and tables are sent to a worker once, whatever the weights."""

    codes: Broadcast
    tables: Broadcast
    weights: tuple[np.ndarray, np.ndarray]

    def model(self) -> Model:
        return Model(self.codes.value, self.tables.value, self.weights)


def _start_weights() -> tuple[np.ndarray, np.ndarray]:
    """More weight to the hashed contexts the more is known of them."""
    token, byte = np.zeros((8, 2)), np.zeros((16, 3))
    for gate in range(8):
        token[gate] = [1 - 0.25 * (gate % 4), 0.25 * (gate % 4)]
    for gate in range(16):
        two, three = gate // 4, gate % 4
        byte[gate] = [max(0.0, 1 - 0.15 * two - 0.2 * three), 0.15 * two, 0.2 * three]
    return token, byte


def _text(docs: DataFrame, text_col: str, *more: Column) -> DataFrame:
    return docs.select(*more, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


#: Kinds of counts: words, bytes of words and white space (END: tokens), rows.
_WORDS, _BYTES, _ROWS = range(3)


def counted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(kind, word, name, n)``: words with their hashes, bytes, and the number of rows, over all
    rows' texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, rows = np.zeros(257, np.int64), 0
        held: list[tuple[pa.Array, np.ndarray]] = []

        def merged() -> tuple[pa.Array, np.ndarray]:
            coded = pa.concat_arrays([names for names, _ in held]).dictionary_encode()
            return coded.dictionary, np.bincount(coded.indices.to_numpy(), np.concatenate([n for _, n in held]), len(coded.dictionary)).astype(np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            names, n = merged()
            for k in range(0, len(names), 1 << 16):
                part = names.slice(k, 1 << 16).cast(pa.binary())
                yield _rows_of(np.full(len(part), _WORDS), part, _hashed(part), n[k : k + len(part)])
            held.clear()

        for batch in slices(batches, "text", PACK_BYTES):
            words = Words(batch.column("text"), SPACED, hashed=False)
            at, names = words.distinct()
            letters += np.bincount(words.buf, minlength=257)
            letters[END] += len(at) + batch.num_rows
            rows += batch.num_rows
            held.append((names, np.bincount(at, minlength=len(names))))
            if len(held) == HELD:
                held[:] = [merged()]
                if len(held[0][0]) > HELD_WORDS:
                    yield from out()
        if held:
            yield from out()
        yield _rows_of(np.repeat([_BYTES, _ROWS], [257, 1]), pa.nulls(258, pa.binary()), np.append(np.arange(257), 0), np.append(letters, rows))

    return _text(docs, text_col).mapInArrow(count, "kind int, word binary, name long, n long").groupBy("kind", "word", "name").agg(F.sum("n").alias("n"))


def _rows_of(kind: np.ndarray, word: pa.Array, name: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), word, pa.array(name), pa.array(n.astype(np.int64))], ["kind", "word", "name", "n"])


def _hashed(names: pa.Array) -> np.ndarray:
    """The hashes that Words gives these words."""
    data, at = pieces_of(names.cast(pa.large_binary()))
    return hashes(data, at[:-1], at[1:]).view(np.int64)


def pairs(docs: DataFrame, text_col: str = "text", common: np.ndarray | None = None) -> DataFrame:
    """``(name, n, top)``: for each word, by hash, and the start of a text, how often anything
    followed, and what did most with how often it did (ties: the larger), in one number. The
    words with the hashes ``common`` are left out: anything may follow them, and as contexts of
    nodes they have counts of their own."""
    skip = np.sort(common if common is not None else np.zeros(0, np.int64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> Iterator[pa.RecordBatch]:
            every = held[0]
            for k in range(0, len(every[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + (1 << 16)]) for x in every], ["name", "after", "n"])
            held.clear()

        for batch in slices(batches, "text", PACK_BYTES):
            words = Words(batch.column("text"), SPACED)
            n, rows = len(words.hash), batch.num_rows
            at, names = words.distinct()
            first = words.first + np.arange(rows + 1)
            kinds = len(names) + 1
            token = np.full(n + rows, kinds - 1, np.int64)
            body = np.ones(n + rows, bool)
            body[first[1:] - 1] = False
            token[body] = at
            before = np.empty(n + rows, np.int64)
            before[1:] = token[:-1]
            before[first[:-1]] = kinds - 1
            hashed = _hashed(names)
            told = np.append(~np.isin(hashed, skip), True)
            both, times = np.unique((before * kinds + token)[told[before]], return_counts=True)
            name = np.append(hashed, _START)
            after = np.append((hashed.view(np.uint64) >> np.uint64(64 - NEXT_BITS)).astype(np.int64), _END)
            held.append((name[both // kinds], after[both % kinds], times))
            if sum(len(x[0]) for x in held) > HELD_PAIRS:
                held[:] = [_merged(held)]
                if len(held[0][0]) > HELD_PAIRS // 2:
                    yield from out()
        if held:
            held[:] = [_merged(held)]
            yield from out()

    # Dealt out as they come: few pairs of one task are alike once merged, and maps of them fill an executor's heap.
    every = _text(docs, text_col).mapInArrow(count, "name long, after long, n long").repartition("name", "after").groupBy("name", "after").agg(F.sum("n").alias("n"))
    # Beyond 2 ** 27 a count in ``top`` is held for that.
    one = F.shiftleft(F.least("n", F.lit((1 << 27) - 1).cast("long")), NEXT_BITS) + F.col("after")
    return every.select("name", "n", one.alias("top")).groupBy("name").agg(F.sum("n").alias("n"), F.max("top").alias("top"))


def _merged(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Pairs and their counts, those of equal pairs summed. Pairs are ordered by a hash of both and
    told apart by themselves; of one hash, a pair may stay in several parts."""
    name, after, n = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(name.view(np.uint64) ^ after.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    name, after, n = name[order], after[order], n[order]
    fresh = np.ones(len(name), bool)
    fresh[1:] = (name[1:] != name[:-1]) | (after[1:] != after[:-1])
    first = np.flatnonzero(fresh)
    return name[first], after[first], np.add.reduceat(n, first) if len(first) else n


def _level(times: str, total: str) -> str:
    """How sure it is that what came ``times`` of ``total`` times comes again: 1 to 24, 0 for none."""
    times, total = f"({times})", f"({total})"
    much = f"CASE WHEN {total} < 2 THEN 0 WHEN {total} < 4 THEN 1 WHEN {total} < 16 THEN 2 ELSE 3 END"
    share = " ".join(f"WHEN {times} >= {r} * {total} THEN {5 - k}" for k, r in enumerate((1, 0.75, 0.5, 0.25, 0.1)))
    return f"CASE WHEN {times} < 1 OR {total} < 1 THEN 0 ELSE 1 + 6 * ({much}) + CASE {share} ELSE 0 END END"


LEVELS = 25


def _sure(follows: DataFrame) -> np.ndarray:
    """Log-odds of each level, from every pair of the training texts against the counts without it."""
    parts = follows.selectExpr("n", f"shiftright(top, {NEXT_BITS}) AS c")
    # The most frequent follower's own occurrences, then those of others.
    cases = parts.selectExpr(f"{_level('c - 1', 'n - 1')} AS level", "c AS tries", "c AS hits").where("level > 0").unionByName(
        parts.selectExpr(f"{_level('c', 'n - 1')} AS level", "CASE WHEN c > 1 THEN n - c ELSE n END AS tries", "0L AS hits").where("n > 1 AND tries > 0")
    )
    out = np.zeros(LEVELS)
    for r in cases.groupBy("level").agg(F.sum("tries").alias("t"), F.sum("hits").alias("h")).collect():
        out[r["level"]] = np.log((r["h"] + 0.5) / (r["t"] - r["h"] + 0.5))
    return out


def lexicon(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, Codes, int, int, int]:
    """Of all rows' texts: the stored table ``(word, n, follow, level)`` of all words, codes, and the
    numbers of tokens, distinct tokens and rows. In the code are the words that occur most, twice
    at least; all of one 64th of an octave of counts or none, VOCAB at most."""
    counts = written(counted(docs, text_col), "lm-counts")
    top = counts.where(f"kind = {_WORDS}").orderBy(F.desc("n"), "word").limit(COMMON).collect()
    follows = written(pairs(docs, text_col, np.array([r["name"] for r in top], np.int64)), "lm-follows")
    sure = _sure(follows)
    told = follows.selectExpr("name", f"top & {(1 << NEXT_BITS) - 1}L AS follow", f"{_level(f'shiftright(top, {NEXT_BITS})', 'n')} AS level")
    unknown = F.lit(0).cast("long")
    words = counts.where(f"kind = {_WORDS}").select("word", "name", "n").join(told, "name", "left")
    words = written(words.select("word", "n", F.coalesce("follow", unknown).alias("follow"), F.coalesce(F.col("level").cast("int"), F.lit(0)).alias("level")), "lm-words")
    letters, rows = np.zeros(257, np.int64), 0
    for r in counts.where(f"kind <> {_WORDS}").collect():
        if r["kind"] == _BYTES:
            letters[r["name"]] = r["n"]
        else:
            rows = r["n"]
    graded = words.withColumn("grade", F.floor(64 * F.log2("n")))
    least, room, total, distinct = 1 << 20, VOCAB, 0, 0
    for r in sorted(graded.groupBy("grade").agg(F.count("*").alias("c"), F.sum("n").alias("n")).collect(), key=lambda r: -r["grade"]):
        total += r["n"]
        distinct += r["c"]
        room -= r["c"]
        if room >= 0 and r["grade"] > 0:
            least = r["grade"]
    chosen = graded.where(F.col("grade") >= least).drop("grade").toArrow().sort_by("word")
    n = chosen.column("n").to_numpy()
    start = told.where(F.col("name") == _START).first()
    follow, level = (np.concatenate([chosen.column(c).to_numpy(), [0, 0, start[c] if start else 0]]).astype(t) for c, t in (("follow", np.int64), ("level", np.uint8)))
    codes = Codes(chosen.column("word").combine_chunks().cast(pa.large_binary()), n, int(total - n.sum()), rows, letters, follow, level, sure)
    release(counts, follows)
    return words, codes, total + rows, distinct + (rows > 0), rows


def _summed(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's numbers."""
    each, n = np.concatenate(keys), np.concatenate(times)
    order = np.argsort(each)
    each = each[order]
    first = np.flatnonzero(np.diff(each, prepend=-1))
    return each[first], np.add.reduceat(n[order], first) if len(first) else n


def symbols(docs: DataFrame, sent: Broadcast, text_col: str = "text") -> DataFrame:
    """``(part, salt, names, times)``: how often each symbol came in each context, over all rows'
    texts. Parts up to COMMON are of the words' code, by the common word before; after its symbols
    stand usual and unusual white space. The others are of spelled pieces: a name is whether it
    is white space, the three symbols before (see Tokens.spelling) and the symbol, of nine bits each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = sent.value
        kinds, salt = len(own.names) + 4, TaskContext.get().partitionId() % SALTS
        fresh: list[np.ndarray] = []
        held: list[tuple[list[np.ndarray], list[np.ndarray]]] = [([], []), ([], [])]
        spaces = np.zeros(2 * (COMMON + 1), np.int64)

        def put(spelled: int, names: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
            keys, numbers = held[spelled]
            keys.append(names)
            numbers.append(times)
            if sum(map(len, keys)) > HELD_SYMBOLS:
                keys[:], numbers[:] = ([x] for x in _summed(keys, numbers))
                if len(keys[0]) > HELD_SYMBOLS // 2:
                    yield from out(spelled)

        def words() -> Iterator[pa.RecordBatch]:
            each = np.unique(np.concatenate(fresh), return_counts=True)
            fresh.clear()
            yield from put(0, *each)

        def out(spelled: int) -> Iterator[pa.RecordBatch]:
            names, times = _summed(*held[spelled])
            part, names = (COMMON + 1 + _part(names), names) if spelled else (names // kinds, names % kinds)
            order = np.argsort(part, kind="stable")
            part, names, times = part[order], names[order], times[order]
            first = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
            yield from (_counts_of(int(part[a]), salt, names[a:b], times[a:b]) for a, b in zip(first, [*first[1:], len(part)]))
            for x in held[spelled]:
                x.clear()

        for batch in slices(batches, "text"):
            tokens = Tokens(batch.column("text"), own)
            fresh.append(tokens.rank.astype(np.int64) * kinds + tokens.symbol)
            spaces += np.bincount(tokens.rank * 2 + tokens.odd, minlength=len(spaces))
            if sum(map(len, fresh)) > HELD_SYMBOLS:
                yield from words()
            uses = tokens.uses()
            for a, b in tokens.pieces():
                piece, symbol, before = tokens.spelling(a, b)
                name = tokens.piece_space[a:b][piece].astype(np.int64)
                for x in (*before[::-1], symbol):
                    name = name << 9 | x
                yield from put(1, name, uses[a:b][piece])
        if fresh:
            yield from words()
        came = np.flatnonzero(spaces)
        yield from put(0, came // 2 * kinds + kinds - 2 + came % 2, spaces[came])
        for spelled in range(2):
            if any(map(len, held[spelled][0])):
                yield from out(spelled)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, keys, numbers = None, [], []
        for batch in batches:
            for part, salt, names, times in zip(*(batch.column(c).to_pylist() for c in ("part", "salt", "names", "times"))):
                if key != (part, salt):
                    if key:
                        yield _counts_of(*key, *_summed(keys, numbers))
                    key, keys, numbers = (part, salt), [], []
                keys.append(np.cumsum(_unpacked(names)))
                numbers.append(_unpacked(times))
                if sum(map(len, keys)) > HELD_SYMBOLS:
                    keys, numbers = ([x] for x in _summed(keys, numbers))
        if key:
            yield _counts_of(*key, *_summed(keys, numbers))

    schema = "part int, salt int, names binary, times binary"
    summed = _text(docs, text_col).mapInArrow(count, schema)
    summed = summed.repartition("part", "salt").sortWithinPartitions("part", "salt").mapInArrow(add, schema).withColumn("salt", F.lit(0))
    return summed.repartition(MERGES, "part").sortWithinPartitions("part").mapInArrow(add, schema)


def _part(names: np.ndarray) -> np.ndarray:
    """Parts of symbols of spelled pieces, alike for a context's."""
    return (mix((names >> 9).view(np.uint64)) % np.uint64(SPELLED_PARTS)).astype(np.int64)


def _counts_of(part: int, salt: int, names: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [*(pa.array([x], pa.int32()) for x in (part, salt)), *(pa.array([_packed(x)], pa.binary()) for x in (np.diff(names, prepend=0), times))], ["part", "salt", "names", "times"]
    )


class Counted:
    """Decisions of the rows that :func:`symbols` gives."""

    def __init__(self, codes: Codes):
        self.words, self.letters = Nodes(codes.words), Nodes(codes.letters)

    def of(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, Decisions, np.ndarray]]:
        """Whether of spelled pieces; distinct decisions, and how often each was made."""
        for batch in batches:
            for part, names, times in zip(*(batch.column(c).to_pylist() for c in ("part", "names", "times"))):
                names, times = np.cumsum(_unpacked(names)), _unpacked(times)
                if part <= COMMON:
                    yield False, *self._common(part, names, times)
                else:
                    lane = np.cumsum(np.diff(names >> 9, prepend=-1) > 0) - 1
                    cuts = np.searchsorted(lane, np.arange(0, lane[-1] + 1 + LANES, LANES)).tolist()
                    for a, b in zip(cuts, cuts[1:]):
                        yield True, *self._spelled(names[a:b], lane[a:b] - lane[a], times[a:b])

    def _common(self, part: int, symbol: np.ndarray, times: np.ndarray) -> tuple[Decisions, np.ndarray]:
        code = self.words
        own = symbol < code.symbols
        node, _, bit, number = code.passed(symbol[own], np.zeros(own.sum(), np.int64), times[own], 1)
        spaces = (~own).sum()
        group, place = np.append(code.group[node], np.full(spaces, _SPACE_NODE)), np.append(code.place[node], np.zeros(spaces, np.uint8))
        sort = np.repeat(np.array([WORD, SPACE], np.uint8), [len(node), spaces])
        odds = np.append(code.odds[node], np.zeros(spaces, np.float32))
        slots = _slots(_scatter(np.full(len(sort), part, np.uint32) + _BASE), group, place, SLOTS[0])
        return Decisions(np.ones(len(sort), np.int64), sort, np.append(bit, (symbol[~own] - code.symbols).astype(np.uint8)), odds, (slots,)), np.append(number, times[~own])

    def _spelled(self, names: np.ndarray, lane: np.ndarray, times: np.ndarray) -> tuple[Decisions, np.ndarray]:
        code = self.letters
        node, lane_of, bit, number = code.passed(names & 511, lane, times, int(lane[-1]) + 1)
        context = names[np.flatnonzero(np.diff(lane, prepend=-1))] >> 9
        behind = _behind([(context >> k & 511).astype(np.uint32) for k in (0, 9, 18)], context >> 27 > 0)
        group, place = code.group[node], code.place[node]
        slots = tuple(_slots(x[lane_of], group, place, bits) for x, bits in zip(behind, SLOTS[1:]))
        return Decisions(np.ones(len(bit), np.int64), np.zeros(len(bit), np.uint8), bit, code.odds[node], slots), number


def train(docs: DataFrame, codes: Codes, text_col: str = "text") -> Sent:
    """A model of all rows' texts (null: empty). No rows give a model that knows nothing."""
    spark = docs.sparkSession
    sent_codes = spark.sparkContext.broadcast(codes)
    sizes = [2 << bits for bits in SLOTS]
    met = written(symbols(docs, sent_codes, text_col), "lm-symbols")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros(size, np.int64) for size in sizes]
        for spelled, made, times in Counted(sent_codes.value).of(batches):
            for table, slot in zip(tables[1:] if spelled else tables, made.slots):
                np.add.at(table, slot.astype(np.int64) * 2 + made.bit, times)
        for k, table in enumerate(tables):
            for at in range(0, len(table), 2 * CHUNK):
                part = table[at : at + 2 * CHUNK]
                if part.any():
                    yield _chunk((k, at // (2 * CHUNK)), _packed(part))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, np.zeros(2 * CHUNK, np.int64)
        for batch in batches:
            for k, chunk, n in zip(*(batch.column(c).to_pylist() for c in ("k", "chunk", "n"))):
                if key != (k, chunk):
                    if key:
                        yield _chunk(key, _packed(total))
                    key, total = (k, chunk), np.zeros(2 * CHUNK, np.int64)
                total += _unpacked(n)
        if key:
            yield _chunk(key, _packed(total))

    schema = "k int, chunk int, n binary"
    summed = met.mapInArrow(count, schema).repartition("k", "chunk").sortWithinPartitions("k", "chunk").mapInArrow(add, schema)
    raw = [np.zeros(size, np.int64) for size in sizes]
    for r in summed.collect():
        raw[r["k"]][r["chunk"] * 2 * CHUNK : (r["chunk"] + 1) * 2 * CHUNK] = _unpacked(bytes(r["n"]))
    tables = [_odds(n[::2], n[1::2]) for n in raw]
    sent = Sent(sent_codes, spark.sparkContext.broadcast(tables), _start_weights())
    _learn(met, sent, spark.sparkContext.broadcast(raw))
    release(met)
    return sent


def _chunk(key: tuple[int, int], data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in key), pa.array([data], pa.binary())], ["k", "chunk", "n"])


def _packed(counts: np.ndarray) -> bytes:
    """Bytes of like weight side by side, which packs small numbers well."""
    return zlib.compress(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()


def _odds(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    seen = zero + one
    odds = np.clip(np.rint(16 * np.log((one + 0.3) / (zero + 0.3))), -160, 160).astype(np.int16)
    return odds * np.int16(4) + ((seen > 0).astype(np.int16) + (seen > 6) + (seen > 60))


def _learn(met: DataFrame, sent: Sent, raw: Broadcast) -> None:
    """Weights of the gates by Newton steps over all decisions, each against the counts without itself."""
    shapes = [w.shape for w in sent.weights]

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, counts = sent.model(), raw.value
        sums = [np.zeros((gates, k + k * k)) for gates, k in shapes]
        for spelled, made, times in Counted(model.codes).of(batches):
            own = []
            for table, slot in zip(counts[1:] if spelled else counts, made.slots):
                at = slot.astype(np.int64) * 2
                own.append(_odds(table[at] - (made.bit == 0), table[at + 1] - made.bit))
            place = tuple(np.arange(len(made.bit)) for _ in own)
            tables = [*[np.zeros(0, np.int16)] * spelled, *own]
            gate, x = Model(model.codes, tables, model.weights).looked_up(Decisions(made.size, made.sort, made.bit, made.odds, place), spelled)
            weights = model.weights[spelled]
            miss = 1 / (1 + np.exp(np.clip((weights[gate].T * x).sum(axis=0), -_EDGE, _EDGE)))
            gates, k = shapes[spelled]
            first, second = times * miss, times * miss * (1 - miss)
            for i in range(k):
                sums[spelled][:, i] += np.bincount(gate, first * x[i], gates)
                for j in range(i, k):
                    sums[spelled][:, k * (i + 1) + j] += np.bincount(gate, second * x[i] * x[j], gates)
        for spelled, total in enumerate(sums):
            k = shapes[spelled][1]
            for i in range(k):
                for j in range(i):
                    total[:, k * (i + 1) + j] = total[:, k * (j + 1) + i]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total), spelled)), pa.array(np.arange(len(total))), pa.array(total.tolist(), pa.list_(pa.float64()))], ["spelled", "gate", "w"])

    width = max(k + k * k for _, k in shapes)
    parts = [F.sum(F.get("w", F.lit(i))).alias(f"w{i}") for i in range(width)]
    for _ in range(WEIGHT_ROUNDS):
        for r in met.mapInArrow(learn, "spelled long, gate long, w array<double>").groupBy("spelled", "gate").agg(*parts).collect():
            # Damped where a gate has seen little.
            weights, k = sent.weights[r["spelled"]], shapes[r["spelled"]][1]
            own = np.array([r[f"w{i}"] for i in range(k + k * k)])
            step = np.linalg.solve(own[k:].reshape(k, k) + 5 * np.eye(k), own[:k])
            weights[r["gate"]] = np.clip(weights[r["gate"]] + np.clip(step, -0.5, 0.5), -0.3, 1.5)


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, total_bits,
    bits_per_byte, base_bits)`` of each row.

    ``training`` marks the rows to learn from (null: not). Tokens are white-space-separated
    words, A-Z lower-cased, and one end. A null text is empty: its one token is the end. Scores are
    log10 probabilities, and ``total_bits`` is ``score`` in bits; bits per byte (of UTF-8) are 0 for
    a text without bytes. ``base_bits`` is ``base_score`` in bits with what it leaves out, at the
    model's price: the letters of words that training does not know and the white space. Without
    training rows all that is known is that bytes are alike. Rows that share an id, equal
    rows and rows with a null id are scored one by one; other columns are not read.
    """
    rows = _text(docs, text_col, F.col(id_col).cast("long").alias("id"), F.coalesce(training, F.lit(False)).alias("train"))
    learned = rows.where("train").select("text")
    words, codes, total, distinct, ends = lexicon(learned)
    sent = train(learned, codes)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.model()
        for batch in slices(batches, "text", PACK_BYTES):
            yield _packed_rows(batch, model, ends)

    parts = "which binary, row binary, price binary, after binary, saved binary"
    schema = f"ids array<long>, train array<boolean>, scores array<double>, sizes array<long>, lengths array<long>, base array<double>, spaces array<double>, names array<binary>, {parts}"
    packs = written(rows.mapInArrow(packed, schema).withColumn("pack", F.monotonically_increasing_id()), "lm-packs")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room, sure = np.log10(total + distinct + 1), sent.codes.value.sure
        for batch in batches:
            for k in range(batch.num_rows):
                yield _finished(batch.slice(k, 1).to_pylist()[0], total, room, ends > 0, sure)

    # A pack's words outside the code are those of PACK_BYTES of text, or of one longer text.
    asked = packs.select("pack", F.posexplode("names").alias("place", "word"))
    back = asked.join(words, "word").groupBy("pack").agg(F.collect_list(F.struct("place", "n", "follow", "level")).alias("back"))
    both = packs.drop("names").join(back, "pack", "left").select("ids", "train", "scores", "sizes", "lengths", "base", "spaces", "which", "row", "price", "after", "saved", *(F.col(f"back.{c}").alias(f"back_{c}") for c in ("place", "n", "follow", "level")))
    out = both.mapInArrow(scored, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, total_bits double, bits_per_byte double, base_bits double")
    return out.withColumnRenamed("id", id_col)


def _packed_rows(batch: pa.RecordBatch, model: Model, ends: int) -> pa.RecordBatch:
    """A pack: scores of its rows as far as the code goes, and what is open on words outside it."""
    own = model.codes
    base = np.log10(np.concatenate([own.counts + 1.0, [1.0, ends + 1.0]]))
    out: dict[str, list] = {k: [] for k in ("scores", "sizes", "lengths", "base", "spaces", "rare")}
    names, uses = [], []
    held = 0
    for part in slices(iter([batch]), "text", SCORED_BYTES):
        tokens = Tokens(part.column("text"), own)
        word, space, letters = model.costs(tokens)
        n, lanes = len(tokens.symbol), part.num_rows
        row_of = np.repeat(np.arange(lanes), np.diff(tokens.first))
        out["scores"].append(np.bincount(row_of, word + space, lanes))
        out["sizes"].append(np.diff(tokens.first))
        out["lengths"].append(np.diff(tokens.words.offsets))
        out["base"].append(np.bincount(row_of, base[tokens.symbol], lanes))
        out["spaces"].append(np.bincount(row_of, space, lanes))
        # Words outside the code: where they stand, what follows there and at which price.
        rare = tokens.spelled
        number = np.cumsum(tokens.body) - 1
        strange = np.flatnonzero(tokens.symbols == own.escape)
        place = np.full(len(tokens.symbols), -1)
        place[strange] = np.arange(len(strange))
        uses.append((row_of[rare] + held, place[tokens.at[number[rare]]], letters, tokens.next[rare + 1], word[rare + 1]))
        names.append(tokens.names.take(pa.array(strange)))
        held += lanes
    coded = pa.chunked_array([x.dictionary_encode() for x in names]).unify_dictionaries()
    place = [c.indices.to_numpy() for c in coded.chunks]
    which = np.concatenate([p[u[1]] if len(p) else u[1] for p, u in zip(place, uses)])
    fields = [np.concatenate([u[k] for u in uses]) for k in (0, 2, 3, 4)]
    listed = [batch.column("id").to_pylist(), batch.column("train").to_pylist(), *(np.concatenate(out[k]).tolist() for k in ("scores", "sizes", "lengths", "base", "spaces"))]
    kinds = (pa.int64(), pa.bool_(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    data = [which.astype("<u4"), fields[0].astype("<u4"), fields[1].astype("<f4"), fields[2].astype("<i8"), fields[3].astype("<f4")]
    return pa.RecordBatch.from_arrays(
        [*(pa.array([x], pa.list_(t)) for x, t in zip(listed, kinds)), pa.array([coded.chunk(0).dictionary.cast(pa.binary()).to_pylist()], pa.list_(pa.binary())), *(pa.array([x.tobytes()], pa.binary()) for x in data)],
        ["ids", "train", "scores", "sizes", "lengths", "base", "spaces", "names", "which", "row", "price", "after", "saved"],
    )


def _finished(pack: dict, total: int, room: float, ended: bool, sure: np.ndarray) -> pa.RecordBatch:
    """Rows of a pack, with what the table of words has on those outside the code."""
    which, row = np.frombuffer(pack["which"], "<u4").astype(np.int64), np.frombuffer(pack["row"], "<u4").astype(np.int64)
    price, after, saved = np.frombuffer(pack["price"], "<f4"), np.frombuffer(pack["after"], "<i8"), np.frombuffer(pack["saved"], "<f4")
    lanes, kinds = len(pack["ids"]), int(which.max(initial=-1)) + 1
    count, follow, level = (np.zeros(kinds, np.int64) for _ in range(3))
    place = np.array(pack["back_place"] or [], np.int64)
    for into, c in ((count, "n"), (follow, "follow"), (level, "level")):
        into[place] = np.array(pack[f"back_{c}"] or [], np.int64)
    known = count[which] > 0
    base = np.array(pack["base"]) + np.bincount(row, np.log10(count[which] + 1.0), lanes)
    sizes, lengths = np.array(pack["sizes"], np.int64), np.array(pack["lengths"], np.int64)
    score = np.array(pack["scores"])
    open_ = np.flatnonzero(level[which] > 0)
    right = follow[which[open_]] == after[open_]
    first = np.searchsorted(row[open_], np.arange(lanes + 1))
    score = score + np.bincount(row[open_], following(right, sure[level[which[open_]]], first) - np.where(right, saved[open_], 0.0), lanes)
    n_known = sizes - 1 - np.bincount(row[~known], minlength=lanes) + ended
    base_score, bits = base - sizes * room, -score / np.log(2)
    letters = np.bincount(row[~known], price[~known], lanes) + np.array(pack["spaces"])
    columns = [
        pa.array(pack["ids"], pa.int64()), pa.array([not x for x in pack["train"]]), pa.array(sizes), pa.array(n_known), pa.array(np.full(lanes, total)), pa.array(base_score),
        pa.array(score / np.log(10)), pa.array(lengths), pa.array(bits), pa.array(np.where(lengths > 0, bits / np.maximum(lengths, 1), 0.0)), pa.array(-base_score * np.log2(10) - letters / np.log(2)),
    ]
    return pa.RecordBatch.from_arrays(columns, ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "total_bits", "bits_per_byte", "base_bits"])
