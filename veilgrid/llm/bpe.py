"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

The nondeterministic transducer reads bytes and guesses where tokens begin: a guess is a node of the
vocabulary's trie. The set of all live guesses is fixed by the deepest of them (the others are its
suffixes), so a determinised state is one trie node, and its outputs are the tokens that end there.
Moves, fallbacks and outputs of a state are made when first needed. Of the tokens ending at a place
one alone fits: the merges must leave it apart from the last token of the text before it. That pair
test is remembered. A boundary is emitted once the paths of all places where a live guess began
share it, so output lags by a few of the longest tokens.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .scan import Texts

#: Pair tests and pieces kept before the tables are emptied and grown anew.
KEEP_PAIRS = 1 << 20
KEEP_PIECES = 1 << 18
#: Open bytes of a piece at which settled tokens are emitted; more than the longest token.
LAG = 512

#: Characters for which the quick pattern below splits as the given pattern does.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-ɏ]*")
_QUICK = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Rank file: one base64 token and its rank a line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}


class Splitter:
    """Matches of the pattern; plain European text takes an equivalent pattern of the quicker library."""

    def __init__(self, pattern: str, usual: str | None = None):
        self.full = regex.compile(pattern)
        self.quick = usual is None or pattern == usual

    def __call__(self, text: str) -> list[str]:
        if self.quick and _PLAIN.fullmatch(text):
            return _QUICK.findall(text)
        return self.full.findall(text)


class Transducer:
    """Encoder of single pieces; see the module's text."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.child: dict[int, int] = {}  # node * 256 + byte -> node
        self.ends = [-1]  # token that ends at a node
        for token, i in ranks.items():
            node = 0
            for b in token:
                nxt = self.child.get(node * 256 + b)
                if nxt is None:
                    nxt = self.child[node * 256 + b] = len(self.ends)
                    self.ends.append(-1)
                node = nxt
            self.ends[node] = i
        self.depth = [0]
        self.parent = [(0, 0)]
        for key, node in self.child.items():  # parents come before their children
            self.depth.append(self.depth[key >> 8] + 1)
            self.parent.append((key >> 8, key & 255))
        self.made: dict[int, tuple[int, int]] = {}
        self.apart: dict[int, bool] = {}
        self.moves: dict[int, int] = {}
        self.backs: dict[int, int] = {}
        self.outs: dict[int, list[tuple[int, int]]] = {}

    def merged(self, data: bytes, down_to: int = 1) -> list[int]:
        """Tokens by the merge rules themselves, for short strings: lowest rank first, leftmost of equals."""
        parts = [bytes([b]) for b in data]
        while len(parts) > down_to:
            ranked = [(self.ranks[p], i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in self.ranks]
            if not ranked:
                break
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one."""
        got = self.made.get(token)
        if got is None:
            data = self.tokens[token]
            got = self.made[token] = tuple(self.merged(data, 2))
        return got

    def stay(self, left: int, right: int) -> bool:
        """Whether the merges leave this pair of tokens as it is.

        The merges inside the two are undone, latest first (of equal ranks the left one is the
        earlier). If the tokens then beside the boundary could merge before the merge just undone,
        the boundary would have been crossed.
        """
        got = self.apart.get(left << 32 | right)
        if got is None:
            tokens, ranks = self.tokens, self.ranks
            a, b, before, got = left, right, len(ranks) + 1, True
            while got:
                if ranks.get(tokens[a] + tokens[b], before) < before:
                    got = False
                elif len(tokens[a]) == len(tokens[b]) == 1:
                    break
                elif len(tokens[b]) == 1 or len(tokens[a]) > 1 and a > b:
                    before, a = a, self.halves(a)[1]
                else:
                    before, b = b + 1, self.halves(b)[0]
            self.apart[left << 32 | right] = got
        return got

    def move(self, node: int, byte: int) -> int:
        """State after one more byte: the longest suffix that begins a token."""
        key = node << 8 | byte
        got = self.moves.get(key)
        if got is None:
            got = self.child.get(key)
            if got is None:
                got = self.move(self.back(node), byte) if node else 0
            self.moves[key] = got
        return got

    def back(self, node: int) -> int:
        """The longest proper suffix of a node that is a node."""
        got = self.backs.get(node)
        if got is None:
            above, byte = self.parent[node]
            got = self.backs[node] = self.move(self.back(above), byte) if above else 0
        return got

    def out(self, node: int) -> list[tuple[int, int]]:
        """(token, length) of all tokens that end at a state, longest first."""
        got = self.outs.get(node)
        if got is None:
            got, at = [], node
            while at:
                if self.ends[at] >= 0:
                    got.append((self.ends[at], self.depth[at]))
                at = self.back(at)
            self.outs[node] = got
        return got

    def encode(self, data: bytes) -> list[int]:
        if len(self.apart) > KEEP_PAIRS:
            self.apart.clear()
        out: list[int] = []
        lasts = [-1]  # last token of each prefix since the last settled boundary
        node, moves, outs, apart = 0, self.moves, self.outs, self.apart
        for b in data:
            to = moves.get(node << 8 | b)
            node = self.move(node, b) if to is None else to
            ending = outs.get(node)
            if ending is None:
                ending = self.out(node)
            j = len(lasts)
            for token, n in ending:
                if n > j:
                    continue
                before = lasts[j - n]
                if before >= 0:
                    fits = apart.get(before << 32 | token)
                    if fits is None:
                        fits = self.stay(before, token)
                    if not fits:
                        continue
                elif n < j:
                    continue
                lasts.append(token)
                break
            if j >= LAG:
                settled, lasts = self.settle(lasts, self.depth[node])
                out += settled
        return out + self.path(lasts, len(lasts) - 1)

    def path(self, lasts: list[int], to: int) -> list[int]:
        tokens = []
        while to:
            tokens.append(lasts[to])
            to -= len(self.tokens[lasts[to]])
        return tokens[::-1]

    def settle(self, lasts: list[int], live: int) -> tuple[list[int], list[int]]:
        """Tokens before the last boundary that all live places share, and what stays open after it."""
        ends = set(range(len(lasts) - 1 - live, len(lasts)))
        while len(ends) > 1:
            last = max(ends)
            ends.remove(last)
            ends.add(last - len(self.tokens[lasts[last]]))
        at = ends.pop()
        if not at or lasts[at] < 0:
            return [], lasts
        # the token before the boundary stays, for the pair test of the next one
        start = at - len(self.tokens[lasts[at]])
        done = self.path(lasts, start)
        if not done:
            return [], lasts
        return done, [-1, *([-2] * (at - start - 1)), *lasts[at:]]


class Pieces(dict):
    """Encoded pieces (little-endian 32-bit ids), made by ``encode`` when first met; emptied when full."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= KEEP_PIECES:
            self.clear()
        got = np.array(self.encode(piece), "<u4").tobytes()
        if len(piece) < 64:
            self[piece] = got
        return got


class Utf8:
    """Incremental UTF-8 state machine over byte chunks.

    A state is (bytes still expected, allowed range of the next one). ``feed`` returns the bytes of
    the characters completed so far and holds back an unfinished one; a byte that fits nowhere
    is passed on as it is and ends the character. Runs of whole, valid characters are passed at once.
    """

    def __init__(self) -> None:
        self.state = (0, 0x80, 0xBF)
        self.held = b""

    def feed(self, chunk: bytes) -> bytes:
        data = self.held + chunk
        cut = len(data)
        for back in range(1, min(4, cut) + 1):  # an unfinished character begins with one of the last three bytes
            b = data[cut - back]
            if b >= 0xC0:
                cut -= back * (back < (2 if b < 0xE0 else 3 if b < 0xF0 else 4))
            if b & 0xC0 != 0x80:
                break
        try:
            data[:cut].decode()
        except UnicodeDecodeError:
            return self._steps(data)
        self.state, self.held = (0, 0x80, 0xBF), b""
        return data[:cut] + (self._steps(data[cut:]) if cut < len(data) else b"")

    def _steps(self, data: bytes) -> bytes:
        """The machine itself, a byte at a time from the start of a character."""
        left, low, high = 0, 0x80, 0xBF
        done, start = bytearray(), 0
        for i in range(len(data)):
            b = data[i]
            if left and low <= b <= high:
                left, low, high = left - 1, 0x80, 0xBF
            else:
                if left:  # broken off: what was held is passed on
                    done += data[start:i]
                    start = i
                left = 1 if 0xC2 <= b <= 0xDF else 2 if 0xE0 <= b <= 0xEF else 3 if 0xF0 <= b <= 0xF4 else 0
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
            if not left:
                done += data[start : i + 1]
                start = i + 1
        self.state, self.held = (left, low, high), data[start:]
        return bytes(done)

    def finish(self) -> bytes:
        rest, self.held, self.state = self.held, b"", (0, 0x80, 0xBF)
        return rest


class Decoder:
    """Streams ids back to bytes, a character at a time; runs of self-contained tokens skip the machine."""

    def __init__(self, ranks: dict[bytes, int]):
        self.table = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, i in ranks.items():
            self.table[i] = t
        self.whole = np.array([self._whole(t) for t in self.table], bool)

    @staticmethod
    def _whole(token: bytes) -> bool:
        machine = Utf8()
        return machine.feed(token) == token and not machine.held

    def stream(self, ids: np.ndarray, step: int = 4096) -> Iterator[bytes]:
        machine, table = Utf8(), self.table
        for i in range(0, len(ids), step):
            part = ids[i : i + step]
            chunk = b"".join([table[t] for t in part.tolist()])
            yield chunk if not machine.held and self.whole[part].all() else machine.feed(chunk)
        yield machine.finish()


#: Machines of this worker, which serves many tasks; their tables of pieces stay warm and are bounded.
_READY: dict[tuple, object] = {}


def _encoder(name: str, content, pattern: str, usual_pattern: str | None):
    key = ("encode", name, pattern, usual_pattern)
    if key not in _READY:
        machine, split = Transducer(read_ranks(content.value)), Splitter(pattern, usual_pattern)
        look = Pieces(lambda piece: machine.encode(piece.encode())).__getitem__
        _READY[key] = lambda text: b"".join(map(look, split(text))) if text else b""
    return _READY[key]


def _decoder(name: str, content):
    key = ("decode", name)
    if key not in _READY:
        decoder = Decoder(read_ranks(content.value))
        _READY[key] = lambda cell: b"".join(decoder.stream(np.frombuffer(cell, "<u4"))) if cell else b""
    return _READY[key]


def _mapped(df: DataFrame, column: str, keep: list[str], name: str, make) -> DataFrame:
    """``keep`` and a binary column ``name`` that ``make()``'s function computes from ``column``."""

    def run(batches):
        one = make()
        for batch in batches:
            cells = batch.column(len(keep))
            weights = np.diff(Texts(cells).offsets) if pa.types.is_string(cells.type) else np.full(len(cells), 4096)
            cuts = [0, *np.unique(np.searchsorted(np.cumsum(weights), np.arange(4 << 20, weights.sum(), 4 << 20), "right")).tolist(), len(cells)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    out = pa.array([one(x.as_py()) for x in cells.slice(lo, hi - lo)], pa.binary())
                    yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(len(keep))), out], names=[*keep, name])

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    return df.select(*keep, column).mapInArrow(run, f"{kinds}`{name}` binary")


def encode(df: DataFrame, text: str, keep: list[str], ranks_file: bytes, pattern: str, usual_pattern: str | None = None, name: str = "token_ids") -> DataFrame:
    """``keep`` and the ids of each whole text as little-endian unsigned 32-bit integers.

    Null and empty texts give no ids. Only ``keep`` and ``text`` are read.
    """
    content = df.sparkSession.sparkContext.broadcast(ranks_file)  # one vocabulary file

    digest = hashlib.sha256(ranks_file).hexdigest()
    return _mapped(df, text, keep, name, lambda: _encoder(digest, content, pattern, usual_pattern))


def decode(df: DataFrame, ids: str, keep: list[str], ranks_file: bytes, name: str = "decoded") -> DataFrame:
    """``keep`` and the decoded bytes of ids in the form that ``encode`` gives; null ids give no bytes."""
    content = df.sparkSession.sparkContext.broadcast(ranks_file)

    digest = hashlib.sha256(ranks_file).hexdigest()
    return _mapped(df, ids, keep, name, lambda: _decoder(digest, content))
