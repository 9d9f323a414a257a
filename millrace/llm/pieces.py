"""Operator 2: SentencePiece encoding and decoding as shortest paths.

The model file is compiled into transducers: the normaliser (the model's own character map, prefix, white space), the
pieces and the byte fallback.  Composed with an input they give a lattice whose arcs are pieces; the encoding is its
shortest path under (min, +).  For a BPE model the lattice is composed with one more acceptor over pairs of pieces, so
its states are (place, last piece): a pair weighs nothing if merging its text gives these two pieces again, and is
no arc otherwise; an arc weighs the number of longer ones from its place.  What that acceptor lets pass from end to end is the library's own segmentation.  Should nothing pass
(a model whose pieces do not follow from merges), a bad pair weighs BAD instead, so the path with fewest of them wins.
For a unigram model arcs weigh minus their scores.

No piece crosses from ink into a following space mark, nor between characters that never adjoin in pieces, so the
lattice falls apart there; equal parts share one path, kept in a memo of bounded size per worker.  A part without such
a place is swept from left to right; only living paths are held, which share what they have in common.

Null text: null ids.  Empty text: no ids.  Decoding gives the normalised text again; with an identity normaliser
that is the text itself, whatever characters it has.  Repeated rows are encoded alike, an empty table gives an empty
one, and ties go to the path found first, from left to right with short pieces first.
"""

from __future__ import annotations

import gc
import re
from array import array
from dataclasses import dataclass, field
from heapq import heappop, heappush, heappushpop

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import documents

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words that each of the two generations of a worker's memo holds, and pairs in the memo of pairs.
MEMO, PAIRS = 60_000, 200_000
#: Bytes of text that are encoded and ids that are decoded at a time.
BATCH = 4 << 20
DECODED = 2_000_000
#: Longest part that is remembered, and searched best first.
SHORT = 64
#: Weight of a pair that merging would not leave, where no path does without.
BAD = 1e6
_INF = float("inf")
_NONE: dict = {}


def _fields(data: bytes):
    """(number, value) of each field of an encoded message."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 0x7F) << shift
            if b < 0x80:
                return n
            shift += 7

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if key & 7 == 5 else 8
            yield key >> 3, np.frombuffer(data[at : at + n], "<f4" if n == 4 else "<f8")[0].item()
            at += n


class CharMap:
    """The normaliser that a model carries: a double-array trie over UTF-8 bytes, and the replacements that it points to."""

    def __init__(self, data: bytes):
        size = int.from_bytes(data[:4], "little")
        self.units, self.new = np.frombuffer(data[4 : 4 + size], "<u4").tolist(), data[4 + size :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def _longest(self, data: bytes, at: int) -> tuple[int, int] | None:
        """(end of the longest key from a place on, place of its replacement)."""
        units, found = self.units, None
        node = self._offset(units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units) or units[node] & 0x800000FF != data[k]:
                break
            unit = units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = k + 1, units[node] & 0x7FFFFFFF
        return found

    def apply(self, text: str) -> str:
        """The text with the longest key at each place replaced; other characters stay."""
        data, out, at = text.encode("utf-8", "replace"), [], 0
        while at < len(data):
            if got := self._longest(data, at):
                at, new = got
                out.append(self.new[new : self.new.index(b"\0", new)])
            else:
                width = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                out.append(data[at : at + width])
                at += width
        return b"".join(out).decode("utf-8", "replace")


@dataclass
class Model:
    """A compiled model: piece tables and normaliser settings."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    bpe: bool
    normaliser: str
    dummy_prefix: bool
    squeeze: bool
    charmap: CharMap | None = None
    ids: dict[str, int] = field(default_factory=dict)
    bytes_: list[int] = field(default_factory=list)
    unknown: int = 0
    longest: int = 1

    @classmethod
    def parse(cls, data: bytes) -> Model:
        pieces, scores, kinds, kind, norm = [], [], [], 1, {}
        for n, value in _fields(data):
            if n == 1:
                p = dict(_fields(value))
                pieces.append(p.get(1, b"").decode())
                scores.append(p.get(2, 0.0))
                kinds.append(p.get(3, NORMAL))
            elif n == 2:
                kind = dict(_fields(value)).get(3, 1)
            elif n == 3:
                norm = dict(_fields(value))
        if USER in kinds:
            raise ValueError("models with user-defined pieces are not supported")
        charmap = CharMap(norm[2]) if norm.get(2) else None
        m = cls(pieces, scores, kinds, kind == 2, norm.get(1, b"").decode(), bool(norm.get(3, 1)), bool(norm.get(4, 1)), charmap)
        m.ids = {p: i for i, p in enumerate(pieces) if kinds[i] == NORMAL}
        by_byte = {int(p[3:5], 16): i for i, p in enumerate(pieces) if kinds[i] == BYTE}
        m.bytes_ = [by_byte[b] for b in range(256)] if len(by_byte) == 256 else []
        m.unknown = kinds.index(UNKNOWN) if UNKNOWN in kinds else 0
        m.longest = max(map(len, m.ids), default=1)
        return m

    def normalise(self, text: str) -> str:
        """The text as the lattice reads it, with white space as space marks."""
        if self.charmap:
            text = self.charmap.apply(text)
        if self.squeeze:
            text = re.sub(r"\x20+", " ", text).strip(" ")
        if not text:
            return ""
        return (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)


class Memo:
    """A mapping that keeps the recently used: two generations, the older of which goes when the younger is full."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def get(self, key):
        got = self.young.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.put(key, got)
        return got

    def put(self, key, value) -> None:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Encoder:
    """Shortest paths through the lattices of a model.  A symbol is a piece's id or, for a character without a piece,
    minus its code point minus one."""

    def __init__(self, model: Model):
        self.model, self.follows, self.n_pairs, self.heads = model, {}, 0, {}
        self.words, self.memo = Memo(MEMO), Memo(MEMO // 4)
        self.unknown_cost = 10.0 - min(model.scores, default=0.0)
        self.splits = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in model.ids)
        self.part = self._parts()
        # A node: its children by character and its piece's id; below zero: minus one minus an id not tried yet.
        self.trie: list = [{}, None]
        for piece, k in model.ids.items():
            node = self.trie
            for c in piece:
                node = node[0].setdefault(c, [{}, None])
            node[1] = -1 - k

    def _parts(self) -> re.Pattern:
        """Splits a line where no piece crosses: space marks lead a run of characters that adjoin, directly or through
        others, inside pieces (letters of a script, say, but not a letter and a comma)."""
        group: dict[str, str] = {c: c for p in self.model.ids for c in p if c != SPACE}

        def root(c: str) -> str:
            while group[c] != c:
                group[c] = c = group[group[c]]
            return c

        joins = set()
        for piece in self.model.ids:
            for a, b in zip(piece, piece[1:], strict=False):
                if SPACE not in (a, b):
                    joins |= {a, b}
                    group[root(a)] = root(b)
        runs: dict[str, list[str]] = {}
        for c in sorted(joins):
            runs.setdefault(root(c), []).append(c)
        escape = lambda chars: "[" + "".join(map(re.escape, chars)) + "]"
        kinds = [escape(r) + "+" for r in sorted(runs.values(), key=len, reverse=True)]
        if alone := sorted(set(group) - joins):
            kinds.append(escape(alone))
        return re.compile(f"{SPACE}*(?:{'|'.join(kinds)})|{SPACE}+|[^{SPACE}]" if kinds else f"{SPACE}+|[^{SPACE}]")

    def _merged(self, text: str) -> list[str]:
        """The text's pieces after all merges, best score first and leftmost among equals."""
        parts, ids, scores = list(text), self.model.ids, self.model.scores
        while len(parts) > 1:
            best, where = -_INF, -1
            for i in range(len(parts) - 1):
                k = ids.get(parts[i] + parts[i + 1])
                if k is not None and scores[k] > best:
                    best, where = scores[k], i
            if where < 0:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def _edges(self, piece: str) -> tuple[list, list] | None:
        """The parts that stand at the right and at the left end of a piece while it is merged, each with the rank of the
        merge that ends it; None for a piece that merging its own characters never gives."""
        if len(piece) == 1:
            return [(piece, _INF)], [(piece, _INF)]
        got = self.heads.get(piece, 0)  # as many entries as the model has pieces, at most
        if got != 0:
            return got
        if self._merged(piece) != [piece]:
            got = None
        else:
            at = self._last_merge(piece)
            left, right, rank = self._edges(piece[:at]), self._edges(piece[at:]), -self.model.scores[self.model.ids[piece]]
            got = None if left is None or right is None else ([(piece, _INF), *((p, min(r, rank)) for p, r in right[0])], [(piece, _INF), *((p, min(r, rank)) for p, r in left[1])])
        self.heads[piece] = got
        return got

    def _last_merge(self, piece: str) -> int:
        """Length of the left part that the last merge of a piece joins."""
        parts, ids, scores = list(piece), self.model.ids, self.model.scores
        while len(parts) > 2:
            where = max((i for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ids), key=lambda i: (scores[ids[parts[i] + parts[i + 1]]], -i))
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return len(parts[0])

    def _text(self, symbol: int) -> str:
        return self.model.pieces[symbol] if symbol >= 0 else chr(-1 - symbol)

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether merging the text of two symbols gives these two: no part at a's right end may merge with one at b's
        left end before its own piece takes it in (left merges first among equals)."""
        left, right = self._edges(self._text(a)), self._edges(self._text(b))
        if left is None or right is None:
            return False
        get, scores = self.model.ids.get, self.model.scores
        return not any((k := get(s + t)) is not None and -scores[k] < ends and -scores[k] <= before for s, ends in left[0] for t, before in right[1])

    def _pair(self, a: int, b: int) -> bool:
        """The same, and remembered; after PAIRS pairs the memo starts anew."""
        if self.n_pairs >= PAIRS:
            for known in self.follows.values():
                known.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        self.follows.setdefault(a, {})[b] = got = self._may_follow(a, b)
        return got

    def _checked(self, node: list, piece: str) -> int | None:
        """The id at a node whose piece was not tried yet; a piece that merging never gives is taken out of a BPE model."""
        node[1] = None if self.model.bpe and self._edges(piece) is None else -1 - node[1]
        return node[1]

    def _arcs(self, text: str, at: int) -> list[tuple[int, int]]:
        """(end, symbol) of the lattice's arcs from a place, the shortest first."""
        c, end, n = text[at], at + 1, len(text)
        node, out = self.trie[0].get(c), []
        if node is None or node[1] is None:
            out.append((end, -1 - ord(c)))
        while node is not None:
            symbol = node[1]
            if symbol is not None:
                if symbol < 0:
                    symbol = self._checked(node, text[at:end])
                if symbol is not None:
                    out.append((end, symbol))
            if end == n:
                break
            node = node[0].get(text[end])
            end += 1
        return out

    def _weight(self, symbol: int) -> float:
        return -self.model.scores[symbol] if symbol >= 0 else self.unknown_cost

    def _path(self, text: str) -> list[int]:
        """Symbols on the shortest path through the states (place, last symbol)."""
        end = self._search(text) if self.model.bpe and len(text) <= SHORT else self._sweep(text, _INF)
        end, path = end or self._sweep(text, BAD), []
        while end[2] is not None:
            path.append(end[1])
            end = end[2]
        return path[::-1]

    def _search(self, text: str) -> tuple | None:
        """The end of the shortest path of a BPE model, by best first search: (cost, symbol, state before).

        Only the states that cost no more than the whole path are looked at, which are few, as most pieces of a path are
        the longest that there are.  None if no path passes the pair acceptor.
        """
        n, arcs, follows = len(text), self._arcs(text, 0), self.follows
        state, seen, serial, heap = (0, None, None), set(), 0, []
        cost, k = 0, len(arcs) - 1
        while True:
            if k:
                serial += 1
                heappush(heap, (cost + 1, -arcs[k - 1][0], serial, arcs, k - 1, state))
            end, symbol = arcs[k]
            last = state[1]
            if last is None:
                good = True
            else:
                known = follows.get(last)
                good = None if known is None else known.get(symbol)
                if good is None:
                    good = self._pair(last, symbol)
            if good and (end, symbol) not in seen:
                if end == n:
                    return cost, symbol, state
                seen.add((end, symbol))
                state, arcs = (cost, symbol, state), self._arcs(text, end)
                k = len(arcs) - 1
                serial += 1
                item = heappushpop(heap, (cost, -arcs[k][0], serial, arcs, k, state))
            elif heap:
                item = heappop(heap)
            else:
                return None
            cost, _, _, arcs, k, state = item

    def _sweep(self, text: str, bad: float) -> tuple | None:
        """The end of the shortest path, place by place: (cost, symbol, state before).

        A state names the one before it, so those that no living path has come through are freed as the sweep goes on.
        bad: what a pair that may not be weighs.
        """
        bpe, n = self.model.bpe, len(text)
        states: list[list[tuple] | None] = [None] * (n + 1)
        states[0] = [(0.0, None, None)]
        for j in range(n):
            here, states[j] = states[j], None
            if here is None:
                continue
            arcs = self._arcs(text, j)
            for state in here:
                last = state[1]
                for k, (end, symbol) in enumerate(arcs):
                    cost = state[0] + (len(arcs) - 1 - k if bpe else self._weight(symbol))
                    if bpe and last is not None:
                        good = self.follows.get(last, _NONE).get(symbol)
                        if good is None:
                            good = self._pair(last, symbol)
                        cost += 0.0 if good else bad
                    there = states[end]
                    if cost == _INF:
                        continue
                    if there is None:
                        states[end] = [(cost, symbol, state)]
                        continue
                    # Another last symbol is another state, but for a unigram model.
                    same = next((i for i, old in enumerate(there) if not bpe or old[1] == symbol), None)
                    if same is None:
                        there.append((cost, symbol, state))
                    elif cost < there[same][0]:
                        there[same] = (cost, symbol, state)
        return None if states[n] is None else min(states[n], key=lambda x: x[0])

    def _part(self, text: str) -> bytes:
        """The ids of a part as bytes of 32-bit integers."""
        path = self._path(text)
        if min(path) >= 0:
            return array("i", path).tobytes()
        out, unknown = array("i"), False
        for symbol in path:
            if symbol >= 0:
                out.append(symbol)
            elif self.model.bytes_:
                out.extend(self.model.bytes_[b] for b in chr(-1 - symbol).encode("utf-8", "replace"))
            elif not unknown:  # neighbours without a piece are one unknown
                out.append(self.model.unknown)
            unknown = symbol < 0
        return out.tobytes()

    def _remembered(self, part: str) -> bytes:
        """The ids of a part."""
        got = self.memo.get(part)
        if got is None:
            got = self._part(part)
            if len(part) <= SHORT:
                self.memo.put(part, got)
        return got

    def _word(self, word: str) -> bytes:
        """The ids of a mark and a word."""
        got = self.words.get(word)
        if got is None:
            first, *rest = self.part.findall(SPACE + word)
            got = self._part(first) if len(first) > len(word) else self._word(first[1:])
            if rest:
                got += b"".join(map(self._remembered, rest))
            if len(word) <= SHORT:
                self.words.put(word, got)
        return got

    def encode_bytes(self, text: str) -> bytes:
        line = self.model.normalise(text)
        if not line:
            return b""
        if not self.splits:
            return self._part(line)
        if line[0] != SPACE or line[-1] == SPACE or SPACE + SPACE in line:
            return b"".join(map(self._remembered, self.part.findall(line)))
        return b"".join(map(self._word, line[1:].split(SPACE)))

    def encode_column(self, text: pa.Array) -> pa.Array:
        """Lists of ids of a column of texts, some BATCH bytes at a time.

        Where every space mark leads a word, the words of a batch are told apart first and each is looked up once.
        """
        text, out, at = text.cast(pa.large_string()), [], 0
        sizes = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False))
        while at < len(text):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH)))
            out.append(self._encode_batch(text.slice(at, end - at)))
            at = end
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))

    def _encode_batch(self, text: pa.Array) -> pa.Array:
        model = self.model
        plain = self.splits and model.dummy_prefix and not model.squeeze and model.charmap is None
        odd = pc.match_substring_regex(text, f"  |^ | $|{SPACE}|^$") if plain else pa.array([True] * len(text))
        odd = pc.fill_null(odd, True).to_numpy(zero_copy_only=False)
        words = pc.split_pattern(text.filter(pa.array(~odd)), " ")
        told = words.flatten().dictionary_encode()
        found = [self._word(w) for w in told.dictionary.to_pylist()]
        ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found], dtype=np.int64)])
        place = told.indices.to_numpy()
        ids = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), np.int32))).take(told.indices).flatten()
        upto = np.concatenate([[0], np.cumsum(np.diff(ends)[place])])[words.offsets.to_numpy() - words.offsets[0].as_py()] if len(words) else np.zeros(1, np.int64)
        if not odd.any():
            return pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), ids)
        rows: list[bytes | None] = [None] * len(text)
        flat = ids.to_numpy()
        for k, row in enumerate(np.flatnonzero(~odd)):
            rows[row] = flat[upto[k] : upto[k + 1]].tobytes()
        for row in np.flatnonzero(odd):
            value = text[int(row)].as_py()
            rows[row] = None if value is None else self.encode_bytes(value)
        return _lists(rows)

    def encode(self, text: str) -> list[int]:
        return array("i", self.encode_bytes(text)).tolist()


class Decoder:
    """The inverse transducer: pieces and bytes back to text."""

    def __init__(self, model: Model):
        self.model = model
        raw = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, k in zip(model.pieces, model.kinds, strict=True)]
        self.raw = pa.array(raw, pa.binary())

    def decode_lists(self, ids: pa.Array) -> pa.Array:
        """Texts of lists of ids; null of null."""
        sizes = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False), out=sizes[1:])
        if len(ids) > 1 and sizes[-1] > DECODED:
            half = len(ids) // 2
            return pa.concat_arrays([self.decode_lists(ids.slice(0, half)), self.decode_lists(ids.slice(half))])
        raw = self.raw.take(ids.flatten())
        if sizes[-1] > DECODED:
            joined = [b"".join(raw.to_pylist())]
        else:
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(sizes.astype(np.int32)), raw), b"").to_pylist()
        texts = [x.decode("utf-8", "replace") if there else None for x, there in zip(joined, ids.is_valid().to_pylist(), strict=True)]
        if self.model.dummy_prefix:
            texts = [t[1:] if t and t[0] == " " else t for t in texts]
        return pa.array(texts, pa.string())

    def decode(self, ids) -> str:
        return self.decode_lists(pa.array([ids], pa.list_(pa.int32())))[0].as_py()


_ENCODERS: dict[bytes, Encoder] = {}
_DECODERS: dict[bytes, Decoder] = {}


def encoder_of(data: bytes) -> Encoder:
    """One encoder per worker and model."""
    if data not in _ENCODERS:
        _ENCODERS[data] = Encoder(Model.parse(data))
        gc.freeze()  # the tables stay: no need to walk them at every collection
    return _ENCODERS[data]


def decoder_of(data: bytes) -> Decoder:
    """One decoder per worker and model; it needs none of the encoder's tables."""
    if data not in _DECODERS:
        _DECODERS[data] = Decoder(Model.parse(data))
    return _DECODERS[data]


def compiled(data: bytes) -> tuple[Encoder, Decoder]:
    return encoder_of(data), decoder_of(data)


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _lists(rows: list[bytes | None]) -> pa.Array:
    """Lists of integers from their bytes."""
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([0 if r is None else len(r) // 4 for r in rows], out=offsets[1:])
    flat = np.frombuffer(b"".join(r for r in rows if r), np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array([r is None for r in rows]) if None in rows else None)


def encoder(data: bytes):
    """A column function: text to piece ids."""

    @arrow_udf("array<int>")
    def encode(text: pa.Array) -> pa.Array:
        return encoder_of(data).encode_column(text)

    return encode


def decoder(data: bytes):
    """A column function: piece ids to text."""

    @arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        return decoder_of(data).decode_lists(ids)

    return decode


def round_trip(data: bytes, step: int = 256):
    """A column function: piece ids, and whether they decode to the text again.  Both in one worker, so that a task holds one
    process and one set of tables; decoded texts are compared ``step`` rows at a time and dropped."""

    @arrow_udf("struct<piece_ids:array<int>,same:boolean>")
    def run(text: pa.Array) -> pa.Array:
        coder = encoder_of(data)
        if data not in _DECODERS:
            _DECODERS[data] = Decoder(coder.model)
        ids, same = [], []
        for at in range(0, len(text), step):
            part = text.slice(at, step)
            ids.append(coder.encode_column(part))
            equal = pc.equal(_DECODERS[data].decode_lists(ids[-1]), part.cast(pa.string()))
            same.append(pc.fill_null(equal, True))  # a null text has null ids
        if not ids:
            return pa.StructArray.from_arrays([pa.array([], pa.list_(pa.int32())), pa.array([], pa.bool_())], ["piece_ids", "same"])
        return pa.StructArray.from_arrays([pa.concat_arrays(ids), pa.concat_arrays(same)], ["piece_ids", "same"])

    return run


def encode_documents(docs: DataFrame, model: str = MODEL, text: str = "text") -> DataFrame:
    """The input with a column ``piece_ids``; an input column of that name is replaced."""
    return docs.withColumn("piece_ids", encoder(read_model(model))(F.col(text)))


def decode_documents(docs: DataFrame, model: str = MODEL, ids: str = "piece_ids", to: str = "decoded") -> DataFrame:
    """The input with the text that the ids stand for; an input column of the name ``to`` is replaced.

    The condition keeps the ids' own function, if they come from one, out of this one's batch: called from within, it
    would run twice, once for the ids and once for the text.
    """
    there = F.when(F.col(ids).isNotNull(), F.col(ids))
    return docs.withColumn(to, decoder(read_model(model))(there))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every text of ``documents``, and whether decoding gives the text again."""
    out = documents(spark, sf_dir).select("doc_id", round_trip(read_model())("text").alias("r"))
    return out.select(
        "doc_id",
        F.size("r.piece_ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join("r.piece_ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.col("r.same").alias("round_trip"),
        F.col("r.piece_ids").alias("piece_ids"),
    )
