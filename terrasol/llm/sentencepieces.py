"""SentencePiece encoding and decoding with a max-plus scan over chunks of giant texts.

A segmentation is a path through the lattice of pieces; its weight is the max-plus product of
its steps.  For a BPE vocabulary a step from one piece to the next weighs 0 if the two
stay as they are when merged side by side, else minus infinity: exactly one path has weight 0, and it
is the BPE segmentation.  Texts are cut into chunks of equal length.  The state at a cut is the
piece that covers the last character before it and how far it reaches over; each chunk yields
its matrix from entry states to exit states, neighbouring matrices are multiplied up a tree, the
states on the path of weight 0 are handed down it, and every chunk traces its own pieces.

A text of up to one chunk has no cut, so no matrix.  No piece crosses a break (before a space mark that
follows something else, beside a line feed that no piece holds), so inside a chunk, from its first break
to its last, the path is that of the words between breaks; equal words are segmented once, all
words of a slice together.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasol.llm import words as W
from terrasol.llm.common import cut, small_batches, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: characters of a chunk; longer texts are giant
CHUNK = 32_768
#: words of up to so many characters are merged together in matrices of these widths, longer ones go through
#: the lattice
WIDTHS = (4, 6, 8, 10, 12, 16, 24, 48, 256)
#: cells of such a matrix, characters of a slice of texts
CELLS, SLICE = 1 << 20, 1 << 20
#: judged pairs kept by a worker
KEPT = 80_000
#: matrices of neighbouring chunks multiplied by one task
FAN = 32

NORMAL, BYTE = 1, 6
#: score of a union that is no piece
LEAST = float("-inf")

_coders: dict[int, tuple] = {}


def read_model(path: str) -> dict:
    """Pieces, scores and kinds of a model file.  Text is taken as it is (identity
    normalisation), spaces become marks and one mark goes before the text."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    model.ParseFromString(Path(path).read_bytes())
    if model.trainer_spec.model_type != proto.TrainerSpec.BPE or model.normalizer_spec.precompiled_charsmap or not model.normalizer_spec.add_dummy_prefix or model.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("a BPE model with identity normalisation and a dummy prefix is needed")
    return {"pieces": [p.piece for p in model.pieces], "scores": [p.score for p in model.pieces], "kinds": [p.type for p in model.pieces]}


class Coder:
    """Segments, encodes and decodes texts with one model."""

    def __init__(self, model: dict):
        self.id = {p: i for i, (p, k) in enumerate(zip(model["pieces"], model["kinds"])) if k == NORMAL}
        self.score = {p: s for p, s, k in zip(model["pieces"], model["scores"], model["kinds"]) if k == NORMAL}
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(model["pieces"], model["kinds"])) if k == BYTE}
        self.longest = max(map(len, self.id), default=1)
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("pieces that hold a space mark after other characters are not supported")
        self.feed = not any("\n" in p for p in self.id)
        self.byte_id = np.array([self.byte.get(b, 0) for b in range(256)], np.int32)
        texts = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() if k == NORMAL else b"" for p, k in zip(model["pieces"], model["kinds"])]
        self.raw = np.frombuffer(b"".join(texts), np.uint8)
        self.raw_size = np.array([len(t) for t in texts], np.int64)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        self.pairs: dict[tuple[str, str], bool] = {}
        self.stays: dict[str, bool] = {}
        self._unions()

    def _unions(self):
        """Numbers of symbols (pieces and the characters in them; 0 is any other character), and a hash table of
        the pairs whose union is a piece."""
        number = {p: k for k, p in enumerate(dict.fromkeys([*self.id, *(c for p in self.id for c in p)]), 1)}
        self.symbols = len(number) + 1
        self.piece = np.full(self.symbols, -1, np.int32)
        self.rank = np.zeros(self.symbols, np.int32)
        if self.id:
            own = np.array([number[p] for p in self.id])
            self.piece[own] = list(self.id.values())
            self.rank[own] = np.unique(-np.array(list(self.score.values())), return_inverse=True)[1]
        chars = sorted((ord(p), k) for p, k in number.items() if len(p) == 1)
        self.char, self.char_symbol = np.array([c for c, _ in chars], np.uint32), np.array([k for _, k in chars], np.int32)
        found = {(number[p[:k]] * self.symbols + number[p[k:]]): number[p] for p in self.id for k in range(1, len(p)) if p[:k] in number and p[k:] in number}
        self.bits = max(4, (4 * len(found)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        keys, values = np.array(list(found), np.int64), np.array(list(found.values()), np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] < 0)
            free = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[free]], self.values[slot[free]] = keys[free], values[free]
            left = np.ones(len(keys), bool)
            left[free] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * W.STEP) >> np.uint64(64 - self.bits)).astype(np.int64)

    def union(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbol of each pair's union, 0 if that is no piece."""
        keys = a.astype(np.int64) * self.symbols + b
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], 0)
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
            there = self.keys[slot[left]]
            hit = there == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (there >= 0)]
        return out

    def merged(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """BPE of many words, a column each: in every round each word merges the pair whose union scores best,
        leftmost first.  Gives the symbols and where one begins."""
        width, n = symbols.shape
        none = np.int32(2**31 - 1)
        bits = max(1, (width - 1).bit_length())
        out, out_alive = np.zeros((width, n), np.int32), np.zeros((width, n), bool)
        # a last row stands for what is before the first and after the last symbol
        sym = np.vstack([symbols, np.zeros((1, n), np.int32)])
        alive = np.arange(width + 1)[:, None] < lengths
        after = np.repeat(np.arange(1, width + 2, dtype=np.int16)[:, None], n, 1)
        before = np.repeat(np.arange(-1, width, dtype=np.int16)[:, None], n, 1)
        before[0] = width
        rank = lambda u, at: np.where(u > 0, (self.rank[u] << bits) | at, none)
        joint = np.zeros((width + 1, n), np.int32)
        best = np.full((width + 1, n), none)
        for j in range(width - 1):
            joint[j] = self.union(sym[j], sym[j + 1])
            best[j] = rank(joint[j], np.int32(j))
        columns = np.arange(n)
        while len(columns):
            least = best.min(0)
            go = np.flatnonzero(least < none)
            if len(go) < 0.8 * len(columns):
                done = least == none
                out[:, columns[done]], out_alive[:, columns[done]] = sym[:-1, done], alive[:-1, done]
                sym, alive, after, before, joint, best = (np.take(x, go, 1) for x in (sym, alive, after, before, joint, best))
                columns, least, go = columns[go], least[go], np.arange(len(go))
                continue
            m = len(columns)
            s, v, f, b, q, k = (x.reshape(-1) for x in (sym, alive, after, before, joint, best))
            at = least[go] & ((1 << bits) - 1)
            here = at * m + go
            new = q[here]
            gone = f[here].astype(np.int64) * m + go
            s[here], v[gone], k[gone] = new, False, none
            then = f[gone]
            f[here] = then
            right = then.astype(np.int64) * m + go
            b[right] = at
            u = self.union(new, s[right])
            q[here], k[here] = u, rank(u, at)
            prior = b[here]
            left = prior.astype(np.int64) * m + go
            u = self.union(s[left], new)
            q[left], k[left] = u, rank(u, prior.astype(np.int32))
            k[width * m :] = none
        return out, out_alive

    def _bytes(self, symbols: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols and their number for each: a character without a piece has its bytes' ids."""
        piece = self.piece[symbols]
        size = np.where(piece >= 0, 1, 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)).astype(np.int64)
        ids = np.repeat(piece, size)
        odd = np.flatnonzero(ids < 0)
        if len(odd):
            which = np.repeat(np.arange(len(size)), size)[odd]
            c, n = chars[which].astype(np.int64), size[which]
            nth = odd - (np.cumsum(size) - size)[which]
            low = (c >> (6 * (n - 1 - nth))) & 0x3F | 0x80
            lead = np.where(n == 1, c, np.choose(n - 1, [c, 0xC0 | c >> 6, 0xE0 | c >> 12, 0xF0 | c >> 18]))
            ids[odd] = self.byte_id[np.where(nth == 0, lead, low)]
        return ids, size

    def _words(self, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different words: flat ids, and each word's place and number in them."""
        at, count, flat, held = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), [], 0
        order = np.argsort(lengths, kind="stable")
        bounds = np.searchsorted(lengths[order], [1, *(w + 1 for w in WIDTHS)])
        for width, a, b in zip(WIDTHS, bounds[:-1], bounds[1:]):
            for i in range(a, b, CELLS // width):
                rows = order[i : min(b, i + CELLS // width)]
                places = starts[rows] + np.minimum(np.arange(width)[:, None], lengths[rows] - 1)
                place = np.minimum(np.searchsorted(self.char, points[places]), len(self.char) - 1) if len(self.char) else np.zeros(places.shape, np.int64)
                known = self.char[place] == points[places] if len(self.char) else np.zeros(places.shape, bool)
                known &= np.arange(width)[:, None] < lengths[rows]
                symbols, begins = self.merged(np.where(known, self.char_symbol[place] if len(self.char) else 0, 0).astype(np.int32), lengths[rows])
                take = begins.T
                ids, size = self._bytes(symbols.T[take], points[places].T[take])
                total = np.concatenate([[0], np.cumsum(size)])
                ends = total[np.cumsum(take.sum(1))]
                count[rows] = np.diff(ends, prepend=0)
                at[rows] = held + ends - count[rows]
                flat.append(ids)
                held += len(ids)
        for r in order[bounds[-1] :]:
            text = points[starts[r] : starts[r] + lengths[r]].tobytes().decode("utf-32-le")
            ids = [i for p in self.trace(self.lattice(text, 0, "", len(text)), 0, len(text)) for i in self.ids(p)]
            at[r], count[r] = held, len(ids)
            flat.append(np.array(ids, np.int32))
            held += len(ids)
        return np.concatenate(flat) if flat else np.empty(0, np.int32), at, count

    def segment(self, marked: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts whose spaces are marks and that begin and end at a break, one after another, and
        their number for each text.  Equal words of a slice are segmented once."""
        parts, numbers = [], []
        sizes = np.cumsum([0] + [len(t) for t in marked])
        for i, j in W.slices(sizes, SLICE):
            points = np.frombuffer("".join(marked[i:j]).encode("utf-32-le"), np.uint32)
            breaks = self.break_mask(points)
            edges = np.unique(sizes[i : j + 1] - sizes[i])
            breaks[edges[edges < len(points)]] = True
            starts = np.flatnonzero(breaks)
            ends = np.append(starts[1:], len(points)) if len(starts) else starts
            _, first, back = np.unique(W.code_hashes(points, starts, ends), return_index=True, return_inverse=True)
            flat, at, count = self._words(points, starts[first], (ends - starts)[first])
            n = count[back]
            parts.append(flat[np.repeat(at[back] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
            upto = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(starts, sizes[i : j + 1] - sizes[i])]
            numbers.append(np.diff(upto))
        return np.concatenate(parts) if parts else np.empty(0, np.int32), np.concatenate(numbers) if numbers else np.empty(0, np.int64)

    def break_mask(self, points: np.ndarray) -> np.ndarray:
        """Positions that no piece crosses: before a space mark that follows something else, beside a line feed."""
        mark = points == ord(SPACE)
        out = mark.copy()
        out[1:] &= ~mark[:-1]
        if self.feed:
            feed = points == 10
            out |= feed
            out[1:] |= feed[:-1]
        return out

    def merge(self, text: str) -> list[str]:
        """BPE of a short text: the pair whose union scores best is merged, leftmost first."""
        parts, score = list(text), self.score.get
        unions = [score(a + b, LEAST) for a, b in zip(parts, parts[1:])]
        while unions:
            best = max(unions)
            if best == LEAST:
                break
            at = unions.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del unions[at]
            if at:
                unions[at - 1] = score(parts[at - 1] + parts[at], LEAST)
            if at < len(unions):
                unions[at] = score(parts[at] + parts[at + 1], LEAST)
        return parts

    def weightless(self, a: str, b: str) -> bool:
        """Whether the step from piece a to piece b has weight 0."""
        if a == "":
            return True
        if (got := self.pairs.get((a, b))) is None:
            if len(self.pairs) > KEPT:
                self.pairs.clear()
            got = self.pairs[a, b] = self.merge(a + b) == [a, b]
        return got

    def is_node(self, piece: str) -> bool:
        if len(piece) == 1:
            return True
        if piece not in self.score:
            return False
        if (got := self.stays.get(piece)) is None:
            got = self.stays[piece] = self.merge(piece) == [piece]
        return got

    def lattice(self, text: str, begin: int, before: str, end: int) -> dict[int, str]:
        """Last piece of the weight-0 path from (begin, after piece `before`) to each
        position up to `end`; positions without a path are absent."""
        last = {begin: before}
        for at in range(begin + 1, end + 1):
            for size in range(min(self.longest, at - begin), 0, -1):
                prior = last.get(at - size)
                if prior is None:
                    continue
                piece = text[at - size : at]
                if self.is_node(piece) and self.weightless(prior if at - size > begin or before else "", piece):
                    last[at] = piece
                    break
        return last

    @staticmethod
    def trace(last: dict[int, str], begin: int, end: int) -> list[str]:
        out = []
        while end > begin:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def ids(self, piece: str) -> tuple[int, ...]:
        found = self.id.get(piece)
        return (found,) if found is not None else tuple(self.byte[b] for b in piece.encode())

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        return self.segment([(SPACE + t).replace(" ", SPACE) if t else "" for t in texts])

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of consecutive stretches of ids."""
        texts = []
        for i, j in W.slices(offsets, SLICE):
            own = ids[offsets[i] : offsets[j]]
            size = self.raw_size[own]
            upto = np.concatenate([[0], np.cumsum(size)])
            raw = self.raw[np.repeat(self.raw_at[own] - upto[:-1], size) + np.arange(upto[-1])].tobytes()
            bounds = upto[offsets[i : j + 1] - offsets[i]]
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                text = raw[a:b].decode("utf-8", "replace")
                texts.append(text[1:] if text.startswith(" ") else text)
        return texts

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, np.int64), np.array([0, len(ids)]))[0]

    # one chunk of a giant text: `left` and `right` are the neighbours' characters

    def entries(self, left: str, body: str) -> list[tuple[str, int]]:
        """States at the cut between two strings: every piece over its last character
        before it, with its reach beyond."""
        around, at = left + body, len(left)
        return [(around[s:e], e - at) for s in range(max(0, at - self.longest), at) for e in range(at, min(len(around), s + self.longest) + 1) if self.is_node(around[s:e])]

    def _frame(self, body: str, right: str):
        text = body + right[: self.longest]
        inner = np.flatnonzero(self.break_mask(np.frombuffer(text.encode("utf-32-le"), np.uint32)))
        inner = inner[(inner >= self.longest) & (inner < len(body))].tolist()
        return text, (inner[0], inner[-1]) if inner else None

    def exits(self, last: dict[int, str], size: int, final: bool) -> list[tuple[str, int]]:
        if final:
            return [(last[size], 0)] if size in last else []
        return [(last[e], e - size) for e in range(size, size + self.longest) if e in last and e - len(last[e]) < size]

    def matrix(self, left: str, body: str, right: str) -> list[tuple[str, int, str, int]]:
        """Weight-0 entries of the chunk's transfer matrix: entry state, exit state."""
        text, inner = self._frame(body, right)
        final = not right
        states = self.entries(left, body) if left else [("", 0)]
        reach = len(body) if final else min(len(text), len(body) + self.longest - 1)
        if inner:
            first, last = inner
            open_ = [s for s in states if first in self.lattice(text, s[1], s[0], first)]
            out = self.exits(self.lattice(text, last, "", reach), len(body), final)
            return [(*s, *o) for s in open_ for o in out]
        return [(*s, *o) for s in states for o in self.exits(self.lattice(text, s[1], s[0], reach), len(body), final)]

    def backtrace(self, left: str, body: str, right: str, entry: tuple[str, int], out: tuple[str, int]) -> tuple[list[int], str, list[int]]:
        """Ids of the chunk's head, its inside between breaks, and ids of its tail."""
        text, inner = self._frame(body, right)
        end = len(body) + out[1]
        ids = lambda path: [i for p in path for i in self.ids(p)]
        if inner:
            first, last = inner
            head = self.trace(self.lattice(text, entry[1], entry[0], first), entry[1], first)
            return ids(head), text[first:last], ids(self.trace(self.lattice(text, last, "", end), last, end))
        return ids(self.trace(self.lattice(text, entry[1], entry[0], end), entry[1], end)), "", []


def _coder(shared) -> Coder:
    """The worker's coder for a model; tasks that run one after another in a worker share what it knows."""
    if shared.id not in _coders:
        _coders.clear()
        _coders[shared.id] = Coder(shared.value)
    return _coders[shared.id]


class _Shared:
    """A broadcast model with a name of its own."""

    def __init__(self, spark, model: dict):
        self.id, self.sent = hash(tuple(map(tuple, (model["pieces"], model["scores"], model["kinds"])))), spark.sparkContext.broadcast(model)

    @property
    def value(self):
        return self.sent.value


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids.astype(np.int32)))


def _encode(shared):
    def run(batches):
        coder = _coder(shared)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(*coder.encode_all(batch.column(1).to_pylist()))], ["_rest", "ids"])

    return run


def _split(longest: int, size: int):
    def run(batches):
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for k, text in enumerate(batch.column(1).to_pylist()):
                row += 1
                marked = (SPACE + text).replace(" ", SPACE)
                for no, at in enumerate(range(0, len(marked), size)):
                    # a last piece shorter than the longest one goes with the chunk before it
                    if no and len(marked) - at <= longest:
                        break
                    to = at + size if len(marked) - at - size > longest else len(marked)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(k, 1), pa.array([row]), pa.array([no]), pa.array([marked[max(0, at - longest) : at]]), pa.array([marked[at:to]]), pa.array([marked[to : to + longest]])],
                        ["_rest", "_row", "no", "l", "body", "r"],
                    )

    return run


CELL_SQL = "struct<p:string,over:int,q:string,out:int>"
CELL = pa.struct([("p", pa.string()), ("over", pa.int32()), ("q", pa.string()), ("out", pa.int32())])


def _matrices(shared):
    def run(batches):
        coder = _coder(shared)
        for batch in batches:
            cells = [[dict(zip(("p", "over", "q", "out"), c)) for c in coder.matrix(*x)] for x in zip(*(batch.column(k).to_pylist() for k in ("l", "body", "r")))]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("no"), pa.array(cells, pa.list_(CELL))], ["_row", "no", "cells"])

    return run


def _combined(data: pa.Table) -> pa.Table:
    """Product of the matrices of neighbouring stretches of a text, in order."""
    product: dict | None = None
    for _, cells in sorted(zip(data["no"].to_pylist(), data["cells"].to_pylist()), key=lambda x: x[0]):
        step: dict = {}
        for c in cells:
            step.setdefault((c["p"], c["over"]), []).append((c["q"], c["out"]))
        if product is None:
            product = {entry: set(outs) for entry, outs in step.items()}
        else:
            product = {entry: set().union(*(step.get(s, ()) for s in states)) for entry, states in product.items()}
    cells = [dict(zip(("p", "over", "q", "out"), (*entry, *out))) for entry, outs in product.items() for out in sorted(outs)]
    return pa.table({"_row": data["_row"].slice(0, 1), "no": pa.array([data["no"][0].as_py() // FAN], pa.int64()), "cells": pa.array([cells], pa.list_(CELL))})


def _handed_down(data: pa.Table) -> pa.Table:
    """States between neighbouring stretches on the path through them that the stretch they form has."""
    over = data["cell"][0].as_py()
    parts = sorted(zip(data["no"].to_pylist(), data["cells"].to_pylist()), key=lambda x: x[0])
    reached, back = {(over["p"], over["over"])}, []
    for _, cells in parts:
        step = {}
        for c in cells:
            if (c["p"], c["over"]) in reached:
                step.setdefault((c["q"], c["out"]), (c["p"], c["over"]))
        back.append(step)
        reached = step.keys()
    states = [(over["q"], over["out"])]
    for step in back[::-1]:
        states.append(step[states[-1]])
    states.reverse()
    cells = [dict(zip(("p", "over", "q", "out"), (*states[k], *states[k + 1]))) for k in range(len(parts))]
    return pa.table({"_row": pa.array([data["_row"][0].as_py()] * len(parts), pa.int64()), "no": pa.array([no for no, _ in parts], pa.int64()), "cell": pa.array(cells, CELL)})


def _states(matrices: DataFrame, most: int) -> DataFrame:
    """(_row, no, cell): entry and exit of every chunk on its text's path.

    Matrices of FAN neighbours are multiplied in a task, their products again, up to one for each text (of `most` chunks
    at most); then the states are handed down the same tree.
    """
    levels, left = [matrices], most
    group = F.expr(f"no div {FAN}")
    while left > 1:
        levels.append(cut(levels[-1].groupBy("_row", group.alias("_g")).applyInArrow(_combined, f"_row bigint, no bigint, cells array<{CELL_SQL}>")))
        left = -(-left // FAN)
    states = levels[-1].select("_row", "no", F.get("cells", F.lit(0)).alias("cell"))
    for level in levels[-2::-1]:
        above = states.select("_row", F.col("no").alias("_g"), "cell")
        states = level.withColumn("_g", group).join(above, ["_row", "_g"]).groupBy("_row", "_g").applyInArrow(_handed_down, f"_row bigint, no bigint, cell {CELL_SQL}")
    return states


def _traced(shared):
    def run(batches):
        coder = _coder(shared)
        for batch in batches:
            parts = [coder.backtrace(left, body, right, (c["p"], c["over"]), (c["q"], c["out"])) for left, body, right, c in zip(*(batch.column(k).to_pylist() for k in ("l", "body", "r", "cell")))]
            inside, n = coder.segment([x for _, x, _ in parts])
            at = np.concatenate([[0], np.cumsum(n)])
            ids = [np.concatenate([head, inside[a:b], tail]).astype(np.int32) for (head, _, tail), a, b in zip(parts, at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("no"), _lists(np.concatenate(ids) if ids else np.empty(0), np.array([len(i) for i in ids], np.int64))], ["_row", "no", "ids"])

    return run


def encode(docs: DataFrame, text_col: str = "text", model_path: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """The input's columns without the text, and `ids`: the model's piece ids.

    Null and empty texts have no ids; other columns may hold anything and repeat, one called `ids`
    gives way to the result; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = read_model(model_path)
    shared = _Shared(spark, model)
    rest = [c for c in docs.columns if c not in (text_col, "ids")]
    rows = docs.select((F.struct(*(F.col(f"`{c}`") for c in rest)) if rest else F.struct(F.lit(0).alias("_none"))).alias("_rest"), F.col(text_col).alias("_text"))
    kind = rows.schema["_rest"].dataType.simpleString()
    cuts = F.coalesce(F.length("_text") > chunk, F.lit(False))
    whole = rows.where(~cuts).mapInArrow(_encode(shared), f"_rest {kind}, ids array<int>")
    longest = max(len(p) for p, k in zip(model["pieces"], model["kinds"]) if k == NORMAL)
    chunks = cut(rows.where(cuts).mapInArrow(_split(longest, chunk), f"_rest {kind}, _row bigint, no bigint, l string, body string, r string"))
    most = chunks.agg(F.max("no")).first()[0]
    if most is not None:
        matrices = cut(chunks.select("_row", "no", "l", "body", "r").mapInArrow(_matrices(shared), f"_row bigint, no bigint, cells array<{CELL_SQL}>"))
        states = _states(matrices, most + 1)
        traced = chunks.select("_row", "no", "l", "body", "r").join(states, ["_row", "no"]).mapInArrow(_traced(shared), "_row bigint, no bigint, ids array<int>")
        joined = traced.groupBy("_row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", "ids"))), lambda x: x["ids"])).alias("ids"))
        whole = whole.unionByName(chunks.where("no = 0").select("_row", "_rest").join(joined, "_row").select("_rest", "ids"))
    return whole.select(*(F.col(f"_rest.`{c}`").alias(c) for c in rest), "ids")


def decode(coded: DataFrame, ids_col: str = "ids", model_path: str = MODEL, to: str = "decoded") -> DataFrame:
    """The input's columns and the text of the ids (null ids give an empty text); an input column called as
    the result gives way to it."""
    shared = _Shared(coded.sparkSession, read_model(model_path))
    kept = [c for c in coded.columns if c != to]
    rows = coded.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_rest"), F.col(ids_col).alias("_ids"))

    def run(batches):
        coder = _coder(shared)
        for batch in batches:
            lists = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            flat, at = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(coder.decode_all(flat, at), pa.string())], ["_rest", "_to"])

    return rows.mapInArrow(run, f"_rest {rows.schema['_rest'].dataType.simpleString()}, _to string").select(*(F.col(f"_rest.`{c}`").alias(c) for c in kept), F.col("_to").alias(to))


def op10_sentencepieces(spark, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether decoding them gives the text back (marks that stand in
    the text itself come back as spaces)."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    coded = encode(docs.select("doc_id", F.sha2(F.coalesce(F.translate("text", SPACE, " "), F.lit("")).cast("binary"), 256).alias("text_sha256"), "text"))
    back = decode(coded)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.sha2(F.col("decoded").cast("binary"), 256) == F.col("text_sha256")).alias("round_trip"))

