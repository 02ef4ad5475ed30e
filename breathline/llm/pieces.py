"""Sampled segmentation over the lattice of a SentencePiece vocabulary, and lossless decoding.

No piece has a word mark after its first character (those that do are left out), so
the lattice of a text is a chain of the lattices of its space-separated units. The
forward sums of each distinct unit are computed once and kept in a bounded table of
lattice nodes; the backward draws of all units of many texts then advance together, one
piece a step. The random numbers are a hash of row key, unit number and step, so
neither batches nor partitions change a draw.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breathline.llm.textvec import tidy

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Lattice nodes kept; the table is emptied between passes once it is larger.
TABLE_NODES = 1_000_000
#: Characters of texts that advance together; a longer text is a pass of its own.
PASS_CHARS = 100_000
#: Weight of one byte of a character that the vocabulary lacks.
BYTE_WEIGHT = -12.0
#: No piece of this length ends here.
_NONE = np.iinfo(np.int32).min

_STEP, _MIX_A, _MIX_B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the splitmix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def _seed(key: str) -> int:
    return int.from_bytes(hashlib.blake2b(key.encode(), digest_size=8).digest(), "big")


class Sampler:
    """Pieces weigh by Zipf's law of their rank: the model has merge ranks, not probabilities."""

    def __init__(self, model_file: str = MODEL, sharpness: float = 1.0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.weight, self.id, self.byte, raw = {}, {}, [0] * 256, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                raw.append(bytes([int(piece[3:5], 16)]))
                continue
            raw.append(piece.replace(MARK, " ").encode())
            if not model.is_control(i) and not model.is_unknown(i) and MARK not in piece[1:]:
                self.id[piece], self.weight[piece] = i, -sharpness * math.log(i + 2.7)
        self.longest = max(map(len, self.id))
        self.raw_size = np.array([len(r) for r in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self._trie()
        self._empty()

    def _trie(self) -> None:
        """For each depth: arcs by (state, character) in ascending order and their targets; then the piece that ends in each state."""
        arcs, ends = [{} for _ in range(self.longest)], [-1]
        for piece, i in self.id.items():
            state = 0
            for char, known in zip(map(ord, piece), arcs):
                key = (state << 21) + char
                if key not in known:
                    known[key] = len(ends)
                    ends.append(-1)
                state = known[key]
            ends[state] = i
        self.arcs = [np.array(sorted(known), np.int64) for known in arcs]
        self.target = [np.array([known[k] for k in keys.tolist()], np.int32) for known, keys in zip(arcs, self.arcs, strict=True)]
        self.ends = np.array(ends, np.int32)
        self.weights = np.zeros(len(self.raw_size))
        for piece, i in self.id.items():
            self.weights[i] = self.weight[piece]

    def _empty(self) -> None:
        """Node n's options start at first[n]: pieces with the node before each, up to ascending edges; the last edge is the largest number."""
        self.units: dict[str, int] = {}
        self.nodes, self.first, self.edge, self.before, self.piece = 0, array("i"), array("I"), array("i"), array("i")

    def _add(self, new: list[str]) -> None:
        """Filter forward through the lattices of new units, all together, and keep their nodes: one per character."""
        texts = [MARK + u for u in new]
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.array([len(t) for t in texts], np.int64)
        first = np.cumsum(size) - size
        place = np.arange(len(chars)) - np.repeat(first, size)
        left = np.repeat(size, size) - place
        share = np.full((len(chars), self.longest), -np.inf)
        piece = np.full((len(chars), self.longest), _NONE, np.int32)
        flat_share, flat_piece = share.ravel(), piece.ravel()
        at = np.flatnonzero((place == 0) | (chars != ord(MARK)))
        state = np.zeros(len(at), np.int32)
        for length, (arcs, target) in enumerate(zip(self.arcs, self.target, strict=True), 1):
            key = (state.astype(np.int64) << 21) + chars[at + length - 1]
            arc = np.minimum(np.searchsorted(arcs, key), len(arcs) - 1)
            on = np.flatnonzero(arcs[arc] == key)
            at, state = at[on], target[arc[on]]
            got = self.ends[state]
            full = np.flatnonzero(got >= 0)
            got, into = got[full], (at[full] + length - 1) * self.longest + length - 1
            flat_piece[into], flat_share[into] = got, self.weights[got]
            on = np.flatnonzero(left[at] > length)
            at, state = at[on], state[on]
        lone = np.flatnonzero(piece[:, 0] == _NONE)  # bytes, also for a word mark in the text itself
        n_bytes = 1 + (chars[lone] > 0x7F) + (chars[lone] > 0x7FF) + (chars[lone] > 0xFFFF)
        piece[lone, 0], share[lone, 0] = -1 - chars[lone], BYTE_WEIGHT * n_bytes
        alpha, by_size = np.zeros(len(chars)), np.argsort(-size, kind="stable")
        heads, tall = first[by_size], -size[by_size]
        for end in range(1, int(size.max()) + 1):
            rows, wide = heads[: np.searchsorted(tall, -end, side="right")] + end - 1, min(end, self.longest)
            sums = share[rows, :wide]
            for length in range(1, min(end - 1, wide) + 1):
                sums[:, length - 1] += alpha[rows - length]
            top = sums.max(axis=1)
            sums = np.cumsum(np.exp(sums - top[:, None]), axis=1)
            alpha[rows] = top + np.log(sums[:, -1])
            share[rows, :wide] = sums / sums[:, -1:]
        taken = np.flatnonzero(flat_piece != _NONE)
        node, column = taken // self.longest, taken % self.longest
        edge = np.minimum(np.floor(flat_share[taken] * 4294967296.0), 4294967295.0).astype(np.uint32)
        edge[np.append(node[1:] != node[:-1], True)] = 4294967295
        starts = len(self.edge) + np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        self.first.frombytes(starts.astype(np.int32).tobytes())
        self.edge.frombytes(edge.tobytes())
        self.before.frombytes(np.where(column == place[node], -1, node + self.nodes - column - 1).astype(np.int32).tobytes())
        self.piece.frombytes(flat_piece[taken].tobytes())
        self.units.update(zip(new, (self.nodes + first + size - 1).tolist(), strict=True))
        self.nodes += len(chars)

    def _learn(self, new: set[str]) -> None:
        """Add units that the table lacks, in parts of at most PASS_CHARS characters or one unit."""
        part, held = [], 0
        for unit in sorted(new):
            if part and held + len(unit) > PASS_CHARS:
                self._add(part)
                part, held = [], 0
            part.append(unit)
            held += len(unit) + 1
        if part:
            self._add(part)

    def _ends(self, units: list[str]) -> np.ndarray:
        """The last node of each unit; new units are learnt first."""
        found = list(map(self.units.get, units))
        lacking = [i for i, node in enumerate(found) if node is None]
        if lacking:
            self._learn({units[i] for i in lacking})
            for i in lacking:
                found[i] = self.units[units[i]]
        return np.array(found, np.int32)

    def _spell(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Replace each character without a piece, held as -1 - its code point, by its byte pieces."""
        lone = np.flatnonzero(ids < 0)
        if not len(lone):
            return ids, offsets
        spelt = [[self.byte[b] for b in chr(-1 - c).encode()] for c in ids[lone].tolist()]
        width = np.ones(len(ids), np.int64)
        width[lone] = [len(b) for b in spelt]
        ends = np.cumsum(width)
        out = np.repeat(ids, width)
        out[out < 0] = [b for bytes_ in spelt for b in bytes_]
        return out, np.concatenate([[0], ends])[offsets]

    def encode_many(self, texts: list[str], keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): a segmentation of each text drawn from its lattice's distribution."""
        if self.nodes > TABLE_NODES:
            self._empty()
        split = [t.split(" ") for t in texts]
        at = self._ends([u for units in split for u in units])
        sizes = np.array([len(units) for units in split], np.int64)
        ends = np.cumsum(sizes)
        number = np.arange(len(at)) - np.repeat(ends - sizes, sizes)
        seeds = np.repeat(np.array([_seed(k) for k in keys], np.uint64), sizes)
        state = _mix(seeds + _mix(number.astype(np.uint64) + np.uint64(1)))
        first, edge, before, piece = (np.frombuffer(a, t) for a, t in ((self.first, np.int32), (self.edge, np.uint32), (self.before, np.int32), (self.piece, np.int32)))
        active, drawn = np.arange(len(at), dtype=np.int32), []
        count = np.zeros(len(at), np.int32)
        while len(active):
            state += _STEP
            target = np.minimum(_mix(state) >> np.uint64(32), np.uint64(4294967294)).astype(np.uint32)
            option = first[at]
            beyond = np.flatnonzero(edge[option] <= target)
            while len(beyond):
                option[beyond] += 1
                beyond = beyond[edge[option[beyond]] <= target[beyond]]
            drawn.append((active, piece[option]))
            count[active] += 1
            at = before[option]
            on = at >= 0
            active, at, state = active[on], at[on], state[on]
        last = np.cumsum(count)
        ids = np.empty(int(last[-1]) if len(last) else 0, np.int32)
        for step, (units, got) in enumerate(drawn, 1):
            ids[last[units] - step] = got
        return self._spell(ids, np.concatenate([[0], last[ends - 1]]) if len(ends) else np.zeros(1, np.int64))

    def decode_many(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, the end of each piece in them)."""
        size = self.raw_size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.raw[np.repeat(self.raw_at[ids] - (ends - size), size) + np.arange(total)], ends

    def encode(self, text: str, key: str) -> list[int]:
        """A segmentation drawn from the lattice's distribution; the same key draws the same."""
        return self.encode_many([text], [key])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return self.decode_many(np.asarray(ids, np.int64))[0].tobytes()[1:].decode()

    def lossless(self, texts: list[str], ids: np.ndarray, offsets: np.ndarray) -> list[bool]:
        """Whether decoding each text's ids gives its bytes again."""
        found, ends = self.decode_many(ids)
        cuts = np.concatenate([[0], ends])[offsets]
        return [found[a + 1 : b].tobytes() == t.encode() for t, a, b in zip(texts, cuts[:-1], cuts[1:], strict=True)]


_samplers: dict[tuple[str, float], Sampler] = {}


def sampler(model_file: str, sharpness: float) -> Sampler:
    if (model_file, sharpness) not in _samplers:
        _samplers[model_file, sharpness] = Sampler(model_file, sharpness)
    return _samplers[model_file, sharpness]


def _passes(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of at most PASS_CHARS characters, or one row."""
    first, held = 0, 0
    for row in range(len(texts)):
        size = len(texts[row].as_py() or "")
        if row > first and held + size > PASS_CHARS:
            yield first, row
            first, held = row, 0
        held += size
    if len(texts) > first:
        yield first, len(texts)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, model_file: str = MODEL, sharpness: float = 1.0) -> DataFrame:
    """(id, ids, lossless) of each row: the sampled pieces, and whether decoding gives the text again.

    The draw depends on the seed and the id only. A null text has null ids and null
    ``lossless``; an empty text is the word mark alone; rows repeated under an id and
    text give equal pieces; other columns are ignored. The tokenizer file is read where
    the rows are, at ``model_file``.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sampler(model_file, sharpness)
        for batch in batches:
            for first, end in _passes(batch.column("text")):
                part = batch.slice(first, end - first)
                rows = part.column("text").to_pylist()
                texts = [t for t in rows if t is not None]
                keys = [f"{seed}:{k}" for k, t in zip(part.column("id").to_pylist(), rows, strict=True) if t is not None]
                flat, offsets = own.encode_many(texts, keys)
                same = iter(own.lossless(texts, flat, offsets))
                null = np.array([t is None for t in rows])
                where = np.zeros(len(rows) + 1, np.int32)
                where[1:] = offsets[np.cumsum(~null)]
                ids = pa.ListArray.from_arrays(pa.array(where), pa.array(flat), mask=pa.array(null))
                kept = pa.array([None if t is None else next(same) for t in rows], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("id"), ids, kept], ["id", "ids", "lossless"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(tidy(run), "id long, ids array<int>, lossless boolean")
