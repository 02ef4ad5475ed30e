"""Toxicity: a subsequence string-kernel SVM with Nyström landmarks, trained on labelled sentences.

Characters are folded to letters; marks between them vanish and spaced single letters
are one word, so inserted characters cost nothing. The kernel of two words sums decayed
matches of three-character subsequences that span at most five letters (the word's ends
count as letters), divided by the root of both words' kernels with themselves; that of
two sentences is the sum over their pairs of words. The machine separates sentences in
the space of its landmark sentences; a text scores as its worst sentence.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breathline.llm.skew import text_hash, without
from breathline.llm.storage import materialise
from breathline.llm.textvec import passes, tidy, word_hashes

DECAY = 0.6
#: Offsets of the second and third character.
PATTERNS = [(a, b) for a, b in combinations(range(1, 5), 2)]
#: Labelled rows of each class that the fit uses at most, by the order of a hash of the id.
FIT_ROWS = 2000
#: Letters of a unit: longer words are units in windows that overlap by half.
WIDTH = 16
#: Units of a sentence: longer ones go on in further pieces.
UNITS = 12
#: Landmark sentences, half of them from toxic texts.
LANDMARKS = 1000
#: Share of the machine's ridge, and of the largest eigenvalue below which the landmarks' space is cut.
RIDGE, EIGEN = 1e-3, 1e-4
#: Times that the worst sentences are picked anew and the machine is fitted.
ROUNDS = 4
#: A clean text that is rejected weighs as much as so many toxic ones that pass, by rate.
CLEAN_WEIGHT = 10.0
#: Bytes of text in one numpy pass.
PASS = 1 << 20
#: Units whose features are held at once.
BLOCK = 8192
#: Sentences whose features are held at once, besides the landmarks.
FEATURE_ROWS = 200

_EDGE, _SPACE, _STOP, _MARK = 31, 32, 33, 34
_DIM = 1 << 15
_LEET = dict(zip("01345@$", "oieasas", strict=True))


def _fold(c: str) -> int:
    """1-26 a folded Latin letter, 27-30 another one, else a space, a sentence mark or any other mark."""
    if c in " \t\r\x0b\x0c":
        return _SPACE
    if c in "\n.!?":
        return _STOP
    base = unicodedata.normalize("NFKD", _LEET.get(c, c).lower())[:1]
    if "a" <= base <= "z":
        return ord(base) - 96
    return 27 + ord(c) % 4 if unicodedata.category(c)[0] in "LN" else _SPACE if c.isspace() else _MARK


_FOLD = np.full(1 << 16, _MARK, np.uint8)
_FOLD[: 0xD800] = [_fold(chr(i)) for i in range(0xD800)]
_FOLD[0xF900:] = [_fold(chr(i)) for i in range(0xF900, 1 << 16)]


@dataclass
class Units:
    """Letters of a run of texts, and start, end, sentence and text of each unit; both ascend."""

    letters: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    sentence: np.ndarray
    row: np.ndarray


def units(data: np.ndarray, offsets: np.ndarray) -> Units:
    """Folded words of UTF-8 texts; sentences end at a mark before a space and after UNITS units."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begins = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    code = _FOLD[np.minimum(points, 0xFFFF)].copy()
    code[points > 0xFFFF] = _MARK
    n_rows = len(offsets) - 1
    row = np.repeat(np.arange(n_rows), np.diff(begins))
    after = np.full(len(code), True)  # whether a space, line or text ends here
    after[:-1] = (code[1:] == _SPACE) | (points[1:] == 10) | (row[1:] != row[:-1])
    ends_sentence = (code == _STOP) & (after | (points == 10))
    gap = (code == _SPACE) | ends_sentence
    gap[1:] |= row[1:] != row[:-1]  # the first character of a text; a letter there stays one
    letter = code < _EDGE
    word = np.cumsum(gap)[letter]
    part = np.cumsum(ends_sentence)[letter]
    letters, row = code[letter], row[letter]
    if not len(letters):
        none = np.zeros(0, np.int64)
        return Units(letters, none, none, none, none)
    first = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (row[1:] != row[:-1]))))
    size = np.diff(np.append(first, len(letters)))
    part, row = part[first], row[first]
    apart = np.concatenate(([True], (part[1:] != part[:-1]) | (row[1:] != row[:-1])))
    alone = size == 1
    head = np.concatenate(([True], ~(alone[1:] & alone[:-1]) | apart[1:]))  # spaced single letters are one word
    start, row, apart = first[head], row[head], np.maximum.reduceat(apart, np.flatnonzero(head))
    length = np.diff(np.append(start, len(letters)))
    pieces = np.where(length > WIDTH, -(-(length - WIDTH) // (WIDTH // 2)) + 1, 1)
    owner = np.repeat(np.arange(len(start)), pieces)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = start[owner] + step * (WIDTH // 2)
    ends = np.minimum(starts + WIDTH, start[owner] + length[owner])
    opens = apart[owner] & (step == 0)
    place = np.arange(len(owner)) - np.maximum.accumulate(np.where(opens, np.arange(len(owner)), 0))
    sentence = np.cumsum(opens | (place % UNITS == 0)) - 1
    return Units(letters, starts, ends, sentence, row[owner])


def _entries(found: Units, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, feature, value) of the units ``at``, features summed within a unit and divided by the root of k(u, u)."""
    size = found.ends[at] - found.starts[at]
    grid = np.zeros((len(at), WIDTH + 2), np.int64)
    place = np.arange(WIDTH)
    inside = place < size[:, None]
    source = np.minimum(found.starts[at][:, None] + place, max(len(found.letters) - 1, 0))
    grid[:, 1:-1] = np.where(inside, found.letters[source], 0)
    grid[:, 0] = _EDGE
    grid[np.arange(len(at)), size + 1] = _EDGE
    keys, values = [], []
    for a, b in PATTERNS:
        row, i = np.nonzero((np.arange(WIDTH + 2 - b) + b) < (size + 2)[:, None])
        keys.append(row * _DIM + ((grid[row, i] << 10) | (grid[row, i + a] << 5) | grid[row, i + b]))
        values.append(np.full(len(row), DECAY ** (b + 1)))
    keys, values = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    keys, values = keys[first], np.add.reduceat(values, first) if len(first) else values
    unit = keys // _DIM
    norm = np.sqrt(np.bincount(unit, values**2, minlength=len(at)))
    return unit, keys % _DIM, values / norm[unit]


def _distinct(found: Units) -> tuple[np.ndarray, np.ndarray]:
    """(a unit of each kind, the kind of each unit)."""
    hashes = word_hashes(found.letters, found.starts, found.ends)
    _, first, of = np.unique(hashes, return_index=True, return_inverse=True)
    return first, of


def sentence_scores(weights: np.ndarray, found: Units) -> tuple[np.ndarray, np.ndarray]:
    """(sum over the units' linear function, text) of each sentence."""
    if not len(found.starts):
        return np.zeros(0), np.zeros(0, np.int64)
    first, of = _distinct(found)
    each = np.zeros(len(first))
    for i in range(0, len(first), BLOCK):
        unit, feature, value = _entries(found, first[i : i + BLOCK])
        each[i : i + BLOCK] = np.bincount(unit, weights[feature] * value, minlength=len(first[i : i + BLOCK]))
    opens = np.flatnonzero(np.concatenate(([True], found.sentence[1:] != found.sentence[:-1])))
    return np.add.reduceat(each[of], opens), found.row[opens]


def vectors(sentences: list[str]) -> np.ndarray:
    """One row of subsequence features per string, each taken as one sentence."""
    raw = [s.encode() for s in sentences]
    found = units(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64))
    out = np.zeros((len(sentences), _DIM), np.float32)
    if len(found.starts):
        unit, feature, value = _entries(found, np.arange(len(found.starts)))
        np.add.at(out, (found.row[unit], feature), value.astype(np.float32))
    return out


def _text_of(found: Units, opens: np.ndarray, s: int) -> str:
    """The folded words of a sentence."""
    span = slice(opens[s], opens[s + 1] if s + 1 < len(opens) else len(found.starts))
    return " ".join("".join(chr(96 + c) if c < 27 else "αβγδ"[c - 27] for c in found.letters[a:b]) for a, b in zip(found.starts[span], found.ends[span], strict=True))


@dataclass
class Model:
    """Kernel SVM as a linear function of subsequences, with a logistic link on the worst sentence."""

    weights: np.ndarray
    slope: float
    offset: float

    def best(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), -1e3)
        for first, _, data, offsets in passes(column, PASS):
            scores, rows = sentence_scores(self.weights, units(data, offsets))
            np.maximum.at(out, rows + first, scores)
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.best(column) + self.offset, -50, 50)))


def _moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per class the number of texts and the sum and square sum of their mean features."""
    sums = np.zeros((2, 2, _DIM))
    n = np.zeros(2, np.int64)
    for batch in batches:
        labels = batch.column("label").to_numpy()
        for begin, end, data, offsets in passes(batch.column("text"), PASS):
            found = units(data, offsets)
            if not len(found.starts):
                continue
            first, of = _distinct(found)
            unit, feature, value = _entries(found, first)
            edges = np.searchsorted(unit, np.arange(len(first) + 1))
            for r in range(end - begin):
                mine = of[np.searchsorted(found.row, r) : np.searchsorted(found.row, r, "right")]
                if len(mine):
                    kinds = np.unique(mine)
                    at = np.concatenate([np.arange(edges[k], edges[k + 1]) for k in kinds])
                    mean = np.bincount(feature[at], value[at], minlength=_DIM) / len(kinds)
                    label = labels[begin + r]
                    sums[label, 0] += mean
                    sums[label, 1] += mean**2
                    n[label] += 1
    for k in np.flatnonzero(n):
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n[k]]), pa.array([sums[k].ravel()], pa.list_(pa.float64()))], ["label", "n", "s"])


def _picker(weights: np.ndarray, seed: int):
    """Per text its worst sentence under ``weights``, its score, and another sentence."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        for batch in batches:
            worst, other, high = [""] * len(batch), [""] * len(batch), np.full(len(batch), -1e3)
            for first, _, data, offsets in passes(batch.column("text"), PASS):
                found = units(data, offsets)
                scores, rows = sentence_scores(weights, found)
                opens = np.flatnonzero(np.concatenate(([True], found.sentence[1:] != found.sentence[:-1]))) if len(scores) else []
                for r in np.unique(rows):
                    a, b = np.searchsorted(rows, [r, r + 1])
                    top = a + int(np.argmax(scores[a:b]))
                    high[first + r], worst[first + r] = scores[top], _text_of(found, opens, top)
                    other[first + r] = _text_of(found, opens, int(rng.integers(a, b)))
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("left_out"), pa.array(worst), pa.array(other), pa.array(high)], ["label", "left_out", "worst", "other", "high"])

    return run


def _kernel(sentences: list[str], others: list[str] | None = None, step: int = FEATURE_ROWS) -> np.ndarray:
    """The kernel of each sentence with each of the others, by blocks of bounded size."""
    others = sentences if others is None else others
    blocks = []
    for i in range(0, len(sentences), step):
        part = vectors(sentences[i : i + step])
        blocks.append(np.hstack([part @ vectors(others[j : j + step]).T for j in range(0, len(others), step)]))
    return np.vstack(blocks)


def _spread(sentences: list[str], most: int) -> list[str]:
    """Sentences picked one by one, each the farthest from the span of those before (pivoted Cholesky)."""
    kernel = _kernel(sentences)
    length = np.sqrt(np.maximum(np.diag(kernel), 1e-9))
    kernel = kernel / length / length[:, None]
    left, basis, picked = np.diag(kernel).copy(), np.zeros((len(sentences), 0)), []
    while len(picked) < min(most, len(sentences)) and left.max() > 1e-3:
        i = int(np.argmax(left))
        column = (kernel[:, i] - basis @ basis[i]) / np.sqrt(left[i])
        basis = np.column_stack([basis, column])
        left = left - column**2
        left[i] = -1.0
        picked.append(i)
    return [sentences[i] for i in picked]


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of the squared-hinge machine, the last one the bias, by Newton steps; ``x`` ends with ones and may be single precision."""
    y, cost = y.astype(x.dtype), cost.astype(x.dtype)
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[-1, -1] = 1e-6
    for _ in range(15):
        active = y * (x @ w.astype(x.dtype)) < 1
        xa = x[active]
        weighted = xa * cost[active][:, None]
        new = np.linalg.solve((weighted.T @ xa).astype(np.float64) + penalty, (weighted.T @ y[active]).astype(np.float64))
        if np.abs(new - w).max() < 1e-4 * np.abs(new).max():
            return new
        w = new
    return w


def _landmarks(most: int):
    """In one task: the landmark sentences, half of them from the worst ones of either class."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).to_pandas()
        both = [_spread(sorted(set(rows.worst[rows.label == k])), most // 2) for k in (1, 0)]
        yield pa.RecordBatch.from_arrays([pa.array(both[0] + both[1], pa.string())], ["sentence"])

    return run


def _train(marks: list[str], turn: int):
    """In one task: the weights of the machine that parts the toxic texts' present worst sentences from the clean texts' ones so far."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).to_pandas()
        basis = vectors(marks)
        values, axes = np.linalg.eigh((basis @ basis.T).astype(np.float64))
        use = values > EIGEN * values.max()
        lift = (axes[:, use] / np.sqrt(values[use])).astype(np.float32)  # kernels with the landmarks to the Nyström space
        toxic = sorted(rows.worst[(rows.label == 1) & (rows.turn == turn)])
        clean = rows[rows.label == 0]
        clean = sorted(set(clean.worst) | set(clean.other[clean.turn == 0]))
        x = np.ones((len(toxic) + len(clean), lift.shape[1] + 1), np.float32)  # the last column is the bias
        for first, part in ((0, toxic), (len(toxic), clean)):
            for i in range(0, len(part), FEATURE_ROWS):
                end = min(i + FEATURE_ROWS, len(part))
                x[first + i : first + end, :-1] = vectors(part[i:end]) @ basis.T @ lift
        y = np.concatenate([np.ones(len(toxic)), -np.ones(len(clean))])
        cost = np.concatenate([np.full(len(part), 1 / len(part)) for part in (toxic, clean)])
        w = _machine(x, y, cost, RIDGE)
        yield pa.RecordBatch.from_arrays([pa.array([(basis.T @ (lift @ w[:-1].astype(np.float32))).astype(np.float64)], pa.list_(pa.float64()))], ["weights"])

    return run


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, landmarks: int = LANDMARKS, rounds: int = ROUNDS) -> Model:
    """Fit on at most ``fit_rows`` rows of each class: ``docs`` (id, text), ``labels`` (id, label).

    The first weights are the standardised difference of the classes' mean features.
    Landmarks are picked from the worst sentences of either class, each the farthest from
    those before. Then the machine is fitted on the worst sentences of toxic texts against
    the worst and other ones of clean texts, and these are picked anew. A quarter of the
    texts is left out of the fit and sets the cut; of equal cuts the middle one counts.
    The machine sees two sentences of each sampled text and round, so one task holds them;
    the driver gets the landmarks, the weights and the scores that set the cut.

    Null labels are ignored, of an id's repeated labels the largest counts, equal texts of
    a class count once; without texts of both classes every text gets the score 0.
    """
    nothing = Model(np.zeros(_DIM), 1.0, -50.0)
    labels = labels.filter("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").cast("int").alias("label"))
    picked = [labels.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(fit_rows) for k in (0, 1)]
    chosen = materialise(picked[0].unionByName(picked[1]), "labels")  # at most twice fit_rows small rows
    sample = docs.select("id", "text").join(F.broadcast(chosen), "id").withColumn("text", F.coalesce("text", F.lit("")))
    sample = materialise(sample.dropDuplicates(["label", "text"]).withColumn("left_out", F.crc32(F.concat(F.lit("left out "), "id").cast("binary")) % 4 == 0), "sample")
    spread_out = sample.repartition(max(2, docs.sparkSession.sparkContext.defaultParallelism))
    sums = [(0, np.zeros((2, _DIM)))] * 2
    for row in spread_out.mapInArrow(tidy(_moments), "label int, n long, s array<double>").toLocalIterator():
        n, s = sums[row.label]
        sums[row.label] = n + row.n, s + np.array(row.s).reshape(2, _DIM)
    if not sums[0][0] or not sums[1][0]:
        return nothing
    mean = [s[0] / n for n, s in sums]
    spread = sum(np.maximum(s[1] / n - m**2, 0) / n for m, (n, s) in zip(mean, sums, strict=True))
    weights = (mean[1] - mean[0]) / np.sqrt(spread + np.median(spread[spread > 0]))
    rows, marks = None, []
    for turn in range(rounds + 1):
        found = materialise(spread_out.mapInArrow(tidy(_picker(weights, turn)), "label int, left_out boolean, worst string, other string, high double").withColumn("turn", F.lit(turn)), "picked")
        if turn == rounds:
            break
        part = found.filter("not left_out and worst <> ''")
        rows = part if rows is None else rows.unionByName(part)
        if turn == 0:
            if part.select("label").distinct().count() < 2:
                return nothing
            marks = [r.sentence for r in part.select("label", "worst").repartition(1).mapInArrow(tidy(_landmarks(landmarks)), "sentence string").collect()]  # at most ``landmarks``
        weights = np.array(rows.repartition(1).mapInArrow(tidy(_train(marks, turn)), "weights array<double>").collect()[0].weights)
    high = found.select("label", "left_out", "high").toArrow().to_pandas()  # at most twice fit_rows figures
    for among in (high[high.left_out], high):
        good, bad = (among.high[among.label == k].to_numpy().round(6) for k in (0, 1))
        if len(good) and len(bad):
            break
    cuts = np.unique(np.concatenate([good, bad]))
    cuts = np.append((cuts[1:] + cuts[:-1]) / 2, cuts[-1] + 0.5)  # the last one rejects nothing
    errors = [(good >= c).mean() * CLEAN_WEIGHT + (bad < c).mean() for c in cuts]
    best = np.flatnonzero(errors == np.min(errors))
    return Model(weights, 8.0, -8.0 * float(cuts[best[len(best) // 2]]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(id, score) of each row of ``docs`` (id, text); null and empty texts have no sentence and score lowest.

    Repeated rows score alike; other columns are ignored; an empty table gives no rows;
    texts are read whole, however long.
    """

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.score(batch.column("text")))], ["id", "score"])

    return docs.select("id", "text").mapInArrow(tidy(apply), "id long, score double")


def keep_clean(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``cut``, with all columns; rows are told apart by id and text, those with a null id stay."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).filter("id is not null")

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = pa.array(model.score(batch.column("text")) >= cut)
            yield batch.select(["id", "th"]).filter(bad)

    hashed = rows.withColumn("th", text_hash(F.coalesce("text", F.lit(""))))
    rejected = hashed.select("id", "th", "text").mapInArrow(tidy(judge), "id long, th binary").distinct()
    return without(docs, materialise(rejected, "toxic"), id_col, text_col)
