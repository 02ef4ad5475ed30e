"""Secret scans: all rules in one pass over the bytes of a text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breathline.llm.automaton import Automaton, compile_rules

#: (kind, regex, either case, least characters). ``assign`` counts those of its value, the other
#: kinds those of the match. Only ``hex`` counts inside the automaton, where every text has hex
#: digits; counted runs of several rules would multiply its states.
BASE_RULES = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=\-]+""", True, 6),
    ("access", r"AKIA[A-Z0-9]+", False, 20),
    ("hex", r"[0-9a-f]{24,}", False, 24),
)
#: Further kinds, by the published shapes of common credentials.
MORE_RULES = (
    ("pem", r"-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----", False, 0),
    ("github", r"gh[oprsu]_[A-Za-z0-9]+", False, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9\-]+", False, 15),
)
RULES = BASE_RULES + MORE_RULES


class Scanner:
    """The combined automaton finds where some rule has matched; two small ones per rule give its ends."""

    def __init__(self, rules=RULES):
        self.rules = rules
        patterns = [(regex, fold) for _, regex, fold, _ in rules]
        self.combined = compile_rules(patterns, anchored=False)
        self.forward = [compile_rules([p], anchored=True) for p in patterns]
        self.backward = [compile_rules([p], anchored=True, backwards=True) for p in patterns]

    @staticmethod
    def _reach(automaton: Automaton, data: bytes, at: int, stop: int, step: int) -> tuple[int, int]:
        """(first, last) position where ``automaton``, run from ``at``, accepts; -1 if nowhere."""
        table, state, accepting, first, last = automaton.table, automaton.start, automaton.accepting, -1, -1
        while at != stop:
            state = table[state + data[at]]
            if not state:
                break
            if state >= accepting:
                first, last = at if first < 0 else first, at
            at += step
        return first, last

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) of the matches, leftmost and not overlapping per rule, sorted."""
        table, state, accepting, rules = self.combined.table, self.combined.start, self.combined.accepting, self.combined.rules
        done, found = [0] * len(self.rules), []
        for at, byte in enumerate(data):
            state = table[state + byte]
            if state >= accepting:
                for rule in rules[state >> 8]:
                    if at < done[rule]:
                        continue
                    _, start = self._reach(self.backward[rule], data, at, done[rule] - 1, -1)
                    if start < 0:
                        continue
                    first, last = self._reach(self.forward[rule], data, start, len(data), 1)
                    done[rule] = last + 1
                    if last + 1 - (first if self.rules[rule][0] == "assign" else start) >= self.rules[rule][3]:
                        found.append((start, rule, last + 1))
        return sorted(found)


@lru_cache(maxsize=1)
def default_scanner() -> Scanner:
    return Scanner()


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = default_scanner()
    kinds = [kind for kind, *_ in scanner.rules]
    for batch in batches:
        out = []
        for text in batch.column("text"):
            data, spans, seen, chars = (text.as_py() or "").encode(), [], 0, 0
            places = {}
            found = scanner.spans(data)
            for byte in sorted({p for start, _, end in found for p in (start, end)}):
                chars += len(data[seen:byte].decode())
                seen, places[byte] = byte, chars
            for start, rule, end in found:
                spans.append({"kind": kinds[rule], "rule": rule, "start": places[start], "end": places[end]})
            out.append(spans)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("rule", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, kind)], ["id", "spans"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The secrets of each text: id and ``spans`` (kind, rule, start, end), sorted by start, then rule.

    Positions are code points, the end exclusive. A null text counts as empty and has no
    spans; every row gives one row, repeated and null ids included; other columns are
    ignored; memory is bounded by the longest single text.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(_scan, "id long, spans array<struct<kind:string,rule:int,start:long,end:long>>")
