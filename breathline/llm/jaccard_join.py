"""N-gram Jaccard join: prefix filters under several global orders, exact verification, components.

A set's tokens stand in three orders: class of frequency then hash, ascending hash, and
descending hash. The first order's prefixes are joined on their tokens with the tokens'
positions, so sizes and positions rule out most rows inside that join. What is left must
share prefix tokens under the other two orders and have near enough parities; both are
small sketches of the members. Only then texts are shipped, one member to its head, and
the sets are compared exactly.

No pair list of a group is made. Documents that share a prefix token are first compared
with the token's most central member only; what is linked by that needs no further
comparison. Pairs left between different groups are then compared exactly, once their
number is linear in the postings or the heads stop helping.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breathline.llm.skew import is_small, lookup, text_hash, without
from breathline.llm.storage import discard, materialise
from breathline.llm.textvec import LOWER, passes, shingles, tidy, word_bounds, word_hashes

#: Counters of the frequency order; a token's frequency class is that of its counter. They are counted and added in blocks.
SLOTS, BLOCK = 1 << 22, 1 << 16
#: Rounds of comparison with heads, and the comparisons per posting (some 20 ns each) from which on a further one is tried.
ROUNDS, PAIRS_PER_POSTING = 6, 256
#: Parity bits per set, by 64: two sets differ in at least as many tokens as bits.
PARITY_LONGS = 16
#: Bits by 64 that tell which tokens are in the prefix of the second and third order.
ORDER_LONGS = 4
#: Members that one task compares with the same head.
CHUNK = 512


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, tokens, their offsets by row) in passes of bounded size; tokens ascend in a row."""
    for first, end, data, offsets in passes(batch.column("text")):
        starts, ends, rows = word_bounds(data, offsets)
        found, owner = shingles(word_hashes(LOWER[data], starts, ends), rows, end - first, k)
        yield first, end, found, np.searchsorted(owner, np.arange(end - first + 1))


def _prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return np.where(n > 0, n - (n * percent + 99) // 100 + 1, 0)


def _digest(found: np.ndarray, at: np.ndarray) -> pa.Array:
    raw = [found[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
    return pa.array([hashlib.blake2b(r, digest_size=16).digest() if r else None for r in raw], pa.binary())


def _sketch(found: np.ndarray, at: np.ndarray, longs: int, chosen: np.ndarray | None = None) -> pa.Array:
    """Per row 64 * longs bits: whether an odd number of its tokens falls on the bit, or any of the ``chosen`` ones."""
    rows, width, parts = len(at) - 1, 64 * longs, []
    for first in range(0, rows, 512):
        end = min(first + 512, rows)
        span = slice(at[first], at[end])
        tokens, owner = found[span], np.repeat(np.arange(end - first), np.diff(at[first : end + 1]))
        if chosen is not None:
            tokens, owner = tokens[chosen[span]], owner[chosen[span]]
        place = owner * width + ((tokens >> np.uint64(24)) % np.uint64(width)).astype(np.int64)
        count = np.bincount(place, minlength=(end - first) * width)
        parts.append(np.packbits((count & 1 if chosen is None else count) > 0).view(np.int64))
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * longs, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


_SCAN = "id long, th binary, n long, sig binary, bits array<long>, asc array<long>, desc array<long>, block int, counts binary"


def _packed(counts: np.ndarray) -> bytes:
    """Low bytes, then the rest: most counts are small, so this is some two bits a counter."""
    return zlib.compress((counts & 255).astype(np.uint8).tobytes() + (counts >> 8).astype(np.uint32).tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    raw = zlib.decompress(packed)
    size = len(raw) // 5
    return np.frombuffer(raw, np.uint8, size).astype(np.int64) + (np.frombuffer(raw, np.uint32, size, size).astype(np.int64) << 8)


def _classes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, ranks) of the counters' blocks: the frequency class of each counter, by quarters of a power of two."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, packed in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            sums[block] = sums.get(block, 0) + _unpacked(packed)
    ranks = [np.floor(4 * np.log2(1 + c)).astype(np.uint8).tobytes() for c in sums.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(ranks, pa.binary())], ["block", "ranks"])


def _scan(k: int, percent: int, slots: int):
    """Per row its id, text hash, set size, digest and sketches; then per task the counts of the token slots, by block."""
    names = [f.split()[0] for f in _SCAN.split(", ")]
    longs = pa.list_(pa.int64())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(slots, np.uint32)
        for batch in batches:
            for first, end, found, at in _sets(batch, k):
                np.add.at(counts, (found & np.uint64(slots - 1)).astype(np.int64), 1)
                rows, n = end - first, np.diff(at)
                place = np.arange(len(found)) - np.repeat(at[:-1], n)
                length = np.repeat(_prefix_length(n, percent), n)
                orders = [_sketch(found, at, ORDER_LONGS, part) for part in (place < length, place >= np.repeat(n, n) - length)]
                own = [batch.column(c).slice(first, rows) for c in ("id", "th")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), _digest(found, at), _sketch(found, at, PARITY_LONGS), *orders, pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names)
        for first in range(0, slots, BLOCK):
            part = counts[first : first + BLOCK]
            if part.any():
                none = [pa.nulls(1, t) for t in (pa.int64(), pa.binary(), pa.int64(), pa.binary(), longs, longs, longs)]
                yield pa.RecordBatch.from_arrays([*none, pa.array([first // BLOCK], pa.int32()), pa.array([_packed(part)])], names)

    return run


def _prefixes(k: int, percent: int, classes):
    """(key, t, p) of the prefix tokens under the frequency order; p holds the token's position and the set's size.

    Of the rows of a member that is there ``again`` only the first of each task counts.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, done = classes.value, set()
        for batch in batches:
            keys = batch.column("key").to_numpy()
            use = np.ones(len(keys), bool)
            for r in np.flatnonzero(batch.column("again").to_numpy(zero_copy_only=False)):
                use[r] = keys[r] not in done
                done.add(keys[r])
            for first, end, found, at in _sets(batch, k):
                n = np.diff(at)
                owner = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((found, rank[(found & np.uint64(len(rank) - 1)).astype(np.int64)], owner))
                place = np.arange(len(found)) - at[owner]
                head = (place < _prefix_length(n, percent)[owner]) & use[first:end][owner]
                owner = owner[head]
                packed = (place[head] << 32) | n[owner]
                yield pa.RecordBatch.from_arrays([pa.array(keys[first:end][owner]), pa.array(found[order][head].view(np.int64)), pa.array(packed)], ["key", "t", "p"])

    return run


def _compare(k: int, percent: int):
    """(a, b) of the members whose sets are similar enough to their head's; rows come by head, the head first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head = None, np.zeros(0, np.uint64)
        for batch in batches:
            members, heads, salts = batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("salt").to_pylist()
            linked: list[tuple[int, int]] = []
            for first, end, found, at in _sets(batch, k):
                for r in range(first, end):
                    own = found[at[r - first] : at[r - first + 1]]
                    if members[r] is None:
                        now, head = (heads[r], salts[r]), own
                        continue
                    if now != (heads[r], salts[r]):
                        raise RuntimeError("a member came before its head")
                    where = np.minimum(np.searchsorted(head, own), len(head) - 1)
                    both = int((head[where] == own).sum())
                    if 100 * both >= percent * (len(head) + len(own) - both):
                        linked.append((members[r], heads[r]))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in linked], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(id, component) by passing on the smallest id along ``edges`` (a, b) until nothing changes."""
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    total = both.count()
    small = is_small(both)
    label = materialise(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("component"), F.count(F.lit(1)).alias("degree")), "labels")
    while total:
        far = label.select(F.col("id").alias("b"), "component", "degree")
        heard = lookup(both, far, "b", "degree", total, small=small).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("heard"))
        new = label.join(heard, "id").select("id", F.least("component", "heard").alias("near"), "component", "degree")
        jumps = label.select(F.col("id").alias("near"), F.col("component").alias("far"))
        if not small:  # a label's own label: paths halve; the members of a large group look up few labels
            new = materialise(new, "heard")
            jumps = materialise(new.groupBy("near").agg(F.count(F.lit(1)).alias("times")).join(jumps, "near"), "jumps")
        new = lookup(new, jumps, "near", "times", total, small=small)
        new = materialise(new.select("id", F.least("near", "far").alias("new"), "component", "degree"), "labels")
        moved = new.filter("new < component").limit(1).count()
        label = new.select("id", F.col("new").alias("component"), "degree")
        if not moved:
            break
    return label.select("id", "component")


def _position(p: Column) -> Column:
    return F.shiftright(p, 32)


def _size(p: Column) -> Column:
    return p.bitwiseAND(0xFFFFFFFF)


def _fits(p: Column, q: Column, percent: int) -> Column:
    """Whether two sets may be similar whose first common token has the positions and sizes ``p`` and ``q``."""
    sizes = _size(p) + _size(q)
    least = (100 + percent) * F.least(_size(p) - _position(p), _size(q) - _position(q))
    return (100 * F.least(_size(p), _size(q)) >= percent * F.greatest(_size(p), _size(q))) & (least >= percent * sizes)


def _near(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` that share prefix tokens under the other orders and whose parities allow the similarity, as far as sketches tell."""
    table = members.select("key", "n", "bits", "asc", "desc")
    for x in ("a", "b"):
        pairs = pairs.join(table.select(F.col("key").alias(x), *[F.col(c).alias(c + x) for c in table.columns[1:]]), x)
    apart = sum((F.bit_count(F.col("bitsa")[i].bitwiseXOR(F.col("bitsb")[i])) for i in range(PARITY_LONGS)), F.lit(0))
    good = apart * (100 + percent) <= (100 - percent) * (F.col("na") + F.col("nb"))
    for order in ("asc", "desc"):
        good = good & (sum((F.bit_count(F.col(order + "a")[i].bitwiseAND(F.col(order + "b")[i])) for i in range(ORDER_LONGS)), F.lit(0)) > 0)
    return pairs.filter(good).select("a", "b")


def _groups(rows: DataFrame, k: int, percent: int, slots: int, rounds: int) -> DataFrame:
    """(id, th, n, keep): ``rows`` has (id, text, th), th the 128-bit hash of the text; keep is the (id, th) that stays."""
    spark = rows.sparkSession
    scan = materialise(rows.mapInArrow(tidy(_scan(k, percent, slots)), _SCAN), "scan")
    blocks = scan.filter("block is not null").select("block", "counts").repartition("block")
    ranks = np.zeros(slots, np.uint8)
    for row in blocks.mapInArrow(tidy(_classes), "block int, ranks binary").collect():  # a byte for each slot
        ranks[row.block * BLOCK :][: len(row.ranks)] = np.frombuffer(row.ranks, np.uint8)
    classes = spark.sparkContext.broadcast(ranks)

    found = scan.filter("block is null")
    one = F.min(F.struct("id", "th")).alias("rep")
    groups = found.filter("sig is not null and id is not null").groupBy("sig").agg(one, F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("bits", "asc", "desc")])
    members = materialise(groups.select("sig", "rep.id", "rep.th", "n", "copies", "bits", "asc", "desc").withColumn("key", F.monotonically_increasing_id()), "members")
    total = found.count()
    # A posting is to come once: a row that repeats an id and its text would cancel itself out of the lists of members below.
    again = found.filter("sig is not null and id is not null").groupBy("id", "th").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    again = materialise(again.select("id", "th", F.lit(True).alias("again")), "again")
    repeats = again.limit(1).count() > 0

    def with_texts(some: DataFrame) -> DataFrame:
        """``some`` (id, th, ...) with the texts of these rows; equal rows come as often as they are there."""
        return rows.join(F.broadcast(some) if is_small(some) else some, ["id", "th"]).drop("id", "th")

    told = members.select("id", "th", "key")
    told = materialise(told.join(again, ["id", "th"], "left").fillna(False, "again"), "told") if repeats else told.withColumn("again", F.lit(False))
    posts = with_texts(told).mapInArrow(tidy(_prefixes(k, percent, classes)), "key long, t long, p long")
    # Dealt once by token: the counts and the join use the same exchange. Of tokens in the very same
    # members the first one in the order is enough, for it is the first common token of their pairs.
    dealt = posts.filter("t is not null").repartition("t")  # as the join would filter, else the exchanges differ
    dealt = dealt.distinct() if repeats else dealt
    lists = [F.bit_xor(F.xxhash64("key", F.lit(i))).alias(f"s{i}") for i in (1, 2)]
    often = dealt.groupBy("t").agg(F.count(F.lit(1)).alias("c"), *lists, F.min(_position(F.col("p"))).alias("first")).filter("c > 1")
    once = often.groupBy("c", "s1", "s2").agg(F.min_by("t", "first").alias("t")).select("t", "c")
    shared = materialise(dealt.join(once, "t").withColumn("comp", F.col("key")), "shared")

    label = members.select("key", F.col("key").alias("comp"))
    before = None
    for seed in range(rounds + 1):
        size = shared.count()
        if seed:  # the tokens whose members are in different groups, except pairs, which were compared
            per = shared.groupBy("t", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("t")
            per = per.agg(F.sum("m").alias("times"), F.sum(F.col("m") * F.col("m")).alias("sq"), F.max_by("comp", "m").alias("major")).filter("times * times > sq")
            per = materialise(per, "tokens")
            left = per.agg(F.coalesce(F.sum((F.col("times") * F.col("times") - F.col("sq")) / 2), F.lit(0.0)).alias("x")).first().x
            if not left:
                break
            shared = materialise(lookup(shared.drop("major"), per.select("t", "times", "major"), "t", "times", size).drop("times"), "shared")
        elif not size:
            break
        last = seed == rounds or (seed > 0 and (left <= PAIRS_PER_POSTING * size or (before is not None and left > 0.9 * before)))
        before = left if seed else None
        if last:
            a = (shared.filter("comp <> major") if seed else shared).select("t", F.col("key").alias("a"), F.col("comp").alias("ca"), F.col("p").alias("pa"))
            b = shared.select("t", F.col("key").alias("b"), F.col("comp").alias("cb"), F.col("p").alias("pb"))
            pairs = a.join(b, (a.t == b.t) & (F.col("ca") != F.col("cb")) & _fits(F.col("pa"), F.col("pb"), percent))
        else:
            # The head of a token and size class is the member with the fewest tokens before that one; classes shift by half from round to round.
            # A pair is one class, whatever its sizes: it is not looked at again.
            size_class = F.floor(F.log(_size(F.col("p")).cast("double")) / math.log(100 / percent) + 0.5 * (seed % 2))
            rows_by = shared.withColumn("size", F.when(F.col("c") > 2, size_class).otherwise(F.lit(-1).cast("long")))
            central = F.struct(_position(F.col("p")), F.xxhash64("key"), "key", "comp", "p")
            heads = (rows_by.filter("comp <> major") if seed else rows_by).groupBy("t", "size").agg(F.min(central).alias("h"))
            heads = heads.select("t", "size", F.col("h.key").alias("b"), F.col("h.comp").alias("cb"), F.col("h.p").alias("pb"))
            pairs = rows_by.select("t", "size", F.col("key").alias("a"), F.col("comp").alias("ca"), F.col("p").alias("pa")).join(heads, ["t", "size"])
            pairs = pairs.filter((F.col("ca") != F.col("cb")) & _fits(F.col("pa"), F.col("pb"), percent))
        pairs = materialise(pairs.select("a", "b").distinct(), "pairs")
        near = materialise(_near(pairs, members, percent), "near")
        links = materialise(_verified(near, members, with_texts, k, percent), "links")
        if not links.limit(1).count():
            if last:
                break
            continue
        # Only the groups that the new links touch take part; every other member keeps its group.
        edges = links if not seed else links.join(label.select(F.col("key").alias("a"), F.col("comp").alias("ca")), "a").join(label.select(F.col("key").alias("b"), F.col("comp").alias("cb")), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        merged = components(edges.filter("a <> b").select("a", "b")).select(F.col("id").alias("comp"), "component")
        times = label.groupBy("comp").agg(F.count(F.lit(1)).alias("times"))
        merged = materialise(merged.join(times, "comp"), "merged")
        label = materialise(lookup(label, merged, "comp", "times", total, "left").select("key", F.coalesce("component", "comp").alias("comp")), "groups")
        if last:
            break
        # Members that are in a group by now get its name, of the tokens that more than a compared pair has.
        older, many = shared, shared.filter("c > 2").select("t", "key", "p", "c")
        held = many.groupBy("key").agg(F.count(F.lit(1)).alias("held"))
        known = materialise(label.filter("key <> comp").join(held, "key"), "known")
        small = is_small(known)
        named = lookup(many, known, "key", "held", size, small=small).select("t", "key", "p", "c", "comp")
        alone = many.join(F.broadcast(known.select("key")) if small else known.select("key"), "key", "left_anti").withColumn("comp", F.col("key"))
        shared = materialise(named.unionByName(alone.select(*named.columns)), "shared")
        discard(older)

    classes_of = members.join(label, "key").select("sig", "id", "th", "copies", "comp")
    least = classes_of.groupBy("comp").agg(F.min(F.struct("id", "th")).alias("keep"), F.count(F.lit(1)).alias("times"))
    named = materialise(lookup(classes_of, materialise(least, "least"), "comp", "times", total).select("sig", "keep", "copies"), "classes")
    out = lookup(found, named, "sig", "copies", total, "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("keep", F.struct("id", "th")))
    return out.select("id", "th", "n", own.alias("keep"))


def _verified(near: DataFrame, members: DataFrame, with_texts, k: int, percent: int) -> DataFrame:
    """(a, b) of the pairs whose sets are similar enough: each member's text goes to its head, a head's to each task with some of its members."""
    heads = near.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("salts"))
    heads = materialise(heads.join(members.select(F.col("key").alias("b"), "id", "th"), "b"), "heads")
    told = heads.select("b", "salts", (F.col("salts") * CHUNK).alias("times"))
    found = lookup(near.join(members.select(F.col("key").alias("a"), "id", "th"), "a"), told, "b", "times", near.count())
    left = with_texts(found.select("id", "th", "b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), F.col("a")))
    right = with_texts(heads.select("id", "th", "b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("a")))
    rows = right.unionByName(left).repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())
    return rows.mapInArrow(tidy(_compare(k, percent)), "a long, b long").distinct()


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"), text_hash(F.coalesce(text, F.lit(""))).alias("th"))


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, slots: int = SLOTS, rounds: int = ROUNDS) -> DataFrame:
    """id, n_shingles and component_id: the smallest id reachable by links of similarity ``percent`` or more.

    Equal sets are one member of the join. The frequency class of the first order comes
    from ``slots`` counters over all tokens; it may be coarse, for any order of tokens
    gives the same links. ``rounds`` bounds only the comparisons with heads; all pairs left
    after them are compared.

    Texts without words, empty or null, have an empty set and link with nothing; a row
    with a null id counts as its own component (null); repeated rows are equal sets;
    different texts under one id are members apart; very long texts are read whole, each
    in a pass of its own; other columns are ignored; an empty table gives an empty result.
    """
    found = _groups(_rows(docs, id_col, text_col), k, percent, slots, rounds)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("keep.id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that stay when one text of each group of linked documents is kept, with all columns.

    Of a group the row with the smallest id stays, of texts that repeat that id the one
    with the smallest hash. Rows with the same id and text, rows without words and rows
    with a null id all stay. Rows are told apart by id and text, so another text under a
    dropped row's id stays.
    """
    settings = {"k": 5, "percent": 80, "slots": SLOTS, "rounds": ROUNDS} | settings
    found = _groups(_rows(docs, id_col, text_col), **settings)
    dropped = found.filter("id is not null and keep <> struct(id, th)").select("id", "th").distinct()
    return without(docs, materialise(dropped, "near"), id_col, text_col)
