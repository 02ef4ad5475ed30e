"""Benchmark decontamination by a positional index of the test terms: DataFrame functions only.

The index stores, for the rarest terms of every test window, each place in the training
texts. Rows are told apart by a hash of id and text, so rows that share an id or have
none keep their own hits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breathline.llm.skew import is_small
from breathline.llm.storage import materialise

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of windows with their words that are broadcast at most (some 300 bytes each, so 15 MB); of narrow rows skew.BROADCAST_ROWS.
WIDE_ROWS = 50_000


def words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and characters beyond ASCII; null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _row_key(doc_id: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary")))


def _small(df: DataFrame, wide: bool = False) -> DataFrame:
    """The materialised table ``df``, broadcast if few enough rows were counted."""
    return F.broadcast(df) if (is_small(df, WIDE_ROWS) if wide else is_small(df)) else df


def windows(benchmark: DataFrame, size: int) -> DataFrame:
    """(win, item_id, ws, len): every run of ``size`` words of an item, or all words of a shorter one."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0))), lambda i: F.slice("w", i + 1, F.least(F.size("w"), F.lit(size))))
    found = items.select("item_id", F.explode(F.array_distinct(cut)).alias("ws")).distinct()
    return found.withColumn("win", F.xxhash64("item_id", "ws")).withColumn("len", F.size("ws"))


@dataclass
class Index:
    """Stored tables: windows (win, item_id, ws, len, missing), anchors (win, off, term, len, missing, need), postings (term, row, pos)."""

    windows: DataFrame
    anchors: DataFrame
    postings: DataFrame


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(_row_key(F.col("doc_id"), F.col("text")).alias("row"), "doc_id", "text")


def index(docs: DataFrame, benchmark: DataFrame, size: int = 13, rarest: int = 2, slop: int = 0) -> Index:
    """Store the places of each window's rarest words in ``docs`` (doc_id, text).

    A window's anchors are its ``rarest`` rarest words in the corpus, and at least one more
    than the words that may be missing from it: at most ``slop``, and a quarter of them.
    Equal rows have the same places once. Null and empty texts have none.
    """
    wins = materialise(windows(benchmark, size).withColumn("missing", F.least(F.lit(slop), F.floor(F.col("len") / 4).cast("int"))), "windows")
    tokens = _texts(docs).select("row", F.posexplode(words(F.col("text"))).alias("pos", "term"))
    places = wins.select("win", "len", "missing", F.posexplode("ws").alias("off", "term"))
    terms = materialise(places.select("term").distinct(), "terms")
    counts = materialise(tokens.join(_small(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df")), "counts")
    by_rarity = Window.partitionBy("win").orderBy(F.coalesce("df", F.lit(0)), "off")
    ranked = places.join(_small(counts), "term", "left").withColumn("k", F.row_number().over(by_rarity))
    chosen = ranked.filter(F.col("k") <= F.greatest(F.lit(rarest), F.col("missing") + 1)).groupBy("win", "len", "missing", "off", "term").agg(F.min("k").alias("k"))
    anchors = materialise(chosen.withColumn("need", F.count(F.lit(1)).over(Window.partitionBy("win"))), "anchors")
    wanted = materialise(anchors.select("term").distinct(), "anchor_terms")
    return Index(wins, anchors, materialise(tokens.join(_small(wanted), "term").distinct(), "postings"))


def _spoken(docs: DataFrame, found: DataFrame, span: Column) -> DataFrame:
    """(row, win, start, said): the words of ``docs`` at the candidates ``found`` (row, win, start, len); ``span`` maps a candidate and the words."""
    lists = materialise(found.groupBy("row").agg(F.collect_list(F.struct(*[c for c in found.columns if c != "row"])).alias("cs")), "candidates")  # at most one per word and window of a text
    texts = _texts(docs).join(_small(materialise(lists.select("row"), "rows")), "row", "left_semi").dropDuplicates(["row"])
    heard = texts.join(lists, "row").select("row", words(F.col("text")).alias("w"), "cs")
    return heard.select("row", F.explode(F.transform("cs", lambda c: span(c, F.col("w")))).alias("c")).select("row", "c.*")


def phrase_hits(docs: DataFrame, benchmark: DataFrame, size: int = 13, rarest: int = 2, stored: Index | None = None) -> DataFrame:
    """(row, item_id, start, length) of every exact occurrence of a window; start is a word position, ``row`` the hash of id and text.

    Offset-adjusted lists of each window's anchors are intersected; what is left is
    compared with the text's words. ``docs`` has (doc_id, text), ``benchmark`` (item_id,
    text). Null and empty texts hit nothing; equal rows have their hits once; tables are
    broadcast after a count, larger ones are joined by shuffle; an empty table hits nothing.
    """
    at = stored or index(docs, benchmark, size, rarest)
    starts = at.postings.join(_small(at.anchors), "term").select("row", "win", (F.col("pos") - F.col("off")).alias("start"), "off", "need", "len")
    cands = starts.filter("start >= 0").groupBy("row", "win", "start", "len").agg(F.countDistinct("off").alias("n"), F.first("need").alias("need")).filter("n = need")
    span = lambda c, w: F.struct(c["win"].alias("win"), c["start"].alias("start"), F.slice(w, c["start"] + 1, c["len"]).alias("ws"))
    said = _spoken(docs, cands.select("row", "win", "start", "len"), span)
    wins = at.windows.select("win", "item_id", "ws", "len")
    return said.join(_small(wins, wide=True), ["win", "ws"]).select("row", "item_id", "start", F.col("len").alias("length")).distinct()


def proximity_hits(docs: DataFrame, benchmark: DataFrame, size: int = 13, slop: int = 2, stored: Index | None = None) -> DataFrame:
    """(row, item_id, start, length, matched) of every place where a window occurs nearly: words inserted, dropped or changed.

    A window of n words tolerates t = min(slop, n // 4). It matches at ``start`` if at
    least n - t of its words stand at their own offset from there or up to t places
    later; of starts within t of each other the best one counts, then the last. Exact
    occurrences match as well. At most t words can be missing, so one of the t + 1 rarest
    is there: their postings give all candidates, which the text's words decide.
    Null and empty texts match nothing; equal rows have their matches once.
    """
    at = stored or index(docs, benchmark, size, 1, slop)
    found = at.postings.join(_small(at.anchors), "term").withColumn("shift", F.col("pos") - F.col("off"))
    found = found.select("row", "win", "len", "missing", F.explode(F.sequence(F.col("shift") - F.col("missing"), F.col("shift"))).alias("start")).distinct()

    def span(c: Column, w: Column) -> Column:
        first = F.greatest(c["start"], F.lit(0))
        around = F.slice(w, first + 1, F.greatest(c["start"] + c["len"] + c["missing"] - first, F.lit(0)))
        return F.struct(c["win"].alias("win"), c["start"].alias("start"), c["missing"].alias("missing"), (first - c["start"]).alias("ahead"), around.alias("said"))

    said = _spoken(docs, found, span).join(_small(at.windows.select("win", "item_id", "ws", "len"), wide=True), "win")

    def there(o: Column) -> Column:
        first = F.greatest(o - F.col("ahead"), F.lit(0))
        return F.array_contains(F.slice("said", first + 1, F.greatest(o + F.col("missing") - F.col("ahead") - first + 1, F.lit(0))), F.element_at("ws", o + 1))

    matched = F.size(F.filter(F.sequence(F.lit(0), F.col("len") - 1), there))
    good = said.withColumn("matched", matched).filter("matched >= len - missing")
    # The best of each stretch of starts: no better one, nor an equal later one, within t places.
    near = F.collect_list(F.struct("start", "matched")).over(Window.partitionBy("row", "win").orderBy("start").rangeBetween(-slop, slop))
    better = lambda d: (F.abs(d["start"] - F.col("start")) <= F.col("missing")) & ((d["matched"] > F.col("matched")) | ((d["matched"] == F.col("matched")) & (d["start"] > F.col("start"))))
    best = good.select("row", "win", "item_id", "start", "len", "missing", "matched", near.alias("near")).filter(~F.exists("near", better))
    return best.select("row", "item_id", F.greatest("start", F.lit(0)).alias("start"), F.col("len").alias("length"), "matched")


def _judged(docs: DataFrame, benchmark: DataFrame, size: int) -> DataFrame:
    """(row, n_hit, items) of the texts with hits, once each."""
    hits = phrase_hits(docs, benchmark, size)
    spots = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))))
    by_row = hits.groupBy("row").agg(F.collect_set(F.struct("start", "length")).alias("spans"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    return materialise(by_row.select("row", F.size(spots).cast("long").alias("n_hit"), "items"), "hits")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13) -> DataFrame:
    """Per document: n_words, n_hit (words inside occurrences), n_items, items and ``contaminated`` (a twentieth or more hit).

    One row comes for each row of ``docs``: rows that repeat an id are judged by their own
    text, and so are rows with a null id; null texts have no words. Very long texts are
    read whole. Other columns are ignored. Without documents there are no rows, without a
    benchmark nothing is hit.
    """
    docs = docs.select("doc_id", "text")
    found = _texts(docs).select("row", "doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = found.join(_small(_judged(docs, benchmark, size), wide=True), "row", "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, size: int = 13) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all columns; each row is judged by its own text."""
    texts = docs.select("doc_id", "text")
    hit = _judged(texts, benchmark, size).select("row", "n_hit")
    words_of = _texts(texts).join(_small(hit), "row").select("row", "n_hit", F.size(words(F.col("text"))).alias("n_words"))
    dropped = materialise(words_of.filter("20 * n_hit >= n_words").select(F.col("row").alias("__row")).distinct(), "contaminated")
    return docs.join(_small(dropped), _row_key(docs["doc_id"], docs["text"]) == F.col("__row"), "left_anti")
