"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Texts become lists of words (lower case, letters and digits only).  Each fixed mask
says which of the next few words count: `1` reads a word, `0` ignores it, so a seed
still matches when ignored words were substituted.  Seeds of test items are joined with
those of training documents by hash.  Around each hit the two texts are compared word
by word, and the hit stands if some window of `window` words (or the whole item, if
shorter) that holds the seed agrees in at least `similarity` of its words.

Items of fewer than seven words have masks of their own (SHORT_MASKS), one for each way in
which the rule lets such an item differ; their seeds are made of documents only if there
are items of that length.  So every passage that the rule accepts has a seed.

A document's seeds are computed inside its row; what leaves it are small rows (document,
position, seed).  Hits of one document and item on one diagonal (position less position) become
one row, which meets the item's words and then the document's, takes the stretch of both
that the diagonal covers, and is compared once.  A document is named by its id and a hash of its text, so rows
that share an id, or have none, are judged each by its own text.  The table of test seeds is
broadcast while it is proven to have at most `broadcast_rows` rows; beyond that both
sides are shuffled by seed, and adaptive execution splits hot seeds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Fixed masks.  Any two substitutions within thirteen words, and any one within seven, leave a hit of one of them.
MASKS = ("11011", "1001011")
#: Fixed masks for shorter items, and the item lengths that each is for.
SHORT_MASKS = (("1", (1,)), ("11", (2,)), ("111", (3,)), ("1111", (4, 5, 6)), ("10111", (5,)), ("11101", (5,)))
WINDOW = 13
SIMILARITY = 0.8


def words(text: Column) -> Column:
    """Lower-case words of letters and digits; a text without any gives one empty word."""
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")


def _mask_seeds(w: Column, k: int, mask: str) -> Column:
    """One hash for each position at which the mask fits."""
    read = [i for i, c in enumerate(mask) if c == "1"]
    last = F.size(w) - len(mask)
    each = F.transform(F.sequence(F.lit(0), last), lambda at: F.xxhash64(F.lit(k), *[F.get(w, at + i) for i in read]))
    return F.when(last >= 0, each).otherwise(F.array().cast("array<bigint>"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _seeds(rows: DataFrame, keys: list[str], text: Column, masks: list[str], apply: Callable[[Column, int], Column] | None = None) -> DataFrame:
    """(keys, at, seed) for every mask at every position it fits in each row's text.

    apply(words, k), if given, says whether mask k is for a text.
    """

    def made(w: Column) -> Column:
        begins, begin, seeds = [], F.lit(0), []
        for k, m in enumerate(masks):
            own = _mask_seeds(w, k, m)
            own = own if apply is None else F.when(apply(w, k), own).otherwise(F.array().cast("array<bigint>"))
            begins.append(begin)
            begin = begin + (F.greatest(F.size(w) - len(m) + 1, F.lit(0)) if apply is None else F.size(own))
            seeds.append(own)
        return F.struct(F.array(*begins).alias("begins"), F.concat(*seeds).alias("seeds"))

    flat = rows.select(*keys, _let(words(text), made).alias("made"))
    flat = flat.select(*keys, F.col("made.begins").alias("begins"), F.posexplode("made.seeds").alias("p", "seed"))
    at = F.col("p")
    for k in range(1, len(masks)):
        begin = F.get("begins", F.lit(k))
        at = F.when(F.col("p") >= begin, F.col("p") - begin).otherwise(at)
    return flat.select(*keys, at.alias("at"), "seed")


def _standing(doc: Column, item: Column, need: Column, hits: Column, similarity: float) -> Column:
    """How many of `hits` (positions in the stretch) are in a window of `need` words that agree enough.

    `doc` and `item` are the two texts' words along one diagonal, equally many.
    """
    limit = F.ceil(need * F.lit(similarity) - F.lit(1e-9))
    same = F.zip_with(doc, item, lambda x, y: F.when(x == y, 1).otherwise(0))

    def good(x: Column) -> Column:
        """Where windows begin that agree enough."""
        starts = F.sequence(F.lit(0), F.size(x["same"]) - x["need"])
        found = F.filter(starts, lambda s: F.aggregate(F.slice(x["same"], s + 1, x["need"]), F.lit(0), lambda n, v: n + v) >= x["limit"])
        return F.when(F.size(x["same"]) >= x["need"], found).otherwise(F.array().cast("array<int>"))

    def count(x: Column) -> Column:
        return F.size(F.filter(x["hits"], lambda h: F.exists(x["good"], lambda s: (s <= h) & (h < s + x["need"]))))

    packed = F.struct(same.alias("same"), need.alias("need"), limit.alias("limit"))
    return _let(F.struct(_let(packed, good).alias("good"), hits.alias("hits"), need.alias("need")), count)


_NAME = ("doc_id", "text_hash")


def _hits(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, masks: tuple[str, ...], window: int, similarity: float, broadcast_rows: int, broadcast_ids: int) -> DataFrame:
    """(doc_id, text_hash, item_id, hits) for every distinct row of either table."""
    tests = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("item")).distinct()
    tests = materialize(tests.select(F.xxhash64("item_id", "item").alias("i"), "item_id", "item", words(F.col("item")).alias("v")).filter("v[0] <> ''"), "test-texts")
    lengths = {r[0] for r in tests.select(F.least(F.size("v"), F.lit(7))).distinct().collect()}  # seven numbers at most
    used = [(m, (7,)) for m in masks] + [(m, own) for m, own in SHORT_MASKS if lengths & set(own)]
    size = lambda v: F.least(F.size(v), F.lit(7))
    # the ordinary masks are for all items, as long as they fit
    meant = lambda v, k: F.lit(True) if k < len(masks) else size(v).isin(*used[k][1])
    spans = [m for m, _ in used]
    table = materialize(_seeds(tests, ["i"], F.col("item"), spans, meant).withColumnRenamed("at", "q"), "test-seeds")
    name = [F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash")]
    texts = docs.select(*name, F.col(text_col).alias("text"))
    seeds = _seeds(texts, list(_NAME), F.col("text"), spans)
    small = table.count() <= broadcast_rows
    places = seeds.join(F.broadcast(table) if small else table, "seed")
    places = places.groupBy(*_NAME, "i", (F.col("at") - F.col("q")).alias("diagonal")).agg(F.collect_set("q").alias("qs"))
    places = materialize(places, "places")
    found = places.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).distinct()
    # names alone are broadcast, 16 bytes each, if proven few; else texts are shuffled by name
    found = F.broadcast(found) if found.count() <= broadcast_ids else found
    same_row = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))
    few = texts.join(found, same_row, "left_semi")
    # stored, so that a text is split once and not for each of its hits
    few = materialize(few.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), words(F.col("text")).alias("w")).dropDuplicates(["d", "h"]), "hit-texts")
    known = tests.select("i", "item_id", "v")
    # a word of an item is in a seed of it, so the words of all items are bounded as their seeds are
    hits = places.join(few, same_row).join(F.broadcast(known), "i") if small else places.join(known, "i").join(few, same_row)
    start = F.greatest(F.lit(0), -F.col("diagonal"))  # of the stretch, in the item
    length = F.greatest(F.lit(0), F.least(F.size("v") - start, F.size("w") - start - F.col("diagonal")))
    hits = hits.withColumn("start", start).withColumn("length", length)
    need = F.least(F.lit(window), F.size("v"))
    standing = _standing(F.slice("w", F.col("start") + F.col("diagonal") + 1, F.col("length")), F.slice("v", F.col("start") + 1, F.col("length")), need, F.transform("qs", lambda q: q - F.col("start")), similarity)
    hits = hits.select(*_NAME, "item_id", standing.alias("hits")).filter("hits > 0")
    return hits.groupBy(*_NAME, "item_id").agg(F.sum("hits").cast("bigint").alias("hits"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", masks: tuple[str, ...] = MASKS, window: int = WINDOW, similarity: float = SIMILARITY, broadcast_rows: int = 100_000, broadcast_ids: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id, hits): documents that hold a passage of a test item.

    hits counts the places whose surroundings agree.  Null, empty and wordless texts hold
    nothing and wordless items are in nothing.  An item of n words, n under `window`, is
    found where similarity * n of its words agree, an item of one to four words where
    all do.  A null id is a value like others.  A repeated row adds no hits; rows of one id
    with different texts add theirs.  Either table may be empty.  Items longer than the window are found by any
    part of `window` words.  Very long texts are read whole, inside their row.
    """
    hits = _hits(docs, benchmark, id_col, text_col, item_col, item_text_col, masks, window, similarity, broadcast_rows, broadcast_ids)
    return hits.groupBy("doc_id", "item_id").agg(F.sum("hits").alias("hits"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", masks: tuple[str, ...] = MASKS, window: int = WINDOW, similarity: float = SIMILARITY, broadcast_rows: int = 100_000, broadcast_ids: int = 1_000_000) -> DataFrame:
    """`docs` without the rows that hold a passage; other rows of the same or a null id stay."""
    hits = _hits(docs, benchmark, id_col, text_col, item_col, item_text_col, masks, window, similarity, broadcast_rows, broadcast_ids)
    bad = materialize(hits.select(F.col("doc_id").alias("_bad_id"), F.col("text_hash").alias("_bad_hash")).distinct(), "contaminated")
    bad = F.broadcast(bad) if bad.count() <= broadcast_ids else bad
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_bad_id"]) & (F.xxhash64(docs[text_col]) == bad["_bad_hash"]), "left_anti")
