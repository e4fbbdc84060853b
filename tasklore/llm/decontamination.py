"""Operator 12, benchmark passages in training texts, by a positional inverted index. DataFrame functions only.

The index has one posting (term, text, position) for every occurrence of a test term in the training texts; it is written as
the texts are read, without a shuffle. A window (some consecutive words of an item) is looked up from its rarest term: the list of
that term, moved back by the term's offset, gives the places where the window may begin; the list of the second rarest
term, moved likewise, is intersected with them, and what is left is intersected with the lists of all its other terms. Only the lists of rarest
terms meet all windows; the lists of frequent terms are only probed at places that are left. All joins are on the place in a text,
so neither a frequent word nor a passage that many texts share is a key.

Defined results: null and empty texts have no words and no windows; rows of one id and text are one text in the index and get the same
result; rows of one id with other texts are texts of their own; a null id is a text named by its hash; repeated items add nothing,
an item without id is named by the empty string; empty tables give no hits; columns of other names are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tasklore.llm.common import written
from tasklore.operators.logs import pin
from tasklore.operators.sizing import join_measured, measured

WINDOW_WORDS = 10
NOT_A_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # words are lower-cased after the split, which keeps A-Z together with a-z
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TEXT = ["text_key", "text_hash"]


def words_of(text: Column) -> Column:
    """Words of a text in order, letters as written."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), NOT_A_WORD), lambda word: word != "")


def lowered(word: Column) -> Column:
    """A-Z lower-cased, all else as it is; the slow way only for words that are not plain ASCII."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def _named(documents: DataFrame) -> DataFrame:
    """``text_key`` and ``text_hash``: two numbers that name a row's text, the id and a hash, or two hashes where there is no id."""
    return documents.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit("key"), "text")).alias("text_key"),
                            F.xxhash64("text").alias("text_hash"))


def windows(benchmark: DataFrame, size: int = WINDOW_WORDS) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (``window_id, words``) and the items that hold them (``window_id, item``)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").distinct()
    items = pin(items.select("item", F.transform(words_of(F.col("text")), lowered).alias("all_words")), item_words=F.col("all_words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("item_words") - size + 1, F.lit(1)))
    held = items.filter(F.size("item_words") > 0).select("item", "item_words", F.explode(starts).alias("begin")).select(
        "item", F.slice("item_words", F.col("begin"), F.lit(size)).alias("words"))
    held = written(held.distinct(), "item-windows")
    found = written(held.select("words").distinct().withColumn("window_id", F.monotonically_increasing_id()), "windows")
    return found, held.join(found, "words").select("window_id", "item")


def postings(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """The index: ``term, text_key, text_hash, place`` of every occurrence of the given terms, places from 0; written once."""
    found = _named(documents).select(*TEXT, F.posexplode(words_of(F.col("text"))).alias("place", "word")).select(
        lowered(F.col("word")).alias("term"), *TEXT, "place")
    return written(join_measured(found, terms, ["term"], "terms"), "postings")


def _entries(found: DataFrame, index: DataFrame) -> DataFrame:
    """``window_id, size, term, back, turn``: each word of a window, rarest first; ``back`` is its offset in the window."""
    counts, small = measured(index.groupBy("term").agg(F.count("*").alias("n")), "term-counts")  # one row a test term
    words = found.select("window_id", F.size("words").alias("size"), F.posexplode("words").alias("back", "term"))
    rarest = Window.partitionBy("window_id").orderBy(F.coalesce("n", F.lit(0)), "back")
    return written(words.join(F.broadcast(counts) if small else counts, "term", "left").withColumn("turn", F.row_number().over(rarest) - 1), "entries")


def _lists(index: DataFrame, entries: DataFrame) -> DataFrame:
    """Lists of the entries' terms, moved back: ``window_id, size, text, begin``."""
    near = join_measured(index, entries.select("term", "window_id", "size", "back"), ["term"], "entry-terms")
    return near.filter("place >= back").select("window_id", "size", *TEXT, (F.col("place") - F.col("back")).alias("begin"))


def phrase_matches(index: DataFrame, found: DataFrame) -> DataFrame:
    """Where windows occur word by word: ``window_id, size, text_key, text_hash, begin``."""
    entries = _entries(found, index)
    place = ["window_id", "size", *TEXT, "begin"]
    first = _lists(index, entries.filter("turn = 0"))
    second = _lists(index, entries.filter("turn = 1"))
    short = first.filter("size = 1")
    left = written(first.filter("size > 1").join(second, place).select(*place), "two-rarest")
    complete = left.filter("size = 2")
    # Each other word of a place that is left must be in the list of its term; a text that has no such place is not read.
    asked = left.filter("size > 2").join(entries.filter("turn > 1").select("window_id", "term", "back"), "window_id").select(
        *place, "term", (F.col("begin") + F.col("back")).alias("place"))
    probed = join_measured(index, left.select(*TEXT).distinct(), TEXT, "texts-left")
    rest = asked.join(probed, [*TEXT, "term", "place"]).groupBy(*place).agg(F.count("*").alias("n")).filter("n = size - 2")
    return short.unionByName(complete).unionByName(rest.select(*place))


def proximity_matches(index: DataFrame, found: DataFrame, span: int) -> DataFrame:
    """Texts that hold all different words of a window within ``span`` consecutive words, in any order: ``window_id``, text, ``begin``.

    ``begin`` is the first word of such a stretch. Stretches are sought around the rarest word; every word found near it is
    dealt to the starts it fits, at most ``span`` of them, so places join by blocks and no two lists are paired whole.
    """
    entries = _entries(found, index).groupBy("window_id", "term").agg(F.min("turn").alias("turn"))
    needed = entries.groupBy("window_id").agg(F.count("*").alias("needed"))
    anchors = join_measured(index, entries.filter("turn = 0").select("term", "window_id"), ["term"], "anchor-terms").select(
        "window_id", *TEXT, F.col("place").alias("anchor"))
    around = anchors.select("*", F.explode(F.sequence(
        F.floor((F.col("anchor") - span + 1) / span), F.floor((F.col("anchor") + span - 1) / span))).alias("block"))
    asked = around.join(entries.select("window_id", "term"), "window_id")
    probed = join_measured(index, anchors.select(*TEXT).distinct(), TEXT, "texts-near").withColumn("block", F.floor(F.col("place") / span))
    met = asked.join(probed, [*TEXT, "block", "term"]).filter(F.abs(F.col("place") - F.col("anchor")) < span)
    low, high = F.greatest(F.col("place"), F.col("anchor")) - span + 1, F.least("place", "anchor")
    starts = met.select("window_id", *TEXT, "term", F.explode(F.sequence(F.greatest(low, F.lit(0)), high)).alias("begin")).distinct()
    return starts.groupBy("window_id", *TEXT, "begin").agg(F.count("*").alias("n")).join(needed, "window_id").filter("n = needed").select(
        "window_id", *TEXT, "begin")


def contamination(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit`` (words inside a benchmark window), ``n_items, items_sha256, contaminated``."""
    found, holders = windows(benchmark, size)
    index = postings(documents, found.select(F.explode("words").alias("term")).distinct())
    matches = written(phrase_matches(index, found), "matches")
    covered = matches.select(*TEXT, "begin", "size").distinct().select(
        *TEXT, F.explode(F.sequence(F.col("begin"), F.col("begin") + F.col("size") - 1)).alias("place")).distinct()
    hits = covered.groupBy(*TEXT).agg(F.count("*").alias("n_hit"))
    items = join_measured(matches.select("window_id", *TEXT).distinct(), holders, ["window_id"], "holders").select(*TEXT, "item").distinct()
    lists = items.groupBy(*TEXT).agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    results, small = measured(hits.join(lists, TEXT), "hits")
    rows = _named(documents).select("doc_id", *TEXT, F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    joined = rows.join(F.broadcast(results) if small else results, TEXT, "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
                         F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))
