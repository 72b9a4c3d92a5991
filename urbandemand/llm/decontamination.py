"""Benchmark decontamination over a distributed positional inverted index.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower
case. A window is ``width`` consecutive words of a benchmark item, or all words
of a shorter one.

1. Every occurrence in the corpus of a word that some item uses is stored as a
   posting (term, document, position), and so is each text's end, whose
   position is the number of words. Texts are read and cut into words once.
2. Terms are counted over the postings. In each window the two rarest places
   are chosen, and the postings of their terms shifted by the place: postings
   of a window that really occurs meet on one diagonal (document, item, shift).
3. Along each diagonal that enough rare terms agree on, the offset-adjusted
   postings of all the item's terms are intersected. Runs of places that meet
   are exact phrases; with a ``slop`` a place also meets where its term stands
   that many words off the diagonal, and runs of these are proximity matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, documents, scratch, small, stored

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH = 10
#: Words that a place may stand off its diagonal in a proximity match.
SLOP = 1
#: The term of a text's end; no word holds a blank.
END = " "
END_NO = -1


def words(text: Column) -> Column:
    """The words of a text in order; none of a null."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def item_words(items: DataFrame) -> DataFrame:
    """``item_id`` (string), ``item_words``: items that have words, once each."""
    one = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text").cast("string")).alias("item_words"))
    return one.filter(F.col("item_id").isNotNull() & (F.size("item_words") > 0)).distinct()


def item_places(item: DataFrame) -> DataFrame:
    """``item_no, term, place, span, n_places``: every word of every item."""
    n = F.size("item_words")
    return item.select("item_no", F.posexplode("item_words").alias("place", "term"), F.least(n, F.col("width")).alias("span"), n.alias("n_places"))


def postings(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``term_no, doc_id, mark, position`` of all occurrences of stored ``vocabulary``.

    ``mark`` is the text's hash, which tells apart rows that share a doc_id.
    A text's end is a posting of ``END_NO`` at the number of its words.
    """
    cut = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.split(ascii_lower(F.coalesce("text", F.lit(""))), SEPARATORS).alias("cut"))
    # Only the first and the last part can be empty, where a text begins or ends with separators.
    first, last = F.element_at("cut", 1) == "", (F.size("cut") > 1) & (F.element_at("cut", -1) == "")
    cut = cut.select("doc_id", "mark", first.cast("int").alias("first"), last.cast("int").alias("last"), F.concat("cut", F.array(F.lit(END))).alias("cut"))
    at = cut.select("doc_id", "mark", "first", "last", F.posexplode("cut").alias("part", "term"))
    position = F.col("part") - F.col("first") - F.when(F.col("term_no") == END_NO, F.col("last")).otherwise(0)
    return at.join(small(vocabulary), "term").select("term_no", "doc_id", "mark", position.alias("position"))


def rarest_places(places: DataFrame, frequency: DataFrame, rarest: int = 2) -> DataFrame:
    """``term_no, item_no, place, need``: the rarest places of every window.

    ``need`` is how many of an item's places a diagonal with a whole window
    must meet.
    """
    at = places.join(frequency, "term_no", "left").na.fill({"n": 0})
    first = F.sequence(F.greatest(F.lit(0), F.col("place") - F.col("span") + 1), F.least(F.col("place"), F.col("n_places") - F.col("span")))
    ranked = at.select("item_no", "place", "term_no", F.least("span", F.lit(rarest)).alias("need"), "n", F.explode(first).alias("start"))
    rank = F.row_number().over(Window.partitionBy("item_no", "start").orderBy("n", "place"))
    return ranked.withColumn("rank", rank).filter(F.col("rank") <= rarest).select("term_no", "item_no", "place", "need").distinct()


def diagonals(index: DataFrame, chosen: DataFrame, slop: int = 0) -> DataFrame:
    """``doc_id, mark, item_no, shift`` where enough rare terms agree.

    With a slop, places may differ by that much: a posting then counts for
    every shift within reach.
    """
    shift = F.col("position") - F.col("place")
    met = index.join(small(chosen), "term_no").select("doc_id", "mark", "item_no", "place", "need", F.explode(_reach(shift, slop)).alias("shift"))
    if slop:
        met = met.distinct()
    line = met.groupBy("doc_id", "mark", "item_no", "shift").agg(F.count("*").alias("met"), F.max("need").alias("need"))
    return line.filter("met >= need").select("doc_id", "mark", "item_no", "shift")


def _reach(at: Column, slop: int) -> Column:
    return F.array(at) if slop == 0 else F.sequence(at - slop, at + slop)


def _same(left: DataFrame, right: DataFrame, *more: str) -> Column:
    """One document, whose doc_id may be null, and equal columns ``more``."""
    both = left["doc_id"].eqNullSafe(right["doc_id"])
    for c in ("mark", *more):
        both &= left[c] == right[c]
    return both


def _starts(places: Column, span: Column) -> Column:
    """Where ``span`` consecutive numbers begin in a sorted array of distinct ones."""
    run = lambda i: F.get(places, i + span - 1) == F.get(places, i) + span - 1
    first = F.sequence(F.lit(0), F.size(places) - span)
    return F.when(F.size(places) >= span, F.transform(F.filter(first, run), lambda i: F.get(places, i))).otherwise(F.array().cast("array<int>"))


def matches(index: DataFrame, line: DataFrame, places: DataFrame, slop: int = 0) -> DataFrame:
    """``doc_id, mark, item_no, shift, exact, near``: starts of the windows met on stored lines."""
    doc = line.select("doc_id", "mark").distinct()
    doc = small(stored(doc, "lined"))
    have = index.filter(F.col("term_no") != END_NO)
    have = have.join(doc, _same(have, doc), "left_semi")
    want = line.join(small(places), "item_no")
    want = want.select("doc_id", "mark", "item_no", "shift", "place", "span", "term_no", F.explode(_reach(F.col("shift") + F.col("place"), slop)).alias("position")).filter("position >= 0")
    met = want.join(have, _same(want, have, "term_no", "position")).select(want["doc_id"], want["mark"], "item_no", "shift", "span", "place", want["position"])
    on_line = F.when(F.col("position") == F.col("shift") + F.col("place"), F.col("place"))
    run = met.groupBy("doc_id", "mark", "item_no", "shift").agg(F.first("span").alias("span"), F.array_sort(F.collect_set(on_line)).alias("exact"), F.array_sort(F.collect_set("place")).alias("near"))
    run = run.select("doc_id", "mark", "item_no", "shift", "span", _starts(F.col("exact"), F.col("span")).alias("exact"), _starts(F.col("near"), F.col("span")).alias("near"))
    return run.filter(F.size("near") > 0)


def _indexed(docs: DataFrame, items: DataFrame, width: int, slop: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored: the index, the items' ids by number, the windows met."""
    item = stored(item_words(items).withColumn("item_no", F.monotonically_increasing_id()).withColumn("width", F.lit(width)), "items")
    term = item.select(F.explode("item_words").alias("term")).distinct().withColumn("term_no", F.monotonically_increasing_id())
    end = docs.sparkSession.range(1).select(F.lit(END).alias("term"), F.lit(END_NO).cast("long").alias("term_no"))
    vocabulary = stored(term.unionByName(end), "vocabulary")
    index = stored(postings(docs, vocabulary), "postings")
    frequency = index.groupBy("term_no").agg(F.count("*").alias("n"))
    places = stored(item_places(item).join(small(vocabulary), "term").drop("term"), "places")
    chosen = stored(rarest_places(places, frequency), "chosen")
    line = stored(diagonals(index, chosen, slop), "diagonals")
    met = stored(matches(index, line, places, slop), "matches")
    names = stored(item.select("item_no", "item_id"), "names")
    return index, names, met


def _listed(met: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """doc_id, mark and the sorted item_ids that the documents' windows belong to."""
    ids = met.select("doc_id", "mark", "item_no").distinct().join(small(names), "item_no")
    return ids.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set("item_id")).alias(name))


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH, slop: int = 0) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, mark, near_items.

    A document word inside any occurrence of a window is hit; items are those
    with occurring windows, as strings in sorted order, and their sha256 is of
    the comma-joined list; ``mark`` is the text's 64-bit hash. ``near_items``
    are the items with a window each of whose words stands at most ``slop``
    words off its place on one diagonal, exact ones among them; it changes no
    other column.

    Null and empty texts have no words; items without words or without an id
    take no part, and an item_id given more than once counts once for each of
    its texts. Rows that repeat a doc_id are judged by their own texts. No
    documents give no rows, no items no hits. Other columns are not read.
    """
    with scratch() as keep:
        return _judged(docs, items, width, slop, keep)


def _judged(docs: DataFrame, items: DataFrame, width: int, slop: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    index, names, met = _indexed(documents(docs), items, width, slop)
    exact = met.filter(F.size("exact") > 0)
    covered = F.flatten(F.transform("exact", lambda s: F.sequence(s, s + F.col("span") - 1)))
    hit = exact.select("doc_id", "mark", F.explode(F.array_distinct(covered)).alias("place"), "shift").select("doc_id", "mark", (F.col("shift") + F.col("place")).alias("position")).distinct()
    hit = hit.groupBy("doc_id", "mark").agg(F.count("*").alias("n_hit"))
    near = _listed(met, names, "near_items")
    of_exact = _listed(exact, names, "items")
    found = near.join(of_exact, _same(near, of_exact), "left").select(near["doc_id"], near["mark"], "near_items", "items")
    found = found.join(hit, _same(found, hit), "left").select(found["doc_id"], found["mark"], "near_items", "items", "n_hit")
    found = small(keep(stored(found, "found")))
    text = keep(stored(index.filter(F.col("term_no") == END_NO).select("doc_id", "mark", "position"), "ends"))
    none = F.array().cast("array<string>")
    own, close = F.coalesce("items", none), F.coalesce("near_items", none)
    return text.join(found, _same(text, found), "left").select(
        text["doc_id"], F.col("position").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(own).cast("long").alias("n_items"),
        F.sha2(F.array_join(own, ","), 256).alias("items_sha256"), (F.size(own) > 0).alias("contaminated"), own.alias("items"), text["mark"], close.alias("near_items"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` without the rows in which a window of an item occurs."""
    with scratch() as keep:
        _, _, met = _indexed(documents(docs), items, width, 0)
        hit = small(keep(stored(met.select(F.col("doc_id").alias("its_id"), F.col("mark").alias("its_mark")).distinct(), "contaminated")))
    same = docs["doc_id"].cast("long").eqNullSafe(hit["its_id"]) & (F.xxhash64(docs["text"].cast("string")) == hit["its_mark"])
    return docs.join(hit, same, "left_anti")
