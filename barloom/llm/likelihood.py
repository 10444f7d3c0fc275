"""Quality rules: hashed n-gram log-likelihood ratio of two multinomials.

The words of a text and their neighbouring pairs are hashed into ``buckets``
counters.  Two multinomials are counted, one over the rows of a trusted target
and one over all rows of the raw corpus, both with add-``alpha`` smoothing.  A
row's score is the mean over its n-grams of log target - log raw, so length
does not matter, and it is kept if the score reaches a threshold that follows
from the labelled rows alone, all of them.

Everything is DataFrame functions; arrays never leave their row, and the
counters are aggregated inside the map tasks before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import long_id, stored

_WORD = r"[^\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
#: Number of counters: bounds the model that travels with the tasks to 64 KB.
BUCKETS = 1 << 13
#: Bits of the map of hashed ids that spares texts a shuffle: 4 MB whatever the
#: number of ids, as 1,024 bitmaps of Spark's size.
ID_BITS = 1 << 25


def _pairs(a: Column, fn) -> Column:
    """``fn`` of neighbours of an array."""
    n = F.greatest(F.size(a) - 1, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(2), n), fn)


def with_words(rows: DataFrame) -> DataFrame:
    """Add the words of ``__text`` and their hashes."""
    rows = rows.withColumn("__words", F.regexp_extract_all(F.coalesce(F.col("__text"), F.lit("")), F.lit(_WORD), F.lit(0)))
    return rows.withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))


def base_rules(rows: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed to rows with words."""
    body = F.coalesce(F.col("__text"), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(_WORD))
    rows = rows.withColumns({
        "n_words": F.size("__words").cast("bigint"),
        "word_chars": F.length(F.translate(body, _SPACES, "")).cast("bigint"),
        "n_symbols": (F.length(body) - F.length(F.translate(body, _SYMBOLS, ""))).cast("bigint"),
        "__lines": lines,
    })
    rows = rows.withColumns({
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
        "__windows": F.when(F.col("n_words") >= 5, F.transform(
            F.sequence(F.lit(0), (F.col("n_words") - 5).cast("int")),
            lambda i: F.xxhash64(*[F.get(F.col("__hashes"), i + F.lit(k)) for k in range(5)]))).otherwise(F.array().cast("array<bigint>")),
    })
    # only rows with equal hashes are held word by word
    exact = F.transform(F.sequence(F.lit(1), (F.col("n_words") - 4).cast("int")),
                        lambda i: F.struct(F.concat_ws(" ", F.slice("__words", i, 5)).alias("g"), i.alias("i")))
    rows = rows.withColumn("__grams", F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), F.sort_array(exact)))
    twice = F.sort_array(F.array_distinct(F.flatten(_pairs(F.col("__grams"), lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))))))
    rows = rows.withColumn("__twice", twice)
    covered = F.aggregate(_pairs(F.col("__twice"), lambda a, b: F.least(b - a, F.lit(5))), F.lit(0), lambda s, x: s + x) + F.when(F.size("__twice") > 0, 5).otherwise(0)
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint"))
    failed = (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def _pair_hashes() -> Column:
    return _pairs(F.col("__hashes"), lambda a, b: F.xxhash64(a, b))


def ratio_model(rows: DataFrame, trusted: DataFrame, buckets: int, alpha: float) -> DataFrame:
    """One row: ``ratio``, log target - log raw of every counter in order.

    Both tables have ``__hashes``; ``trusted`` holds the rows of the target again.  The
    array has ``buckets`` values whatever the size of the corpus.
    """
    both = rows.select("__hashes", F.lit(1).alias("__raw"), F.lit(0).alias("__good")).union(trusted.select("__hashes", F.lit(0), F.lit(1)))
    # outer, or the optimizer tests the array for emptiness by computing it again
    grams = both.select("__raw", "__good", F.explode_outer(F.concat("__hashes", _pair_hashes())).alias("h")).where("h is not null")
    counts = grams.groupBy(F.pmod("h", F.lit(buckets)).cast("int").alias("b")).agg(F.sum("__raw").alias("raw"), F.sum("__good").alias("good"))
    spots = rows.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"))
    filled = spots.join(counts, "b", "left").select("b", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("good", F.lit(0)).alias("good"))
    # the gathered array has one entry per counter
    table = filled.agg(F.sort_array(F.collect_list(F.struct("b", "raw", "good"))).alias("t"), F.sum("raw").alias("n_raw"), F.sum("good").alias("n_good"))
    smooth = F.lit(alpha * buckets)
    value = lambda x: (F.log((x["good"] + alpha) / (F.col("n_good") + smooth)) - F.log((x["raw"] + alpha) / (F.col("n_raw") + smooth)))
    return table.select(F.transform("t", value).alias("ratio"))


def scored(rows: DataFrame, model: DataFrame, buckets: int) -> DataFrame:
    """Add ``score``: mean log ratio over the n-grams, 0 for a text without any."""
    add = lambda s, h: s + F.get(F.col("ratio"), F.pmod(h, F.lit(buckets)).cast("int"))
    total = F.aggregate("__hashes", F.lit(0.0), add) + F.aggregate(_pair_hashes(), F.lit(0.0), add)
    n = F.size("__hashes")
    return rows.crossJoin(F.broadcast(model)).withColumn("score", F.when(n > 0, total / (2 * n - 1)).otherwise(F.lit(0.0))).drop("ratio")


def threshold_model(rows: DataFrame, steps: int = 4096, weight: float = 10.0) -> DataFrame:
    """One row: ``threshold``, the score that parts the labelled rows best.

    ``rows`` has ``score`` and ``__good`` (1, 0, or null without a label).  The
    scores are counted in ``steps`` equal steps between the least and the
    largest; the threshold is the step where the share of bad rows below it less
    ``weight`` times that of good rows is largest, the lowest of equals.  With
    only one kind of label, or none, every row is kept.
    """
    known = rows.where("__good is not null").select("score", "__good")
    ends = known.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    step = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")) * steps), F.lit(steps - 1))).otherwise(0)
    counts = known.crossJoin(F.broadcast(ends)).groupBy(step.cast("int").alias("k"), "lo", "hi").agg(
        F.sum("__good").alias("good"), F.sum(1 - F.col("__good")).alias("bad"))
    # at most ``steps`` rows from here on
    table = counts.groupBy("lo", "hi").agg(F.sort_array(F.collect_list(F.struct("k", "good", "bad"))).alias("t"), F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    start = F.struct(F.lit(0).cast("bigint").alias("g"), F.lit(0).cast("bigint").alias("b"), F.lit(-1.0).alias("best"), F.lit(0).alias("k"), F.lit(-1).alias("last"))

    def walk(s, x):
        # what lies below this step is rejected; empty steps before it are equals
        gain = s["b"] / F.col("bad") - weight * s["g"] / F.col("good")
        up = gain > s["best"]
        return F.struct((s["g"] + x["good"]).alias("g"), (s["b"] + x["bad"]).alias("b"), F.when(up, gain).otherwise(s["best"]).alias("best"), F.when(up, s["last"] + 1).otherwise(s["k"]).alias("k"), x["k"].alias("last"))

    chosen = F.aggregate("t", start, walk, lambda s: s["k"])
    both = (F.col("good") > 0) & (F.col("bad") > 0)
    found = table.select(F.when(both, F.col("lo") + (F.col("hi") - F.col("lo")) * chosen / steps).alias("threshold"))
    return found.agg(F.coalesce(F.max("threshold"), F.lit(float("-inf"))).alias("threshold"))


def known_labels(labels: DataFrame, doc_id: str, good: str, bad: str | None) -> DataFrame:
    """``(__id, __good, __trusted)`` of every labelled id."""
    is_good, is_bad = (labels[f"`{good}`"] == 1).cast("int"), (F.coalesce(labels[f"`{bad}`"] == 1, F.lit(False)) if bad else F.lit(False))
    said = labels.select(long_id(labels, doc_id).alias("__id"), is_good.alias("__good"), ((is_good == 1) & ~is_bad).alias("__trusted")).where("__id is not null and __good is not null")
    return said.groupBy("__id").agg(F.min("__good").alias("__good"), F.min("__trusted").alias("__trusted"))


def perhaps_in(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``doc_id`` is not an ``__id`` of ``ids``; loses none that is.

    Ids are hashed to ``ID_BITS`` bits, so what travels to the tasks is bounded;
    with more ids than bits more rows pass.
    """
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(ID_BITS))
    bits = ids.select(spot("__id").alias("__s")).groupBy(F.bitmap_bucket_number("__s").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__s")).alias("__bits"))
    place = F.bitmap_bit_position(spot("doc_id"))
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    near = rows.join(F.broadcast(bits), F.bitmap_bucket_number(spot("doc_id")) == F.col("__bucket"))
    return near.where(F.getbit(byte, (place % 8).cast("int")) == 1).select(*rows.columns)


def quality_rules(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", good: str = "quality", bad: str | None = "toxic",
                  buckets: int = BUCKETS, alpha: float = 0.5) -> DataFrame:
    """Base statistics, score and verdict per row of ``docs``, with all its columns in ``row``.

    Returns ``row, doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, score, threshold, kept``.  ``labels`` has the
    ids with ``good`` 0 or 1 and, if named, ``bad``; a row is trusted if good
    is 1 and bad is not; the threshold parts good from not good alone.  Of an
    id labelled more than once the least label counts.

    A null text has no words and fails; a null id has no label.  Repeated rows
    are counted and returned as they are.  Without labels nothing but the base
    rules rejects.  An empty table gives an empty result.
    """
    known = stored(known_labels(labels, doc_id, good, bad), "labels")
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), long_id(docs, doc_id).alias("doc_id"), docs[f"`{text}`"].cast("string").alias("__text"))
    bare, ids = rows.select("doc_id", "__text"), known.where("__trusted").select("__id")
    # ids grow with the corpus, so they are shuffled and not broadcast
    trusted = perhaps_in(bare, ids).join(ids.hint("merge"), F.col("doc_id") == F.col("__id"))
    model = stored(ratio_model(with_words(bare), with_words(trusted), buckets, alpha), "ratio")
    # texts that cannot have a label are not scored here; scores are shuffled to the labels, not texts; the threshold asks twice for them
    scores = scored(with_words(perhaps_in(bare, known.select("__id"))), model, buckets).select("doc_id", "score")
    known = stored(scores.join(known.hint("merge"), F.col("doc_id") == F.col("__id")).select("score", "__good"), "scores")
    limit = stored(threshold_model(known), "threshold")
    result = base_rules(scored(with_words(rows), model, buckets)).crossJoin(F.broadcast(limit))
    kept = ~F.col("base_failed") & (F.col("score") >= F.col("threshold"))
    return result.select("row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "threshold", kept.alias("kept"))


def kept_rows(verdicts: DataFrame) -> DataFrame:
    """The rows of ``quality_rules`` that stay, with their own columns.

    A filter on ``kept`` would be pushed below the steps that build it, each
    written out again wherever it is used; behind a generator it stays put.
    """
    return verdicts.select(F.explode_outer(F.when(F.col("kept"), F.array("row"))).alias("row")).where("row is not null").select("row.*")
