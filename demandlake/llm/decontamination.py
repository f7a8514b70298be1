"""Benchmark decontamination by template windows and slot consistency.

Texts are split into words, and each word is canonicalised: numbers, capitalised words
(names) and units become typed placeholders, all else is lower-cased. Windows of template
words are hashed on both sides and joined, so a question that was given other numbers,
names or units still meets its original. A hit counts if its slots map one to one: wherever
the item repeats a value, the document repeats the value that took its place. A stretch of
``VERBATIM`` windows that agree in their slot values as well counts by itself.

Placeholders follow the case of the words, so windows of plain lower-cased words are joined
beside them: ``VERBATIM`` of them at one place of the item, or all of a shorter item, count
whatever the case on either side and however few words are literal.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlake.llm.tables import stage, table, text_or_empty

WINDOW = 8
# Items shorter than a window are matched whole, from this length on.
SHORTEST = 5
# Windows of an alignment without any other value, enough without one-to-one slots.
VERBATIM = 6
# Words of a window that are not placeholders, at least.
LEAST_LITERAL = 4

NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"
# Words taken as units.
UNITS = (
    "mm", "cm", "dm", "m", "km", "mg", "g", "kg", "t", "ml", "cl", "l", "ms", "s", "min", "h",
    "hz", "khz", "mhz", "ghz", "w", "kw", "mw", "v", "kb", "mb", "gb", "tb", "mph", "kmh",
    "usd", "eur", "gbp", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles",
    "ounce", "ounces", "pound", "pounds", "ton", "tons", "meter", "meters", "metre", "metres",
    "kilometer", "kilometers", "gram", "grams", "kilogram", "kilograms", "liter", "liters",
    "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks",
    "month", "months", "year", "years", "dollar", "dollars", "cent", "cents", "euro", "euros",
    "percent",
)
_BREAK = r"[^\p{L}\p{M}\p{N}]+"


def raw_words(text: Column) -> Column:
    return F.filter(F.split(text, _BREAK), lambda w: w != "")


def canonical(word: Column) -> Column:
    lower = F.lower(word)
    return (
        # Words from a small Latin letter on need no pattern.
        F.when((word >= "a") & (word < "{"), F.when(lower.isin(*UNITS), UNIT).otherwise(lower))
        .when(word.rlike(r"^\p{N}"), NUMBER)
        .when(word.rlike(r"^\p{Lu}"), NAME)
        .when(lower.isin(*UNITS), UNIT)
        .otherwise(lower)
    )


def is_slot(word: Column) -> Column:
    return word.isin(NUMBER, NAME, UNIT)


def plain(word: Column) -> Column:
    return F.lower(word)


def _windows(df: DataFrame, size: int, carried: list[str], step: int = 1) -> DataFrame:
    """``carried`` with ``at`` (from 1), ``hash`` and ``plain`` of each window of the
    templates, and of every ``step``-th window of the plain words."""
    n = F.size("word_hashes") - (size - 1)
    hashes = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.xxhash64(*(F.get("word_hashes", i + k) for k in range(size))),
    )
    hashes = F.when(n > 0, F.concat(hashes, _plain_windows(n, size, step)))
    found = df.select(*carried, n.alias("n"), F.posexplode(hashes).alias("at", "hash"))
    at, n = F.col("at"), F.col("n")
    return found.select(
        *carried, (F.when(at < n, at).otherwise((at - n) * step) + 1).alias("at"), "hash",
        (at >= n).alias("plain"),
    )


def _plain_windows(n: Column, size: int, step: int = 1) -> Column:
    starts = F.sequence(F.lit(1), n, F.lit(step))
    return F.transform(starts, lambda i: F.xxhash64(F.transform(F.slice("words", i, size), plain)))


def _item_windows(items: DataFrame, size: int, least_literal: int) -> DataFrame:
    found = _windows(items, size, ["item_id", "template", "words"])
    literal = F.size(F.filter("item_template", lambda w: ~is_slot(w))) >= least_literal
    return found.select(
        "item_id", F.col("at").alias("item_at"), F.lit(size).alias("size"), "hash", "plain",
        F.slice("words", F.col("at"), size).alias("item_words"),
        F.slice(
            F.when(F.col("plain"), F.transform("words", plain)).otherwise(F.col("template")), F.col("at"), size
        ).alias("item_template"),
        F.least(F.size("words") - (size - 1), F.lit(VERBATIM)).alias("enough"),
    ).filter(F.col("plain") | literal)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_literal: int = LEAST_LITERAL,
) -> DataFrame:
    """One row per document and benchmark item that it holds, with the number of matching
    windows, of distinct slot values, and whether every slot has the item's own value. A pair
    that only its plain words tie has no slots and is verbatim.

    Null and empty texts on either side hold nothing; items below ``SHORTEST`` words match
    nothing; repeated rows of a document or item count once; a null key never matches; an
    empty table gives an empty result; other columns, of whatever name, are ignored.
    """
    words = raw_words(text_or_empty())
    items = benchmark.select("item_id", words.alias("words")).filter("item_id IS NOT NULL")
    items = items.distinct().withColumn("template", F.transform("words", canonical))
    items = stage(items.withColumn("word_hashes", F.transform("template", lambda w: F.xxhash64(w))), "items")
    # At most window - SHORTEST lengths, whatever the benchmark holds.
    short = items.select(F.size("words").alias("n")).filter(
        (F.col("n") < window) & (F.col("n") >= SHORTEST)
    ).distinct().collect()
    item_windows = _item_windows(items, window, least_literal)
    for row in short:
        whole = items.filter(F.size("words") == row["n"])
        item_windows = item_windows.union(_item_windows(whole, row["n"], least_literal))
    item_windows = stage(item_windows, "item-windows")
    # Spark broadcasts these hashes only if their stored size is below its threshold.
    wanted = stage(item_windows.select("hash").distinct().coalesce(1), "item-hashes")

    # Of as many neighbouring windows as a match needs, one is sent to be met.
    step = item_windows.filter((F.col("size") == window) & F.col("plain")).agg(F.min("enough")).first()[0] or 1
    named = docs.filter("doc_id IS NOT NULL").select("doc_id", words.alias("words"))
    hashed = named.select(
        "doc_id", "words", F.transform("words", lambda w: F.xxhash64(canonical(w))).alias("word_hashes")
    )
    hits = None
    for size in [window, *sorted(row["n"] for row in short)]:
        hit = _windows(hashed, size, ["doc_id"], step if size == window else 1).join(wanted, "hash", "left_semi")
        hits = hit if hits is None else hits.union(hit)
    hits = stage(hits.distinct(), "window-hits")
    suspects = stage(hits.select("doc_id").distinct(), "suspects")
    met = stage(named.join(suspects, "doc_id", "left_semi").distinct(), "suspect-words")
    if step > 1:
        # All plain windows of the documents that met one.
        n = F.size("words") - (window - 1)
        rest = met.select(
            "doc_id", F.posexplode(F.when(n > 0, _plain_windows(n, window))).alias("at", "hash")
        ).withColumns({"at": F.col("at") + 1, "plain": F.lit(True)}).join(wanted, "hash", "left_semi")
        hits = stage(hits.unionByName(rest).distinct(), "all-window-hits")
    return _consistent(met, hits, item_windows)


def _consistent(words: DataFrame, hits: DataFrame, item_windows: DataFrame) -> DataFrame:
    pairs = (
        hits.join(item_windows, ["hash", "plain"]).join(words, "doc_id")
        .withColumn("doc_words", F.slice("words", F.col("at"), F.col("size")))
        .filter(
            F.when(F.col("plain"), F.transform("doc_words", plain))
            .otherwise(F.transform("doc_words", canonical)) == F.col("item_template")
        )
        .withColumn("pairs", F.arrays_zip(
            F.col("item_template").alias("kind"), F.col("item_words").alias("item"),
            F.col("doc_words").alias("doc"),
        ))
        .withColumn("pairs", F.filter("pairs", lambda p: is_slot(p["kind"])))
    )
    aligned = pairs.groupBy(
        "doc_id", "item_id", "plain", (F.col("at") - F.col("item_at")).alias("shift")
    ).agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.min("enough").alias("enough"),
        F.count_if(F.forall("pairs", lambda p: p["item"] == p["doc"])).alias("n_verbatim"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
    )
    n = F.size("pairs")
    one_to_one = (
        (n == F.size(F.array_distinct(F.transform("pairs", lambda p: F.struct(p["kind"], p["item"])))))
        & (n == F.size(F.array_distinct(F.transform("pairs", lambda p: F.struct(p["kind"], p["doc"])))))
    )
    by_template = one_to_one | (F.col("n_verbatim") >= VERBATIM)

    def best(value: Column) -> Column:
        # Plain windows have no slots: they speak only for pairs without a template.
        return F.coalesce(F.max(F.when(~F.col("plain"), value)), F.max(value))

    return (
        aligned.filter(F.when(F.col("plain"), F.col("n_windows") >= F.col("enough")).otherwise(by_template))
        .withColumn("verbatim", F.forall("pairs", lambda p: p["item"] == p["doc"]))
        .groupBy("doc_id", "item_id").agg(
            best(F.col("n_windows")).alias("n_windows"),
            best(n.cast("long")).alias("n_slots"),
            best(F.col("verbatim")).alias("verbatim"),
        )
    )


def op5_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold a benchmark item."""
    found = stage(contaminated(docs, benchmark).select("doc_id").distinct(), "contaminated")
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
