r"""Quality rules by distribution divergence.

Each document gives two histograms: characters by class, and its language's most common short words (all
other words in one further bin). References are the same histograms summed over all documents of a language.
A document fails if its Jensen-Shannon distance (square root of the divergence in bits, 0 to 1) to its
language's reference is too large in either; the word test needs ``LEAST_WORDS`` words, the character test
``LEAST_CHARS`` characters, and a reference needs ``LEAST_REFERENCE`` words, else the test is passed. Before
that come simple rules on length and repetition.

Only built-in functions. Repeated windows are found inside the row, by sorting window hashes, so no n-gram
is shuffled. What is shuffled are counts of words of at most ``SHORT`` code points by language.

Null text is empty; a document without words fails; null languages share one reference of their own;
repeated rows are judged alike and kept; an empty table gives an empty result; further columns stay (the
names in ``ADDED`` are replaced). Whole texts are counted, whatever their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from punctual.llm.common import let, stored, words_of

ADDED = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "char_distance", "word_distance", "base_failed", "kept",
]
#: Thresholds of the verdict.
CHAR_DISTANCE, WORD_DISTANCE = 0.28, 0.45
LEAST_WORDS, LEAST_CHARS, LEAST_REFERENCE = 50, 200, 5000
#: Common words: the first ``COMMON`` among those of at most ``SHORT`` code points.
COMMON, SHORT = 40, 5
#: References of up to so many languages (about 2 KB each) are broadcast; those of more are joined by a shuffle.
BROADCAST_LANGUAGES = 1000
#: Character classes, taken off the text one after another; what is left is the last class.
CLASSES = ["[a-z]+", "[A-Z]+", r"[\x20\x09-\x0D]+", r"[.,;:!?'()-]+", r"\p{L}+", r"\p{N}+"]


def _letters(text: Column) -> Column:
    """Struct of ``chars`` (code points by class) and ``rest`` (the text without the classes)."""
    length = F.length

    def strip(left: Column, classes: list[str], counts: list[Column]) -> Column:
        if not classes:
            return F.struct(F.array(*counts, length(left)).alias("chars"), left.alias("rest"))
        return let(
            F.regexp_replace(left, classes[0], ""),
            lambda less: strip(less, classes[1:], [*counts, length(left) - length(less)]),
        )

    return let(text, lambda t: strip(t, CLASSES, []))


def repeat_words(words: Column, width: int = 5) -> Column:
    """Words inside windows of ``width`` words that occur twice or more in the text."""

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(places, k + 1) - p, F.lit(width))))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def repeated(pairs: Column) -> Column:
        same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
        return F.sort_array(
            F.filter(
                F.transform(pairs, lambda p, k: F.when(same(p, F.get(pairs, k - 1)) | same(p, F.get(pairs, k + 1)), p["i"])),
                lambda i: i.isNotNull(),
            )
        )

    def count(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            let(let(pairs, repeated), covered)
        )

    def windows(ws: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(ws) - width)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(width)]))

    return let(words, lambda ws: F.when(F.size(ws) > width, let(windows(ws), count)).otherwise(F.lit(0)))


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls)))


def references(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """One row per language: common ``ref_words`` joined by commas, their shares ``ref_shares`` (first: all other words), ``ref_chars``."""
    base = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit("")).alias("ref_lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    short = base.select("ref_lang", F.explode(words_of(F.lower("t"))).alias("w")).select(
        "ref_lang", F.when(F.length("w") <= SHORT, F.col("w")).alias("w")
    )
    counts = stored(short.groupBy("ref_lang", "w").count())
    place = Window.partitionBy("ref_lang").orderBy(F.desc("count"), "w")
    # Common words are looked up in a list joined by commas, so none has one.
    common = counts.where(F.col("w").isNotNull() & ~F.col("w").contains(",")).withColumn("place", F.row_number().over(place)).where(F.col("place") <= COMMON)
    totals = counts.groupBy("ref_lang").agg(F.sum("count").alias("ref_total"))
    tops = (
        common.groupBy("ref_lang").agg(F.sort_array(F.collect_list(F.struct("place", "w", "count"))).alias("top"), F.sum("count").alias("listed"))
    )
    classes = base.select("ref_lang", _letters(F.col("t"))["chars"].alias("c")).groupBy("ref_lang").agg(
        *[F.sum(F.col("c")[k]).alias(f"c{k}") for k in range(len(CLASSES) + 1)]
    )
    total_chars = sum((F.col(f"c{k}") for k in range(1, len(CLASSES) + 1)), F.col("c0"))
    return (
        totals.join(tops, "ref_lang").join(classes, "ref_lang")
        .where(F.col("ref_total") >= LEAST_REFERENCE)
        .select(
            "ref_lang",
            F.array_join("top.w", ",").alias("ref_words"),
            F.concat(
                F.array((F.col("ref_total") - F.col("listed")) / F.col("ref_total")),
                F.transform("top", lambda t: t["count"] / F.col("ref_total")),
            ).alias("ref_shares"),
            F.array(*[F.col(f"c{k}") / F.greatest(total_chars, F.lit(1)) for k in range(len(CLASSES) + 1)]).alias("ref_chars"),
        )
    )


def _term(p: Column, q: Column) -> Column:
    """One bin's part of the divergence."""
    mean = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / mean)).otherwise(F.lit(0.0))
    return (part(p) + part(q)) / 2


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def _root(divergence: Column) -> Column:
    return F.sqrt(F.least(F.greatest(divergence, F.lit(0.0)), F.lit(1.0)))


def char_distance(chars: Column, reference: Column) -> Column:
    n = F.aggregate(chars, F.lit(0), lambda total, c: total + c)
    return let(n, lambda all_: _root(_total(F.zip_with(chars, reference, lambda c, q: _term(c / all_, q)))))


def word_distance(words: Column, ref_words: Column, ref_shares: Column) -> Column:
    """Bins in which the document has no word add half of their reference share."""

    def runs(places: Column) -> Column:
        n = F.size(places)
        ends = F.filter(
            F.transform(places, lambda v, j: F.when((j + 1 == n) | (F.get(places, j + 1) != v), F.struct(v.cast("int").alias("v"), (j + 1).alias("e")))),
            lambda end: end.isNotNull(),
        )
        return let(ends, lambda es: F.transform(es, lambda x, k: F.struct(x["v"].alias("v"), ((x["e"] - F.coalesce(F.get(es, k - 1)["e"], F.lit(0))) / n).alias("p"))))

    def distance(bins: Column) -> Column:
        absent = F.lit(1.0) - _total(F.transform(bins, lambda b: F.get(ref_shares, b["v"])))
        return _root(absent / 2 + _total(F.transform(bins, lambda b: _term(b["p"], F.get(ref_shares, b["v"])))))

    places = F.sort_array(F.transform(words, lambda w: F.when(F.length(w) <= SHORT, F.find_in_set(F.lower(w), ref_words)).otherwise(F.lit(0))))
    return let(let(places, runs), distance)


def judge(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with the counts, both distances, ``base_failed`` and ``kept``."""
    columns = [c for c in docs.columns if c not in ADDED]
    held = docs.select(
        F.struct(*[f"`{c}`" for c in columns]).alias("row"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("whole"),
        F.coalesce(F.col(f"`{lang}`"), F.lit("")).alias("ref_lang"),
    )
    refs = stored(references(docs, text, lang))
    if refs.count() <= BROADCAST_LANGUAGES:
        refs = F.broadcast(refs)
    joined = held.join(refs, "ref_lang", "left")
    whole = F.col("whole")
    measured = let(
        words_of(whole),
        lambda ws: F.struct(
            F.size(ws).alias("n_words"),
            repeat_words(ws).alias("n_repeat_words"),
            F.when((F.size(ws) >= LEAST_WORDS) & F.col("ref_words").isNotNull(), word_distance(ws, F.col("ref_words"), F.col("ref_shares"))).alias("word_distance"),
        ),
    )
    lettered = let(
        _letters(whole),
        lambda x: F.struct(
            (F.length(whole) - x["chars"][2]).alias("word_chars"),
            (F.length(x["rest"]) - F.length(F.regexp_replace(x["rest"], r"[#*$%&|<>]", ""))).alias("n_symbols"),
            F.when((F.length(whole) >= LEAST_CHARS) & F.col("ref_chars").isNotNull(), char_distance(x["chars"], F.col("ref_chars"))).alias("char_distance"),
        ),
    )
    counted = joined.select("row", measured.alias("w"), lettered.alias("c"), duplicate_lines(whole).cast("long").alias("n_dup_lines"))
    named = counted.select(
        "row",
        F.col("w.n_words").cast("long").alias("n_words"),
        F.col("c.word_chars").cast("long").alias("word_chars"),
        F.col("c.n_symbols").cast("long").alias("n_symbols"),
        "n_dup_lines",
        F.col("w.n_repeat_words").cast("long").alias("n_repeat_words"),
        F.col("c.char_distance").alias("char_distance"),
        F.col("w.word_distance").alias("word_distance"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    near = (F.coalesce("char_distance", F.lit(0.0)) <= CHAR_DISTANCE) & (F.coalesce("word_distance", F.lit(0.0)) <= WORD_DISTANCE)
    verdict = named.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & near)
    return verdict.select("row.*", *ADDED)
