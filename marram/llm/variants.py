r"""Spelling variants: words one letter apart, found by anagram hashing.

The anagram key of a word is the sum of a power of each letter's number, so it depends on
the letters but not on their order, and one letter more, fewer or other changes it by the
value of that letter or by the difference of two.  Two words are a letter apart only if the
key of one equals the other's less one of its letters (addition, removal), or if their keys
are equal once each is less one letter (exchange).  Both are equi-joins of keys; a word is
emitted once for each distinct letter.

Of two words a letter apart the shorter has six letters at least, of which at most one is
touched, so they share their first three letters or their last three.  Every key goes with
either end, which leaves few candidates; the order of letters is then verified.

Everything is a DataFrame expression.  Occurrences are counted over whole texts, with partial
counts before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise

#: Production parameters of the query.
LETTERS, LEAST, RATIO, TYPO = 6, 5, 5, 199
#: The letter's number is raised to this power; keys are taken modulo a prime under 2**61.
POWER, MODULUS = 5, 2**61 - 1
#: Shared letters at one end of two words a letter apart: (LETTERS - 1) / 2, rounded up.
END = 3

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RUN = r"[A-Za-zÀ-ÿ]+"


def letter_value(letter: Column) -> Column:
    """The letter's code point to the power POWER, modulo MODULUS (code points are under 2**12 here)."""
    c = F.ascii(letter).cast("long")
    out = c
    for _ in range(POWER - 1):
        out = out * c
    return out % F.lit(MODULUS)


def anagram_key(letters: Column) -> Column:
    """The sum of the letters' values; the running sum stays under twice the modulus."""
    return F.aggregate(letters, F.lit(0).cast("long"), lambda total, x: (total + letter_value(x)) % F.lit(MODULUS))


def runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", typo: int | None = None) -> DataFrame:
    """A row (word) for each run of letters of every whole text, A-Z lower-cased.

    With ``typo``, a run whose crc32 with its document's id is divisible by it loses one
    letter.  Null and empty texts have no runs; a null id counts as empty.
    """
    lower = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), _UPPER, _LOWER)
    out = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_id"), F.explode(F.regexp_extract_all(lower, F.lit(_RUN), F.lit(0))).alias("word"))
    # A run shorter than the least word never counts.
    out = out.filter(F.length("word") >= LETTERS)
    if typo:
        h = F.crc32(F.concat("_id", F.lit(":"), "word").cast("binary"))
        at = (h % F.length("word")).cast("int")
        cut = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
        out = out.withColumn("word", F.when(h % F.lit(typo) == 0, cut).otherwise(F.col("word"))).filter(F.length("word") >= LETTERS)
    return out.select("word")


def frequent(words: DataFrame, least: int = LEAST) -> DataFrame:
    """(word, n) of the words of LETTERS letters or more with ``least`` occurrences or more."""
    return words.filter(F.length("word") >= LETTERS).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b): every pair of distinct words of ``words`` (word) a letter apart, both ways round.

    Words have LETTERS letters or more.  No pair is lost: keys and ends are necessary conditions.
    """
    letters = F.regexp_extract_all(F.col("word"), F.lit("(?s)."), F.lit(0))
    keyed = words.select("word", letters.alias("_l")).withColumn("_key", anagram_key(F.col("_l")))
    less = F.transform(F.array_distinct("_l"), lambda x: F.struct(F.lit(1).alias("cut"), F.pmod(F.col("_key") - letter_value(x), F.lit(MODULUS)).alias("key")))
    whole = F.array(F.struct(F.lit(0).alias("cut"), F.col("_key").alias("key")))
    ends = F.array(F.struct(F.lit(False).alias("tail"), F.substring("word", 1, END).alias("end")), F.struct(F.lit(True).alias("tail"), F.expr(f"right(word, {END})").alias("end")))
    rows = keyed.select("word", F.explode(F.concat(whole, less)).alias("k"), ends.alias("ends")).select("word", "k.*", F.explode("ends").alias("e")).select("word", "cut", "key", "e.*")
    a, b = rows.alias("a"), rows.alias("b")
    same = (F.col("a.key") == F.col("b.key")) & (F.col("a.tail") == F.col("b.tail")) & (F.col("a.end") == F.col("b.end"))
    # A whole word meets the longer one less a letter; two words less a letter each meet once.
    sizes = F.length("b.word") - F.length("a.word")
    kinds = ((F.col("a.cut") == 0) & (F.col("b.cut") == 1) & (sizes == 1)) | ((F.col("a.cut") == 1) & (F.col("b.cut") == 1) & (sizes == 0) & (F.col("a.word") < F.col("b.word")))
    # Pairs that share both ends are met twice: the tail is for those with other heads.
    once = ~F.col("a.tail") | (F.substring("a.word", 1, END) != F.substring("b.word", 1, END))
    found = a.join(b, same & kinds & once).filter(F.levenshtein("a.word", "b.word", 1) == 1).select(F.col("a.word").alias("a"), F.col("b.word").alias("b")).distinct()
    return found.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.*")


def forms(counts: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n): the most frequent near word, if ``ratio`` times as frequent."""
    beside = pairs.join(counts.withColumnsRenamed({"word": "b", "n": "b_n"}), "b")
    best = beside.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("k"), F.col("b").alias("w"))).alias("top"))
    out = counts.join(best, "word", "left").withColumn("top", F.when(-F.col("top.k") >= F.lit(ratio) * F.col("n"), F.col("top")))
    return out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("top.w").alias("form"), (-F.col("top.k")).alias("form_n"))


def roots(found: DataFrame) -> DataFrame:
    """(word, root) of the words with a form: the last word that following forms leads to.

    A form is RATIO times as frequent as its word, so there are no circles and a chain has
    fewer than 28 words for counts under 2**63; each round doubles the step, so five do.
    """
    chain = materialise(found.filter("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "variant-chain")
    while not chain.filter("moved").isEmpty():
        step = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = chain.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        longer = materialise(longer, "variant-chain")
        discard(chain)
        chain = longer
    return chain.select("word", "root")


def group_variants(words: DataFrame, least: int = LEAST, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word with ``least`` occurrences in ``words`` (word).

    Null words and those under LETTERS letters are left out.
    Words are compared by code points.  Ties of frequency go to the smaller word in code-point
    order; words without near ones have n_near 0, no form and themselves as root.  An empty
    table gives no rows, and repeated texts count as often as they stand there.
    """
    counts = materialise(frequent(words, least), "variant-counts")
    found = materialise(forms(counts, near_pairs(counts.select("word")), ratio), "variant-forms")
    return found.join(roots(found), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), typo=TYPO))
