"""Spelling variants of the corpus' words by anagram hashing (operator 11).

A word's anagram key is the sum of a fixed power of each letter's number, so words with the same letters have the same key in
whatever order, and a letter more or less changes the key by that letter's value. Words one edit apart therefore meet at an
integer: a word's own key is the key of a word with one letter more less that letter's value (addition, removal), and two words
that differ in one letter leave the same key when each loses its letter (exchange). Keys are counted first; only words whose key
somebody else reaches, in the way that an edit would, go on to the check of their letters' order: what remains of the word
without the letter, and for an exchange the letter's place, must be equal too.

That check is an equal join as well, so no pairs are formed: words with one remainder and place are all near each other and
differ in one letter, which makes at most as many as the alphabet has letters; a word and the longer ones of which it is
the remainder are at most letters times places. So no group grows with the corpus, however many words share their letters. Words of more
than LONG letters would leave too many remainders; of these only pairs that share all but a block are compared, letter by letter.

Words are counted with partial sums, whatever the number of a word's occurrences. Everything is DataFrame functions.

Nulls and ties: a null text has no words; a null id counts as the text "null"; repeated rows count as often as they occur; among
near words with equal counts the one first in code-point order is the form. An empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters by number, from 1.
ALPHABET = LOWER + "".join(map(chr, range(0xC0, 0x100)))
#: Power of a letter's number. The largest value times the greatest length of a string fits a long integer.
POWER = 5
#: Letters of words whose remainders are compared as such, and blocks of longer ones.
LONG, BLOCKS = 64, 4


def runs(docs: DataFrame, every: int = 199) -> DataFrame:
    """(word): each run of letters, lower-cased in A-Z; of those whose hash with the id ``every`` divides, less one letter."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    lower = found.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id"), F.translate("run", UPPER, LOWER).alias("run"))
    hashed = lower.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return hashed.select(F.when(F.col("h") % every == 0, less).otherwise(F.col("run")).alias("word"))


def value(letter: Column) -> Column:
    """A letter's share of a key."""
    number = F.instr(F.lit(ALPHABET), letter).cast("long")
    out = number
    for _ in range(POWER - 1):
        out = out * number
    return out


def counted(words: DataFrame, least_length: int, least_count: int) -> DataFrame:
    """(word, n, key): the words of at least so many letters and occurrences, with their anagram keys."""
    known = words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)
    return known.withColumn("key", F.aggregate(F.split("word", ""), F.lit(0).cast("long"), lambda total, c: total + value(c)))


def meetings(words: DataFrame) -> DataFrame:
    """(key, word, n, letter): each word at its own key (letter null) and at its key less each of its letters, where an edit could
    lead to another word."""
    letters = F.transform(F.array_distinct(F.split("word", "")), lambda c: F.struct((F.col("key") - value(c)).alias("key"), c.alias("letter")))
    own = F.array(F.struct(F.col("key"), F.lit(None).cast("string").alias("letter")))
    rows = words.select("word", "n", F.explode(F.concat(own, letters)).alias("m")).select("m.key", "word", "n", "m.letter")
    met = rows.groupBy("key").agg(F.count_if(F.col("letter").isNull()).alias("whole"), F.count("letter").alias("less")).where("less > 1 or (less > 0 and whole > 0)")
    return rows.join(met, "key")


def remainders(met: DataFrame) -> DataFrame:
    """(rest, place, longer, word, n): what is left of a word without a letter, and the letter's place where others may have another
    letter there; with place -1 the word itself as the rest of longer ones, and those."""
    own = met.where("letter is null and less > 0").select(F.col("word").alias("rest"), F.lit(-1).alias("place"), F.lit(False).alias("longer"), "word", "n")
    places = F.filter(F.transform(F.split("word", ""), lambda c, i: F.when(c == F.col("letter"), i)), lambda i: i.isNotNull())
    less = met.where("letter is not null").select("word", "n", "less", "whole", "letter", F.explode(places).alias("at"))
    rest = F.concat(F.substring("word", F.lit(1), F.col("at")), F.substring("word", F.col("at") + 2, F.char_length("word"))).alias("rest")
    # Of equal letters in a row each leaves the same rest: the first one stands for them.
    first = (F.col("at") == 0) | (F.substring("word", F.col("at"), F.lit(1)) != F.col("letter"))
    longer = less.where(F.col("whole") > 0).where(first).select(rest, F.lit(-1).alias("place"), F.lit(True).alias("longer"), "word", "n")
    exchanged = less.where("less > 1").select(rest, F.col("at").alias("place"), F.lit(True).alias("longer"), "word", "n")
    return own.unionByName(longer).unionByName(exchanged)


def near_short(met: DataFrame) -> DataFrame:
    """(word, near, best) of words of at most LONG letters: how many are near in one respect, and the first of these."""
    entry = F.struct((-F.col("n")).alias("less"), "word", "longer")
    groups = remainders(met).groupBy("rest", "place").agg(F.array_sort(F.collect_list(entry)).alias("members")).where(F.size("members") > 1)
    groups = groups.select("place", F.filter("members", lambda m: ~m["longer"]).alias("shorter"), F.filter("members", lambda m: m["longer"]).alias("longer"))
    # In an exchange each is near all others; a shorter word is near all longer ones, and these are near it alone.
    exchange = groups.where("place >= 0").select(F.explode("longer").alias("m"), F.slice("longer", 1, 2).alias("top"), (F.size("longer") - 1).alias("near"))
    exchange = exchange.select("m.word", "near", F.when(F.col("top")[0]["word"] == F.col("m.word"), F.col("top")[1]).otherwise(F.col("top")[0]).alias("best"))
    pair = groups.where("place < 0 and size(shorter) > 0 and size(longer) > 0").select(F.col("shorter")[0].alias("shorter"), "longer")
    up = pair.select("shorter.word", F.size("longer").alias("near"), F.col("longer")[0].alias("best"))
    down = pair.select(F.explode("longer").alias("m"), "shorter").select("m.word", F.lit(1).alias("near"), F.col("shorter").alias("best"))
    return exchange.unionByName(up).unionByName(down).select("word", "near", F.col("best.less").alias("less"), F.col("best.word").alias("best"))


def near_long(met: DataFrame) -> DataFrame:
    """The same for words of more letters, whose remainders would be as many as they are long: a row for each near word.

    An edit leaves three of a word's BLOCKS as they are, but for a shift behind it; what lies before and behind the fourth is compared
    by a hash, and pairs that agree in it and in the key by their letters.
    """

    def rows(some: DataFrame, length: Column, skip: int) -> DataFrame:
        """A row for each block that may hold the edit; ``skip`` letters more lie before what is behind it."""
        q = F.ceil(length / BLOCKS).cast("int")
        some = some.select("*", length.alias("length"), F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block"))
        inner = F.substring("word", F.col("block") * q + 1, q + skip)
        some = some.where(F.col("letter").isNull() | F.contains(inner, "letter"))
        return some.select("key", "length", "block", F.xxhash64(F.substring("word", F.lit(1), F.col("block") * q)).alias("before"), F.xxhash64(F.substring("word", (F.col("block") + 1) * q + 1 + skip, F.char_length("word"))).alias("behind"), "word", "n", "letter")

    on = ["key", "length", "block", "before", "behind"]
    other = lambda df: df.select(*on, F.col("word").alias("other"), F.col("n").alias("m"), F.col("letter").alias("its"))
    equal = rows(met.where("letter is not null and less > 1"), F.char_length("word"), 0)
    exchanged = equal.join(other(equal), on).where("letter <> its and levenshtein(word, other, 1) = 1").select("word", "n", "other", "m")
    shorter, longer = rows(met.where("letter is null and less > 0"), F.char_length("word"), 0), rows(met.where("letter is not null and whole > 0"), F.char_length("word") - 1, 1)
    # An added letter among equal ones can lie in two blocks.
    added = shorter.join(other(longer), on).where("levenshtein(word, other, 1) = 1").select("word", "n", "other", "m").distinct()
    pairs = exchanged.unionByName(added).unionByName(added.select(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m")))
    return pairs.select("word", F.lit(1).alias("near"), (-F.col("m")).alias("less"), F.col("other").alias("best"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best): for words with near ones, how many, and the first of them as (count less than 0, word)."""
    short = near_short(meetings(words.where(F.char_length("word") <= LONG + 1)))
    # Words of LONG and LONG + 1 letters are compared with each other above; further up, those of LONG + 1 stand with longer ones.
    long = near_long(meetings(words.where(F.char_length("word") > LONG)))
    both = (F.char_length("word") == LONG + 1) & (F.char_length("best") == LONG + 1)
    found = short.unionByName(long.where(~both))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct("less", F.col("best").alias("word"))).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms are followed to the last one, twice as far in each round.

    A form occurs at least ``ratio`` times as often as its word, so the way is short: for five, at most 26 steps of a
    64-bit count, or five rounds.
    """
    now = base.stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if now.join(further, "root", "left_semi").isEmpty():
            return now
        now = base.stored(now.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")


@base.scoped("variants")
def variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, ratio: int = 5, every: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each word of at least so many letters and occurrences.

    ``n_near`` counts the words one inserted, deleted or replaced letter away; the form is the most frequent of them if it occurs
    ``ratio`` (more than 1) times as often; the root is the last form on the way from form to form, or the word itself.
    """
    if ratio <= 1:
        raise ValueError("a form must be more frequent than its word")
    words = base.stored(counted(runs(base.texts(docs, id_col, text_col), every), least_length, least_count), "words")
    near = near_words(words)
    usual = -F.col("best.less") >= ratio * F.col("n")
    known = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(usual, F.col("best.word")).alias("form"), F.when(usual, -F.col("best.less")).alias("form_n"))
    known = base.stored(known, "known")
    return known.join(roots(known.where("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))
