"""Languages of texts by character trigrams: profiles learned from labelled texts, scores as a join and a sum.

A word with a space at both ends gives its trigrams; a language's profile is the logarithm of each trigram's share in it,
smoothed by one. Trigrams are counted by distinct words, so texts are only ever split into words, and a word's scores are
computed once for all texts that hold it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import stored
from .bags import counted

#: So many words' scores, a row each, are broadcast.
FREQUENT = 1 << 16
WORD = r"\p{L}+"


def bags(texts: DataFrame, *kept: str, text: str = "text") -> DataFrame:
    """The columns kept, then arrays word and n: the words of each text and how often they stand there."""
    return counted(texts, F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)), *kept)


def each_word(texts: DataFrame) -> DataFrame:
    """texts: as ``bags`` gives them. Their kept columns, word, n: a row a word."""
    return texts.select(*[c for c in texts.columns if c not in ("word", "n")], F.inline(F.arrays_zip("word", "n")))


def words(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, word, n: the words of each text with how often they stand there."""
    return each_word(bags(texts, key, text=text))


def trigrams(word: Column) -> Column:
    """Of a word of k letters, its k trigrams with a space at both ends."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(padded, i, F.lit(3)))


def profiles(labelled: DataFrame, lang: str = "lang") -> DataFrame:
    """labelled: lang, word, n (any number of rows a word). Returns gram, lang, logp: a row for every gram and language, 0 counts too."""
    counts = labelled.where(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("lang"), "word").agg(F.sum("n").alias("n"))
    grams = counts.select("lang", "n", F.explode(trigrams(F.col("word"))).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    kinds = grams.agg(F.count_distinct("gram").alias("kinds"))  # one row
    totals = grams.groupBy("lang").agg(F.sum("n").alias("all")).crossJoin(F.broadcast(kinds))
    every = grams.select("gram").distinct().crossJoin(F.broadcast(totals))  # a row a language
    return every.join(grams, ["lang", "gram"], "left").select("gram", "lang", F.log((F.coalesce("n", F.lit(0)) + 1) / (F.col("all") + F.col("kinds"))).alias("logp"))


def predict(texts_words: DataFrame, model: DataFrame, key: str, frequent: int = FREQUENT) -> DataFrame:
    """texts_words: key, word, n. Returns key, lang: the language under which the text's known trigrams are likeliest, ties by name. Texts without any have no row.

    The scores of the ``frequent`` words that stand in most texts go to every task, which adds them up by text; only
    rarer words are shuffled. A language is a column.
    """
    langs = sorted(r["lang"] for r in model.select("lang").distinct().collect())  # a row a language
    if not langs:
        return texts_words.select(key, F.lit(None).cast("string").alias("lang")).where("false")
    cols = [f"_{k}" for k in range(len(langs))]
    sums = lambda df, by, value: df.groupBy(*by).agg(*[F.sum(value(c)).alias(c) for c in cols])
    by_gram = model.groupBy("gram").agg(*[F.max(F.when(F.col("lang") == name, F.col("logp"))).alias(c) for c, name in zip(cols, langs, strict=True)])
    known = texts_words.groupBy("word").agg(F.count(F.lit(1)).alias("texts")).select("word", "texts", F.explode(trigrams(F.col("word"))).alias("gram"))
    scores = stored(sums(known.join(by_gram, "gram"), ("word", "texts"), F.col))
    often = stored(scores.orderBy(F.desc("texts"), "word").limit(frequent))
    own = lambda c: F.col("n") * F.col(c)
    near = sums(texts_words.join(F.broadcast(often), "word"), (key,), own)
    far = sums(texts_words.join(F.broadcast(often.select("word")), "word", "left_anti").join(scores, "word"), (key,), own)
    by = sums(near.unionByName(far), (key,), F.col)
    best = F.array_min(F.array(*[F.struct((-F.round(F.col(c), 6)).alias("worse"), F.lit(name).alias("lang")) for c, name in zip(cols, langs, strict=True)]))
    return by.select(key, best["lang"].alias("lang"))


def gate(lang: Column, allowed: tuple[str, ...] = ("en",)) -> Column:
    """language where a text's language is known and not allowed; a text that tells none passes."""
    return F.when(~lang.isin(*allowed), "language")


