"""Skills of postings by a vocabulary table: aliases of one or more words, matched as word n-grams, with their evidence.

The vocabulary is data: rows (skill, alias), thousands or millions of them. A posting is taken line by line; the words
of a line give n-grams up to the longest alias, and an equi-join with the table finds those that are aliases. Of matches
that lie inside a longer one only the longer stays ("machine learning" is not "machine"). A line belongs to a section: a
header with something after it rules its own line, a header alone rules the lines below, up to a blank one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..sources.store import stored
from .bags import lists, rows_of

#: A vocabulary of at most so many aliases is sent to every task; n-grams of texts are shuffled to a larger one.
FEW = 1 << 16

#: Our own configuration: what may open a section.
HEADERS = {
    "required": "required|requirements|required skills|must have|must haves|qualifications|what you need",
    "preferred": "nice|nice to have|preferred|preferred skills|bonus|assets|pluses",
    "other": "about|about us|benefits|responsibilities|what we offer|how to apply",
}
WORD = r"[\p{L}\p{N}+#]+"


def words_of(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def vocabulary(rows: DataFrame) -> DataFrame:
    """rows: skill, alias. Returns alias (words joined by a space), n (its words), skill: a row an alias, every skill an alias of itself.

    An alias of several skills means the first by name, unless it is the name of a skill.
    """
    own = rows.select("skill", F.col("skill").alias("alias")).unionByName(rows.select("skill", "alias").where("alias IS NOT NULL"))
    named = own.select("skill", words_of(F.col("alias")).alias("w"), (F.col("skill") == F.col("alias")).alias("own")).where(F.size("w") > 0)
    best = F.min_by("skill", F.struct(~F.col("own"), F.col("skill"))).alias("skill")
    return named.groupBy(F.array_join("w", " ").alias("alias"), F.size("w").alias("n")).agg(best)


def grown(rows: DataFrame, candidates: DataFrame, least: int) -> DataFrame:
    """rows with the candidates (skill, n: postings that ask for it) that at least ``least`` postings have and no alias knows."""
    known = vocabulary(rows).select("alias")
    new = candidates.where(F.col("n") >= least).select("skill", F.array_join(words_of(F.col("skill")), " ").alias("alias"))
    return rows.select("skill", "alias").unionByName(new.join(known, "alias", "left_anti").select("skill", "alias"))


def lines(texts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """key, line (from 0), section, body: the lines of each text, headers cut off."""
    head = {k: rf"(?i)^\s*(?:{p})\s*:\s*" for k, p in HEADERS.items()}
    opens = lambda raw: F.coalesce(*[F.when(raw.rlike(p), k) for k, p in head.items()])

    def body_of(raw: Column, own: Column) -> Column:
        out = raw
        for k, p in head.items():
            out = F.when(own == k, F.regexp_replace(raw, p, "")).otherwise(out)
        return out

    def parted(raw: Column) -> Column:
        own = opens(raw)
        return F.struct(own.alias("opens"), body_of(raw, own).alias("body"), (F.trim(raw) == "").alias("blank"))

    def state(x: Column) -> Column:
        """What holds after this line: a header alone rules on, a blank line or a header with its text ends what ruled."""
        alone = x["opens"].isNotNull() & (F.trim(x["body"]) == "")
        return F.when(alone, x["opens"]).when(x["blank"] | x["opens"].isNotNull(), F.lit("other"))

    rows = texts.select(key, F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), parted).alias("x"))
    rows = rows.select(key, "x", _ruling(F.transform("x", state)).alias("rules"))
    each = rows.select(key, F.posexplode(F.arrays_zip("x", "rules")).alias("line", "l"))
    return each.select(key, "line", F.coalesce("l.x.opens", "l.rules", F.lit("other")).alias("section"), F.col("l.x.body").alias("body"))


@F.arrow_udf(ArrayType(StringType()))
def _ruling(states: pa.Array) -> pa.Array:
    """Of each line the last state that is told before it in its text, so that lines need no shuffle and no sort."""
    flat, row = states.flatten(), rows_of(states)
    at = np.arange(len(flat))
    last = np.maximum.accumulate(np.where(flat.is_valid().to_numpy(zero_copy_only=False), at, -1)) if len(flat) else at
    last = np.concatenate([[-1], last[:-1]])[: len(flat)]
    sizes = states.value_lengths().fill_null(0).to_numpy()
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return lists(offsets, flat.take(pa.array(last, mask=last < offsets[row])))


def matches(parts: DataFrame, vocab: DataFrame, key: str = "id") -> DataFrame:
    """parts: key, line, section, body; vocab: as vocabulary() gives it. Rows key, line, section, skill, start, n: words start .. start + n - 1 of the line."""
    vocab = stored(vocab)
    size = vocab.agg(F.coalesce(F.max("n"), F.lit(1)).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    longest, known = size["n"], vocab.select("alias", "skill")
    known = F.broadcast(known) if size["rows"] <= FEW else known
    words = parts.select(key, "line", "section", words_of(F.col("body")).alias("w")).where(F.size("w") > 0)
    grams = F.flatten(F.expr(f"transform(sequence(1, least({longest}, size(w))), k -> transform(sequence(1, size(w) - k + 1), i -> named_struct('start', i - 1, 'n', k, 'alias', array_join(slice(w, i, k), ' '))))"))
    found = words.select(key, "line", "section", F.explode(grams).alias("g")).select(key, "line", "section", "g.*").join(known, "alias")
    before = Window.partitionBy(key, "line").orderBy("start", F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.max(F.col("start") + F.col("n")).over(before) >= F.col("start") + F.col("n"), F.lit(False))
    return found.withColumn("_inside", inside).where(~F.col("_inside")).select(key, "line", "section", "skill", "start", "n")


def evidence(found: DataFrame, key: str = "id") -> DataFrame:
    """key, skill, section (the first of required, preferred, other that mentions it), n (mentions), evidence (line, start, n of each, in order)."""
    rank = F.array_position(F.array(*[F.lit(s) for s in HEADERS]), F.col("section"))
    spans = F.array_sort(F.collect_list(F.struct("line", "start", "n"))).alias("evidence")
    return found.groupBy(key, "skill").agg(F.min_by("section", rank).alias("section"), F.count(F.lit(1)).alias("n"), spans)


def asked(texts: DataFrame, vocab: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """key, required, preferred: distinct skills, sorted; what is required is not preferred too. A row a text, arrays empty where it asks for nothing."""
    own = matches(lines(texts, key, text).where("section IN ('required', 'preferred')"), vocab, key)
    by = own.groupBy(key).agg(*[F.array_sort(F.collect_set(F.when(F.col("section") == s, F.col("skill")))).alias(s) for s in ("required", "preferred")])
    none = F.array().cast("array<string>")
    rows = texts.select(key).join(by, key, "left")
    required = F.coalesce("required", none)
    return rows.select(key, required.alias("required"), F.array_except(F.coalesce("preferred", none), required).alias("preferred"))
