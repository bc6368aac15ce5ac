"""Groups of spelling variants: words one edit apart, the common one as the form.

1. Words are counted where they lie and then over all documents; a seeded share
   of runs loses a letter first (``every``), as a fixed rule of the input.
2. Positional bigrams of the distinct words are put in one order, the rarest
   first (ties: by bigram, then by place).  One edit changes two bigrams of a word
   at most, and those it leaves keep their order in both words, so the first one
   left is among the three rarest of both: only these are joined.
3. Position limits.  The edit lies before or behind such a bigram.  So what is
   on its other side stays in place, counted from the start or from the end, and
   of the side with the edit one half does, too.  That gives four keys a bigram,
   for the word as the longer of a pair and as the shorter one: places agree
   within one, lengths too, and words meet only where half their letters agree.
4. Verification is in the join: a pair leaves it only if exactly one inserted,
   deleted or replaced code point parts its words.
5. A word's form is the most frequent near word if that is ``factor`` times as
   frequent.  Counts grow along forms by that factor, so a root is found in a
   number of pointer jumps that follows from the largest count.

The bigram table has at most 90 * 90 rows, whatever the corpus, and is sent to the
tasks.  All steps are DataFrame functions.

Defined results: null and empty texts have no words; a null doc_id takes no
letter away; texts of any length are read whole; repeated rows count again; among
near words of equal count the smaller in code-point order is the form; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_RUN = "[a-zÀ-ÿ]+"
_KEPT = 3


def _first(word: Column | str, n: Column) -> Column:
    return F.substring(word, F.lit(1), n)


def _last(word: Column | str, n: Column) -> Column:
    return F.substring(word, F.length(word) - n + 1, n)


def word_counts(docs: DataFrame, min_letters: int, min_count: int, every: int) -> DataFrame:
    """(word, n) of runs of letters, one letter short where ``every`` divides the
    crc32 of "doc_id:run"."""
    runs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.explode(F.regexp_extract_all(F.translate("text", _UPPER, _UPPER.lower()), F.lit(_RUN), F.lit(0))).alias("run"))
    hashed = runs.filter(F.length("run") >= min_letters).withColumn("h", F.crc32(F.concat("doc_id", F.lit(":"), "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(_first("run", at), F.substring("run", at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % every == 0, shorter).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= min_letters)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def rarest_bigrams(words: DataFrame) -> DataFrame:
    """(word, n, p): places of the three rarest positional bigrams of every word."""
    places = F.transform(F.sequence(F.lit(0), F.length("word") - 2), lambda p: F.struct(p.alias("p"), F.substring("word", p + 1, F.lit(2)).alias("gram")))
    grams = words.select("word", "n", F.explode(places).alias("g")).select("word", "n", "g.*")
    frequency = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))  # 8,100 rows at most
    ranked = grams.join(F.broadcast(frequency), "gram").groupBy("word", "n").agg(F.sort_array(F.collect_list(F.struct("df", "gram", "p"))).alias("g"))
    return ranked.select("word", "n", F.explode(F.slice("g", 1, _KEPT)).alias("g")).select("word", "n", "g.p")


def keys(places: DataFrame) -> DataFrame:
    """(key, word, n, longer): ``longer`` rows are for the word as the longer one of
    a pair (or an equally long one), the others for it as the shorter one."""
    rows = places.select("word", "n", "p", F.explode(F.array(F.lit(True), F.lit(False))).alias("longer"))
    size = F.length("word") + F.when(F.col("longer"), 0).otherwise(1)  # of the longer one
    # behind the bigram: [p + 2, size) in halves; before it: [0, size - back)
    behind = F.col("p") + 2 + F.floor((size - F.col("p") - 2) / 2).cast("int")
    back = F.length("word") - F.col("p")
    before = F.floor((size - back) / 2).cast("int")
    found = F.array(
        F.xxhash64(F.lit(0), size, "p", _first("word", behind)),
        F.xxhash64(F.lit(1), size, "p", _first("word", F.col("p") + 2), _last("word", size - behind)),
        F.xxhash64(F.lit(2), size, back, _first("word", before), _last("word", back)),
        F.xxhash64(F.lit(3), size, back, _last("word", size - before)),
    )
    return rows.select(F.explode(F.array_distinct(found)).alias("key"), "word", "n", "longer")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n), each pair both ways."""
    keyed = cut(keys(rarest_bigrams(words)).distinct(), "keys")
    a, b = (keyed.select("key", *(F.col(c).alias(f"{x}_{c}") for c in ("word", "n", "longer"))) for x in "ab")
    one_edit = F.levenshtein("a_word", "b_word", 1) == 1
    met = a.join(b, (a.key == b.key) & (F.col("a_word") < F.col("b_word")) & (F.col("a_longer") | F.col("b_longer")) & one_edit)
    pairs = cut(met.select("a_word", "a_n", "b_word", "b_n").distinct(), "pairs")
    drop(keyed)
    names = ("word", "n", "near", "near_n")
    return pairs.select("a_word", "a_n", "b_word", "b_n").toDF(*names).unionByName(pairs.select("b_word", "b_n", "a_word", "a_n").toDF(*names))


def _roots(forms: DataFrame, jumps: int) -> DataFrame:
    """(word, root) of words that have a form."""
    known = forms.select("word", F.col("form").alias("root"))
    for _ in range(jumps):
        step = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        known = cut(known.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return known


def variants(docs: DataFrame, min_letters: int = 6, min_count: int = 5, factor: int = 5, every: int = 199) -> DataFrame:
    """word, form, root, n, n_near, form_n, one row a word."""
    if min_letters < 4 or min_count < 1 or factor < 2:
        raise ValueError("min_letters is 4 or more, min_count 1 or more, factor 2 or more")
    words = cut(word_counts(docs.select("doc_id", "text"), min_letters, min_count, every), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    near = near_words(words).groupBy("word").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    near = near.select("word", "n_near", F.when(-F.col("best.less") >= factor * F.col("n"), F.struct(F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("to"))
    near = cut(near.select("word", "n_near", "to.form", "to.form_n"), "near")
    most = words.agg(F.max("n")).first()[0] or 1
    depth = max(1, math.ceil(math.log(max(most, 1), factor)))
    roots = _roots(near.filter("form is not null"), max(1, math.ceil(math.log2(depth))))
    return (
        words.join(near, "word", "left").join(roots, "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
    )
