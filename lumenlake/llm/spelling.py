"""Spelling variants: words that differ by one edit, by a rare-first prefix filter over positional bigrams.

The bigrams of a vocabulary are ordered by how many places have them, the rarest first.  One edit changes at most two
bigrams of either word; so of two near words, the first bigram that the edit left alone is among the three rarest of
both, and its place differs by no more than the lengths do: not at all if they are equal, by none or one if one word is
longer.  Words thus meet on one of their three rarest bigrams, its place and the length.

Common endings and stems would still make large groups, so the key also has a half of the word: the half that the edit
is not in is the same in both.  Groups are then as small as the number of words that share half of their letters, the
length and a rare bigram; pairs are verified by their edit distance where they meet.

A word's form is its near word of largest count, if that is at least `ratio` times the word's own; forms are followed to
the last one by doubling, since counts along them grow by that factor.

Defined cases: a null text has no words; a text or word of any length is read to its end; a null doc_id counts as empty
where the words' typing errors are drawn from it; repeated rows count each; an empty table gives no rows; other columns
play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.functions.lineage import written
from lumenlake.llm.sharding import CRC_SQL

#: Letters of a word, and those of them whose case is folded.
LETTERS, UPPER = "[A-Za-zÀ-ÿ]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Fewest letters and occurrences of a word; how often its form occurs for each of its own; one of so many runs, by the
#: hash of its document and itself, loses a letter.
LEAST, OCCURS, RATIO, DROPPED = 7, 2, 10, 31
#: The rarest bigrams by which words meet: one more than an edit can change.
RAREST = 3


def vocabulary(docs: DataFrame, least: int = LEAST, occurs: int = OCCURS, dropped: int | None = DROPPED) -> DataFrame:
    """(word, n): the words of docs(doc_id, text) with their occurrences; counted in part before the shuffle."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= least).select("doc", F.translate("run", UPPER, UPPER.lower()).alias("run"))
    word = F.col("run")
    if dropped:
        drawn = runs.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))).withColumn("at", (F.col("h") % F.length("run")).cast("int"))
        word = F.when(F.col("h") % dropped == 0, F.concat(F.col("run").substr(F.lit(1), F.col("at")), F.col("run").substr(F.col("at") + 2, F.length("run")))).otherwise(word)
        runs = drawn
    return runs.select(word.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= occurs)


def rarest_bigrams(words: DataFrame) -> DataFrame:
    """words with gram and at: a row for each of a word's rarest bigrams and its place.

    There are as many bigrams as pairs of letters (8100 of the letters above), so their order is broadcast.
    """
    grams = words.select("word", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("at", "gram"))
    order = F.broadcast(grams.groupBy("gram").agg(F.count("*").alias("places")))
    ranked = grams.join(order, "gram").groupBy("word").agg(F.slice(F.array_sort(F.collect_list(F.struct("places", "gram", "at"))), 1, RAREST).alias("rare"))
    return words.join(ranked, "word").select(*words.columns, F.explode("rare").alias("g")).select(*words.columns, "g.gram", "g.at")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): every two words of words(word, n) that are one edit apart, once; the shorter first.

    What words meet by is hashed into one number; the edit distance tells true meetings from chance.
    """
    rare = written(rarest_bigrams(words))
    size, at = F.length("word"), F.col("at")
    rest = lambda start: F.col("word").substr(start, size)
    part = lambda length: F.col("word").substr(F.lit(1), length)
    half, shorter = F.floor(size / 2).cast("int"), F.floor((size - 1) / 2).cast("int")
    key = lambda kind, length, place, side: F.xxhash64(F.lit(kind), "gram", length, place, side)
    same = [key("=<", size, at, part(half)), key("=>", size, at, rest(half + 1))]
    # A word with one letter more has the bigram at the same place or the next: in an equal first half at the same, in an
    # equal second half at the next.
    asks = [*same, key("+<", size + 1, at, part(half)), F.when(at + 1 > half, key("+<", size + 1, at + 1, part(half))),
            key("+>", size + 1, at + 1, rest(half + 1)), F.when(at <= half, key("+>", size + 1, at, rest(half + 1)))]
    found = [*same, key("+<", size, at, part(shorter)), key("+>", size, at, rest(shorter + 2))]
    left = rare.select("word", "n", F.explode(F.array(*asks)).alias("key")).where("key IS NOT NULL")
    right = rare.select(F.col("word").alias("other"), F.col("n").alias("other_n"), F.explode(F.array(*found)).alias("key"))
    longer = F.length("other") - F.length("word")
    apart = ((longer == 1) | ((longer == 0) & (F.col("word") < F.col("other")))) & (F.levenshtein("word", "other", 1) == 1)
    return left.join(right, "key").where(apart).select("word", "n", "other", "other_n").distinct()


def last_forms(forms: DataFrame, ratio: int) -> DataFrame:
    """(word, root): forms(word, form, form_n) followed to the last."""
    most = forms.agg(F.max("form_n")).first()[0]
    steps = 0 if most is None or ratio < 2 else math.ceil(math.log(max(most, 2), ratio)) + 1
    roots = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(steps, 1))))):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = written(roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return roots


def group_variants(docs: DataFrame, ratio: int = RATIO, least: int = LEAST, occurs: int = OCCURS, dropped: int | None = DROPPED) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of docs(doc_id, text)."""
    words = written(vocabulary(docs, least, occurs, dropped))
    pairs = near_pairs(words)
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    # Strings compare by their UTF-8 bytes, which is code-point order.
    near = written(both.groupBy("word").agg(F.count("*").alias("n_near"), F.max("n").alias("n"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best")))
    near = near.withColumn("is_form", -F.col("best.less") >= ratio * F.col("n")).select("word", "n_near", F.when(F.col("is_form"), F.col("best.form")).alias("form"), F.when(F.col("is_form"), -F.col("best.less")).alias("form_n"))
    roots = last_forms(near.where("form IS NOT NULL").select("word", "form", "form_n"), ratio)
    out = words.join(near, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def oracle_sql() -> str:
    """group_variants with its defaults, over documents: words meet on all words with one letter less or blotted out."""
    return f"""{CRC_SQL.replace('WITH', 'WITH RECURSIVE', 1)}, runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc, translate(run, '{UPPER}', '{UPPER.lower()}') AS run, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{LETTERS}')) AS run FROM documents) GROUP BY ALL),
hashed AS (
  SELECT run, times, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(regexp_extract_all(hex(encode(doc || ':' || run)), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM runs, crc_table WHERE length(run) >= {LEAST}),
typed AS (
  SELECT CASE WHEN h % {DROPPED} = 0 THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, times FROM hashed),
words AS (SELECT word, sum(times)::BIGINT AS n FROM typed WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(times) >= {OCCURS}),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
shapes AS (SELECT word, n, i, substr(word, 1, i::INTEGER - 1) || '*' || substr(word, i::INTEGER + 1) AS blot, substr(word, 1, i::INTEGER - 1) || substr(word, i::INTEGER + 1) AS less FROM places),
pairs AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM shapes a JOIN shapes b ON a.blot = b.blot AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM shapes a JOIN words b ON a.less = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM shapes a JOIN words b ON a.less = b.word),
ranked AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS r FROM pairs),
near AS (SELECT word, n_near, CASE WHEN other_n >= {RATIO} * n THEN other END AS form, CASE WHEN other_n >= {RATIO} * n THEN other_n END AS form_n FROM ranked WHERE r = 1),
followed AS (
  SELECT word, form AS root, 1 AS step FROM near WHERE form IS NOT NULL
  UNION ALL SELECT f.word, near.form, f.step + 1 FROM followed f JOIN near ON near.word = f.root WHERE near.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, step) AS root FROM followed GROUP BY word)
SELECT words.word, near.form, coalesce(roots.root, words.word) AS root, words.n, coalesce(near.n_near, 0)::BIGINT AS n_near, near.form_n
FROM words LEFT JOIN near ON near.word = words.word LEFT JOIN roots ON roots.word = words.word
"""
