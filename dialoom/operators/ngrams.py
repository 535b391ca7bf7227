"""N-gram profiles of texts."""

from __future__ import annotations

import operator
from collections import Counter, deque
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialoom.functions.storage import written
from dialoom.functions.text import collapse, word_tokens

# The English stop words of the n-gram filter, and five that are added.
STOPWORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's
her hers herself it it's its itself they them their theirs themselves what which who whom this that that'll these those am is
are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for
with about against between into through during before after above below to from up down in out on off over under again further
then once here there when where why how all any both each few more most other some such no nor not only own same so than too
very s t can will just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't
hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't
wasn wasn't weren weren't won won't wouldn wouldn't
said ask tell response question
""".split()
PUNCTUATION = list("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def prepared(text: Column) -> Column:
    """Curly apostrophes and backticks straightened, then every run of straight quotes as one double quote, white space
    collapsed. No contraction is left to expand then."""
    plain = F.regexp_replace(F.translate(text, "‘’`", "'''"), "['\"]+", '"')
    return collapse(plain)


def tokens(text: Column, punctuation: bool = True) -> Column:
    return word_tokens(prepared(text), punctuation)


def _places(df: DataFrame, order: str, text: str, least: int, punctuation: bool) -> DataFrame:
    """A row for each place at which an n-gram may begin: o, place, and the text's words (t), their hashes and marks."""
    cut = df.select(F.col(order).alias("o"), tokens(F.col(text), punctuation).alias("t")).where(F.size("t") >= least)
    marks = lambda words: F.transform("t", lambda w: w.isin(words).cast("int"))
    marked = cut.select("o", "t", marks(STOPWORDS).alias("stops"), marks(PUNCTUATION).alias("marks"), F.transform("t", lambda w: F.xxhash64(w)).alias("hashes"))
    return marked.select("*", F.explode(F.sequence(F.lit(0), F.size("t") - least)).alias("place"))


def _fits(n: int, stop_limit: int, punct_limit: int) -> Column:
    total = lambda of: reduce(operator.add, (F.get(of, F.col("place") + k) for k in range(n)))
    return (F.col("place") + n <= F.size("t")) & (total("stops") <= stop_limit) & (total("marks") <= punct_limit)


def ngrams(df: DataFrame, order: str, text: str, least: int = 3, most: int = 5, stop_limit: int = 1, punct_limit: int = 1, punctuation: bool = True) -> DataFrame:
    """n, ngram and pos (order of appearance: text, n, place), one row an occurrence.

    Words are marked once; then each place is a row of generated code that sums the marks of its words.
    """
    places = _places(df, order, text, least, punctuation)

    def gram(n: int) -> Column:
        return F.when(_fits(n, stop_limit, punct_limit), F.struct(F.lit(n).alias("n"), F.slice("t", F.col("place") + 1, n).alias("ngram")))

    every = places.select("o", "place", F.explode(F.array(*map(gram, range(least, most + 1)))).alias("g")).where("g is not null")
    return every.select("g.n", "g.ngram", F.struct("o", "place").alias("pos"))


def frequent_ngrams(df: DataFrame, order: str, text: str, k: int = 10, least: int = 3, most: int = 5, stop_limit: int = 1, punct_limit: int = 1, punctuation: bool = True, buckets: int = 1 << 18, tried: int = 64) -> DataFrame:
    """As top_ngrams(ngrams(...)), exactly, without moving all n-grams.

    All occurrences are counted by a hash of the n-gram first, into `buckets` for each n; no n-gram occurs more often than its
    bucket. The n-grams of the `tried` fullest buckets are counted one by one. The k-th of them bounds the result from below,
    so only other buckets that reach it can hold more of it, and all of those are counted, too, however many they are.
    """
    places = _places(df, order, text, least, punctuation)

    def occurrences() -> DataFrame:
        def gram(n: int) -> Column:
            h = F.xxhash64(*(F.get("hashes", F.col("place") + i) for i in range(n)))
            return F.when(_fits(n, stop_limit, punct_limit), F.struct(F.lit(n).alias("n"), h.bitwiseAND(F.lit(buckets - 1)).cast("int").alias("bucket")))

        every = places.select("o", "t", "place", F.explode(F.array(*map(gram, range(least, most + 1)))).alias("g"))
        return every.where("g is not null").select("o", "t", "place", "g.n", "g.bucket")

    def counted(some: DataFrame) -> DataFrame:
        own = occurrences().join(F.broadcast(some), ["n", "bucket"])
        grams = own.select("n", F.expr("slice(t, place + 1, n)").alias("ngram"), F.struct("o", "place").alias("pos"))
        return written(grams.groupBy("n", "ngram").agg(F.count("*").alias("cnt"), F.min("pos").alias("pos")), "ngram-counts")

    full = written(occurrences().groupBy("n", "bucket").agg(F.count("*").alias("most")), "ngram-buckets")
    sizes = range(least, most + 1)
    fullest = [(n, r.bucket) for n in sizes for r in full.where(F.col("n") == n).orderBy(F.desc("most"), "bucket").limit(tried).collect()]
    first = df.sparkSession.createDataFrame(fullest, "n int, bucket int")
    found = counted(first)
    bound = {n: [r.cnt for r in found.where(F.col("n") == n).orderBy(F.desc("cnt")).limit(k).collect()] for n in sizes}
    reached = reduce(operator.or_, ((F.col("n") == n) & (F.col("most") >= (c[-1] if len(c) == k else 1)) for n, c in bound.items()))
    others = written(full.where(reached).join(F.broadcast(first), ["n", "bucket"], "left_anti").select("n", "bucket"), "ngram-others")
    if others.limit(1).count():
        found = found.union(counted(others))
    return ranked(found, k)


def said_by(df: DataFrame, turns: str, roles: list[str] | None = None, order: str = "_pos") -> DataFrame:
    """o (conversation and turn, in order) and text of the turns of these roles, whatever their case; all without roles."""
    each = df.select(F.col(order).alias("c"), F.posexplode(turns).alias("k", "t")).where("t.value is not null")
    wanted = F.lit(True) if roles is None else F.coalesce(F.lower("t.from"), F.lit("")).isin([r.lower() for r in roles])
    return each.where(wanted).select(F.struct("c", "k").alias("o"), F.col("t.value").alias("text"))


def top_ngrams(grams: DataFrame, k: int = 10) -> DataFrame:
    """n, ngram, cnt and rank; ties go to the first to appear."""
    return ranked(grams.groupBy("n", "ngram").agg(F.count("*").alias("cnt"), F.min("pos").alias("pos")), k)


def ranked(counted: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("cnt"), "pos"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= k).select("n", F.array_join("ngram", " ").alias("ngram"), "cnt", "rank")


def with_recency(grams: DataFrame, window: int = 50, threshold: float = 0.85) -> DataFrame:
    """Occurrences that resemble none of the last `window` kept of the same n.

    What is kept depends on all that was kept before, so each n is one ordered walk. Its rows come from Spark's own sort in
    batches, and only the window is held, so memory doesn't grow with the data; time does. Different sets of n words have a
    likeness of (n - 1) / n at most; where the threshold lies above, equal sets are all that counts.
    """

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[int, deque[frozenset]] = {}
        held: dict[int, Counter[frozenset]] = {}
        for frame in frames:
            keep = []
            for n, g in zip(frame["n"], frame["ngram"], strict=True):
                s = frozenset(g)
                row, own = last.setdefault(n, deque()), held.setdefault(n, Counter())
                if threshold > (n - 1) / n:
                    fresh = not own[s]
                else:
                    fresh = all(len(s & x) / max(1, len(s | x)) < threshold for x in row)
                keep.append(fresh)
                if fresh:
                    row.append(s)
                    own[s] += 1
                    if len(row) > window:
                        gone = row.popleft()
                        own[gone] -= 1
                        if not own[gone]:
                            del own[gone]
                elif not own[s]:
                    del own[s]
            yield frame[keep]

    flat = grams.select("n", "ngram", "pos.o", "pos.place")
    sorted_rows = flat.repartition("n").sortWithinPartitions("n", "o", "place")
    return sorted_rows.mapInPandas(walk, flat.schema).select("n", "ngram", F.struct("o", "place").alias("pos"))
