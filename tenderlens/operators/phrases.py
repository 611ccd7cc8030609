"""N-gram counts over cleaned tokens."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlens.operators.ordering import running_total
from tenderlens.session import dealt, materialise, settled

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
MOST = 1 << 30
BUCKETS = 1 << 16
PIECE_BYTES = 16 << 20   # of text and
PIECE_TOKENS = 2 << 20   # tokens that a task makes into n-grams at once: some 3 million different ones, 0.4 GB


def letter_tokens(tokens) -> Column:
    """Tokens of ASCII letters only: a set of letters is stripped, as a pattern would be compiled for every token."""
    return F.filter(tokens, lambda t: (F.ltrim(t, F.lit(LETTERS)) == "") & (t != ""))


def _sequences(tokens: str, longest: int) -> Column:
    """For every token itself and those behind it: structs ``w0``, ``w1``, ..., null past the end."""
    return F.arrays_zip(*[F.slice(tokens, n + 1, MOST).alias(f"w{n}") for n in range(longest)])


def _words(n: int) -> list[str]:
    return [f"w{i}" for i in range(n)]


def _phrase(longest: int, size: Column | str = "size") -> Column:
    """The first ``size`` words as text."""
    return F.concat_ws(" ", "w0", *[F.when(F.col(size) > n, F.col(f"w{n}")) for n in range(1, longest)])


def _edges(tokens: str, longest: int) -> Column:
    """The first and last ``longest - 1`` tokens of a document with their places in it."""
    reach, size = longest - 1, F.size(tokens)
    tail = F.greatest(size - reach, F.lit(reach))

    def placed(part: Column, start: Column) -> Column:
        return F.transform(part, lambda t, i: F.struct((i + start).alias("at"), t.alias("token")))

    return F.concat(placed(F.slice(tokens, 1, reach), F.lit(0)),
                    placed(F.slice(tokens, tail + 1, F.lit(reach)), tail))


def border_grams(ends: DataFrame, order: list[str], longest: int = 3) -> DataFrame:
    """(size, w0, w1, ...): n-grams that start in one document and end in a later one of the same order.

    ``ends`` holds the order, the number of tokens (``_size``) and the outer tokens (``_edges``) of each
    document. Each token gets its place in the whole token stream, and neighbours meet by an equi-join
    on that place.
    """
    placed = running_total(ends, order, "_size", "_start").select(
        F.col("_start").alias("doc"), "_start", F.explode("_edges").alias("e")
    ).select("doc", (F.col("_start") + F.col("e.at")).alias("place"), F.col("e.token").alias("token"))
    placed = materialise(placed)  # read five times below
    grams, chain = [], placed.select(F.col("doc").alias("first"), "place", F.col("token").alias("w0"))
    for step in range(1, longest):
        following = placed.select((F.col("place") - step).alias("place"),
                                  F.col("doc").alias("_doc"), F.col("token").alias(f"w{step}"))
        chain = chain.join(following, "place")
        blank = [F.lit(None).cast("string").alias(f"w{n}") for n in range(step + 1, longest)]
        grams.append(chain.filter(F.col("first") != F.col("_doc")).select(
            F.lit(step + 1).alias("size"), *_words(step + 1), *blank))
        chain = chain.drop("_doc")
    return reduce(DataFrame.unionAll, grams)


class Grams:
    """The n-grams of all documents, over settled tokens, so that they can be gone through more than once.

    With ``stitch_order`` the documents form one token stream in that order and phrases across their borders
    count too; documents equal in it are in order of their outer tokens. With ``deal`` the settled tokens of a
    stream are dealt to short tasks, for counts that combine all n-grams in them.
    """

    def __init__(self, docs: DataFrame, tokens: str, sizes: tuple[int, ...] = (1, 2, 3),
                 stitch_order: list[str] | None = None, settle: bool = True, deal: bool = False):
        self.sizes, longest = sizes, max(sizes)
        letters = docs.select(*(stitch_order or []), letter_tokens(tokens).alias("_tokens"))
        stitched = bool(stitch_order) and longest > 1
        letters = settled(letters, "tokens") if settle or stitched else letters
        shares = dealt(letters, F.size("_tokens"), PIECE_TOKENS) if deal and stitched else letters
        self.sequences = shares.select(F.inline(_sequences("_tokens", longest)))
        self.borders = None
        if stitched:
            ends = letters.select(*stitch_order, F.size("_tokens").cast("bigint").alias("_size"),
                                  _edges("_tokens", longest).alias("_edges"))
            order = [*stitch_order, "_size", "_tie"]
            found = border_grams(ends.withColumn("_tie", F.xxhash64("_edges")), order, longest)
            self.borders = settled(found.filter(F.col("size").isin(*sizes)), "borders")

    def rows(self, name: Callable[[int], Column] = F.lit) -> DataFrame:
        """(w0, w1, ..., size, gram): ``gram`` = name(size) for every n-gram, which has that many words."""
        words = _words(max(self.sizes))
        named = F.array(*[F.when(F.col(f"w{n - 1}").isNotNull(), name(n)) for n in self.sizes])
        size = F.element_at(F.array(*[F.lit(n) for n in self.sizes]), F.col("_at") + 1)
        inside = self.sequences.select(*words, F.posexplode(named).alias("_at", "gram")).filter(
            F.col("gram").isNotNull()).select(*words, size.alias("size"), "gram")
        if self.borders is None:
            return inside
        across = F.coalesce(*[F.when(F.col("size") == n, name(n)) for n in self.sizes])
        return inside.unionAll(self.borders.select(*words, "size", across.alias("gram")))


def in_pieces(docs: DataFrame, text: str) -> DataFrame:
    """Documents dealt by the bytes of their texts, before they are cleaned, as texts are shorter than their tokens."""
    return dealt(docs, F.octet_length(text), PIECE_BYTES)


def ngram_counts(docs: DataFrame, tokens: str, sizes: tuple[int, ...] = (1, 2, 3),
                 stitch_order: list[str] | None = None) -> DataFrame:
    """(phrase, count) over all documents; counts are combined before the shuffle.

    Most n-grams are rare, so a task holds nearly all of its own while it combines them. ``in_pieces`` keeps tasks
    short enough for that; a stream's tokens are dealt here once they are settled.
    """
    grams = Grams(docs, tokens, sizes, stitch_order, settle=False, deal=True)
    return grams.rows().groupBy(_phrase(max(sizes)).alias("phrase")).agg(F.count(F.lit(1)).alias("count"))


def frequent_ngrams(grams: Grams, k: int = 500, buckets: int = BUCKETS) -> DataFrame:
    """(phrase, count) of all n-grams that can be among the ``k`` most frequent, and perhaps a few more.

    A sketch prunes the rest exactly. The first pass adds up hashed n-grams in a fixed number of buckets; a
    bucket's total bounds each of its n-grams from above. The second counts the n-grams of the fullest
    buckets; the k-th count bounds the result from below. The third counts the n-grams of all buckets that reach this
    bound and are not yet counted. Only n-grams of such buckets are ever built as text and shuffled.
    """
    def hashed(n: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(n), *_words(n)), F.lit(buckets)).cast("int")

    totals = settled(grams.rows(hashed).groupBy(F.col("gram").alias("bucket")).agg(
        F.count(F.lit(1)).alias("total")), "buckets")

    def counted(chosen: DataFrame) -> DataFrame:
        # Never more rows than there are buckets.
        wanted = F.broadcast(chosen.select(F.col("bucket").alias("gram")))
        found = grams.rows(hashed).join(wanted, "gram", "left_semi")
        return found.groupBy(_phrase(max(grams.sizes)).alias("phrase")).agg(F.count(F.lit(1)).alias("count"))

    # Enough buckets for k n-grams; ties at the border are all taken, so nothing hangs on their order.
    edge = totals.orderBy(F.desc("total"), "bucket").limit(2 * k).agg(F.min("total").alias("edge")).scalar()
    first = settled(counted(totals.filter(F.col("total") >= edge)), "counted")
    ranked = first.orderBy(F.desc("count")).limit(k)
    bound = ranked.agg(F.when(F.count(F.lit(1)) >= k, F.min("count")).otherwise(F.lit(0)).alias("bound")).scalar()
    return first.unionAll(counted(totals.filter((F.col("total") < edge) & (F.col("total") >= bound))))


def top_ngrams(counts: DataFrame, k: int = 500) -> DataFrame:
    return counts.orderBy(F.desc("count"), "phrase").limit(k)


def distinct_phrases(counts: DataFrame) -> DataFrame:
    return counts.agg(F.count(F.lit(1)).alias("n_phrases"))
