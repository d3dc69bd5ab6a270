"""Importance resampling towards a target: hashed n-gram features, gains by bucket, Gumbel top-k.

Words become rows with their positions; for orders above one, ``lead`` per text puts the following words beside each.
Features are hashed and counted by bucket on both sides, and the buckets' gains are joined back to the features and
summed by text. Scores are drawn without replacement by adding seeded Gumbel noise and taking the highest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialize
from millrace.llm.fill_middle import seeded

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words in lower case (A-Z only); none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def features(df: DataFrame, key: str, text: str, orders: int = 1) -> DataFrame:
    """(key, word count of the text, feature): runs of 1 to ``orders`` words, repeats kept; a text without words gives one null."""
    table = df.select(key, words(F.col(text)).alias("__w")).select(key, F.size("__w").alias("n_words"), F.posexplode_outer("__w").alias("pos", "word"))
    if orders == 1:
        return table.select(key, "n_words", F.col("word").alias("feature"))
    following = Window.partitionBy(key).orderBy("pos")
    runs = [F.col("word")]
    for k in range(1, orders):
        runs.append(F.concat(runs[-1], F.lit(" "), F.lead("word", k).over(following)))
    found = table.select(key, "n_words", F.array(*runs).alias("runs"))
    kept = F.filter("runs", lambda r: r.isNotNull())
    return found.select(key, "n_words", F.explode_outer(kept).alias("feature"))


def bucket(feature: Column, buckets: int) -> Column:
    return F.crc32(feature.cast("binary")) % buckets


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket: a table of ``buckets`` rows, from the features of both sides."""

    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.where("feature is not null").groupBy(bucket(F.col("feature"), buckets).alias("bucket")).agg(F.count(F.lit(1)).alias(name))

    every = raw.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    both = every.join(counts(raw, "s"), "bucket", "left").join(counts(target, "t"), "bucket", "left").na.fill(0, ["s", "t"])
    both = materialize(both, "bucket-counts")  # rows and totals both come from it, and the texts are counted once
    total = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    d = lambda c: F.col(c).cast("double")
    ratio = (d("t") + 1) * (d("all_s") + buckets) / ((d("s") + 1) * (d("all_t") + buckets))
    # one row of totals beside a table of fixed size
    return both.join(F.broadcast(total), F.lit(True)).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def scores(docs: DataFrame, target: DataFrame, orders: int = 1, buckets: int = 10_000, seed: int = 2024, key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """(row, key, n_words, n_features, weight, score): one row for each row of ``docs``, repeated and null keys included."""
    rows = docs.select(key, text).withColumn("row", F.monotonically_increasing_id())
    found = features(rows.select(F.struct("row", key).alias("__k"), text), "__k", text, orders)
    aim = features(target.select(F.monotonically_increasing_id().alias("__k"), F.col(target_text).alias("__t")), "__k", "__t", orders)
    gain = materialize(gains(found, aim, buckets), "gains")
    # ``buckets`` rows by construction, however large the input is
    priced = found.withColumn("bucket", bucket(F.col("feature"), buckets)).join(F.broadcast(gain), "bucket", "left")
    weighed = priced.groupBy("__k").agg(F.max("n_words").alias("n_words"), F.count("feature").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("weight"))
    noise = F.floor(-1000 * F.log(-F.log((seeded(F.col(f"__k.{key}"), seed, 1)[0].cast("double") + 0.5) / 4294967296.0)))
    return weighed.select("__k.row", F.col(f"__k.{key}").alias(key), F.col("n_words").cast("long").alias("n_words"), "n_features", "weight", (F.col("weight") + noise).cast("long").alias("score"))


def ranked(rows: DataFrame, n: int, order: str, ties: list[str], per_task: int = 20_000, most: int = 1000) -> DataFrame:
    """The ``n`` rows with ``rank``, from 1 by falling ``order``, then rising ``ties``.

    Ranks come from quantile ranges of ``order``, ``most`` at most: rows are numbered within their range, ranges by the
    rows before them. A range has about ``per_task`` rows, or n / ``most``, besides those of one single value.
    """
    steps = min(most, max(1, -(-n // per_task)))
    part = F.lit(0)
    if steps > 1:
        cuts = [i / steps for i in range(1, steps)]
        bounds = sorted(set(rows.agg(F.percentile_approx(order, cuts, 20 * steps)).first()[0]))
        part = F.size(F.filter(F.lit(bounds), lambda b: b >= F.col(order)))
    dealt = rows.withColumn("__part", part)
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    within = Window.partitionBy("__part").orderBy(F.desc(order), *[F.asc_nulls_last(t) for t in ties])
    numbered = dealt.withColumn("__i", F.row_number().over(within)).join(F.broadcast(before), "__part")
    return numbered.withColumn("rank", F.col("__i") + F.col("__before")).drop("__part", "__i", "__before")


def resample(
    docs: DataFrame, target: DataFrame, share: tuple[int, int] = (10, 100), least_words: int = 20, orders: int = 1, buckets: int = 10_000, seed: int = 2024, target_text: str = "text"
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_features, weight, score and rank (null where not drawn).

    Of the N rows with at least ``least_words`` words the ``share`` with the highest scores is drawn, ties to smaller
    ids, null ids last. Null and empty texts have no features and weight 0; a null id is hashed as an empty one.
    """
    scored = materialize(scores(docs, target, orders, buckets, seed, target_text=target_text), "scores")
    fit = F.col("n_words") >= least_words
    n = scored.where(fit).count()
    drawn = share[0] * n // share[1]
    named = ["doc_id", "n_features", "weight", "score"]
    ranks = ranked(scored.where(fit), n, "score", ["doc_id", "row"])
    rest = scored.where(~fit).select(*named, F.lit(None).cast("long").alias("rank"))
    return ranks.select(*named, F.when(F.col("rank") <= drawn, F.col("rank")).cast("long").alias("rank")).unionByName(rest)
