"""Pairs of pages in different editions: by equal title, and by item; labels and what they tell."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editwake import session
from editwake.config import DEFAULT

STRATA = ("both", "naive_only", "wikidata_only")
PAIR = ["wiki_a", "title_a", "wiki_b", "title_b"]
TRUE_WORDS, FALSE_WORDS = ("y", "yes", "1", "true", "same"), ("n", "no", "0", "false", "different")


def pages(edits: DataFrame) -> DataFrame:
    """Pages with a human edit: (wiki, title, qid), with the item of the last such edit by seq."""
    return edits.where(~F.coalesce("bot", F.lit(False))).groupBy("wiki", "title").agg(F.max(F.struct("seq", "qid")).alias("last")).select("wiki", "title", "last.qid")


def _pairs(page: DataFrame, key: str) -> DataFrame:
    """Pairs of different editions within a key, the smaller page first.

    A title has one page per edition and an item hardly more, so a key's pairs are bounded by the square of the number of
    editions, whatever its edits. For counts alone use strata_sizes(), which forms no pair.
    """
    a = page.where(F.col(key).isNotNull()).select(F.col(key).alias("_ew_key"), F.col("wiki").alias("wiki_a"), F.col("title").alias("title_a"))
    b = page.select(F.col(key).alias("_ew_key"), F.col("wiki").alias("wiki_b"), F.col("title").alias("title_b"))
    return a.join(b, "_ew_key").where("wiki_a < wiki_b").select(PAIR)


def naive_pairs(page: DataFrame) -> DataFrame:
    return _pairs(page, "title")


def item_pairs(page: DataFrame) -> DataFrame:
    return _pairs(page, "qid")


def stratified(page: DataFrame) -> DataFrame:
    """Every pair found by either method, with its stratum."""
    marked = naive_pairs(page).withColumn("m", F.lit(1)).unionByName(item_pairs(page).withColumn("m", F.lit(2)))
    both = marked.groupBy(*PAIR).agg(F.sum("m").alias("m"))
    stratum = F.when(F.col("m") == 3, "both").when(F.col("m") == 1, "naive_only").otherwise("wikidata_only")
    return both.select(*PAIR, stratum.alias("stratum"))


def _count_pairs(page: DataFrame, *keys: str) -> Column:
    per = page.groupBy(*keys, "wiki").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy(*keys).agg(((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).cast("bigint").alias("pairs")).agg(
        F.coalesce(F.sum("pairs"), F.lit(0)).cast("bigint").alias("pairs")
    )


def strata_sizes(page: DataFrame) -> DataFrame:
    """(stratum, pairs) from sizes of groups alone: pages of a key in different editions, without forming a pair."""
    named = page.where("qid is not null")
    sums = (
        _count_pairs(page.where("title is not null"), "title").withColumnRenamed("pairs", "t")
        .crossJoin(_count_pairs(named, "qid").withColumnRenamed("pairs", "i"))
        .crossJoin(_count_pairs(named.where("title is not null"), "title", "qid").withColumnRenamed("pairs", "b"))
    )  # three single rows
    rows = F.array(
        F.struct(F.lit("both").alias("stratum"), F.col("b").alias("pairs")), F.struct(F.lit("naive_only").alias("stratum"), (F.col("t") - F.col("b")).alias("pairs")),
        F.struct(F.lit("wikidata_only").alias("stratum"), (F.col("i") - F.col("b")).alias("pairs")),
    )
    return sums.select(F.explode(rows).alias("x")).select("x.*")


def allocate(sizes: dict[str, int], total: int) -> dict[str, int]:
    """total shared evenly over strata that have pairs; what a small one can't use goes to the larger ones."""
    shares = dict.fromkeys(sizes, 0)
    waiting = sorted((s for s in STRATA if sizes.get(s, 0) > 0), key=lambda s: (sizes[s], STRATA.index(s)))
    while waiting:
        s, *rest = waiting
        shares[s] = min(sizes[s], total // len(waiting))
        total, waiting = total - shares[s], rest
    return shares


def allocation(page: DataFrame, total: int = DEFAULT.labels.sample) -> DataFrame:
    sizes = {r[0]: r[1] for r in strata_sizes(page).collect()}  # three rows
    shares = allocate(sizes, total)
    return page.sparkSession.createDataFrame([(s, sizes[s], shares[s]) for s in STRATA], "stratum string, pairs bigint, sampled bigint")


def positioned(df: DataFrame, order: list[str], out: str = "position") -> DataFrame:
    """Adds the row's place (from 0) in the global order: a distributed sort, and partition sizes added up."""
    placed = session.stage(df.orderBy(*order).withColumn("_ew_id", F.monotonically_increasing_id()), "positioned")
    part = F.shiftright("_ew_id", 33)
    sizes = placed.groupBy(part.alias("_ew_part")).agg(F.count(F.lit(1)).alias("n"))
    before: dict[int, int] = {}
    total = 0
    for p, n in sorted((r[0], r[1]) for r in sizes.collect()):  # a row per partition
        before[p], total = total, total + n
    start = df.sparkSession.createDataFrame(sorted(before.items()) or [(0, 0)], "_ew_part bigint, _ew_start bigint")
    return placed.withColumn("_ew_part", part).join(F.broadcast(start), "_ew_part").withColumn(
        out, F.col("_ew_start") + F.col("_ew_id").bitwiseAND(F.lit((1 << 33) - 1))
    ).select(*df.columns, out)


def page_url(wiki: Column, title: Column) -> Column:
    language = F.replace(F.regexp_replace(wiki, "wiki$", ""), F.lit("_"), F.lit("-"))
    path = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    for escaped, plain in (("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        path = F.replace(path, F.lit(escaped), F.lit(plain))
    return F.concat(F.lit("https://"), language, F.lit(".wikipedia.org/wiki/"), path)


def labelling_sample(page: DataFrame, size: int = DEFAULT.labels.sample, seed: int = DEFAULT.labels.seed) -> DataFrame:
    """A blind sample with its key: (pair_id, pair, urls, stratum). Positions are drawn here, rows are found where they lie."""
    spark = page.sparkSession
    sizes = {r[0]: r[1] for r in strata_sizes(page).collect()}
    shares = allocate(sizes, size)
    rng = random.Random(seed)
    drawn = [(s, i) for s in STRATA for i in rng.sample(range(sizes[s]), shares[s])]
    rng.shuffle(drawn)
    wanted = spark.createDataFrame([(s, i, f"p{k:03d}") for k, (s, i) in enumerate(drawn, 1)], "stratum string, position bigint, pair_id string")
    rank = F.when(F.col("stratum") == STRATA[0], 0).when(F.col("stratum") == STRATA[1], 1).otherwise(2)
    offsets = {s: sum(sizes[x] for x in STRATA[:k]) for k, s in enumerate(STRATA)}
    placed = positioned(stratified(page).withColumn("_ew_rank", rank), ["_ew_rank", *PAIR])
    start = F.when(rank == 0, offsets[STRATA[0]]).when(rank == 1, offsets[STRATA[1]]).otherwise(offsets[STRATA[2]])
    found = placed.withColumn("position", F.col("position") - start).join(F.broadcast(wanted), ["stratum", "position"])
    return found.select(
        "pair_id", *PAIR, page_url(F.col("wiki_a"), F.col("title_a")).alias("url_a"), page_url(F.col("wiki_b"), F.col("title_b")).alias("url_b"), "stratum"
    )


def parsed_label(label: Column) -> Column:
    """True, False, or NULL for anything else."""
    word = F.lower(F.trim(label))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def evaluation(labels: DataFrame, key: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row of precision and pooled recall of both methods from labels (pair_id, same_subject), key (pair_id, stratum), sizes.

    A stratum's share of true labels is carried over to its size; where any stratum has no label, all scores are NULL. A
    labelled pair without a key raises an error. Ids are unique in both.
    """
    judged = labels.select("pair_id", parsed_label(F.col("same_subject")).alias("label"))
    joined = judged.join(key, "pair_id", "left")
    known = F.when(F.col("label").isNotNull() & F.col("stratum").isNull(), F.raise_error(F.concat(F.lit("no key for "), F.col("pair_id")))).otherwise(F.col("stratum"))
    counts = joined.select("label", known.alias("stratum"))
    of = lambda s, extra=None: F.count(F.when((F.col("stratum") == s) & F.col("label").isNotNull() & (F.lit(True) if extra is None else extra), 1))
    figures = counts.agg(
        F.count("label").alias("labelled"), F.count(F.when(F.col("label").isNull(), 1)).alias("unlabelled"),
        *[of(s).alias(f"labelled_{s}") for s in STRATA], *[of(s, F.col("label")).alias(f"true_{s}") for s in STRATA],
    )
    width = sizes.agg(*[F.coalesce(F.max(F.when(F.col("stratum") == s, F.col("pairs"))), F.lit(0)).alias(f"size_{s}") for s in STRATA])
    one = figures.crossJoin(width)  # single rows
    for s in STRATA:
        one = one.withColumn(f"est_{s}", F.try_divide(F.col(f"true_{s}").cast("double"), F.col(f"labelled_{s}").cast("double")) * F.col(f"size_{s}"))
    pooled = F.col("est_both") + F.col("est_naive_only") + F.col("est_wikidata_only")

    def scores(name: str, own: str) -> list[Column]:
        true, found = F.col("est_both") + F.col(f"est_{own}"), F.col("size_both") + F.col(f"size_{own}")
        ready = pooled.isNotNull()
        return [
            F.when(ready, found).alias(f"{name}_pairs"), F.when(ready, F.bround(true, 1)).alias(f"{name}_true_pairs"),
            F.when(ready, F.bround(F.try_divide(true, found.cast("double")), 4)).alias(f"{name}_precision"),
            F.when(ready, F.bround(F.try_divide(true, pooled), 4)).alias(f"{name}_recall"),
        ]

    return one.select(
        "labelled", "unlabelled", *[f"labelled_{s}" for s in STRATA], *[f"true_{s}" for s in STRATA], *[F.bround(f"est_{s}", 1).alias(f"estimated_{s}") for s in STRATA],
        *scores("naive", "naive_only"), *scores("wikidata", "wikidata_only"), F.bround("est_wikidata_only", 1).alias("missed_by_naive"),
        F.bround(F.try_divide(F.col("est_wikidata_only"), pooled), 4).alias("share_missed_by_naive"),
    )
