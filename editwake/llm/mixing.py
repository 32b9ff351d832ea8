"""Sources mixed to target weights."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from editwake import session

#: Documents per permutation block, on average.
BLOCK_DOCS = 4_096
#: Blocks of a stretch whose sums are added up in one task.
SUPER = 4_096
SEED = 17


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def tempered(base: dict[str, float], exponent: float) -> dict[str, float]:
    """Weights in proportion to base ** exponent; what is 0 stays 0."""
    logs = {s: exponent * math.log(b) for s, b in base.items() if b > 0}
    top = max(logs.values(), default=0.0)
    raw = {s: math.exp(x - top) for s, x in logs.items()}
    total = sum(raw.values())
    return {s: raw[s] / total if s in raw else 0.0 for s in base}


def bisected(good, low: float, high: float, steps: int = 60) -> float:
    """The end of the stretch from `low` on that is good, where good turns from true to false once between low and high."""
    if good(high):
        return high
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if good(middle) else (low, middle)
    return low


def exponent_for_entropy(shares: dict[str, float], target: float, most: float = 8.0) -> float:
    """The exponent in 0..most at which the tempered shares have the target entropy: it falls as the exponent grows."""
    return bisected(lambda e: entropy(tempered(shares, e)) >= target - 1e-12, 0.0, most)


def exponent_for_limits(shares: dict[str, float], most_share: dict[str, float], near: float = 0.0, most: float = 8.0, steps: int = 800) -> float | None:
    """The exponent in 0..most nearest to `near` at which no source gets more than its greatest share; None where there is none.

    A higher exponent takes from small sources and gives to large ones, so both ends may break a limit: the nearest good
    point of a grid is found, and the border between it and the point before by bisection.
    """
    within = lambda e: all(w <= most_share[s] + 1e-9 for s, w in tempered(shares, e).items())
    if within(near):
        return near
    good = next((e for e in sorted((most * k / steps for k in range(steps + 1)), key=lambda e: (abs(e - near), e)) if within(e)), None)
    if good is None:
        return None
    away = min(most / steps, abs(good - near)) * (1 if near > good else -1)
    return good + away * bisected(lambda x: within(good + away * x), 0.0, 1.0)


def plan(sizes: dict[str, int], targets: dict[str, float], repeats: dict[str, int], total: int | None = None, exact: bool = True) -> dict[str, dict]:
    """Weight and budget in tokens per source, with the exponent and the weight it gives by itself.

    Temperature: the token shares of the sources are raised to an exponent, bisected until the weights have the entropy of
    the target shares. Where `total` tokens would then take a source beyond its repeats, the exponent is bisected again, to
    the nearest one within all limits. One exponent can't meet many targets: with `exact` each weight is then corrected by
    the factor that takes it to its target, as far as the repeats go, so that the targets are met; without, the tempered
    weights are the weights. Without a total the largest one is taken at which the weights stay within every limit. A
    source without tokens can't take part: its target is spread over the others in proportion, its budget is 0.
    """
    nothing = {"weight": 0.0, "budget": 0, "exponent": None, "tempered": 0.0}
    there = {s: t for s, t in targets.items() if sizes.get(s, 0) > 0 and t > 0 and repeats.get(s, 0) > 0}
    if not there:
        return {s: dict(nothing) for s in targets}
    whole, stock = sum(there.values()), sum(sizes[s] for s in there)
    aim = {s: t / whole for s, t in there.items()}
    natural = {s: sizes[s] / stock for s in there}
    most = {s: repeats[s] * sizes[s] for s in there}
    exponent = exponent_for_entropy(natural, entropy(aim))
    weights = tempered(natural, exponent)
    if total is not None and any(weights[s] * total > most[s] * (1 + 1e-9) for s in there):
        nearest = exponent_for_limits(natural, {s: most[s] / total for s in there}, exponent)
        exponent = 1.0 if nearest is None else nearest
        weights = tempered(natural, exponent)
    mild = weights
    if exact:
        weights = aim  # each weight times the factor aim / weight
    if total is None:
        total = int(min(most[s] / w for s, w in weights.items() if w > 0))
    return {
        s: {"weight": weights[s], "budget": min(int(weights[s] * total + 1e-6), most[s]), "exponent": exponent, "tempered": mild[s]} if s in there else dict(nothing) for s in targets
    }


def _wanted(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """The short list of sources; a source listed twice counts as the last one in order of share and repeats."""
    rows = targets.where("source is not null").select("source", F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).collect()
    return {r[0]: (r[1] or 0.0, r[2] or 0) for r in sorted(rows, key=lambda r: (r[0], r[1] or 0.0, r[2] or 0))}


def used_rows(docs: DataFrame, targets: DataFrame, item: str = "doc_id", size: str = "tokens", source: str = "source") -> DataFrame:
    """Documents of listed sources that have tokens, written down once since the mixture reads them several times."""
    rows = docs.where((F.col(size) > 0) & F.col(source).isin(list(_wanted(targets))))
    return session.stage(rows.select(F.col(source).alias("source"), F.col(item).alias(item), F.col(size).cast("bigint").alias(size)), "mix")


def budgets(rows: DataFrame, targets: DataFrame, size: str = "tokens", total: int | None = None, exact: bool = True) -> dict[str, dict]:
    """plan() for the rows there are, with each source's tokens, documents and largest document."""
    wanted = _wanted(targets)
    counted = {r[0]: tuple(r[1:]) for r in rows.groupBy("source").agg(F.sum(size), F.count(F.lit(1)), F.max(size)).collect()}  # a row per listed source
    made = plan({s: x[0] for s, x in counted.items()}, {s: t for s, (t, _) in wanted.items()}, {s: r for s, (_, r) in wanted.items()}, total, exact)
    return {s: x | dict(zip(("tokens", "docs", "largest"), counted.get(s, (0, 0, 0)), strict=True)) for s, x in made.items()}


def mix(rows: DataFrame, budget: dict[str, dict], item: str = "doc_id", size: str = "tokens", seed: int = SEED) -> DataFrame:
    """The mixture: (source, item, use, tokens, position), use counting from 1; rows as used_rows() gives them.

    A source's budget is used up in passes, each a new block permutation of its documents: a seeded hash of the pass puts a
    document into a block of about BLOCK_DOCS and orders it there. Blocks follow one another by prefix sums, first within
    stretches of SUPER blocks and then over these, so that no window holds a source as a whole. The last pass ends with
    the last document in its order that fits, so a share is exact to a document's size. position is the part of its
    source's budget that lies before a document, from 0 to 1: in order of position the sources are mixed evenly. Repeated
    ids are documents each. Sources without a budget have no rows.
    """
    spark = rows.sparkSession
    steps = []
    for s, x in budget.items():
        if x["budget"] > 0:
            passes, rest = divmod(x["budget"], x["tokens"])
            steps.append((s, int(passes), int(rest), int(x["tokens"]), int(x["budget"]), max(1, -(-x["docs"] // BLOCK_DOCS))))
    few = F.broadcast(spark.createDataFrame(steps, "source string, _ew_passes int, _ew_rest bigint, _ew_stock bigint, _ew_budget bigint, _ew_blocks int"))  # a row per listed source
    uses = rows.join(few, "source").withColumn("use", F.explode(F.sequence(F.lit(1), F.col("_ew_passes") + F.when(F.col("_ew_rest") > 0, 1).otherwise(0))))
    uses = uses.where(F.col("use") > 0).withColumn("_ew_order", F.xxhash64(F.lit(seed), "use", F.col(item), F.col(size)))
    uses = uses.withColumn("_ew_block", F.pmod(F.shiftrightunsigned(F.col("_ew_order"), 16), F.col("_ew_blocks")).cast("int"))
    at = ["source", "use", "_ew_block"]
    sums = uses.groupBy(*at).agg(F.sum(size).alias("_ew_sum")).withColumn("_ew_super", F.floor(F.col("_ew_block") / SUPER))
    earlier = lambda *part: Window.partitionBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    supers = sums.groupBy("source", "use", "_ew_super").agg(F.sum("_ew_sum").alias("_ew_all"))
    supers = supers.withColumn("_ew_off", F.coalesce(F.sum("_ew_all").over(earlier("source", "use").orderBy("_ew_super")), F.lit(0))).drop("_ew_all")
    within = F.coalesce(F.sum("_ew_sum").over(earlier("source", "use", "_ew_super").orderBy("_ew_block")), F.lit(0))
    sums = sums.withColumn("_ew_in", within).join(supers, ["source", "use", "_ew_super"]).select(*at, (F.col("_ew_off") + F.col("_ew_in")).alias("_ew_before"))
    placed = uses.join(sums, at).withColumn("_ew_base", (F.col("use") - 1) * F.col("_ew_stock")).where(F.col("_ew_base") + F.col("_ew_before") < F.col("_ew_budget"))
    running = Window.partitionBy(*at).orderBy("_ew_order", item).rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("_ew_upto", F.col("_ew_base") + F.col("_ew_before") + F.sum(size).over(running)).where("_ew_upto <= _ew_budget")
    return placed.select("source", item, "use", size, ((F.col("_ew_upto") - F.col(size)) / F.col("_ew_budget")).alias("position"))


def mixed(docs: DataFrame, targets: DataFrame, item: str = "doc_id", size: str = "tokens", source: str = "source", total: int | None = None, exact: bool = True, seed: int = SEED) -> DataFrame:
    """used_rows(), budgets() and mix() in one. Sources not listed, NULL sources and documents without tokens aren't used."""
    rows = used_rows(docs, targets, item, size, source)
    return mix(rows, budgets(rows, targets, size, total, exact), item, size, seed)


def shares(mixture: DataFrame, targets: DataFrame, budget: dict[str, dict], item: str = "doc_id", size: str = "tokens") -> DataFrame:
    """Per listed source: target share, the share that the exponent alone gives, budget and tokens and share reached, uses,
    most uses of a document and its limit, and whether the budget was met to less than a document and the limit kept."""
    spark = mixture.sparkSession
    listed = [(s, t, float(budget[s]["tempered"]), float(budget[s]["exponent"] or 0.0), int(budget[s]["budget"]), int(budget[s]["largest"]), r) for s, (t, r) in _wanted(targets).items()]
    named = spark.createDataFrame(listed, "source string, target_share double, tempered_share double, exponent double, budget_tokens bigint, _ew_largest bigint, max_repeats int")
    each = mixture.groupBy("source", F.col(item), F.col(size)).agg(F.max("use").alias("_ew_last"), F.count(F.lit(1)).alias("_ew_n"))
    per = each.groupBy("source").agg(
        F.sum(F.col(size) * F.col("_ew_n")).alias("reached_tokens"), F.sum("_ew_n").alias("uses"), F.max("_ew_last").alias("most_uses")
    )
    per = per.crossJoin(F.broadcast(per.agg(F.sum("reached_tokens").alias("all_tokens"))))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0))
    reached = zero("reached_tokens")
    met = (reached <= F.col("budget_tokens")) & ((F.col("budget_tokens") == 0) | (reached > F.col("budget_tokens") - F.col("_ew_largest")))
    return named.join(F.broadcast(per), "source", "left").select(
        "source", "target_share", "tempered_share", "exponent", F.coalesce(F.col("reached_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("reached_share"), "budget_tokens",
        reached.alias("reached_tokens"), zero("uses").alias("uses"), zero("most_uses").alias("most_uses"), "max_repeats",
        F.coalesce(met, F.lit(False)).alias("met"), (zero("most_uses") <= F.col("max_repeats")).alias("within_repeats"),
    )
