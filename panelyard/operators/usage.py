"""Token and cost ledgers: sums that unknown inputs spoil, proportional allocation with an exact total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.operators import exact, scans
from panelyard.sources.folders import as_table


def complete_sum(value: Column) -> Column:
    """Sum that is null if any input is null, or there are none."""
    return F.when(F.bool_and(value.isNotNull()), F.sum(value))


def exact_sum(value: Column, digits: int = 18) -> Column:
    """Sum of amounts of at most ``digits`` decimal places, rounded once: added as decimals, so the order of rows does not matter.

    For money and the like, below 10 ** (38 - digits); null for no rows.  :func:`exact.exact_sums` takes doubles of any size.
    """
    return F.sum(value.cast(f"decimal(38, {digits})")).cast("double")


def total_tokens(total: Column, prompt: Column, completion: Column) -> Column:
    """The total, else prompt plus completion, else unknown; negative counts are unknown."""
    sane = lambda c: F.when(c >= 0, c)
    return F.coalesce(sane(total), sane(prompt) + sane(completion))


def execution_metrics(df: DataFrame, by: list[str], tokens: Column, cost: Column, truncated: Column) -> DataFrame:
    """Per group: attempts, known, total_tokens and total_cost (spoilt by unknowns), known_tokens, max_tokens (spoilt too), truncated.

    The cost is the exact sum, rounded once.
    """
    counted = df.groupBy(*by).agg(
        F.count("*").alias("attempts"),
        F.count(tokens).alias("known"),
        complete_sum(tokens).alias("total_tokens"),
        F.coalesce(F.sum(tokens), F.lit(0)).alias("known_tokens"),
        F.when(F.bool_and(tokens.isNotNull()), F.max(tokens)).alias("max_tokens"),
        F.count_if(truncated).alias("truncated"),
    )
    return exact.joined(counted, by, exact.exact_sums(df, by, {"total_cost": cost}, spoilt=True))


def allocate(items: DataFrame, batch: list[str], order: list[str], weight: str, cost: str, group_rows: int = scans.GROUP_ROWS) -> DataFrame:
    """Splits a batch's cost (the same on all its rows) over its items: adds share.

    By weight if every item's is positive, else equally; the last item in ``order`` (a total order) takes what the others
    leave, their shares added exactly, so shares add up to the cost within its last place.  Batches are counted first: up to
    ``group_rows`` rows a batch is one window, and only batches whose sums are not sure there are gone over again; if one is larger
    all are summed map side first and their totals joined back, so one batch may hold most rows.
    """
    items = as_table(items, "items")  # gone over several times
    if (items.groupBy(*batch).count().agg(F.max("count")).first()[0] or 0) > group_rows:
        return _allocated_apart(items, batch, order, weight, cost)
    run = Window.partitionBy(*batch).orderBy(*[F.desc(c) for c in order])
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    over = lambda c: c.over(whole)
    rows = items.repartition(*batch).withColumn("_w", F.coalesce(F.col(weight).cast("double"), F.lit(0.0)))
    rows = rows.withColumns(exact.digits(F.col("_w"), "_w")).withColumns({"_k": F.row_number().over(run), "_n": over(F.count("*")), "_least": over(F.min("_w")), **exact.added("_w", over)})
    positive = F.col("_least") > 0
    own = F.col(cost) * F.when(positive, F.col("_w")).otherwise(F.lit(1.0)) / F.when(positive, exact.told("_w")).otherwise(F.col("_n").cast("double"))
    rows = rows.select(*items.columns, (F.col("_k") == 1).alias("_end"), own.alias("_share"), (~positive | exact.told("_w").isNotNull()).alias("_sure"))
    rows = rows.withColumns(exact.digits(F.when(F.col("_end"), 0.0).otherwise(F.col("_share")), "_s")).withColumns(exact.added("_s", over))
    share = F.when(F.col("_end"), F.col(cost) - exact.told("_s")).otherwise(F.col("_share"))
    sure = F.col("_sure") & exact.told("_s").isNotNull()  # the same for all of a batch
    shared = as_table(rows.select(*items.columns, share.alias("share"), sure.alias("_sure")), "shares")
    unsure = shared.where("not _sure").select(*batch).distinct()
    done = shared.where("_sure").drop("_sure")
    if unsure.isEmpty():
        return done
    return done.unionByName(_allocated_apart(_within(items, unsure, batch), batch, order, weight, cost))


def _within(df: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """Rows whose ``by`` stands among the keys, null with null."""
    return df.alias("l").join(keys.alias("r"), scans.same("l", "r", by), "left_semi")


def _allocated_apart(items: DataFrame, batch: list[str], order: list[str], weight: str, cost: str) -> DataFrame:
    """:func:`allocate` for batches of any size and any numbers."""
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    about = items.groupBy(*batch).agg(F.min(w).alias("_least"), F.count("*").cast("double").alias("_n"), F.max(F.struct(*order)).alias("_last"))
    about = exact.joined(about, batch, exact.exact_sums(items, batch, {"_weights": w}))
    part = exact.joined(items, batch, about)
    positive = F.col("_least") > 0
    own = F.col(cost) * F.when(positive, w).otherwise(F.lit(1.0)) / F.when(positive, F.col("_weights")).otherwise(F.col("_n"))
    part = as_table(part.withColumns({"_share": own, "_end": F.struct(*order).eqNullSafe(F.col("_last"))}), "shares")
    others = exact.exact_sums(part.where("not _end"), batch, {"_others": F.col("_share")})
    left = F.col(cost) - F.coalesce(F.col("_others"), F.lit(0.0))
    whole = exact.joined(part, batch, others).withColumn("share", F.when(F.col("_end"), left).otherwise(F.col("_share")))
    return whole.drop("_least", "_n", "_last", "_weights", "_share", "_end", "_others")


def ulp(value: Column) -> Column:
    """One unit in the last place of a double."""
    size = F.greatest(F.abs(value), F.lit(2.0**-1022))
    step = F.pow(F.lit(2.0), F.floor(F.log2(size)))
    step = F.when(step > size, step / 2).when(step * 2 <= size, step * 2).otherwise(step)  # the logarithm may be off by one
    return step * F.lit(2.0**-52)


def ledger_violations(shares: DataFrame, batch: list[str], share: str, cost: str, members: DataFrame | None = None, item: str | None = None) -> DataFrame:
    """Batches whose ledger is wrong: rule (receipts_differ, negative_share, total_differs, members_differ) and batch.

    The shares' exact sum may differ from the receipt by one unit in the last place of the larger, however many they are.
    """
    g = shares.withColumns(exact.digits(F.col(share), "_s")).groupBy(*batch).agg(F.min(cost).alias("_lo"), F.max(cost).alias("_hi"), F.min(share).alias("_least"), *(c.alias(k) for k, c in exact.added("_s").items()))
    g = as_table(g.select(*batch, "_lo", "_hi", "_least", exact.told("_s").alias("_sum")), "ledger")
    unsure = g.where("_sum is null").drop("_sum")
    if not unsure.isEmpty():
        sums = exact.exact_sums(_within(shares, unsure.select(*batch), batch), batch, {"_sum": F.col(share)})
        g = g.where("_sum is not null").unionByName(exact.joined(unsure, batch, sums))
    near = F.greatest(ulp(F.col("_sum")), ulp(F.col("_hi")))
    rules = {"receipts_differ": F.col("_lo") != F.col("_hi"), "negative_share": F.col("_least") < -near, "total_differs": F.abs(F.col("_sum") - F.col("_hi")) > near}
    out = g.select(*batch, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]))).alias("rule"))
    if members is not None and item is not None:
        keys = [*batch, item]
        counted = shares.select(*keys).withColumn("_n", F.lit(1)).union(members.select(*keys).withColumn("_n", F.lit(-1)))
        odd = counted.groupBy(*keys).agg(F.sum("_n").alias("_n")).where("_n <> 0")
        out = out.union(odd.select(*batch).distinct().withColumn("rule", F.lit("members_differ")))
    return out


def budget_reserved(df: DataFrame, by: list[str], order: list[str], cost: str, budget: float) -> DataFrame:
    """Running cost within ``by``; adds spent (this row included) and within_budget."""
    return scans.scanned(df, by, order, sums={"spent": F.col(cost)}).withColumn("within_budget", F.col("spent") <= budget)


def attempt_totals(items: DataFrame, batch: str, tokens: str, receipt: str, partitioned: str) -> DataFrame:
    """Tokens of a batch's attempts: known, total_tokens, total_source.

    Item tokens are summed if all are known; else the batch's receipt stands for them, unless the batch was split over exports
    (``partitioned``), whose receipt covers other rows too.  A receipt below what is known is inconsistent (null total).
    """
    g = items.groupBy(batch).agg(F.coalesce(F.sum(tokens), F.lit(0)).alias("known"), F.bool_and(F.col(tokens).isNotNull()).alias("_all"), F.max(receipt).alias("_receipt"), F.bool_or(partitioned).alias("_split"))
    source = F.when(F.col("_all"), "items").when(F.col("_split") | F.col("_receipt").isNull(), "unknown").when(F.col("_receipt") < F.col("known"), "inconsistent").otherwise("receipt")
    total = F.when(source == "items", F.col("known")).when(source == "receipt", F.col("_receipt"))
    return g.select(batch, "known", total.alias("total_tokens"), source.alias("total_source"))


def invalid_truncations(df: DataFrame, finish: str, valid: str) -> DataFrame:
    """Completed rows that stopped at the token limit without a valid answer."""
    return df.where((F.col(finish) == "length") & ~F.coalesce(F.col(valid), F.lit(False)))


def distinct_runtime(df: DataFrame, by: list[str], file: str, seconds: str) -> DataFrame:
    """Runtime by mode, each file counted once with its least seconds: n_files, runtime (null if a file's is unknown)."""
    each = df.groupBy(*by, file).agg(F.min(seconds).alias("_s"))
    return each.groupBy(*by).agg(F.count("*").alias("n_files"), complete_sum(F.col("_s")).alias("runtime"))
