"""Window forms that Spark's SQL lacks."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.operators.ranges import numbered, same


def qualify(df: DataFrame, condition: Column) -> DataFrame:
    """Rows whose window condition holds, without keeping it."""
    return df.withColumn("_keep", condition).where("_keep").drop("_keep")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark cuts groups to k before the shuffle."""
    return qualify(df, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) <= k)


def ranked(df: DataFrame, by: list[str], order: str, coarse: Column, ties: list[str] | None = None, tiles: int | None = None) -> DataFrame:
    """df with rank, dense_rank, row_number, percent_rank, cume_dist and, with `tiles`, ntile, for few keys with many rows.

    coarse is a function of `order` that never falls, such as its month: a key's rows are spread over its
    values and ranked there; the counts of earlier values, a row for each, are added. Rows of equal order
    are numbered by `ties`.
    """
    rows = df.withColumn("_coarse", coarse)
    counts = rows.groupBy(*by, "_coarse").agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(order).alias("_d"))
    if df.schema[order].nullable:
        # Nulls are one value of their own, which a distinct count leaves out.
        counts = rows.groupBy(*by, "_coarse").agg(F.count(F.lit(1)).alias("_n"), (F.count_distinct(order) + F.max(F.col(order).isNull().cast("int"))).alias("_d"))
    key = Window.partitionBy(*by)
    counts = counts.withColumns({
        "_before": F.sum("_n").over(key.orderBy("_coarse")) - F.col("_n"), "_kinds": F.sum("_d").over(key.orderBy("_coarse")) - F.col("_d"), "_all": F.sum("_n").over(key),
    }).drop("_n", "_d")
    part = Window.partitionBy(*by, "_coarse")
    peers = part.orderBy(order)
    rows = rows.withColumns({
        "rank": F.rank().over(peers), "dense_rank": F.dense_rank().over(peers), "cume_dist": F.count(F.lit(1)).over(peers.rangeBetween(Window.unboundedPreceding, 0)),
        "row_number": F.row_number().over(part.orderBy(order, *(ties or []))),
    })
    same = [F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")) for c in (*by, "_coarse")]
    rows = rows.alias("_l").join(counts.alias("_r"), functools.reduce(lambda a, b: a & b, same)).select("_l.*", "_r._before", "_r._kinds", "_r._all")
    rows = rows.withColumns({c: (F.col(c) + F.col("_before")) for c in ("rank", "row_number", "cume_dist")}).withColumn("dense_rank", F.col("dense_rank") + F.col("_kinds"))
    rows = rows.withColumns({
        "percent_rank": F.when(F.col("_all") > 1, (F.col("rank") - 1) / (F.col("_all") - 1)).otherwise(0.0), "cume_dist": F.col("cume_dist") / F.col("_all"),
    })
    if tiles:
        # The first n % tiles tiles have a row more.
        n, place = F.col("_all"), F.col("row_number")
        small, more = F.floor(n / tiles), n % tiles
        cut = more * (small + 1)
        rows = rows.withColumn("ntile", F.when(place <= cut, F.ceil(place / (small + 1))).otherwise(more + F.ceil((place - cut) / F.greatest(small, F.lit(1)))).cast("int"))
    return rows.drop("_coarse", "_before", "_kinds", "_all")


def groups_frame(df: DataFrame, by: list[str], order: str, before: int, after: int, aggregates: dict[str, Column], coarse: Column | None = None, spread: int = 64) -> DataFrame:
    """Aggregates over the peers of `before` order values back to `after` forward: a GROUPS frame.

    With `coarse` (see ranked), a key's rows are spread over runs of `spread` order values, each with the rows
    around it that its frames reach, so that a key needn't fit in a task.
    """
    if coarse is None:
        rows = df.withColumn("_rank", F.dense_rank().over(Window.partitionBy(*by).orderBy(order)))
        rows = rows.withColumns({"_run": F.lit(0).cast("long"), "_of": F.lit(0).cast("long")})
    else:
        places = ranked(df, by, order, coarse).drop("rank", "row_number", "percent_rank", "cume_dist").withColumnRenamed("dense_rank", "_rank")
        run = lambda rank: F.floor(rank / spread)
        reach = F.sequence(run(F.col("_rank") - after), run(F.col("_rank") + before))
        rows = places.withColumns({"_of": run(F.col("_rank")), "_run": F.explode(reach)})
    frame = Window.partitionBy(*by, "_run").orderBy("_rank").rangeBetween(-before, after)
    return rows.withColumns({name: c.over(frame) for name, c in aggregates.items()}).where("_run = _of").drop("_rank", "_run", "_of")


#: What a frame leaves out, of the row's own peers (rows of equal order).
EXCLUDED = ("no others", "current row", "group", "ties")


def frame_excluding(df: DataFrame, by: list[str], order: str, value: str, before: int, after: int, exclude: str, names: tuple[str, str, str, str], spread: int = 64) -> DataFrame:
    """df with the count, sum, least and largest of `value` (under these names) over a GROUPS frame with EXCLUDE.

    The frame goes from `before` order values back to `after` forward, less what is excluded: the row, its peers and it,
    or its peers alone. Peers are aggregated first, which combines in the tasks: the frame before the row's peers and
    that after them are windows over one row for each order value, in runs of `spread` values with the values around
    that their frames reach, so that a hot key is split. A row joins its peers' row and adds of them what stays: for
    the extremes without the row itself, the second least and largest if it alone has the first. Nulls aren't counted;
    without any value the sum and extremes are null.
    """
    if exclude not in EXCLUDED:
        raise ValueError(f"exclude must be one of {EXCLUDED}")
    peers = [*by, order]
    v = F.col(f"`{value}`")
    each = df.groupBy(*peers, v.alias("_v")).agg(F.count(F.lit(1)).alias("_times"))
    groups = each.groupBy(*peers).agg(
        F.coalesce(F.sum(F.when(F.col("_v").isNotNull(), F.col("_times"))), F.lit(0)).alias("_c"), F.sum(F.col("_v") * F.col("_times")).alias("_s"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
        F.min_by("_times", "_v").alias("_lo_times"), F.max_by("_times", "_v").alias("_hi_times"),
    )
    if exclude == "current row":
        extremes = each.alias("_l").join(groups.alias("_r"), same("_l", "_r", peers)).select(*[F.col(f"_l.`{c}`") for c in peers], "_l._v", "_r._lo", "_r._hi")
        second = extremes.groupBy(*peers).agg(F.min(F.when(F.col("_v") > F.col("_lo"), F.col("_v"))).alias("_lo2"), F.max(F.when(F.col("_v") < F.col("_hi"), F.col("_v"))).alias("_hi2"))
        groups = groups.alias("_l").join(second.alias("_r"), same("_l", "_r", peers)).select("_l.*", "_r._lo2", "_r._hi2")
    placed = numbered(groups, by, [order])
    run = lambda at: F.floor(at / spread)
    placed = placed.withColumns({"_of": run(F.col("_at")), "_run": F.explode(F.sequence(run(F.col("_at") - after), run(F.col("_at") + before)))})
    frame = Window.partitionBy(*by, "_run").orderBy("_at")
    sides = {"_b": frame.rangeBetween(-before, -1) if before else None, "_a": frame.rangeBetween(1, after) if after else None}
    whole = {}
    for side, window in sides.items():
        for what, of in (("_c", F.sum), ("_s", F.sum), ("_lo", F.min), ("_hi", F.max)):
            whole[side + what] = of(what).over(window) if window is not None else F.lit(None).cast(groups.schema[what].dataType)
    placed = placed.withColumns(whole).where("_run = _of").drop("_run", "_of", "_at", "_n")
    rows = df.alias("_l").join(placed.alias("_r"), same("_l", "_r", peers)).select("_l.*", *[F.col(f"_r.{c}") for c in placed.columns if c not in by and c != order])
    own = v.isNotNull().cast("long")
    kept = {
        "no others": (F.col("_c"), F.col("_s"), F.col("_lo"), F.col("_hi")),
        "group": (F.lit(0).cast("long"), F.lit(None), F.lit(None), F.lit(None)),
        "ties": (own, v, v, v),
        "current row": () if exclude != "current row" else (
            F.col("_c") - own, F.when(F.col("_c") > own, F.col("_s") - F.coalesce(v, F.lit(0))),
            F.when((v == F.col("_lo")) & (F.col("_lo_times") == 1), F.col("_lo2")).otherwise(F.col("_lo")), F.when((v == F.col("_hi")) & (F.col("_hi_times") == 1), F.col("_hi2")).otherwise(F.col("_hi")),
        ),
    }[exclude]
    zero = lambda *cs: [F.coalesce(c, F.lit(0)) for c in cs]
    n = functools.reduce(lambda a, b: a + b, zero(F.col("_b_c"), F.col("_a_c"), kept[0]))
    total = functools.reduce(lambda a, b: a + b, zero(F.col("_b_s"), F.col("_a_s"), kept[1]))
    made = (n, F.when(n > 0, total), F.least(F.col("_b_lo"), F.col("_a_lo"), kept[2]), F.greatest(F.col("_b_hi"), F.col("_a_hi"), kept[3]))
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], *[c.alias(name) for c, name in zip(made, names)])
