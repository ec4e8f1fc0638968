"""Mixing sources to target weights: entropy balancing, in DataFrame operations only.

Among all rates of documents that give each source its target number of words, entropy balancing takes those closest to 1
in relative entropy, ``sum(r * log(r) - r + 1)``, with no rate above ``most``. Its convex dual has one multiplier a
source, and the rates are the exponential tilt ``r = min(most, exp(multiplier * size))``: a source that must grow
takes more of its long documents, one that must shrink more of its short ones. The gradient and the Hessian of the dual are sums over cells
of equal source and size; each Newton step takes them for all sources at once, in one aggregation.

Rates become copies by systematic rounding. Within a source, sizes go from large to small, and the fractions of copies
add up along them; a size gets one more copy each time the sum passes a half. What is then missing or in excess in
words is made good with smaller documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscope.llm.common import aside, drop, kept, n_words, table

#: Newton's steps end when the words of every source are this close to its target, as a share of it.
CLOSE = 1e-13
STEPS = 80
#: Rates are whole multiples of one millionth, so sums of them are exact in any order.
UNIT = 1_000_000
#: Multipliers, for the source's mean size by words, lie between these.
BOUND = 1e5


def targets(sources: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """Adds ``target`` to (``_src``, ``words``): the share of all words by weight, at most ``most`` times the source's
    words, the excess shared again by weight among the others until none is above.

    Sources in order of ``_src`` take the weights in turn. The end of the resharing is a water level: with ratios
    ``most * words / weight`` in ascending order, sources below the level are full and the others get level * weight.
    """
    order = Window.orderBy("_src")
    rank = (F.row_number().over(order) - 1) % len(weights)
    ranked = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), rank.cast("int") + 1)).withColumn("cap", F.col("words") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "_src")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    level = (F.sum("words").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    leveled = ranked.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    final = F.min(F.when(F.col("open"), F.struct("ratio", "_src", "level"))).over(all_rows)
    return leveled.withColumn("ratio", F.col("cap") / F.col("weight")).withColumn("final", final["level"]).withColumn("target", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final") * F.col("weight")))).select("_src", "words", "target")


def newton_sums(cells: DataFrame, state: DataFrame, most: float) -> DataFrame:
    """``state`` (one row a source) with ``got``, the words at its multiplier ``x``, and ``slope``, their derivative by ``x``."""
    tilt = F.exp(F.least(F.col("x") * F.col("size") / F.col("scale"), F.lit(700.0)))
    words = (F.col("n") * F.col("size")).cast("double")
    exact = lambda v: F.sum(v.cast("decimal(38,12)")).cast("double")  # noqa: E731  the same in any order
    open_ = tilt < most
    sums = cells.where("size > 0").join(state.select("_src", "x", "scale"), "_src").groupBy("_src").agg(
        exact(words * F.least(tilt, F.lit(float(most)))).alias("got"),
        exact(F.when(open_, words * tilt * F.col("size") / F.col("scale")).otherwise(F.lit(0.0))).alias("slope"),
    )
    return state.join(sums, "_src")


def tilted(cells: DataFrame, sources: DataFrame, most: float) -> DataFrame:
    """From (``_src``, ``size``, ``n``) and (``_src``, ``words``, ``target``) to multipliers: ``_src``, ``x``, ``scale``,
    and ``full`` where every document comes ``most`` times. Sources without words or target have none.

    The gradient is ``got - target``. Newton's steps are taken on the logarithm of ``got``, and those that leave the
    interval known to hold the root halve it instead (or double the multiplier, where nothing bounds it yet), so every source
    converges from any start.
    """
    spark = cells.sparkSession
    scale = cells.where("size > 0").groupBy("_src").agg((F.sum((F.col("n") * F.col("size") * F.col("size")).cast("double")) / F.sum(F.col("n") * F.col("size"))).alias("scale"))
    begun = sources.where("words > 0 AND target > 0").join(scale, "_src")
    full = F.col("target") >= F.col("words") * (float(most) * (1 - 1e-12))
    begun = begun.select("_src", "target", "scale", full.alias("full"), F.log(F.col("target") / F.col("words")).alias("x"), F.lit(-BOUND).alias("lo"), F.lit(BOUND).alias("hi"))
    state, path = kept(begun, "mix-newton")
    for _ in range(STEPS):
        at = newton_sums(cells, state.where("NOT full"), most)
        lo = F.when(F.col("got") < F.col("target"), F.col("x")).otherwise(F.col("lo"))
        hi = F.when(F.col("got") < F.col("target"), F.col("hi")).otherwise(F.col("x"))
        far = F.abs(F.col("got") - F.col("target")) / F.col("target")
        step = F.col("x") - F.log(F.col("got") / F.col("target")) * F.try_divide("got", "slope")
        inside = (F.col("got") > 0) & (F.col("slope") > 0) & (step > F.col("lo")) & (step < F.col("hi"))
        wide = F.abs("x") * 2 + 1
        half = F.when(F.col("hi") == BOUND, F.least(F.lit(BOUND), wide)).when(F.col("lo") == -BOUND, F.greatest(F.lit(-BOUND), -wide)).otherwise((F.col("lo") + F.col("hi")) / 2)
        at = at.withColumns({"lo": lo, "hi": hi, "far": far}).withColumn("next", F.coalesce(F.when(inside, step), half))
        still = (F.col("far") > CLOSE) & (F.col("next") != F.col("x"))
        moved = at.select("_src", "target", "scale", "full", F.when(still, F.col("next")).otherwise(F.col("x")).alias("x"), "lo", "hi", still.alias("moves"))
        after, new_path = kept(moved.unionByName(state.where("full").select("*", F.lit(False).alias("moves")).select(*moved.columns)), "mix-newton")
        drop(spark, path)
        state, path = after.drop("moves"), new_path
        if after.where("moves").limit(1).count() == 0:
            break
    return state.select("_src", "x", "scale", "full")


def with_rates(cells: DataFrame, sources: DataFrame, multipliers: DataFrame, most: float) -> DataFrame:
    """Adds ``target`` and ``rate``, in millionths, to cells. Texts without words stay as they are: rate 1."""
    tilt = F.least(F.exp(F.least(F.col("x") * F.col("size") / F.col("scale"), F.lit(700.0))), F.lit(float(most)))
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("full"), float(most)).otherwise(F.coalesce(tilt, F.lit(0.0)))
    return cells.join(sources.select("_src", "target"), "_src").join(multipliers, "_src", "left").select("_src", "size", "n", "target", F.floor(rate * UNIT + 0.5).alias("rate"))


def extra_copies(cells: DataFrame, most: int, rounds: int = 4) -> DataFrame:
    """From (``_src``, ``size``, ``n``, ``target``, ``rate``), one row a size of a source, to ``base``, the copies of
    every document, and ``extra``, how many documents get one more. ``rate`` is in millionths.

    A round goes through the sizes no larger than what is missing (or in excess), from large to small, and adds (or takes away) copies while
    they fit; what it leaves is less than one document of the size it ended at, and the next round takes smaller ones.
    """
    down = Window.partitionBy("_src").orderBy(F.desc("size"))
    upto, before, whole = down.rowsBetween(Window.unboundedPreceding, 0), down.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("_src")
    cells = cells.withColumn("passed", F.sum(F.col("n") * (F.col("rate") % UNIT)).over(upto)).withColumn("passed", F.expr(f"(passed + {UNIT // 2}) div {UNIT}"))
    more = F.least(F.col("n"), F.col("passed") - F.coalesce(F.lag("passed").over(down), F.lit(0)))
    cells = cells.withColumn("all", F.col("n") * F.expr(f"rate div {UNIT}") + more)
    for _ in range(rounds):
        cells = cells.withColumn("lack", F.round(F.col("target")).cast("long") - F.sum(F.col("all") * F.col("size")).over(whole))
        room = F.when(F.col("lack") > 0, F.col("n") * most - F.col("all")).otherwise(F.col("all"))
        cells = cells.withColumn("room", F.when((F.col("size") > 0) & (F.col("size") <= F.abs("lack")), room).otherwise(F.lit(0)))
        rest = F.abs("lack") - F.coalesce(F.sum(F.col("room") * F.col("size")).over(before), F.lit(0))
        step = F.greatest(F.lit(0), F.least(F.col("room"), F.floor(rest / F.greatest(F.col("size"), F.lit(1)))))
        cells = cells.withColumn("all", F.col("all") + F.signum("lack").cast("long") * F.coalesce(step, F.lit(0)))
    return cells.select("_src", "size", "n", F.expr("`all` div n").alias("base"), F.expr("`all` % n").alias("extra"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, bins: int | None = None) -> DataFrame:
    """Adds ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (copies times size) to ``docs``
    (``doc_id``, ``text``, ``source`` and any others, which keep their values).

    Sources in code-point order, null last, weigh ``weights`` in turn and share the words of all documents;
    see ``targets``. Null and empty texts have size 0 and come once. Whole texts count, however long. Which documents of a size get the
    additional copy follows from a hash bin and the order of ids in it, so reruns agree; rows with equal ids and sizes may trade
    places. Empty tables give no rows. Columns of ``docs`` with the names added here are replaced.

    A source may hold any share of the rows: words are summed before rows move, documents are ranked within
    ``bins`` slices of a size of a source (by default one for each million rows, 64 at least), and windows by source run over one row
    for each distinct size.
    """
    added = ("size", "source_size", "target", "copies", "taken")
    docs, back = aside(docs.drop(*added), "_src", "_bin", "_base", "_more", "_rank")
    bins = bins or min(65_536, max(64, docs.count() // 1_000_000))
    src = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), F.col("source")))
    sized = docs.withColumns({"size": n_words(F.col("text")), "_src": src, "_bin": F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 4), 16, 10).cast("int") % bins})
    narrow = sized.select("_src", "size", "_bin")
    slices, _ = kept(narrow.groupBy("_src", "size", "_bin").agg(F.count("*").alias("k")), "mix-slices")
    cells, path = kept(slices.groupBy("_src", "size").agg(F.sum("k").alias("n")), "mix-cells")
    sources, _ = kept(targets(cells.groupBy("_src").agg(F.sum(F.col("n") * F.col("size")).alias("words")), weights, most), "mix-sources")
    rated = with_rates(cells, sources, tilted(cells, sources, most), most)
    copied, _ = kept(extra_copies(rated, most), "mix-copies")
    drop(docs.sparkSession, path)
    in_cell = Window.partitionBy("_src", "size").orderBy("_bin")
    slices = slices.join(copied, ["_src", "size"]).withColumn("upto", F.sum("k").over(in_cell.rowsBetween(Window.unboundedPreceding, 0)))
    share = lambda x: F.expr(f"({x}) * extra div n")
    slices = slices.withColumn("more", share("upto") - share("upto - k")).select("_src", "size", "_bin", F.col("base").alias("_base"), F.col("more").alias("_more"))
    rank = F.row_number().over(Window.partitionBy("_src", "size", "_bin").orderBy("doc_id"))
    copies = F.col("_base") + F.when(F.col("_rank") <= F.col("_more"), F.lit(1)).otherwise(F.lit(0))
    out = sized.withColumn("_rank", rank).join(slices, ["_src", "size", "_bin"]).join(sources.select("_src", F.col("words").alias("source_size"), "target"), "_src")
    out = out.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*back, *added)


def op4_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by weights 5, 2, 1; without their texts, which only the sizes need."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
