"""Mixing sources to target weights by entropy balancing.

The mix keeps each document at a rate as near to 1 as the token targets allow (least relative entropy).  The dual
is convex with one multiplier a source: rate = min(cap, exp(multiplier * size / mean size)).  Newton steps, kept
in a bracket, solve it over a table of counts per (source, size), which is all that the iterations read; sums are
of integers, so reruns agree to the last word whatever the order of rows.  Rates become copies by systematic
rounding in blocks of about ``block_docs`` documents, so a source of any size is spread over many tasks; the
words that rounding leaves over are taken from, or added to, the last copy of a few documents of each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import by_key, discard, read, stored, words

#: Rates are multiples of one millionth.
UNIT = 1_000_000


def _targets(sources: DataFrame, weights: list[float], cap: float) -> DataFrame:
    """Add ``target``: the water level that the caps leave, found by one sort of the sources."""
    n = len(weights)
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % n + 1).cast("int"))
    ranked = sources.withColumn("weight", pick).withColumn("ceil", cap * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("ceil") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("ceil").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    ranked = ranked.withColumn("level", level)
    free = F.when(F.col("ceil") / F.col("weight") >= F.col("level"), F.col("level"))
    ranked = ranked.withColumn("level", F.coalesce(F.max(free).over(whole), F.lit(float("inf"))))
    return ranked.withColumn("target", F.least("ceil", F.col("weight") * F.col("level"))).drop("ceil", "level", "weight")


def _rate(lam: Column, size: Column, mean: Column, cap: float) -> Column:
    """Rate in units: the exponential tilt, stopped at the cap."""
    tilt = F.exp(F.least(lam * size / mean, F.lit(50.0)))
    return F.round(F.least(F.lit(cap), tilt) * UNIT).cast("long")


def _solve(cells: DataFrame, state: DataFrame, cap: float, steps: int, tolerance: float) -> DataFrame:
    """Newton on the dual of each source; ``state`` gains ``lam``."""
    top = F.log(F.lit(cap)) * F.col("mean") / F.col("least_size")
    down = F.log(F.col("target") / F.col("source_size")) * F.col("mean") / F.col("least_size")
    up = F.col("target") >= F.col("source_size")
    state = state.withColumn("lam", F.lit(0.0)).withColumn("hi", F.when(up, top).otherwise(0.0)).withColumn("lo", F.when(up, 0.0).otherwise(down))
    state = stored(state.withColumn("open", F.col("least_size").isNotNull() & (F.col("target") > 0)), "mixing-dual")
    for _ in range(steps):
        if state.filter("open").isEmpty():
            break
        size = F.col("size").cast("double")
        rate = _rate(F.col("lam"), size, F.col("mean"), cap)
        words_ = (F.col("n") * F.col("size")).cast("decimal(20,0)") * rate.cast("decimal(10,0)")
        slope = F.when(rate < int(cap * UNIT), words_ * F.round(size / F.col("mean") * 1000).cast("decimal(8,0)")).otherwise(0)
        sums = (
            cells.join(state.filter("open").select("source_no", "lam", "mean"), "source_no")
            .groupBy("source_no")
            .agg((F.sum(words_).cast("double") / UNIT).alias("got"), (F.sum(slope).cast("double") / UNIT / 1000).alias("slope"))
        )
        s = state.join(sums, "source_no", "left")
        gap = F.col("got") - F.col("target")
        s = s.withColumn("hi", F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))).withColumn("lo", F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")))
        newton = F.col("lam") - gap / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > F.col("lo")) & (newton < F.col("hi"))
        # The end of the bracket is tried first: there all documents are at the cap.
        step = F.when(inside, newton).when((F.col("slope") <= 0) | (newton >= F.col("hi")) & (F.col("lam") == F.col("lo")), F.col("hi"))
        step = F.coalesce(step, (F.col("lo") + F.col("hi")) / 2)
        done = (F.abs(gap) <= F.greatest(F.lit(1.0), tolerance * F.col("target"))) | (F.col("hi") - F.col("lo") <= 1e-12)
        s = s.withColumn("lam", F.when(F.col("open") & ~done, step).otherwise(F.col("lam"))).withColumn("open", F.col("open") & ~done)
        before, state = state, stored(s.drop("got", "slope"), "mixing-dual")
        discard(before)
    else:
        if not state.filter("open").isEmpty():
            raise RuntimeError(f"the dual has not converged in {steps} steps; raise steps or tolerance")
    return state


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    cap: int = 3,
    block_docs: int = 2000,
    steps: int = 60,
    tolerance: float = 1e-5,
    key_col: str | None = None,
) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, rate, copies.

    ``weights`` repeat over the sources in code point order, a null source last; the mix is as large as the
    input.  A source's target stops at ``cap`` times its size and the excess goes to the others by weight.
    ``copies`` are the whole and begun copies taken; only the last one may be cut, to ``taken - (copies - 1) *
    size`` words.  Null and empty texts have size 0 and are never taken.  A row without an id, or repeating
    one, is a document of its own; texts spread such rows over the blocks, or ``key_col`` does, a number that is
    unique to the row.  An empty table gives an empty result; other columns are not returned, but for ``key_col``.
    Runs jobs when called, and raises RuntimeError if a source's dual has not converged in ``steps``.
    """
    key = ["key"] if key_col else []
    named = F.xxhash64("doc_id", "spread")
    named = F.when(F.col("doc_id").isNull(), F.xxhash64(*key)).otherwise(named) if key else named
    text = F.coalesce(F.col(text_col), F.lit(""))
    spread = F.xxhash64(text)
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.size(words(text)).cast("long").alias("size"), spread.alias("spread"), *([F.col(key_col).alias("key")] if key_col else []))
    sized = stored(sized, "mixing-sizes")
    cells = stored(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mixing-cells")
    sources = cells.groupBy("source").agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n_docs"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least_size")
    )
    numbered = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).alias("source_no")
    state = _targets(sources, list(weights), float(cap)).select("*", numbered, (F.col("source_size") / F.col("n_docs")).alias("mean"))
    state = stored(state, "mixing-sources")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    names = state.select("source", "source_no")
    numbered_cells = cells.join(names, same(cells, names)).select("source_no", "size", "n")
    solved = _solve(stored(numbered_cells, "mixing-cells"), state, float(cap), steps, tolerance)
    solved = solved.select(F.col("source").alias("_source"), "source_no", "source_size", "n_docs", "target", "mean", "lam")
    rated = sized.join(solved, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "spread", "size", "source_no", "source_size", "target",
        F.when(F.col("size") > 0, _rate(F.col("lam"), F.col("size").cast("double"), F.col("mean"), float(cap))).otherwise(0).alias("rate"),
        named.alias("h"),
        F.pmod(named, F.ceil(F.col("n_docs") / block_docs)).alias("block"),
        *key,
    )
    block = Window.partitionBy("source_no", "block")
    line = block.orderBy("size", "h", "doc_id", "spread", *key).rowsBetween(Window.unboundedPreceding, 0)
    part, half = F.col("rate") % UNIT, UNIT // 2
    ends = rated.withColumn("cum", F.sum(part).over(line))
    step = F.floor((F.col("cum") + half) / UNIT) - F.floor((F.col("cum") - part + half) / UNIT)
    copied = ends.withColumn("copies", F.when(F.col("size") > 0, F.floor(F.col("rate") / UNIT) + step).otherwise(0))
    copied = copied.withColumn("words", F.col("copies") * F.col("size"))
    due = F.round(F.sum(F.col("rate").cast("decimal(20,0)") * F.col("size")).over(block) / UNIT).cast("long")
    left = copied.withColumn("due", due - F.sum("words").over(block))
    room = F.when(F.col("due") > 0, cap * F.col("size") - F.col("words")).otherwise(F.col("words"))
    by_room = block.orderBy(F.col("room").desc(), "size", "h", "doc_id", "spread", *key).rowsBetween(Window.unboundedPreceding, -1)
    left = left.withColumn("room", room).withColumn("used", F.coalesce(F.sum("room").over(by_room), F.lit(0)))
    move = F.greatest(F.lit(0), F.least(F.col("room"), F.abs("due") - F.col("used"))) * F.signum(F.col("due").cast("double")).cast("long")
    taken = (F.col("words") + move).cast("long")
    return left.select(
        F.col("doc_id").alias(id_col), "size", "source_size", "target", taken.alias("taken"), (F.col("rate") / UNIT).alias("rate"),
        F.when(F.col("size") > 0, F.ceil(taken / F.col("size"))).otherwise(0).cast("long").alias("copies"),
        *([F.col("key").alias(key_col)] if key_col else []),
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: every document of ``docs`` repeated by its copies, all columns kept, the last copy cut.

    A cut copy keeps the first words with the white space between them.  Each row meets its own
    rate, also where it has no id or repeats one.
    """
    rows = by_key(docs, "mixing-rows", id_col)
    source_col = options.pop("source_col", "source")
    flat = rows.select("key", F.col("row")[id_col].alias("id"), F.col("row")[text_col].alias("text"), F.col("row")[source_col].alias("source"))
    plan = mix(flat, "id", "text", "source", key_col="key", **options).filter("copies > 0")
    plan = plan.select("key", F.col("size").alias("_size"), F.col("taken").alias("_taken"), F.col("copies").alias("_copies"))
    joined = rows.join(plan, "key")
    joined = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    words_, text = F.col("_taken") - (F.col("_copy") - 1) * F.col("_size"), F.col("row")[text_col]
    pieces = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    cut = F.when(words_ >= F.col("_size"), text).otherwise(F.array_join(F.slice(pieces, F.lit(1), words_.cast("int")), ""))
    return joined.select(*[(cut if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))
