"""Mixing sources to target weights by entropy balancing, in DataFrame and SQL functions only.

Every document gets a rate (how often the mix takes it) close to 1 under relative entropy, such that each
source's expected words meet its target. The convex dual has one multiplier a source, and the rate is the
exponential tilt exp(multiplier * size / mean size), clipped to the limit of 2 that its bound constraint sets.
Newton steps (with a bisection bracket) solve all duals at once over the histogram of sizes, one small
aggregation a step; a source's rows never meet in one task. Rates become whole copies by systematic rounding
along the sizes, and a last pass moves single copies to bring each source within about its smallest document of
the target. All is a function of the rows, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace
from .words import WORD

LIMIT = 2
STEPS = 60
SALTS = 64


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5) -> DataFrame:
    """(source, source_size, target): weights in code point order, null last; targets stop at LIMIT times the size."""
    by_name = Window.orderBy("source")
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    k = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    table = table.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), k.cast("int") + 1))
    table = table.withColumn("most", LIMIT * F.col("source_size").cast("double"))
    # Fill by weight: sources stop in the order of most / weight; the level is where the rest is shared.
    whole = Window.partitionBy()
    order = Window.orderBy(F.col("most") / F.col("weight"), "source").rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumn("total", share * F.sum("source_size").over(whole).cast("double"))
    table = table.withColumn("stopped", F.coalesce(F.sum("most").over(order), F.lit(0.0)))
    table = table.withColumn("free", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(order), F.lit(0.0)))
    level = (F.col("total") - F.col("stopped")) / F.col("free")
    # the first source in that order that its share at this level doesn't fill sets the level for all
    table = table.withColumn("here", level).withColumn("place", F.row_number().over(Window.orderBy(F.col("most") / F.col("weight"), "source")))
    table = table.withColumn("level", F.min_by(F.when(F.col("most") > F.col("here") * F.col("weight"), F.col("here")), F.when(F.col("most") > F.col("here") * F.col("weight"), F.col("place"))).over(whole))
    return table.select("source", "source_size", F.coalesce(F.least("most", F.col("level") * F.col("weight")), "most").alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, rate, copies.

    size counts the words of the text (null: 0), taken is copies * size, copies is 0, 1 or 2.

    Edge cases: a null source is a source of its own, last in order; documents without words get rate 1 and one
    copy; a source without words has target 0; equal documents are told apart by doc_id, equal rows share their
    fate in total; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "mix")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    # A key without null that sorts like the source: null is last.
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("~"))
    sized = ws.save(docs.select("doc_id", key.alias("source"), size.alias("size")), "sized")
    # Small from here on: one row for each source and size (salted by document, so that ranks need no single task).
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    tally = ws.save(sized.groupBy("source", "size", salt.alias("salt")).agg(F.count("*").alias("n")), "tally")
    hist = tally.groupBy("source", "size").agg(F.sum("n").alias("n"))
    goal = ws.save(targets(hist.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share), "targets")
    mean = hist.where("size > 0").groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    hist = ws.save(hist.where("size > 0").join(mean, "source").select("source", "size", "n", (F.col("size") / F.col("mean")).alias("x")), "histogram")
    spread = goal.join(hist.groupBy("source").agg(F.min("x").alias("low")), "source")
    # A bracket: at this much below zero nothing is left; at this much above, all rates reach the limit.
    state = spread.select(
        "source", "source_size", "target",
        F.lit(0.0).alias("multiplier"), (F.lit(-80.0) / F.col("low")).alias("least"), (F.log(F.lit(float(LIMIT))) / F.col("low")).alias("most"), F.lit(False).alias("met"),
    )
    state = ws.save(state, "dual-0")
    for step in range(1, STEPS + 1):
        rate = F.least(F.exp(F.col("multiplier") * F.col("x")), F.lit(float(LIMIT)))
        words = F.col("size") * F.col("n") * F.col("rate")
        both = hist.join(state.where("not met").select("source", "multiplier"), "source").withColumn("rate", rate)
        sums = both.groupBy("source").agg(F.sum(words).alias("words"), F.sum(F.when(F.col("rate") < LIMIT, words * F.col("x")).otherwise(0.0)).alias("slope"))
        state = state.join(sums, "source", "left")
        gap = F.col("words") - F.col("target")
        state = state.withColumn("met", F.col("met") | (F.col("target") <= 0) | (F.abs(gap) <= 1e-9 * F.col("source_size") + 1e-6) | (F.col("target") >= LIMIT * F.col("source_size")))
        state = state.withColumn("least", F.when(gap < 0, F.col("multiplier")).otherwise(F.col("least"))).withColumn("most", F.when(gap > 0, F.col("multiplier")).otherwise(F.col("most")))
        newton = F.col("multiplier") - gap / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > F.col("least")) & (newton < F.col("most"))
        moved = F.when(F.col("target") >= LIMIT * F.col("source_size"), F.col("most")).when(F.col("met"), F.col("multiplier")).otherwise(F.when(inside, newton).otherwise((F.col("least") + F.col("most")) / 2))
        state = ws.save(state.withColumn("multiplier", moved).select("source", "source_size", "target", "multiplier", "least", "most", "met"), f"dual-{step}")
        if not state.where("not met").limit(1).count():
            break
    dual = state.select("source", "multiplier", "target")
    rate = F.when(F.col("target") <= 0, 0.0).otherwise(F.least(F.exp(F.col("multiplier") * F.col("x")), F.lit(float(LIMIT))))
    classes = hist.join(dual, "source").select("source", "size", "n", "target", rate.alias("rate"))
    # Systematic rounding: copies of a class are the whole steps its summed rates pass, from the largest size down.
    before = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    reach = F.floor(F.sum(F.col("rate") * F.col("n")).over(before) + 0.5)
    classes = classes.withColumn("reach", reach)
    step_of = F.col("reach") - F.coalesce(F.lag("reach").over(Window.partitionBy("source").orderBy(F.desc("size"))), F.lit(0))
    classes = ws.save(classes.select("source", "size", "n", "rate", "target", F.least(step_of, LIMIT * F.col("n")).cast("long").alias("copies")), "copies-0")
    # Repair: the largest size not above what is missing (or too much) gives or takes as many copies as it can.
    for k in range(1, 9):
        own = Window.partitionBy("source")
        off = classes.withColumn("off", F.col("target") - F.sum(F.col("copies") * F.col("size")).over(own))
        room = F.when(F.col("off") > 0, LIMIT * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
        fits = (room > 0) & (F.col("size") <= F.abs("off") + F.col("size") / 2)
        pick = off.withColumn("room", room).withColumn("best", F.max(F.when(fits, F.col("size"))).over(own))
        many = F.least(F.col("room"), F.greatest(F.lit(1), F.floor(F.abs("off") / F.col("size"))))
        moved = F.when(F.col("size") == F.col("best"), F.signum("off") * many).otherwise(0.0).cast("long")
        now = pick.select("source", "size", "n", "rate", "target", (F.col("copies") + moved).alias("copies"), (moved != 0).alias("moved"))
        now = ws.save(now, f"copies-{k}")
        classes = now.drop("moved")
        if not now.where("moved").limit(1).count():
            break
    # A class's copies go to its documents by rank: salts are summed, then documents ranked inside their salt.
    first = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = tally.withColumn("base", F.coalesce(F.sum("n").over(first), F.lit(0)))
    share_of = classes.select("source", "size", F.col("n").alias("class_n"), "rate", "copies")
    bases = bases.drop("n").join(share_of, ["source", "size"], "left").join(goal, "source")
    ranked = sized.withColumn("salt", salt)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id")) - 1)
    got = ranked.join(bases, ["source", "size", "salt"]).withColumn("rank", F.col("base") + F.col("rank"))
    each = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor(F.col("copies") / F.col("class_n")) + (F.col("rank") < F.pmod("copies", "class_n")).cast("int")).cast("int")
    return got.select("doc_id", "size", "source_size", "target", (each * F.col("size")).cast("long").alias("taken"), F.coalesce("rate", F.lit(1.0)).alias("rate"), each.alias("copies"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5) -> DataFrame:
    """The documents of the mix: each as often as it has copies, with its own columns.

    Rows that repeat a doc_id share the copies of that id among them, the earlier texts first; so do rows with a null
    doc_id. Documents without words come once; an empty table gives no rows; columns of any other names are kept.
    """
    ws = Workspace(docs.sparkSession, "mixed")
    plan = ws.save(mix(docs, weights, share).select("doc_id", "copies"), "plan")
    total = plan.groupBy("doc_id").agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows"))
    repeated = total.where("__rows > 1").limit(1).count() > 0
    named = total.where("__copies > 0").select(F.col("doc_id").alias("__doc"), "__copies", "__rows")
    # merged, not broadcast while small: the plan is the same at every size
    got = docs.join(named.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__doc")))
    times = F.col("__copies")
    if repeated:
        place = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
        got = got.withColumn("__place", place)
        times = F.expr("__copies div __rows + cast(__place <= __copies % __rows as int)")
    each = got.withColumn("__times", times.cast("int")).where("__times > 0")
    return each.withColumn("__i", F.explode(F.expr("sequence(1, __times)"))).select(*docs.columns)
