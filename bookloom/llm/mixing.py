"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bookloom.llm.ordered import Ordered
from bookloom.session import cut_lineage

#: most copies of a document; also how far a source's target may exceed its size
CAP = 3
#: weights of the sources in code point order, repeating
WEIGHTS = (1, 2, 3)
#: inclusion odds of a certain document
CERTAIN = 1e9
#: a source that misses more than this share of its target takes one document too many where that brings it nearer
MISSED = 0.01
#: repeated rows that are too heavy for a stretch, sent to all tasks up to this number
SENT_GROUPS = 1_000_000

#: sources that miss too much of their target
MISSING = "_left > %s * target" % MISSED
#: no groups of rows that are exchanged
SWAP = "cast(array() as array<struct<q:double,size:bigint>>)"

WORD = r"[^\x20\x09-\x0D]+"


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """From (source, source_size) the `target` of each source. Sources by code point, null last, get the weights in turn
    and share the total size; a target stops at cap times its source's size and the excess is shared again by weight."""
    line = Ordered(sizes, [], [F.col("source").asc_nulls_last()]).add("_n", F.lit(1)).done()
    of = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("_n") - 1) % len(weights) + 1).cast("int"))
    line = cut_lineage(line.select("source", "source_size", of.cast("double").alias("weight")))
    most = F.col("source_size") * cap
    total = line.agg(F.sum("source_size")).first()[0] or 0
    share, capped = 0.0, -1
    while True:  # each round caps at least one source more; only three sums leave the cluster
        full = F.col("weight") * share >= most if capped >= 0 else F.lit(False)
        n, held, free = line.agg(F.sum(full.cast("long")), F.sum(F.when(full, most)),
                                 F.sum(F.when(~full, F.col("weight")))).first()
        if (n or 0) == capped or not free:
            break
        capped, share = n or 0, (total - (held or 0)) / free
    return line.withColumn("target", F.least(F.col("weight") * share, most.cast("double"))).drop("weight")


def breadth(size: Column) -> Column:
    """What a document counts for when the inclusion odds are dealt out: the root of its words, so that a long text is wanted more than a short
    one, but by far not in proportion, and a few long ones do not use up a source's words."""
    return F.greatest(F.floor(F.sqrt(size.cast("double")) * 1000), F.lit(1)).cast("long")


def inclusion(size: Column, level: Column) -> Column:
    """Probability that a document of this size gets one more copy; 1 for sizes up to a point that the source's level sets."""
    return F.least(level * breadth(size) / size, F.lit(1.0))


def odds(size: Column, level: Column) -> Column:
    """Inclusion odds; very high ones for certain documents, which therefore come first."""
    p = inclusion(size, level)
    return F.when(p < 1 - 1 / CERTAIN, p / (1 - p)).otherwise(F.lit(CERTAIN))


def levels(sizes: DataFrame, by: DataFrame) -> DataFrame:
    """(source, level): the level at which the expected words, the sum of inclusion probability times size, are the words wanted.

    sizes has (source, size, n), by the words wanted (_left). In order of size, all documents up to one are certain and the rest
    share what they leave in proportion to their breadth. Running sums over the different sizes tell which size that is: the last one
    up to which certain documents do not ask for too much.
    """
    rows = sizes.where("size > 0").select("source", "size", (F.col("size") * F.col("n")).alias("_w"), (breadth(F.col("size")) * F.col("n")).alias("_r"))
    line = Ordered(rows, ["source"], [F.col("size").asc()]).add("_ws", F.col("_w")).add("_rs", F.col("_r")).done()
    line = cut_lineage(line)
    whole = line.groupBy("source").agg(F.max("_rs").alias("_all"))
    wanted = by.select(F.col("source").alias("_s"), "_left").where("_left > 0").join(whole.withColumnRenamed("source", "_t"), _same("_s", "_t"))
    asked = F.col("_ws") + F.col("size") / breadth(F.col("size")) * (F.col("_all") - F.col("_rs"))
    sure = line.join(wanted.select("_s", "_left", "_all"), _same("source", "_s")).where(asked <= F.col("_left")) \
        .groupBy("_s").agg(F.max("_ws").alias("_ws"), F.max("_rs").alias("_rs"))
    found = wanted.join(sure.withColumnRenamed("_s", "_c"), _same("_s", "_c"), "left")
    rest = F.greatest(F.col("_all") - F.coalesce("_rs", F.lit(0)), F.lit(1))
    return cut_lineage(found.select(F.col("_s").alias("source"), ((F.col("_left") - F.coalesce("_ws", F.lit(0))) / rest).alias("level")))


def plan(docs: DataFrame, seed: str = "mix", **kw) -> tuple[DataFrame, DataFrame]:
    """One row per source: target, whole copies, the level of its inclusion odds and the accepted stretches of the sampling order; and the
    groups of repeated rows that are too heavy for the stretch they lie in.

    `docs` has source, size and the random number _u. With ratio r = target / source_size, floor(r) copies of each document are certain.
    For the words that are still wanted each document has an inclusion probability by its length (see `inclusion`), such that the
    expected words are the words wanted. Documents are ranked by their random odds u/(1-u) divided by their inclusion odds (Pareto order
    sampling), and taken in that order while their words fit the words that are still wanted (fixed size in words). What then remains
    is filled, in the same order, with later documents that still fit, until none does; earlier ones were too heavy for more than is
    left now. Each round of filling leaves fewer words than the document weighs that ended it, so there are at most as many rounds as
    different weights, and a handful in practice. Repeated rows are weighed together. If more than MISSED of the target is still
    missing, groups are exchanged or added (see `exchange`).
    """
    keys = cut_lineage(docs.groupBy("source", "_u", "size").agg(F.count(F.lit(1)).alias("_c")))
    sizes = keys.groupBy("source").agg(F.sum(F.col("size") * F.col("_c")).alias("source_size"))
    by = targets(sizes, **kw)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    by = by.withColumn("whole", F.floor(ratio).cast("int")) \
        .withColumn("_left", F.col("target") - F.col("whole") * F.col("source_size"))
    by = cut_lineage(by)
    level = levels(keys.groupBy("source", "size").agg(F.sum("_c").alias("n")), by).withColumnRenamed("source", "_l")
    by = by.join(level, _same("source", "_l"), "left").drop("_l").withColumn("level", F.coalesce("level", F.lit(0.0))) \
        .withColumn("_from", F.lit(-1.0)).withColumn("taken", F.array().cast("array<struct<above:double,upto:double,fit:double>>"))
    by = cut_lineage(by)
    left = keys.where("size > 0").select(F.col("source").alias("_s"), "_u", "size", "_c", (F.col("size") * F.col("_c")).alias("_w"))

    def beside(*columns: str) -> DataFrame:
        return left.join(by.where("level > 0").select("source", "level", *columns), _same("_s", "source")) \
            .withColumn("_q", pareto(F.col("_u"), odds(F.col("size"), F.col("level"))))

    while True:  # what is left shrinks below the weight of each document that did not fit
        cand = beside("_left", "_from").where((F.col("_w") <= F.col("_left")) & (F.col("_q") > F.col("_from"))) \
            .select("_s", "_q", "_left", "_w")
        line = Ordered(cand, ["_s"], [F.col("_q").asc()]).add("_sum", F.col("_w")).done()
        end = cut_lineage(line.where(F.col("_sum") <= F.col("_left")).groupBy("_s")
                          .agg(F.max("_q").alias("_upto"), F.max("_sum").alias("_got")))
        if end.isEmpty():
            break
        took = F.col("_upto").isNotNull()
        step = F.struct(F.col("_from").alias("above"), F.col("_upto").alias("upto"), F.col("_left").alias("fit"))
        by = cut_lineage(by.join(end, _same("source", "_s"), "left").select(
            "source", "source_size", "target", "whole", "level",
            (F.col("_left") - F.coalesce("_got", F.lit(0))).alias("_left"),
            F.coalesce("_upto", "_from").alias("_from"),
            F.when(took, F.concat("taken", F.array(step))).otherwise(F.col("taken")).alias("taken")))
    by = exchange(by, beside) if not by.where(MISSING).isEmpty() else by.withColumns({"gone": F.expr(SWAP), "over": F.expr(SWAP)})
    heavy = beside("taken").where((F.col("_c") > 1) & inside(F.col("taken"), F.col("_q"), F.col("size")) & ~inside(F.col("taken"), F.col("_q"), F.col("_w"))) \
        .select(F.col("_s").alias("_hs"), F.col("_u").alias("_hu"), F.col("size").alias("_hn"))
    return by.drop("_left", "_from"), cut_lineage(heavy)


def exchange(by: DataFrame, beside) -> DataFrame:
    """Add to sources that miss too much the groups of rows that are taken out (`gone`) and added (`over`) once nothing fits any more.

    All that is not taken weighs more than what is left. The lightest such group goes in for the lightest taken one that makes room for it,
    of equal ones the first and the last in the sampling order: the words taken grow by the difference, and stay within the target. Where that leaves
    too much missing, the first group that brings the source nearer to its target is added as well.
    """
    place = F.struct(F.col("_q").alias("q"), "size")
    rest = beside("_left", "target", "taken").where(MISSING)
    used = inside(F.col("taken"), F.col("_q"), F.col("_w"))
    into = rest.where(~used).groupBy("_s").agg(F.min(F.struct("_w", "_q", "size")).alias("_in")) \
        .select(F.col("_s").alias("_i"), F.col("_in._w").alias("_heavy"), F.struct(F.col("_in._q").alias("q"), F.col("_in.size").alias("size")).alias("_in"))
    room = rest.where(used).join(into, _same("_s", "_i")) \
        .where((F.col("_w") >= F.col("_heavy") - F.col("_left")) & (F.col("_w") < F.col("_heavy")))
    swap = room.groupBy("_s").agg(F.min(F.struct("_w", -F.col("_q"), place.alias("at"))).alias("_out"), F.first("_in").alias("_in"),
                                  F.first("_heavy").alias("_heavy"))
    by = cut_lineage(by.join(swap, _same("source", "_s"), "left").drop("_s").withColumns({
        "_left": F.col("_left") - F.coalesce(F.col("_heavy") - F.col("_out._w"), F.lit(0)),
        "gone": F.when(F.col("_out").isNotNull(), F.array("_out.at")).otherwise(F.expr(SWAP)),
        "over": F.when(F.col("_out").isNotNull(), F.array("_in")).otherwise(F.expr(SWAP))}).drop("_out", "_in", "_heavy"))
    last = by.where(MISSING).select(F.col("source").alias("_b"), F.col("_left").alias("_now"), F.col("over").alias("_over"))
    nearer = rest.where(~used).join(last, _same("_s", "_b")) \
        .where((F.col("_w") > F.col("_now")) & (F.col("_w") < 2 * F.col("_now")) & ~listed(F.col("_over"), F.col("_q"), F.col("size"))) \
        .groupBy("_s").agg(F.min(place).alias("_more"))
    return cut_lineage(by.join(nearer, _same("source", "_s"), "left").drop("_s")
                       .withColumn("over", F.when(F.col("_more").isNotNull(), F.concat("over", F.array("_more"))).otherwise(F.col("over"))).drop("_more"))


def listed(groups: Column, q: Column, size: Column) -> Column:
    """Whether the group of rows with this place in the order and this size is among the groups."""
    return F.exists(groups, lambda x: (x["q"] == q) & (x["size"] == size))


def inside(taken: Column, q: Column, weight: Column) -> Column:
    """Whether q lies in a stretch that has room for the weight."""
    return F.exists(taken, lambda x: (q > x["above"]) & (q <= x["upto"]) & (weight <= x["fit"]))


def pareto(u: Column, inclusion_odds: Column) -> Column:
    return u / (1 - u) / inclusion_odds


def random(doc: Column, text: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the document and the seed alone, so that reruns agree."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc.isNull(), doc, text), 12).cast("double") + 0.5) / float(1 << 52)


def with_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix",
                **kw) -> DataFrame:
    """Add size (words of the text), source_size, target and copies (0 to the cap) to each row.

    A null text has size 0; a null source is a source of its own, the last one. A document without words is never
    taken. Rows that are repeated share one random number and are taken or left together; ties of the random number likewise. An empty
    table gives an empty result. Other columns are kept; a column with the name of an added one is replaced.
    """
    # the row travels as one column, so that none of its names can clash
    added = ("size", "source_size", "target", "copies")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(source).alias("_source"),
                      F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
                      random(F.col(key), F.col(text), seed).alias("_u"))
    by, heavy = plan(own.select(F.col("_source").alias("source"), F.col("_size").alias("size"), "_u"), seed, **kw)
    by = by.select(F.col("source").alias("_src"), F.struct("source_size", "target", "whole", "level", "taken", "gone", "over").alias("_by"))
    out = own.join(by, _same("_source", "_src"))
    q = pareto(F.col("_u"), odds(F.col("_size"), F.col("_by.level")))
    one_more = inside(F.col("_by.taken"), q, F.col("_size"))
    n = heavy.limit(SENT_GROUPS + 1).count()
    if n:
        out = out.join(F.broadcast(heavy) if n <= SENT_GROUPS else heavy,
                       _same("_source", "_hs") & (F.col("_u") == F.col("_hu")) & (F.col("_size") == F.col("_hn")), "left")
        one_more = one_more & F.col("_hu").isNull()
    one_more = (one_more & ~listed(F.col("_by.gone"), q, F.col("_size"))) | listed(F.col("_by.over"), q, F.col("_size"))
    wanted = (F.col("_size") > 0) & (F.col("_by.level") > 0)
    copies = F.col("_by.whole") + F.when(wanted, F.coalesce(one_more, F.lit(False))).otherwise(False).cast("int")
    kept = [F.col("_row").getField(c).alias(c) for c in docs.columns if c not in added]
    # the row is unpacked in a step of its own: where its names stand beside those used above they could be taken for them
    out = out.select("_row", F.struct(F.col("_size").alias("size"), "_by.source_size", "_by.target", copies.cast("int").alias("copies")).alias("_m"))
    return out.select(*kept, *[F.col(f"_m.{c}").alias(c) for c in added])


def op7_mixing(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source")
    mixed = with_copies(docs)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
