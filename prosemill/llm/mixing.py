"""Mixing sources to target weights by capped water-filling.

Every source gets weight 1, 2, 3, 1, ... in code-point order (null last) and a share of all
words in proportion; no source may exceed ``cap`` epochs of its own words. Sources at their
cap are clamped and what they leave is shared again by weight among the others. The
fixpoint has a closed form: sort sources by cap / weight; the clamped ones are a prefix.

Sampling: each document is repeated ``floor(target / source size)`` whole times; what is
left of the target is taken once more from documents in seeded order, until it is used up
(the last one in part). The order is the md5 of seed and doc_id, so reruns agree.

Defined cases: null or blank text has size 0 and takes 0; a source of size 0 has target 0;
null sources are one source; repeated rows are documents of their own; an empty table gives
an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemill.llm.common import WORD

CAP = 3
WEIGHTS = (1, 2, 3)
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """From rows (source, source_size): source, source_size, target, whole, rest.

    One row a source: the table is as small as the list of sources, so its windows may
    run in one task.
    """
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((order - 1) % len(weights) + 1).cast("int"))
    every = Window.partitionBy()
    rising = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    past = rising.rowsBetween(Window.unboundedPreceding, -1)
    s = sizes.select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * cap).alias("limit"))
    s = s.withColumn(
        "level",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(past), F.lit(0))).cast("double")
        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(past), F.lit(0))).cast("double"),
    )
    free = F.col("limit").cast("double") > F.col("level") * F.col("weight")
    s = s.withColumn("rate", F.first(F.when(free, F.col("level")), ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    s = s.withColumn("target", F.least(F.col("limit").cast("double"), F.coalesce(F.col("rate") * F.col("weight"), F.col("limit").cast("double"))))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    s = s.withColumn("whole", whole)
    return s.select("source", "source_size", "target", "whole", (F.floor("target") - F.col("whole") * F.col("source_size")).cast("long").alias("rest"))


def mix(docs: DataFrame, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, and the columns named in ``keep``.

    Prefix sums in seeded order go over two levels of 256 buckets, then over the rows of
    one bucket: no window ever holds a source.
    """
    key = F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    d = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("_k"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    d = d.withColumns({"_b1": F.substring("_k", 1, 2), "_b2": F.substring("_k", 3, 2)})
    fine = d.groupBy("source", "_b1", "_b2").agg(F.sum("size").alias("_s"))
    coarse = fine.groupBy("source", "_b1").agg(F.sum("_s").alias("_s"))
    before = Window.unboundedPreceding, -1
    coarse = coarse.withColumn("_base1", F.coalesce(F.sum("_s").over(Window.partitionBy("source").orderBy("_b1").rowsBetween(*before)), F.lit(0))).drop("_s")
    fine = fine.withColumn("_base2", F.coalesce(F.sum("_s").over(Window.partitionBy("source", "_b1").orderBy("_b2").rowsBetween(*before)), F.lit(0))).drop("_s")
    targets = source_targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), cap, weights)

    def on(other: DataFrame, *keys: str):
        c = d["source"].eqNullSafe(other["source"])
        for k in keys:
            c &= d[k] == other[k]
        return c

    inner = F.sum("size").over(Window.partitionBy("source", "_b1", "_b2").orderBy("_k", "doc_id", "size").rowsBetween(*before))
    d = d.withColumn("_base3", F.coalesce(inner, F.lit(0)))
    base = fine.join(coarse, fine["source"].eqNullSafe(coarse["source"]) & (fine["_b1"] == coarse["_b1"])).select(
        fine["source"], fine["_b1"], fine["_b2"], (F.col("_base1") + F.col("_base2")).alias("_base")
    )
    base = base.join(targets, base["source"].eqNullSafe(targets["source"])).select(base["source"], "_b1", "_b2", "_base", "source_size", "target", "whole", "rest")
    out = d.join(base, on(base, "_b1", "_b2"))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("_base") - F.col("_base3")))
    return out.select(
        "doc_id", d["source"], "size", "source_size", "target", (F.col("whole") * F.col("size") + extra).cast("long").alias("taken"),
        *[F.col(f"_keep_{c}").alias(f"keep_{c}") for c in keep],
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document once for every whole repetition, and cut to whole words for a last part.

    Returns the columns of ``docs``, whatever their names; documents that the mix does not
    take are left out. Rows that agree in all columns are copies of each other and share
    what the mix takes of them; rows that differ anywhere are taken each for itself. Only
    ``text`` is cut: a column that counts its characters keeps the count of the whole.
    """
    # All columns travel in one struct, so that no name of theirs can clash with one used here.
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    d = d.select("row", "row.doc_id", "row.source", "row.text", F.xxhash64("row").alias("k1"), F.xxhash64(F.lit(1), "row").alias("k2"))
    m = mix(d.select("doc_id", "source", "text", "k1", "k2"), keep=("k1", "k2"), **options)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0)
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0)
    plan = m.groupBy(F.col("keep_k1").alias("k1"), F.col("keep_k2").alias("k2")).agg(F.sum(whole).cast("int").alias("whole"), F.max(part).cast("int").alias("part"))
    plan = plan.where("whole > 0 or part > 0")
    # Rows that repeat a document are taken together, so the text goes through one shuffle.
    one = d.dropDuplicates(["k1", "k2"]).join(plan, ["k1", "k2"])
    last = F.when(F.col("part") > 0, F.array("part")).otherwise(F.array().cast("array<int>"))
    one = one.withColumn("cut", F.explode(F.concat(F.array_repeat(F.lit(0), F.col("whole")), last)))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.greatest("cut", F.lit(1))), " ")
    return one.select(*[F.when(F.col("cut") > 0, cut).otherwise(F.col("text")).alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
