"""Mix sources to target weights by entropy balancing.

Every source gets a token target; the rates of its documents are the solution of the
entropy-balancing problem

    minimise  sum_i size_i * (r_i log r_i - r_i)   subject to   sum_{i in s} size_i r_i = target_s

whose convex dual is ``sum_s source_size_s exp(lambda_s) - lambda_s target_s``.  The dual needs
the documents only through one aggregate per source (partial sums before the shuffle), its
Hessian is diagonal, and Newton's steps run on all sources side by side.  The document rate is
the exponential tilt ``exp(lambda_s)``.

Rates become copies by systematic rounding: documents of a source are put into a fixed
pseudo-random order, ``u_i`` is the share of the source's tokens up to the middle of document
``i``, and the document is taken ``floor(r) + [u_i <= frac(r)]`` times.  A source therefore
misses its target by half a document at most, and reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tariffloom.llm.common import WORD, cut_lineage, group_key, table, text_of
from tariffloom.operators.ordered import row_numbers, running_total

WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2.0
NEWTON_STEPS = 60


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("bigint")


def source_ranks(sources: DataFrame, column: str) -> DataFrame:
    """Number the rows 1.. by ``column`` in code point order, null last, in range pieces."""
    ordered = sources.withColumn("__order", F.struct(F.col(column).isNull().alias("none"), F.col(column).alias("value")))
    pieces = cut_lineage(ordered.repartitionByRange("__order").withColumn("__range", F.spark_partition_id()))
    return row_numbers(pieces, [], "__order", "rank", F.col("__range")).drop("__order", "__range")


def fill_targets(sources: DataFrame, share: float, limit: float) -> DataFrame:
    """Split ``share`` of all tokens by ``weight``; excess above the limit goes to the others by weight.

    ``level`` is the target per unit of weight.  Sources above their limit are set to it and the
    level of the rest rises, until no source passes its limit.  One small aggregate a round.
    """
    most = F.col("source_size") * F.lit(limit)
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = -1.0
    while True:
        over = (F.col("weight") * F.lit(level) > most) if level >= 0 else F.lit(False)
        full, weight = sources.agg(F.sum(F.when(over, most).otherwise(0.0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        if not weight:
            break
        raised = (total * share - full) / weight
        if raised == level:
            break
        level = raised
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(max(level, 0.0)), most))


def solve_dual(size: Column, target: Column, steps: int = NEWTON_STEPS) -> Column:
    """Newton's steps for ``size * exp(x) - target * x`` from 0; convex, so no step size is needed."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0).cast("double"),
        lambda x, _: x - (size * F.exp(x) - target) / (size * F.exp(x)),
    )


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """Documents with their size, their source's size and target, the rate, and the words taken.

    A null text is empty, and an empty text is taken with no words.  A null source is a source of
    its own, last in order.  Equal rows are rounded one by one and may get different copies; an
    empty table gives an empty result.  Columns other than the three named ones are ignored, so
    names cannot clash.
    """
    sized = cut_lineage(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), group_key(source_col).alias("key"),
        word_count(text_col).alias("size"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("draw"),
    ))
    sources = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = source_ranks(sources, "source").withColumn("weight", F.get(turn, ((F.col("rank") - 1) % len(weights)).cast("int")))
    ranked = cut_lineage(ranked)
    size = F.col("source_size").cast("double")
    solved = (
        fill_targets(ranked, share, limit)
        .withColumn("dual", F.when(size > 0, solve_dual(size, F.col("target"))))
        .withColumn("rate", F.coalesce(F.round(F.exp("dual"), 12), F.lit(0.0)))
        .select("key", F.col("rank").alias("source_rank"), "source_size", "target", "rate")
    )
    # pieces of about sqrt(n) rows, and about as many pieces, so neither grows into one task
    digits = max(1, round(math.log(max(sized.count(), 1), 16) / 2))
    joined = sized.join(solved, "key").withColumn("__order", F.struct("draw", "doc_id", "size"))
    summed = running_total(joined, ["source_rank"], "__order", F.col("size"), "upto", F.substring("draw", 1, digits))
    extra = 2 * F.col("upto") - F.col("size") <= 2 * (F.col("rate") - F.floor("rate")) * F.col("source_size") + 0.25
    copies = F.floor("rate") + F.when((F.col("rate") > F.floor("rate")) & extra, 1).otherwise(0)
    return summed.select(
        "doc_id", "size", F.col("source_size").cast("bigint").alias("source_size"), "target", "rate",
        (copies * F.col("size")).cast("bigint").alias("taken"),
    )


def op2_mixing(spark, sf):
    return mix_sources(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         md5(coalesce(cast(doc_id as varchar), '')) as draw
  from documents),
s as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) as rk
  from d group by source),
w as (select *, [3.0, 1.0, 2.0][(rk - 1) % 3 + 1]::double as weight, 2.0::double * source_size as most from s),
o as (
  select *, most / weight as ratio,
         coalesce(sum(most) over (order by most / weight, rk rows between unbounded preceding and 1 preceding), 0) as full_before,
         sum(weight) over (order by most / weight, rk rows between current row and unbounded following) as weight_after,
         1.5::double * sum(source_size) over () as total
  from w),
l as (select coalesce(arg_min((total - full_before) / weight_after, ratio) filter ((total - full_before) / weight_after <= ratio), 0) as level from o),
t as (select source, source_size, least(weight * level, most)::double as target from w, l),
c as (
  select d.doc_id, d.size, t.source_size, t.target,
         case when t.source_size > 0 then round(t.target / t.source_size, 12) else 0 end as rate,
         sum(d.size) over (partition by d.source order by d.draw, d.doc_id, d.size rows unbounded preceding) as upto
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       cast((floor(rate) + case when rate > floor(rate)
             and 2 * upto - size <= 2 * (rate - floor(rate)) * source_size + 0.25 then 1 else 0 end) * size as bigint) as taken
from c
"""
