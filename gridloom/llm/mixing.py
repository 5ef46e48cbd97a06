"""Mixing sources to target weights: weighted fair queueing.

Each source is a queue of its documents in shuffled order, once per allowed
repeat. A document's virtual finish time is the source's cumulative tokens up
to and with it divided by the source's target share; the mix is everything in
order of virtual finish time until the budget is spent. Sources thus advance in
proportion to their shares, a source that runs out leaves its share to the
others, and whatever the budget, the mix is a prefix of the same order.

Cumulative sums never bring a source together: documents fall into hash
buckets, the buckets' sums are prefix-summed per source, and only a bucket's
own documents are summed in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm import tokens
from gridloom.plans.lookup import bucket_of
from gridloom.plans.materialize import materialize

#: Documents that a bucket of one source and repeat should hold, and rows up to which the last range is cut in one task.
BUCKET_ROWS = 20_000
SLICES = 1024


def weigh(docs: DataFrame, targets: DataFrame, file: str | None = None) -> tuple[DataFrame, list]:
    """((doc_id, source, n_tokens) of the documents whose source is listed, the list's rows as plain tuples).

    The list is a parameter table of sources, not data; null sources, shares
    that are null, NaN or not positive and repeats below one leave their source
    out.
    """
    rows = targets.where("source IS NOT NULL AND target_share > 0 AND NOT isnan(target_share) AND max_repeats >= 1").select("source", "target_share", "max_repeats").distinct().collect()
    listed = docs.where("doc_id IS NOT NULL").where(F.col("source").isin([r.source for r in rows]) if rows else F.lit(False))
    counted = tokens.count_tokens(listed.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text"), ["doc_id", "source"], file=file)
    return materialize(counted), [(r.source, float(r.target_share), int(r.max_repeats)) for r in rows]


def _reach(stats: list[tuple[float, float, int]], budget: float) -> float:
    """The virtual time at which (share, tokens, repeats) queues have sent ``budget`` tokens; infinite if they never do."""
    sent = lambda v: sum(min(w * v, t * r) for w, t, r in stats)
    ends = sorted(t * r / w for w, t, r in stats)
    if not ends or sent(ends[-1]) < budget:
        return float("inf")
    lo, hi = 0.0, ends[-1]
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sent(mid) < budget else (lo, mid)
    return hi


def fair_mix(counted: DataFrame, targets: list, budget: int | None = None, seed: int = 17) -> DataFrame:
    """(doc_id, source, n_tokens, copies): the mix; ``copies`` is at least 1 and at most the source's ``max_repeats``.

    ``budget`` is that of all ``counted`` documents together unless given. The
    mix never exceeds it and falls short by less than the next document, or by
    more only if all repeats are used up. Documents without tokens (null and
    empty texts) weigh nothing and take part. Ties in virtual finish time go to
    the source, the repeat and the document with the smaller name, number and
    id. Empty tables give an empty mix.
    """
    spark = counted.sparkSession
    per = {r.source: r for r in counted.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"), F.max("n_tokens").alias("m")).collect()}  # a row a listed source
    known = [(s, w, r) for s, w, r in targets if s in per and per[s].t > 0]
    if not known:
        return spark.createDataFrame([], "doc_id bigint, source string, n_tokens bigint, copies bigint")
    total = sum(per[s].t for s, _, _ in known)
    budget = total if budget is None else budget
    slack = sum(per[s].m for s, _, _ in known)
    until = _reach([(w, per[s].t, r) for s, w, r in known], budget + slack)
    plan = []
    for s, w, r in known:
        # a repeat whose first document would finish after the budget is spent is not even made
        r = r if until == float("inf") else max(1, min(r, int(until * w // max(per[s].t, 1)) + 1))
        plan.append((s, w, r, float(per[s].t)))
    buckets = max(16, -(-max(p.n for p in per.values()) // BUCKET_ROWS))
    table = F.broadcast(spark.createDataFrame(plan, "ps string, share double, repeats int, tokens double"))  # a row a listed source
    rows = counted.join(table, F.col("source") == F.col("ps")).select("doc_id", "source", "n_tokens", "share", "tokens", F.explode(F.sequence(F.lit(1), "repeats")).alias("turn"))
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "turn")).withColumn("b", bucket_of(buckets, F.col("h"), F.lit(1)))
    sums = rows.groupBy("source", "turn", "b").agg(F.sum("n_tokens").alias("bt"))
    before = F.coalesce(F.sum("bt").over(W.partitionBy("source", "turn").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(F.col("source").alias("s2"), F.col("turn").alias("t2"), F.col("b").alias("b2"), before.alias("start"))
    inside = F.sum("n_tokens").over(W.partitionBy("source", "turn", "b").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    timed = rows.withColumn("own", inside).join(F.broadcast(starts) if len(plan) * buckets * 8 < 100_000 else starts, (F.col("source") == F.col("s2")) & (F.col("turn") == F.col("t2")) & (F.col("b") == F.col("b2")))
    finish = ((F.col("turn") - 1) * F.col("tokens") + F.col("start") + F.col("own")) / F.col("share")
    timed = materialize(timed.select("doc_id", "source", "turn", "n_tokens", finish.alias("finish")))

    # range-cut: the slice of virtual time in which the budget runs out is found from sums a slice, and cut finer until it is small
    lo, hi, spent = 0.0, timed.agg(F.max("finish")).first()[0] * (1 + 1e-9) + 1e-9, 0
    while True:
        width = (hi - lo) / SLICES
        part = timed.where((F.col("finish") >= lo) & (F.col("finish") < hi)) if lo else timed.where(F.col("finish") < hi)
        sums = part.groupBy(F.least(F.floor((F.col("finish") - lo) / width), F.lit(SLICES - 1)).alias("k")).agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"), F.min("finish").alias("a"), F.max("finish").alias("z")).orderBy("k").collect()  # SLICES rows at most
        cut = None
        for r in sums:
            if spent + r.t > budget:
                cut = r
                break
            spent += r.t
        if cut is None:
            taken = timed.where(F.col("finish") < hi)
            break
        if cut.n <= BUCKET_ROWS or cut.a == cut.z:
            edge = timed.where((F.col("finish") >= cut.a) & (F.col("finish") <= cut.z))
            run = F.sum("n_tokens").over(W.orderBy("finish", "source", "turn", "doc_id").rowsBetween(W.unboundedPreceding, 0))
            edge = edge.withColumn("run", run).where(F.col("run") <= budget - spent).drop("run")
            taken = timed.where(F.col("finish") < cut.a).unionByName(edge)
            break
        lo, hi = cut.a, cut.z * (1 + 1e-15) + 1e-12
    return taken.groupBy("doc_id", "source").agg(F.max("n_tokens").alias("n_tokens"), F.count("*").alias("copies"))


def shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, n_docs, n_rows, n_tokens, actual_share) of every listed source; zeros for a source without documents."""
    got = mix.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("n_docs"), F.sum("copies").alias("n_rows"), F.sum(F.col("n_tokens") * F.col("copies")).alias("n_tokens"))
    out = targets.where("source IS NOT NULL").select("source", "target_share").distinct().join(got, F.col("source") == F.col("s"), "left")
    whole = F.sum("n_tokens").over(W.partitionBy())  # a row a listed source
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select("source", "target_share", zero("n_docs").alias("n_docs"), zero("n_rows").alias("n_rows"), zero("n_tokens").alias("n_tokens"), F.coalesce(F.col("n_tokens") / whole, F.lit(0.0)).alias("actual_share"))
