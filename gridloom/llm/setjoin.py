"""All pairs of set-valued records whose Jaccard similarity reaches a threshold: extended-prefix join.

Tokens are ordered rarest first. Two sets of sizes n and m that reach the
threshold t share at least ceil(t * max(n, m)) tokens, so their l-th shared
token lies in the first n - ceil(t * n) + l tokens of either. A record
therefore joins on single tokens of its 1-prefix; where such a token is common,
the key is extended by a second token of the longer 2-prefix, and so on up to
``LEVELS`` tokens. How far a key extends depends on its tokens alone, so both
records of a pair extend alike and the pair meets at the key of its first
shared tokens. Candidates pass a size bound and a bitmap bound before their
sets are compared exactly.

Tokens are ordered by their exact number of rows, looked up without a
broadcast that grows: heavy tokens are few by arithmetic, all others go through
a shuffle. A key thus extends when its expected number of records passes
``COMMON``, whatever the size of the table. Keys that hold many records all the
same are cut into slices. Sets of more than ``GIANT`` tokens are never put into
one row; they meet others on several shared tokens of their prefixes, too, and
the overlaps of these candidates are counted by joining rows.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.plans.lookup import bucket_of, heavy_lookup_join
from gridloom.plans.materialize import counted, materialize

#: A key expected to hold more records than this is extended by a further token.
COMMON = 48
LEVELS = 4
GIANT = 4096
#: Records of a key that one slice of it holds, and crowded keys that are broadcast at most.
SLICE = 8192
CROWDED = 1 << 16
#: Slices of a giant's rows while its candidates are verified.
SPREAD = 32


def token_sets(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sets out of (id, tok) rows without nulls, repeats allowed.

    Returns (id, n, toks, dfs, s1, s2) for sets of up to GIANT tokens, tokens
    rarest first with their numbers of rows and a 128-bit bitmap; and distinct
    (id, tok, df) rows of larger sets.
    """
    counts = rows.groupBy("id").agg(F.count("*").alias("c"))
    heavy = counts.where(F.col("c") > GIANT).select(F.col("id").alias("hid"))
    often, of = counted(rows.groupBy("tok").agg(F.count("*").alias("df")), n=F.sum("df"))
    total = of["n"] or 0

    def ranked(df: DataFrame) -> DataFrame:
        return heavy_lookup_join(df.select("id", "tok"), often, "tok", "df", total)

    def grouped(df: DataFrame) -> DataFrame:
        df = df.withColumn("bit", F.expr("cast(pmod(xxhash64(tok, 7), 128) as int)"))
        g = df.groupBy("id").agg(
            F.array_sort(F.collect_set(F.struct("df", "tok"))).alias("z"),
            F.expr("bit_or(if(bit < 64, shiftleft(1L, bit), 0L))").alias("s1"),
            F.expr("bit_or(if(bit >= 64, shiftleft(1L, bit - 64), 0L))").alias("s2"),
        )
        return g.select("id", F.size("z").alias("n"), F.col("z.tok").alias("toks"), F.expr("transform(z.df, x -> cast(least(x, 2147483647L) as int))").alias("dfs"), "s1", "s2")

    heavy = materialize(heavy)
    if heavy.isEmpty():
        return grouped(ranked(rows).repartition("id")), rows.limit(0).withColumn("df", F.lit(0).cast("bigint"))
    light = rows.join(heavy, F.col("id") == F.col("hid"), "left_anti")
    big = materialize(rows.join(heavy, F.col("id") == F.col("hid"), "left_semi").distinct())
    sizes = big.groupBy("id").agg(F.count("*").alias("bn"))
    medium = big.join(sizes.where(F.col("bn") <= GIANT).select(F.col("id").alias("mid")), F.col("id") == F.col("mid"), "left_semi")
    giants = big.join(sizes.where(F.col("bn") > GIANT).select(F.col("id").alias("gid")), F.col("id") == F.col("gid"), "left_semi")
    return grouped(ranked(light).repartition("id")).unionByName(grouped(ranked(medium))), materialize(ranked(giants))


def copy_classes(sets: DataFrame, giants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Identical sets become one class named by its smallest id.

    Returns (rep, copies) of classes with at least two members and (id, rep) of
    their members. A class is told by 128 bits of hash over its ordered tokens,
    so what is shuffled does not grow with the sets. Giants, which are never
    copies of smaller sets, are told by their size and sums of the hashes of
    their rows, which need no order.
    """
    prints = sets.select("id", F.xxhash64("toks").alias("h1"), F.xxhash64(F.lit(11), F.col("toks")).alias("h2"))
    total = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(20,0)"))  # noqa: E731  (a sum of bigint would overflow)
    sums = giants.groupBy("id").agg(F.count("*").alias("n"), total("tok").alias("t1"), total(F.lit(11), F.col("tok")).alias("t2"))
    prints = prints.unionByName(sums.select("id", F.xxhash64("n", "t1", "t2").alias("h1"), F.xxhash64(F.lit(11), F.col("n"), F.col("t1"), F.col("t2")).alias("h2")))
    multi = prints.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).where(F.col("copies") > 1)
    members = prints.join(multi, ["h1", "h2"]).select("id", "rep")
    return multi.select("rep", "copies"), members


def _need(t: Fraction, n: str) -> str:
    """ceil(t * n) in whole numbers."""
    return f"(({t.numerator} * {n} + {t.denominator - 1}) div {t.denominator})"


def keyed(reps: DataFrame, t: Fraction, n_sets: int) -> DataFrame:
    """(k, lvl, short, id, n, toks, s1, s2): a row for each key of each record; a ``short`` key stands for pairs that share its tokens and no others."""
    need = _need(t, "n")
    reach = lambda lvl: f"least(n, n - {need} + {lvl})"
    d = reps.selectExpr("*", f"posexplode(slice(toks, 1, {reach(1)})) as (i1, t1)").selectExpr("*", "dfs[i1] as e1", "xxhash64(t1) as k1").where("e1 > 1")
    d = d.selectExpr("*", "cast(e1 as double) as est", "k1 as k", "1 as lvl", "i1 as i", "false as done", "false as short")
    for lvl in range(1, LEVELS):
        # -2: the key ends here; -1: it goes on, but a record this small may share no further token, so it ends here too
        ends = f"if({t.numerator} * n <= {lvl * t.denominator}, array(-1), array())"
        further = f"if(i + 1 < {reach(lvl + 1)}, sequence(i + 1, {reach(lvl + 1)} - 1), array())"
        d = d.selectExpr("* except (done)", f"explode(if(done or est <= {COMMON}, array(-2), concat({ends}, {further}))) as j", "done as was")
        d = d.selectExpr(
            "* except (est, k, lvl, i, short, was, j)",
            f"if(j >= 0, est * dfs[j] / {max(n_sets, 1)}D, est) as est",
            "case when j >= 0 then xxhash64(k, toks[j]) else k end as k",
            f"if(j >= 0, {lvl + 1}, lvl) as lvl",
            "if(j >= 0, j, i) as i",
            "short or j = -1 as short",
            "was or j < 0 as done",
        )
    return d.selectExpr("k", "lvl", "short", "id", "n", "toks", "s1", "s2")


def similar_classes(sets: DataFrame, giants: DataFrame, members: DataFrame, threshold: Fraction) -> DataFrame:
    """(a, b, both, na, nb), a < b: pairs of different sets that reach the threshold, one row a pair of class representatives."""
    num, den = threshold.numerator, threshold.denominator
    spare = members.where(F.col("id") != F.col("rep")).select(F.col("id").alias("sid"))
    reps, giants = (x.join(spare, F.col("id") == F.col("sid"), "left_anti") for x in (sets, giants))
    post, by = sliced(keyed(reps, threshold, sets.count()))
    a, b = (post(s).select(*by, *[F.col(c).alias(f"{c}{s}") for c in ("lvl", "short", "id", "n", "toks", "s1", "s2")]) for s in "ab")
    # |A xor B| is at most (na + nb) (1 - t) / (1 + t); the bitmaps differ in no more bits
    close = f"ida < idb and {num} * greatest(na, nb) <= {den} * least(na, nb) and (bit_count(s1a ^ s1b) + bit_count(s2a ^ s2b)) * {den + num} <= (na + nb) * {den - num}"
    # explode is a fence: the filters below read the intersection and never compute it again
    c = a.join(b, by).where(close).selectExpr("*", "explode(array(array_intersect(toksa, toksb))) as common")
    first = "case lvla " + " ".join(f"when {x} then xxhash64({'xxhash64(' * (x - 1)}common[0]{''.join(f'), common[{y}]' for y in range(1, x))})" for x in range(1, LEVELS + 1)) + " end"
    c = c.where(f"size(common) * {den} >= {num} * (na + nb - size(common)) and lvla = lvlb and shorta = shortb and if(shorta, size(common) = lvla, size(common) >= lvla)").where(f"k = {first}")
    pairs = c.selectExpr("ida as a", "idb as b", "size(common) as both", "na", "nb")

    large = reps.where(F.col("n") * den >= num * GIANT)
    return pairs.unionByName(giant_pairs(giants, large, threshold))


def sliced(post: DataFrame):
    """(side -> rows, join columns): the keyed rows of either side of the join; one side of a crowded key is cut into slices, the other repeated for each of them."""
    crowded, of = counted(post.groupBy("k").agg(F.count("*").alias("kn")).where(F.col("kn") > SLICE).select(F.col("k").alias("ck"), F.ceil(F.col("kn") / SLICE).cast("int").alias("cuts")), n=F.count(F.lit(1)))
    if not of["n"]:
        return lambda side: post, ["k"]
    crowded = F.broadcast(crowded) if of["n"] <= CROWDED else crowded
    marked = post.join(crowded, F.col("k") == F.col("ck"), "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    cut = {"a": F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int"), "b": F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))}
    return lambda side: marked.withColumn("cut", cut[side]), ["k", "cut"]


def giant_pairs(giants: DataFrame, large: DataFrame, t: Fraction) -> DataFrame:
    """(a, b, both, na, nb) of pairs with at least one giant; ``large`` are the sets that may reach one.

    Of each set the rarest tokens are taken, at least as many as its prefix
    holds (all of the last number of rows among them), two sets that share
    several of those are candidates.
    """
    num, den = t.numerator, t.denominator
    own = giants.groupBy(F.col("id").alias("oid")).agg(F.count("*").cast("int").alias("n"))
    rows = giants.join(own, F.col("id") == F.col("oid")).select("id", "tok", "df", "n")
    rows = rows.unionByName(large.select("id", F.explode(F.arrays_zip("toks", "dfs")).alias("z"), "n").select("id", F.col("z.toks").alias("tok"), F.col("z.dfs").cast("bigint").alias("df"), "n"))
    shared = max(1, min(LEVELS, int(t * t * GIANT)))
    before = F.coalesce(F.sum("c").over(W.partitionBy("fid").orderBy("fdf").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rare = rows.groupBy(F.col("id").alias("fid"), F.col("df").alias("fdf"), F.col("n").alias("fn")).agg(F.count("*").alias("c")).withColumn("before", before)
    rare = rare.where(f"before < fn - {_need(t, 'fn')} + {shared}").select("fid", "fdf")
    prefix = rows.join(rare, (F.col("id") == F.col("fid")) & (F.col("df") == F.col("fdf"))).select("id", "tok", "n")
    x, y = (prefix.select("tok", F.col("id").alias(i), F.col("n").alias(f"n{i}")) for i in "ab")
    met = x.join(y, "tok").where(f"a < b and greatest(na, nb) > {GIANT} and {num} * greatest(na, nb) <= {den} * least(na, nb)")
    met = met.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c")).where(F.col("c") >= shared)
    # a giant may hold a third of all rows: its rows come in slices, its candidates go to each
    at = bucket_of(SPREAD, F.col("tok"))
    met = met.select("a", "b", "na", "nb", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("cut"))
    one = met.join(rows.select("id", "tok", at.alias("at")), (F.col("a") == F.col("id")) & (F.col("cut") == F.col("at"))).select("a", "b", "na", "nb", "tok")
    two = one.join(rows.select(F.col("id").alias("id2"), F.col("tok").alias("tok2")), (F.col("b") == F.col("id2")) & (F.col("tok") == F.col("tok2")))
    two = two.groupBy("a", "b", "na", "nb").agg(F.count("*").cast("int").alias("both")).select("a", "b", "both", "na", "nb")
    return two.where(f"both * {den} >= {num} * (na + nb - both)")


def set_join(rows: DataFrame, threshold: Fraction) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, members, sets) of (id, tok) rows.

    ``pairs`` is of class representatives as in ``similar_classes``, ``members``
    maps each copy (representatives of classes with copies included) to its
    representative, ``sets`` holds all ids of up to GIANT tokens. Copies are
    not expanded. Rows with a null id or token are left out, repeats count
    once, a record without tokens has no set and no pair, an empty table has
    none either.
    """
    rows = rows.select("id", "tok").where("id IS NOT NULL AND tok IS NOT NULL")
    sets, giants = token_sets(rows)
    sets = materialize(sets)
    _, members = copy_classes(sets, giants)
    members = materialize(members)
    return similar_classes(sets, giants, members, threshold), members, sets


def item_sets(array_cells: DataFrame) -> DataFrame:
    """(id, tok) of an array table: rows that are not ``is_na`` and have a value that is not null, NaN or zero. A null ``is_na`` is no false."""
    kept = array_cells.where("is_na = false AND val IS NOT NULL AND NOT isnan(val) AND val <> 0")
    return kept.select(F.col("item").alias("id"), F.col("attr").alias("tok"))


def expand_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b), a < b, of all records: representatives' pairs spread to their copies, and the pairs inside a class."""
    m1 = members.select(F.col("rep").alias("r1"), F.col("id").alias("i1"))
    m2 = members.select(F.col("rep").alias("r2"), F.col("id").alias("i2"))
    wide = pairs.select("a", "b").join(m1, F.col("a") == F.col("r1"), "left").join(m2, F.col("b") == F.col("r2"), "left")
    wide = wide.select(F.coalesce("i1", "a").alias("p"), F.coalesce("i2", "b").alias("q"))
    inner = m1.join(m2, (F.col("r1") == F.col("r2")) & (F.col("i1") < F.col("i2"))).select(F.col("i1").alias("p"), F.col("i2").alias("q"))
    return wide.unionByName(inner).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def record_links(pairs: DataFrame, members: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, class_id, n_links): every record with its class of copies and the number of other records it is similar to, copies included."""
    size = members.groupBy("rep").agg(F.count("*").alias("copies"))
    s1, s2 = (size.select(F.col("rep").alias(f"r{x}"), F.col("copies").alias(f"c{x}")) for x in "ab")
    w = pairs.select("a", "b").join(s1, F.col("a") == F.col("ra"), "left").join(s2, F.col("b") == F.col("rb"), "left")
    w = w.select("a", "b", F.coalesce("ca", F.lit(1)).alias("ca"), F.coalesce("cb", F.lit(1)).alias("cb"))
    ends = w.select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("cb").alias("n")), F.struct(F.col("b").alias("c"), F.col("ca").alias("n")))).alias("e")).select("e.*")
    per = ends.groupBy("c").agg(F.sum("n").alias("n"))
    own = members.select(F.col("id").alias("mid"), "rep")
    at = ids.join(own, F.col("id") == F.col("mid"), "left").withColumn("class_id", F.coalesce("rep", "id")).select("id", "class_id")
    at = at.join(per, F.col("class_id") == F.col("c"), "left").join(size, F.col("class_id") == F.col("rep"), "left")
    return at.select("id", "class_id", (F.coalesce("n", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_links"))
