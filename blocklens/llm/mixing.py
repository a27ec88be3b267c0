"""Mixing sources to target weights along a low-discrepancy schedule."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Words in a block, and slots that are ranked together.
BLOCK, CHUNK = 256, 1 << 14
#: The golden ratio's fraction as a 32-bit integer: slot i's point is i * GOLDEN mod 2**32.
GOLDEN, UNIT = 2654435769, 1 << 32
#: Weights of the sources in code point order, null last, repeating.
WEIGHTS = (3, 1, 2)
#: Documents that are ordered together, at least: they grow with the square root of all rows, and so do the buckets.
BUCKET = 500
#: More sources than this are refused: their table is held on the driver and broadcast.
MAX_SOURCES = 100_000

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str | Column = "text") -> Column:
    """Words of the whole text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def point(slot: str) -> str:
    """SQL for a slot's point, slot * GOLDEN modulo UNIT, by halves of GOLDEN, so that no product passes 64 bits."""
    low = f"({slot} % {UNIT})"
    return f"({low} * {GOLDEN >> 16} % 65536 * 65536 + {low} * {GOLDEN & 65535}) % {UNIT}"


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Split ``share`` of all sizes by weight; no target above ``most`` times its size, the excess reshared."""
    total, weight = share * sum(sizes), float(sum(weights))
    out = [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weights[i], i))
    for n, i in enumerate(order):
        if most * sizes[i] / weights[i] >= total / weight:
            level = total / weight
            for k in order[n:]:
                out[k] = weights[k] * level
            break
        out[i] = float(most * sizes[i])
        total, weight = total - out[i], weight - weights[i]
    return out


def mix_sources(df: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Mix the rows of ``df`` so that each source's words come to its target.

    Each source's documents are put in an order of their hashed keys and its words cut into blocks of ``block``.
    Slot i's golden-ratio point falls into one source's part of the cumulated targets; the source's r-th slot takes
    its block r, beginning anew after the last, until its target is reached (sources that the schedule leaves short
    get slots at its end). Returns ``(documents, mix)``: documents has ``row`` (its place, unique), ``key``, ``size``,
    ``source_size``, ``target``; mix has ``slot, row, first, last``: the words of the document that a slot takes.

    A null source is a source of its own, last in order; null and empty texts have size 0 and are never taken;
    repeated rows are mixed one by one; equal keys are ordered by text; an empty table gives empty frames.
    """
    spark = df.sparkSession
    sized = written(df.select(F.col(key).alias("key"), F.col(source).alias("source"), n_words(text).alias("size"), F.xxhash64(text).alias("tie")), "sized")
    known = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).orderBy(F.col("source").asc_nulls_last()).limit(MAX_SOURCES + 1).collect()
    if len(known) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    wanted = targets([r.n for r in known], [weights[i % len(weights)] for i in range(len(known))], share, most)
    quotas = [int(t + 0.5) for t in wanted]
    total, edges = sum(quotas), [0]
    for q in quotas:
        edges.append(edges[-1] + q)
    plan = spark.createDataFrame(
        [(i, r.source, r.n, wanted[i], quotas[i], edges[i] * UNIT // max(total, 1), edges[i + 1] * UNIT // max(total, 1), -(-r.n // block)) for i, r in enumerate(known)],
        "s int, source string, source_size long, target double, quota long, lo long, hi long, n_blocks long",
    )
    plan = F.broadcast(plan)  # at most MAX_SOURCES rows

    # documents in shuffled order: the hash's first digits give a bucket, so that no source is ordered in one task
    n_rows = sum(r.rows for r in known)
    n_buckets = max(1, n_rows // max(BUCKET, math.isqrt(n_rows)))
    hashed = sized.join(plan, sized.source.eqNullSafe(plan.source)).drop(plan.source).withColumn("h", F.substring(F.md5(F.coalesce(F.col("key").cast("string"), F.lit("")).cast("binary")), 1, 12))
    hashed = hashed.withColumn("bucket", F.expr(f"cast(conv(substr(h, 1, 8), 16, 10) as long) * {n_buckets} div {UNIT}"))
    per_bucket = hashed.groupBy("s", "bucket").agg(F.sum("size").alias("n"))
    before = per_bucket.select("s", "bucket", (F.sum("n").over(Window.partitionBy("s").orderBy("bucket")) - F.col("n")).alias("base"))
    inside = Window.partitionBy("s", "bucket").orderBy("h", F.col("key"), "tie")
    placed = hashed.withColumn("nth", F.row_number().over(inside)).withColumn("local", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    rows = placed.join(before, ["s", "bucket"]).withColumn("at", F.col("base") + F.col("local")).withColumn("row", F.struct("s", "bucket", "nth"))
    documents = rows.select("row", "key", "source", "size", "tie", "source_size", "target")

    # the schedule
    n_slots = -(-total // block)
    points = spark.range(n_slots).select(F.col("id").alias("slot"), F.expr(point("id")).alias("x"))
    # a source's part of the points touches some equal stretches of them, in all fewer than stretches and sources together
    stretch = UNIT >> min(31, (4 * len(known)).bit_length())
    parts = F.broadcast(plan.where("hi > lo").select("s", "lo", "hi", F.explode(F.expr(f"sequence(lo div {stretch}, (hi - 1) div {stretch})")).alias("stretch")))
    points = points.withColumn("stretch", F.expr(f"x div {stretch}"))
    slots = points.join(parts, "stretch").where("x >= lo and x < hi").select("slot", F.expr(f"slot div {CHUNK}").alias("chunk"), "s")
    counts = slots.groupBy("s", "chunk").agg(F.count("*").alias("n"))
    earlier = counts.select("s", "chunk", (F.sum("n").over(Window.partitionBy("s").orderBy("chunk")) - F.col("n")).alias("base"))
    ranked = slots.withColumn("r", F.row_number().over(Window.partitionBy("s", "chunk").orderBy("slot")) - 1).join(earlier, ["s", "chunk"]).select("slot", "s", (F.col("base") + F.col("r")).alias("rank"))
    # slots that a source still needs: its blocks in each pass, the last of which may be short
    need = F.expr(f"(quota div greatest(source_size, 1)) * n_blocks + ((quota % greatest(source_size, 1)) + {block} - 1) div {block}")
    got = slots.groupBy("s").agg(F.count("*").alias("got"))
    short = plan.join(got, "s", "left").select("s", F.coalesce("got", F.lit(0)).alias("got"), need.alias("need")).where("got < need")
    extra = short.select("s", F.explode(F.sequence("got", F.col("need") - 1)).alias("rank")).select((F.lit(n_slots) + F.col("rank")).alias("slot"), "s", "rank")
    taken = ranked.unionByName(extra).join(plan, "s").where("n_blocks > 0").select(
        "slot", "s", F.expr("rank % n_blocks").alias("block"),
        F.expr(f"quota - (rank div n_blocks) * source_size - (rank % n_blocks) * {block}").alias("left"),
    ).where("left > 0")

    # a document's words in each block that it touches
    spans = rows.where("size > 0").select("row", "s", "at", "size", F.explode(F.expr(f"sequence(at div {block}, (at + size - 1) div {block})")).alias("block"))
    spans = spans.select("row", "s", "block", "at", F.expr(f"greatest(at, block * {block})").alias("a"), F.expr(f"least(at + size, (block + 1) * {block})").alias("b"))
    mix = taken.join(spans, ["s", "block"]).withColumn("b", F.least("b", F.expr(f"block * {block} + left"))).where("b > a")
    return documents, mix.select("slot", "row", (F.col("a") - F.col("at")).alias("first"), (F.col("b") - F.col("at")).alias("last"))


def words_taken(df: DataFrame, **parameters) -> DataFrame:
    """``key, source, size, tie, source_size, target, taken`` for each row: words that the mix takes, repeats counted;
    ``tie`` is the text's 64-bit hash."""
    documents, mix = mix_sources(df, **parameters)
    taken = mix.groupBy("row").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    return documents.join(taken, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mix_digest(df: DataFrame, **parameters) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for each row."""
    return words_taken(df, **parameters).select(F.col("key").alias("doc_id"), "source", "size", "source_size", "target", "taken")


def oracle(block: int = BLOCK) -> str:
    """The same by plain windows in DuckDB."""
    return f"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) size, text from documents),
src as (select source, cast(sum(size) as bigint) n, row_number() over (order by source nulls last) - 1 i from d group by source),
w as (select *, cast((case i % 3 when 0 then 3 when 1 then 1 else 2 end) as double) wt from src),
o as (select *, row_number() over (order by 2.0 * n / wt, i) k, 2.0 * n / wt ratio from w),
l as (select *, (1.5 * (select sum(n) from src) - coalesce(sum(2.0 * n) over (order by k rows between unbounded preceding and 1 preceding), 0)) / sum(wt) over (order by k rows between current row and unbounded following) lev from o),
c as (select min(k) k from l where ratio >= lev),
t as (select l.*, case when l.k < coalesce(c.k, 1e9) then 2.0 * n else wt * (select lev from l l2 where l2.k = c.k) end target from l, c),
q as (select *, cast(floor(target + 0.5) as bigint) quota from t),
e as (select *, cast(coalesce(sum(quota) over (order by i rows between unbounded preceding and 1 preceding), 0) as bigint) e0, cast((select sum(quota) from q) as bigint) total from q),
p as (select *, e0 * {UNIT} // greatest(total, 1) lo, (e0 + quota) * {UNIT} // greatest(total, 1) hi, (n + {block} - 1) // {block} nb from e),
ds as (select d.*, p.i, p.n source_size, p.target, sum(size) over (partition by p.i order by substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 12), doc_id rows unbounded preceding) - size pos from d join p on d.source is not distinct from p.source),
sl as (select r.slot, p.i from (select range slot, (range % {UNIT}) * {GOLDEN} % {UNIT} x from range(0, (select (any_value(total) + {block} - 1) // {block} from p))) r join p on x >= lo and x < hi),
rk as (select i, row_number() over (partition by i order by slot) - 1 r from sl),
ex as (select p.i, unnest(range(coalesce(g.got, 0), (quota // greatest(n, 1)) * nb + (quota % greatest(n, 1) + {block} - 1) // {block})) r from p left join (select i, count(*) got from sl group by i) g on p.i = g.i),
tk as (select a.i, a.r % nb b, quota - (a.r // nb) * n - (a.r % nb) * {block} lft from (select * from rk union all select * from ex) a join p on a.i = p.i where nb > 0),
sp as (select i, pos, size, unnest(range(cast(pos as bigint) // {block}, (cast(pos as bigint) + size - 1) // {block} + 1)) b from ds where size > 0),
g as (select sp.i, sp.pos, sum(greatest(0, least(sp.pos + sp.size, (sp.b + 1) * {block}, sp.b * {block} + lft) - greatest(sp.pos, sp.b * {block}))) taken from sp join tk on sp.i = tk.i and sp.b = tk.b where lft > 0 group by sp.i, sp.pos)
select ds.doc_id, ds.source, ds.size, ds.source_size, cast(ds.target as double) target, cast(coalesce(g.taken, 0) as bigint) taken
from ds left join g on ds.i = g.i and ds.pos = g.pos and ds.size > 0
"""
