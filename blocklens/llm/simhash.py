"""SimHash document fingerprints and their search by permuted block tables, in DataFrame expressions alone."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLANKS = r"[\x20\x09-\x0D]+"
#: A term's weight is the number of its code points, this at most: short terms say less.
MOST_WEIGHT = 15
LANES = (1 << 32) | 1
#: Documents that one bucket of neighbours holds, about, and buckets at most (their table is broadcast).
PER_BUCKET, MAX_BUCKETS = 1_000, 1 << 16


def terms(text: Column) -> Column:
    """``array<struct<h, w>>``: hash and weight of each pair of adjacent words (the one word of shorter texts)."""
    words = F.filter(F.split(F.lower(text), BLANKS), lambda w: w != "")

    def term(a: Column, b: Column) -> Column:
        return F.struct(F.xxhash64(a, b).alias("h"), F.least(F.length(a) + F.coalesce(F.length(b), F.lit(0)), F.lit(MOST_WEIGHT)).cast("long").alias("w"))

    # the last word has no next one; its term counts only if it is the only word
    return F.transform(F.array(words), lambda x: F.when(F.size(x) > 1, F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), term)).otherwise(F.transform(x, lambda a: term(a, F.lit(None).cast("string")))))[0]


def votes() -> list[Column]:
    """Sums of the weights of terms with bit b set, two bits (b and b + 32) in the halves of each sum, and of all weights."""
    return [F.sum(F.shiftright("h", b).bitwiseAND(F.lit(LANES)) * F.col("w")).alias(f"v{b}") for b in range(32)] + [F.sum("w").alias("all")]


def fingerprint() -> Column:
    """The 64-bit fingerprint from ``votes``: a bit is set if the terms that have it weigh more than half. No terms: 0."""
    half = F.col("all") / 2
    bits = [F.when(F.col(f"v{b}").bitwiseAND(F.lit(0xFFFFFFFF)) > half, F.lit(1 << b)).otherwise(F.lit(0)) for b in range(32)]
    bits += [F.when(F.shiftrightunsigned(f"v{b}", 32) > half, F.lit(1 << 32 + b if b < 31 else -(1 << 63))).otherwise(F.lit(0)) for b in range(32)]
    out = bits[0].cast("long")
    for b in bits[1:]:
        out = out.bitwiseOR(b.cast("long"))
    return F.coalesce(out, F.lit(0).cast("long"))


def as_text(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64.0


def fingerprints(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and ``fp`` for each row; ``keys`` have to tell the rows apart. Null and empty texts have fingerprint 0."""
    each = df.select(*keys, F.explode_outer(terms(F.coalesce(F.col(text), F.lit("")))).alias("t")).select(*keys, "t.h", "t.w")
    return each.groupBy(*keys).agg(*votes()).select(*keys, fingerprint().alias("fp"))


def _tables(radius: int, blocks: int) -> list[int]:
    """Masks of the permuted tables' keys: each choice of ``blocks - radius`` of the blocks that the 64 bits are cut into."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum((1 << edges[i + 1]) - (1 << edges[i]) for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) * (m >> 63) for m in masks]


def near(queries: DataFrame, fps: DataFrame, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """``a, b, distance``: for each fingerprint of ``queries`` (column ``fp``) the other ones of ``fps`` within ``radius`` bits.

    The 64 bits are cut into ``blocks`` (radius + 2 by default); whichever bits differ, some ``blocks - radius`` blocks
    are equal, so each choice of that many blocks is a table keyed by their bits, and each pair meets in one at least;
    it is given by the first of them. Equal fingerprints count as one row: membership is the caller's table. Null
    fingerprints are left out. A key with many rows is split where adaptive execution splits skewed joins.
    """
    masks = _tables(radius, blocks or radius + 2)
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("k")) for t, m in enumerate(masks)])

    def keyed(df: DataFrame, name: str) -> DataFrame:
        return df.select("fp").where("fp is not null").distinct().select(F.col("fp").alias(name), F.inline(tables))

    differ = F.col("a").bitwiseXOR(F.col("b"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m).cast("long")) == 0, F.lit(t)) for t, m in enumerate(masks)])
    met = keyed(queries, "a").join(keyed(fps, "b"), ["t", "k"]).where((F.bit_count(differ) <= radius) & (F.col("a") != F.col("b")) & (first == F.col("t")))
    return met.select("a", "b", F.bit_count(differ).alias("distance"))


def near_pairs(fps: DataFrame, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """All pairs ``a < b`` of different fingerprints at most ``radius`` bits apart, with their ``distance``, by ``near``."""
    return near(fps, fps, radius, blocks).where("a < b")


def with_next(df: DataFrame, per_bucket: int = PER_BUCKET) -> DataFrame:
    """Rows of ``doc_id, text`` with the text of the next row in descending order (after the last one: the first).

    Buckets are ranges of ids: quantiles of all ids, cut evenly. A bucket's first rows also go, as copies, to the bucket
    that comes before it in the order, so each text is shuffled once and no bucket needs another. Returns ``bucket, pos,
    copy, doc_id, text, next``. Null ids come last; rows of one id are ordered by text.
    """
    low = -(1 << 63)
    keyed = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(low)).alias("k"))
    cuts, n = df.agg(F.expr(f"approx_percentile(doc_id, array({', '.join(str(i / 64) for i in range(65))}), 2000)"), F.count("*")).first()
    cuts = sorted(set(cuts or [0]))
    parts = max(1, min(MAX_BUCKETS // 64, -(-n // (64 * per_bucket)))) if n > per_bucket else 1
    if n <= per_bucket:
        cuts = cuts[:1]
    edges = F.array(*[F.lit(c).cast("long") for c in cuts])
    span = F.greatest(F.size(F.filter(edges, lambda c: c <= F.col("k"))), F.lit(1))
    start, end = F.element_at(edges, span), F.coalesce(F.try_element_at(edges, span + 1), F.lit(cuts[-1] + 1))
    within = F.floor((F.col("k").cast("double") - start.cast("double")) * parts / F.greatest(end.cast("double") - start.cast("double"), F.lit(1.0)))
    bucket = (span.cast("long") * parts + F.greatest(F.lit(0), F.least(F.lit(parts - 1), within))).alias("bucket")
    heads = keyed.select(bucket, "k").groupBy("bucket").agg(F.max("k").alias("head"))
    everything = Window.orderBy("bucket")
    heads = heads.select("bucket", "head", F.coalesce(F.lead("bucket").over(everything), F.first("bucket").over(everything)).alias("before"))
    near = keyed.select("*", bucket).join(F.broadcast(heads), "bucket")
    twice = F.when(F.col("k") == F.col("head"), F.array(F.struct(F.col("bucket"), F.lit(False).alias("copy")), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("copy")))).otherwise(F.array(F.struct(F.col("bucket"), F.lit(False).alias("copy"))))
    dealt = near.select("doc_id", "text", "k", F.explode(twice).alias("x")).select("doc_id", "text", "k", "x.bucket", "x.copy")
    order = Window.partitionBy("bucket").orderBy("copy", F.desc("k"), "text")
    return dealt.select("bucket", F.row_number().over(order).alias("pos"), "copy", "doc_id", "text", F.lead("text").over(order).alias("next"))


def fingerprint_digest(df: DataFrame, per_bucket: int = PER_BUCKET, radius: int = 3, every: int = 50) -> DataFrame:
    """Fingerprints of each whole text and of its edited text (its last half replaced by as much of the next one's start),
    how alike they are, and ``n_near``: for rows whose doc_id ``every`` divides, the number of other fingerprints among
    all rows' within ``radius`` bits, found by the permuted block tables; null for the rest.

    Null and empty texts: no code points, fingerprint 0; repeated rows are kept; null ids are never queries; other columns
    are left out, whatever their names; an empty table gives an empty result.
    """
    rows = with_next(df, per_bucket)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next"), F.lit(1), half))
    rows = rows.select("bucket", "pos", "copy", "doc_id", n.cast("long").alias("n_chars"), "text", F.when(~F.col("copy"), edited).alias("edited"))
    rows = rows.withColumn("sha", F.unhex(F.sha2(F.col("edited").cast("binary"), 256)))
    keys = ["bucket", "pos", "copy", "doc_id", "n_chars", "sha"]
    both = rows.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("body")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("body")))).alias("x")).select(*keys, "x.which", "x.body")
    fps = fingerprints(both, [*keys, "which"], "body")
    paired = fps.groupBy(*keys).agg(F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("efp"))
    after = F.lead("fp").over(Window.partitionBy("bucket").orderBy("pos"))
    done = paired.withColumn("nfp", after).where(~F.col("copy"))
    done = written(done.select("doc_id", "n_chars", "sha", "fp", "efp", "nfp"), "fingerprints")
    asked = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    counts = near(done.where(asked), done, radius).groupBy(F.col("a").alias("fp")).agg(F.count("*").alias("n_near"))
    searched = done.where(asked).join(counts, "fp", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)).cast("long"))
    return searched.unionByName(done.where(~asked).withColumn("n_near", F.lit(None).cast("long"))).select(
        "doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("nfp")).alias("near_next"), "n_near",
    )
