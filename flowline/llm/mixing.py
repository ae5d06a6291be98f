"""Mixing sources to target weights.

Tokens are counted per document and summed per source; each source gets a target by its weight, no more than
``max_rate`` times its own size, and the excess is shared again by weight. A source's repetition rate is
target / size. Every document is emitted floor(rate) times plus once more with probability equal to the fraction: a
Bernoulli draw, a hash of seed and doc_id below the fraction.

Single draws leave a source off its target by chance, by much where few documents hold most of its words. So the draw
is made with ``SEEDS`` seeds at once, and each source keeps the seed whose sum comes nearest to its target. Every seed is
a whole set of independent draws; which one is kept depends on the data and on nothing else, so reruns agree.

All of it is DataFrame work. Sums by source and seed are pre-aggregated before the shuffle; sources are placed and
filled up by range-partitioned running sums, so they may be many; documents meet their source's row in a join on source
and a salt, so a hot source is spread over tasks (Spark broadcasts that table where its size allows).

Null texts have size 0; a null source is a source of its own and comes last; a source without words gets
target 0; repeated rows share their draw, so they are taken alike; a null doc_id hashes as the text ``null``. An
empty table gives an empty result. Extra columns are ignored by ``mix_sources`` and kept, whatever their names, by
``repeat_documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordinal import with_position, with_running
from .common import spill

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Seeds that each source chooses from, a multiple of 4: a digest gives four draws of 32 bits.
SEEDS = 32
#: Parts of a source in the join that gives documents their rate.
SALTS = 32


def n_words(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=(1, 2, 3), max_rate: int = 3) -> DataFrame:
    """(source, size) rows -> one row per source: source, source_size, weight, target.

    Water filling: with sources ordered by max_rate * size / weight, the ones before the first that stays
    under its limit are at their limit, and the level of the rest is what remains over their weights.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("none", F.col("source").isNull())
    per = with_position(per, ["none", "source"], "place").withColumn("weight", F.get(cycle, F.pmod("place", F.lit(len(weights)))))
    per = per.withColumn("most", F.col("source_size") * max_rate).withColumn("full", F.col("most") / F.col("weight"))
    per = with_running(per, ["full", "place"], {"spent": ("sum", F.col("most")), "used": ("sum", F.col("weight"))}, "nth")
    per = spill(per.withColumns({"spent": F.col("spent") - F.col("most"), "used": F.col("used") - F.col("weight")}), "sources")
    total, whole = per.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(float(total or 0)) - F.col("spent")) / (F.lit(whole) - F.col("used"))
    first = per.where(level * F.col("weight") <= F.col("most")).agg(F.min(F.struct("used", level.alias("level"))).alias("x")).first().x
    target = F.least(F.col("most").cast("double"), F.lit(first.level if first else 0.0) * F.col("weight"))
    return per.select("source", "source_size", "weight", target.alias("target"))


def drawn(seed: str, doc_id, number) -> F.Column:
    """The eight hex digits that a document draws with a seed's number."""
    text = F.concat(F.lit(seed), F.floor(number / 4).cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.substring(F.md5(text), F.pmod(number, F.lit(4)).cast("int") * 8 + 1, F.lit(8))


def mix_plan(sized: DataFrame, weights=(1, 2, 3), max_rate: int = 3, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size) rows -> one row per source: source, source_size, target, whole copies, limit of draws, number of the seed."""
    per = source_targets(sized, weights, max_rate)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    per = per.withColumn("whole", F.floor(rate)).withColumn("limit", F.lower(F.lpad(F.hex(F.floor((rate - F.floor(rate)) * float(1 << 32))), 8, "0")))
    per = spill(per.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")), "rates")
    rows = _meet(sized.select("doc_id", "source", "size"), per.select("source", "limit"))
    sums = [F.sum(F.when(drawn(seed, F.col("doc_id"), F.lit(k)) < F.col("limit"), F.col("size")).otherwise(0)) for k in range(SEEDS)]
    sums = rows.groupBy("source").agg(F.array(*sums).alias("sums")).withColumnRenamed("source", "of")
    near = F.array_min(F.transform("sums", lambda x, k: F.struct(F.abs(x - F.col("need")).alias("off"), k.alias("k"))))
    per = per.join(sums, per.source.eqNullSafe(sums.of))
    return spill(per.select("source", "source_size", "target", "whole", "limit", near["k"].alias("number")), "mix")


def _meet(rows: DataFrame, per: DataFrame) -> DataFrame:
    """Rows with the columns of their source's row; both sides salted."""
    of = per.withColumnRenamed("source", "__of").withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int"))
    return rows.join(of, rows.source.eqNullSafe(of["__of"]) & (F.col("__salt") == F.col("__part"))).drop("__of", "__part", "__salt")


def _copies(seed: str) -> F.Column:
    return (F.col("whole") + (drawn(seed, F.col("doc_id"), F.col("number")) < F.col("limit")).cast("long")).cast("long")


def mix_sources(docs: DataFrame, weights=(1, 2, 3), max_rate: int = 3, seed: str = "mix") -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies."""
    sized = spill(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    rows = _meet(sized, mix_plan(sized, weights, max_rate, seed))
    return rows.select("doc_id", "source", "size", "source_size", "target", _copies(seed).alias("copies"))


def repeat_documents(docs: DataFrame, weights=(1, 2, 3), max_rate: int = 3, seed: str = "mix") -> DataFrame:
    """The mix itself: every document of ``docs`` as often as it is taken, with the columns of ``docs``."""
    size = n_words(F.col("text")).alias("size")
    plan = mix_plan(spill(docs.select("doc_id", "source", size), "sizes"), weights, max_rate, seed)
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row"), "doc_id", "source", F.length("text").alias("size"))
    mixed = _meet(whole, plan).withColumn("copies", _copies(seed)).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__row.*")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source ASC NULLS LAST) AS place
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, ((place - 1) % 3 + 1)::DOUBLE AS weight, 3 * source_size::DOUBLE AS most FROM per
), summed AS (
  SELECT *,
    coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
    coalesce(sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
    (sum(source_size) OVER ())::DOUBLE AS total, sum(weight) OVER () AS weights
  FROM weighed
), level AS (
  SELECT arg_min((total - spent) / (weights - used), used) AS level
  FROM summed WHERE (total - spent) / (weights - used) * weight <= most
), aimed AS (
  SELECT source, source_size, least(most, coalesce(level, 0.0) * weight) AS target FROM summed, level
), rated AS (
  SELECT *, floor(rate) AS whole, format('{:08x}', floor((rate - floor(rate)) * 4294967296.0::DOUBLE)::BIGINT) AS limit_, target - floor(rate) * source_size AS need
  FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM aimed)
), drawn AS (
  SELECT s.doc_id, s.size, s.source, r.source_size, r.target, r.whole, r.need, k.k,
         (substr(md5('mix' || (k.k // 4) || ':' || coalesce(s.doc_id::VARCHAR, 'null')), (1 + k.k % 4 * 8)::INTEGER, 8) < r.limit_)::BIGINT AS hit
  FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source, range(SEEDS) k(k)
), chosen AS (
  SELECT source, k FROM (SELECT source, k, sum(size * hit) AS took, any_value(need) AS need FROM drawn GROUP BY source, k)
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(took - need), k) = 1
)
SELECT d.doc_id, d.size, d.source_size, d.target, (d.size * (d.whole + d.hit))::BIGINT AS taken
FROM drawn d JOIN chosen c ON d.source IS NOT DISTINCT FROM c.source AND d.k = c.k
""".replace("SEEDS", str(SEEDS))
