"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Of all document rates w in (0, 2] that give each source its target of tokens, those closest to 1 in relative entropy
are exponentially tilted: w = min(2, exp(l * size / mean size)), with one multiplier l for each source. The multipliers
solve a convex dual. Its gradient and curvature are sums over documents that depend on a document's size only, so each
Newton step is one aggregation over a table of (source, size, count), done for all sources at once; a step that leaves
the bracket known so far is replaced by its middle.

Rates become copies within small buckets of each source, from the longest document to the shortest: each takes the
number of copies that keeps the words taken nearest to the words its rate and those before it ask for. That is the rate
rounded down or up unless long documents have left more than a short one's size over. A source of any size is many
buckets. Rows that repeat each other in all columns are one entry with their number, so that buckets are made of
distinct entries and none is hot, whatever repeats: ids, rows, or ids that are null.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.llm.common import ranked, repeated, settle, spread_join

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
#: Entries that a bucket of the rounding holds on average.
BUCKET = 256
TOLERANCE, MOST_STEPS = 1e-7, 80
_KEY = ["no_source", "source"]


def n_words(text: Column) -> Column:
    """Runs of other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """sources (no_source, source, source_size) with target: share of all sizes, dealt by weights that repeat in
    code-point order (null last); no target above most times the source's size, the excess going to the others by weight.

    The level, words for each unit of weight, is raised until no further source is above its bound: each time is one
    aggregation over the sources, of which the driver sees a row.
    """
    turn = ((F.col("nth") - 1) % len(weights) + 1).cast("int")
    t = ranked(sources.select(*_KEY, "source_size"), _KEY, "nth").withColumn("w", F.element_at(F.array(*map(F.lit, map(float, weights))), turn))
    t = settle(t.withColumn("cap", F.col("source_size") * F.lit(float(most))))
    whole = t.agg(F.sum("source_size").alias("size"), F.sum("w").alias("w")).first()
    total, level, bound = float(whole["size"] or 0) * share, 0.0, None
    while whole["w"]:
        over = F.col("cap") < level * F.col("w")
        got = t.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("cap"))).alias("cap"), F.sum(F.when(over, F.col("w"))).alias("w")).first()
        if got.n == bound or (got.w or 0) >= whole["w"]:
            break
        bound, level = got.n, (total - (got.cap or 0)) / (whole["w"] - (got.w or 0))
    return t.select(*_KEY, "source_size", F.least("cap", F.lit(level) * F.col("w")).alias("target"))


def tilts(sizes: DataFrame, wanted: DataFrame, most: float = MOST) -> DataFrame:
    """wanted with tilt: the multiplier of each source's exponential rates. sizes: (no_source, source, size, n).

    tilt is null where there is nothing to solve: no words, or a target of most times the size. Sources whose target is
    not met within TOLERANCE are warned of.
    """
    ln_most = F.log(F.lit(float(most)))
    facts = sizes.filter(F.col("size") > 0).groupBy(*_KEY).agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.min("size").alias("least"))
    state = wanted.join(facts, _KEY).filter((F.col("target") > 0) & (F.col("target") < F.col("source_size") * F.lit(most * (1 - 1e-12))))
    z, grow = F.col("least") / F.col("mean"), F.col("target") > F.col("source_size")
    state = state.select(*_KEY, "source_size", "target", "mean", F.lit(0.0).alias("tilt"), F.lit(False).alias("done"), F.when(grow, 0.0).otherwise(F.log(F.col("target") / F.col("source_size")) / z).alias("low"), F.when(grow, ln_most / z).otherwise(0.0).alias("high"))
    state = settle(state)
    keep = [*_KEY, "source_size", "target", "mean", "tilt", "done", "low", "high"]
    for _ in range(MOST_STEPS):
        rate = F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), ln_most))
        words = F.col("n") * F.col("size") * rate
        bent = F.when(rate < most, words * F.col("size") / F.col("mean")).otherwise(0.0)
        now = sizes.filter(F.col("size") > 0).join(state, _KEY).groupBy(*keep).agg(F.sum(words).alias("got"), F.sum(bent).alias("slope"))
        now = now.withColumn("low", F.when(F.col("got") <= F.col("target"), F.col("tilt")).otherwise(F.col("low"))).withColumn("high", F.when(F.col("got") >= F.col("target"), F.col("tilt")).otherwise(F.col("high")))
        step = F.col("tilt") + F.log(F.col("target") / F.col("got")) * F.try_divide(F.col("got"), F.col("slope"))
        step = F.when((step > F.col("low")) & (step < F.col("high")), step).otherwise((F.col("low") + F.col("high")) / 2)
        met = F.abs(F.col("got") - F.col("target")) <= F.col("target") * TOLERANCE
        state = settle(now.withColumn("done", met).withColumn("tilt", F.when(met, F.col("tilt")).otherwise(step)).select(*keep))
        missed = state.filter(~F.col("done")).count()
        if not missed:
            break
    else:
        warnings.warn(f"{missed} sources are off their target by more than {TOLERANCE} of it after {MOST_STEPS} steps", stacklevel=2)
    return wanted.join(state.select(*_KEY, "mean", "tilt"), _KEY, "left")


def _rounded(rows: Column, most: float) -> Column:
    """total: copies, 0 to most for each of n rows, for an array of (minus size, doc_id, h, n, rate), toward the words wanted so far."""
    start = F.struct(F.lit(0.0).alias("owed"), F.array().cast("array<struct<doc_id:bigint,size:bigint,h:bigint,n:bigint,rate:double,total:bigint>>").alias("out"))

    def add(state: Column, row: Column) -> Column:
        size = -row["minus"]
        owed = state["owed"] + row["rate"] * size * row["n"]
        near = F.rint(owed / F.nullif(size, F.lit(0).cast("bigint")))
        total = F.coalesce(F.least(F.greatest(near, F.lit(0.0)), F.floor(F.lit(most)) * row["n"]), F.lit(0.0)).cast("bigint")
        made = F.struct(row["doc_id"].alias("doc_id"), size.alias("size"), row["h"].alias("h"), row["n"].alias("n"), row["rate"].alias("rate"), total.alias("total"))
        return F.struct((owed - total * size).alias("owed"), F.concat(state["out"], F.array(made)).alias("out"))

    return F.aggregate(rows, start, add, lambda s: s["out"])


def _hash_of_row(docs: DataFrame) -> Column:
    plain = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields]
    return F.xxhash64(*plain)


def _allotted(docs: DataFrame, share: float, most: float, weights: tuple) -> DataFrame:
    """(doc_id, size, h, n, source_size, target, rate, total): total copies of n rows that agree in all columns, hash h."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").isNull().alias("no_source"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), n_words(F.col("text")).alias("size"), _hash_of_row(docs).alias("h"))
    entries = settle(own.groupBy(*_KEY, "doc_id", "size", "h").agg(F.count("*").alias("n")))
    sizes = settle(entries.groupBy(*_KEY, "size").agg(F.sum("n").alias("n"), F.count("*").alias("entries")))
    sources = settle(sizes.groupBy(*_KEY).agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("entries").alias("entries")))
    wanted = settle(targets(sources, share, most, weights).join(sources.select(*_KEY, "entries"), _KEY))
    solved = settle(tilts(sizes, wanted, most))
    rate = F.when(F.col("tilt").isNull(), F.when(F.col("target") > 0, F.lit(float(most))).otherwise(0.0)).otherwise(F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.log(F.lit(float(most))))))
    bucket = F.pmod(F.xxhash64("doc_id", "size", "h"), F.ceil(F.col("entries") / F.lit(BUCKET))).cast("int")
    row = F.struct((-F.col("size")).alias("minus"), "doc_id", "h", "n", F.least(rate, F.lit(float(most))).alias("rate"))
    rated = spread_join(entries, solved, _KEY).select(*_KEY, "source_size", "target", bucket.alias("bucket"), row.alias("row"))
    made = rated.groupBy(*_KEY, "source_size", "target", "bucket").agg(_rounded(F.sort_array(F.collect_list("row")), float(most)).alias("rows"))
    return made.select("source_size", "target", F.explode("rows").alias("r")).select("r.*", "source_size", "target")


def mix(docs: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """(doc_id, size, source_size, target, rate, copies) of every row of docs (doc_id, text, source).

    size counts words, null text has none; null sources are one source, last in order. Copies are 0 .. most; documents
    without words get none. Repeated rows count each time; of rows that agree in all columns, some get one copy more than
    others. The same rows give the same result, whatever their order or partitions. Empty table: no rows. Other columns
    only tell rows apart.
    """
    found = _allotted(docs, share, most, weights)
    each, more = F.floor(F.col("total") / F.col("n")), F.col("total") % F.col("n")
    ways = F.array(F.struct((each + 1).alias("copies"), more.alias("times")), F.struct(each.alias("copies"), (F.col("n") - more).alias("times")))
    rows = found.select("doc_id", "size", "source_size", "target", "rate", F.explode(ways).alias("way")).select("doc_id", "size", "source_size", "target", "rate", "way.*")
    return repeated(rows, "times")


def mixed(docs: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """docs with each row as often as the mix takes it; rows that it does not take go. Columns may have any names: rows
    travel as one struct. Rows that agree in all columns are taken together, as often as all of them should be."""
    keys = ["no_id", "doc_id", "size", "h"]
    known = lambda c: (c.isNull().alias("no_id"), F.coalesce(c.cast("long"), F.lit(0).cast("long")).alias("doc_id"))
    rows = docs.select(*known(F.col("doc_id")), n_words(F.col("text")).alias("size"), _hash_of_row(docs).alias("h"), F.struct("*").alias("row"))
    taken = settle(_allotted(docs, share, most, weights).filter("total > 0").select(*known(F.col("doc_id")), "size", "h", "n", "total"))
    once = repeated(rows.join(taken.filter("n = 1").drop("n"), keys).select("row", "total"), "total").select("row.*")
    many = taken.filter("n > 1").drop("n")
    if many.isEmpty():
        return once
    alike = rows.join(many, keys, "left_semi").groupBy(*keys).agg(F.any_value("row").alias("row"))
    return once.unionByName(repeated(alike.join(many, keys).select("row", "total"), "total").select("row.*"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate")
