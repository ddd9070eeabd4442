"""Mixing sources to target weights, with DataFrame operations only.

Each source's documents, in a fixed order, form one stream of words which is packed into blocks of `block`
words. A source's target, in blocks, is its number of slots. Every slot of every output shard draws its
source by a hash, with the targets as weights: the counts of the sources in a shard are a multinomial draw.
A source's slots are numbered through the shards by these counts. As draws come near the targets only,
those of a source beyond its number of slots go, in order, to the sources drawn too seldom; so no
source is used beyond its target, and no document more than `most` times.

Slot i of a source is slot i % blocks of pass i / blocks over its blocks, and maps to a block through a keyed
permutation of the source's block numbers (a swap-or-not network: a bijection on [0, n) for any n, computed
per row). Slots then join the blocks by (source, block number).

Edge cases: a null source is a source of its own and comes last; null or empty texts have
size 0 and are taken 0 times; a source without words has target 0; repeated rows count as
documents of their own, and of rows that agree in id and size their hash tells the order; a document longer than a block is in several; an empty table gives an empty result;
other columns are ignored, and kept by `mix_documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free, settle, words

ROUNDS = 12
#: Documents of a source are laid out in this many runs, so that no task orders a whole source.
RUNS = 1021


def _keys(tag: str, n: str) -> str:
    """SQL for the round keys of a permutation of [0, n)."""
    return (
        f"transform(sequence(1, {ROUNDS}), r -> named_struct('tag', concat({tag}, ':', r), 'k',"
        f" cast(conv(substr(md5(concat({tag}, ':', r)), 1, 12), 16, 10) AS bigint) % greatest({n}, 1L)))"
    )


def _permute(x: str, keys: str, n: str) -> str:
    """SQL for the image of x, 0 <= x < n. Each round maps x to k - x mod n, or leaves both as they are."""
    return (
        f"aggregate({keys}, cast({x} AS bigint), (x, s) -> CASE WHEN substr(md5(concat(s.tag, ':', greatest(x, pmod(s.k - x, {n})))), 1, 1) < '8'"
        f" THEN pmod(s.k - x, {n}) ELSE x END)"
    )


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, source and size (words) of each row of documents."""
    return docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """One row for each source: source, source_size, weight, target.

    Sources ordered by code point, nulls last, weigh as `weights` says, repeating. Targets share all
    words by weight; none exceeds `most` times its source, and the excess goes to the others by weight.
    Ranking and levelling order the table of sources, one row each, in one task.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by.withColumn("at", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("at") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    level = Window.orderBy(F.col("cap") / F.col("weight"), "at")
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = ranked.withColumn("words", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    left = left.withColumn("weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # Below the level, sources stay at their cap; the first above it fixes the level for all the others.
    above = (F.col("cap").cast("double") / F.col("weight")) >= (F.col("words").cast("double") / F.col("weights"))
    first = F.min(F.when(above, F.struct((F.col("cap") / F.col("weight")).alias("r"), "at", (F.col("words").cast("double") / F.col("weights")).alias("v")))).over(everything)
    target = F.when(above, F.col("weight") * first["v"]).otherwise(F.col("cap").cast("double"))
    return left.select("source", "source_size", "weight", target.alias("target"))


def planned(target: DataFrame, block: int = 512, seed: int = 0, most: int = 3) -> DataFrame:
    """For each source with words: its number `id`, its slots' number n, and what maps a slot to a block. Orders the table of sources, one row each, in one task."""
    want = f"least(cast(round(target) AS bigint), {most} * source_size)"
    plan = target.filter("source_size > 0").selectExpr(
        "source", "source_size", f"{want} AS want", f"source_size div {block} AS whole", f"source_size % {block} AS rest",
        f"cast(ceil(source_size / {block}) AS bigint) AS blocks",
        f"concat('{seed}', coalesce(concat(':s', source), ':n')) AS tag",
    )
    plan = plan.selectExpr("*", "want div source_size AS full", "want % source_size AS part")
    plan = plan.selectExpr("*", f"full * blocks + cast(ceil(part / {block}) AS bigint) AS n", f"{_keys('tag', 'whole')} AS keys").filter("n > 0")
    return plan.withColumn("id", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))


def _ranged(plan: DataFrame, n: str) -> DataFrame:
    """id and first, the sum of column n over the sources before, of the sources with n > 0; and `all`, the sum over all."""
    some = plan.filter(F.col(n) > 0)
    before = F.coalesce(F.sum(n).over(Window.orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return some.select("id", before.alias("first"), F.col(n).alias("n"), F.sum(n).over(Window.partitionBy()).alias("all"))


def _located(rows: DataFrame, ranged: DataFrame, cell: int = 8192) -> DataFrame:
    """rows (with `v`) with the id and first of the source in whose range v lies. Cells of equal width keep a wide range from one task."""
    starts = ranged.selectExpr("id", "first", f"explode(sequence(first div {cell}, (first + n - 1) div {cell})) AS cell")
    names = rows.columns
    starts = starts.select("cell", F.greatest("first", F.col("cell") * cell).alias("v"), F.lit(0).alias("kind"), F.struct("id", "first").alias("held"))
    both = rows.withColumn("cell", F.expr(f"v div {cell}")).withColumn("kind", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    last = F.last("held", ignorenulls=True).over(Window.partitionBy("cell").orderBy("v", "kind").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("held", last).filter("kind = 1").select(*names, "held.*")


def drawn(plan: DataFrame, seed: int = 0, shard_slots: int = 4096) -> DataFrame:
    """place and id: the source that each place of the mix draws, with the sources' slots as weights."""
    ranged = _ranged(plan, "n")
    parts = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # One row is cut into runs of places before they are listed; the number of partitions is fixed, as rows are few until then.
    runs = ranged.select("all").limit(1).selectExpr("all", f"explode(sequence(0L, (all - 1) div {shard_slots})) AS shard").repartition(parts, "shard")
    places = runs.selectExpr("all", f"explode(sequence(shard * {shard_slots}, least(shard * {shard_slots} + {shard_slots - 1}, all - 1))) AS place")
    places = places.selectExpr("place", f"cast(conv(substr(md5(concat('{seed}', ':draw:', place)), 1, 12), 16, 10) AS bigint) % all AS v")
    return _located(places, ranged).select("place", "id")


def shard_counts(draws: DataFrame, shard_slots: int = 4096) -> DataFrame:
    """shard, id and count: how often each shard draws each source."""
    return draws.groupBy(F.expr(f"place div {shard_slots}").alias("shard"), "id").agg(F.count(F.lit(1)).alias("count"))


def slots(target: DataFrame, block: int = 512, seed: int = 0, shard_slots: int = 4096, most: int = 3, salt: int = 64) -> DataFrame:
    """Rows (shard, place, source, epoch, block, take): the mix, a block at a time.

    `take` is the number of words used from the block's start; it is the block's length but for the
    last slot of a source, so each source's words come to its rounded target.
    """
    plan = settle(planned(target, block, seed, most), "plan")
    draws = settle(drawn(plan, seed, shard_slots), "draws")
    counts = shard_counts(draws, shard_slots)
    head = F.coalesce(F.sum("count").over(Window.partitionBy("id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = counts.select("shard", "id", head.alias("head"))
    within = F.row_number().over(Window.partitionBy("id", "shard").orderBy("place")) - 1
    numbered = draws.withColumn("shard", F.expr(f"place div {shard_slots}")).withColumn("_i", within).join(heads, ["shard", "id"])
    numbered = settle(numbered.select("place", "id", (F.col("head") + F.col("_i")).alias("slot")), "numbered")
    sums = settle(plan.select("id", "n").join(counts.groupBy("id").agg(F.sum("count").alias("drawn")), "id", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0))), "drawn")
    # Draws beyond a source's slots are numbered through all sources; the ranges of those drawn too seldom take them up.
    over = _ranged(sums.withColumn("over", F.greatest(F.col("drawn") - F.col("n"), F.lit(0))), "over").select("id", F.col("first").alias("_first"))
    under = _ranged(sums.withColumn("under", F.greatest(F.col("n") - F.col("drawn"), F.lit(0))), "under")
    salted = lambda df: df.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    met = numbered.withColumn("_t", F.pmod("place", F.lit(salt)).cast("int"))
    marked = met.join(salted(sums.join(over, "id", "left")), ["id", "_t"])
    own = marked.filter("slot < n").select("place", "id", "slot")
    moved = _located(marked.filter("slot >= n").selectExpr("place", "_first + slot - n AS v"), under)
    moved = moved.join(sums.select("id", "drawn"), "id").selectExpr("place", "id", "drawn + v - first AS slot")
    each = own.unionByName(moved).withColumn("_t", F.pmod("place", F.lit(salt)).cast("int")).join(salted(plan), ["id", "_t"])
    each = each.selectExpr("*", "slot div blocks AS epoch", "slot % blocks AS q")
    each = each.selectExpr("*", f"CASE WHEN q >= whole THEN whole ELSE {_permute('q', 'keys', 'whole')} END AS block")
    take = f"CASE WHEN epoch = full AND (q + 1) * {block} > part THEN part - q * {block} WHEN block = whole THEN rest ELSE {block} END"
    return each.selectExpr(f"place div {shard_slots} AS shard", "place", "source", "epoch", "block", f"cast({take} AS bigint) AS take")


def laid_out(sized: DataFrame, runs: int = RUNS) -> DataFrame:
    """sized with `first`, the number of words before the document in its source's stream."""
    cut = sized.withColumn("run", F.coalesce(F.pmod(F.col("doc_id"), F.lit(runs)), F.pmod(F.col("size"), F.lit(runs))))
    heads = cut.groupBy("source", "run").agg(F.sum("size").alias("run_size"))
    head = F.coalesce(F.sum("run_size").over(Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = heads.select(F.col("source").alias("_s"), F.col("run").alias("_r"), head.alias("head"))
    within = Window.partitionBy("source", "run").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = cut.join(heads, cut["source"].eqNullSafe(heads["_s"]) & (cut["run"] == heads["_r"]))
    return joined.select(*sized.columns, (F.col("head") + F.col("before")).alias("first"))


def taken(laid: DataFrame, mix: DataFrame, block: int = 512, more: tuple[str, ...] = ()) -> DataFrame:
    """laid with `uses`: for each pass that takes words of the document, structs (epoch, at, n, and `more` of the slot): n words from word `at` on.

    Documents' block ranges join the slots by (source, block); both keys spread a hot source.
    """
    spans = laid.filter("size > 0").selectExpr(
        "doc_id", "source", "size", "first", f"explode(sequence(first div {block}, (first + size - 1) div {block})) AS b"
    )
    use = mix.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "epoch", "take", *more)
    # Listed slots outgrow the rows Spark measured before listing, so it must not broadcast them.
    met = spans.join(use.hint("merge"), spans["source"].eqNullSafe(use["_s"]) & (spans["b"] == use["_b"]))
    met = met.selectExpr(
        "doc_id", "source", "size", "first", "epoch", *more, f"greatest(b * {block}, first) - first AS at",
        f"least(b * {block} + take, first + size) - greatest(b * {block}, first) AS n",
    ).filter("n > 0")
    uses = met.groupBy("doc_id", "source", "size", "first").agg(F.sort_array(F.collect_list(F.struct("epoch", "at", "n", *more))).alias("uses"))
    uses = uses.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("first").alias("_f"), "uses")
    on = laid["doc_id"].eqNullSafe(uses["_d"]) & laid["source"].eqNullSafe(uses["_s"]) & (laid["size"] == uses["_z"]) & (laid["first"] == uses["_f"])
    return laid.join(uses, on, "left").drop("_d", "_s", "_z", "_f")


def mix_digest(docs: DataFrame, block: int = 512, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    sized = settle(measure(docs), "sizes")
    target = settle(targets(sized), "targets")
    out = taken(laid_out(sized), slots(target, block, seed), block)
    t = target.select(F.col("source").alias("_s"), "source_size", "target")
    # The table of sources is joined by shuffle unless Spark measures it to be small; runs spread a hot source.
    salt = 16
    out = out.withColumn("_salt", F.coalesce(F.pmod(F.col("doc_id"), F.lit(salt)), F.lit(0)))
    t = t.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    out = out.join(t, out["source"].eqNullSafe(t["_s"]) & (out["_salt"] == t["_t"]))
    return out.select(
        "doc_id", "size", "source_size", "target",
        F.coalesce(F.aggregate("uses", F.lit(0).cast("long"), lambda a, u: a + u["n"]), F.lit(0)).cast("long").alias("taken"),
    )


def mix_placed(docs: DataFrame, block: int = 512, seed: int = 0, shard_slots: int = 4096, sized: DataFrame | None = None, target: DataFrame | None = None) -> tuple[DataFrame, str, str]:
    """The mix as rows of documents: one for each shard and pass over a document, with the words that the pass has in the shard; and
    the names of two more columns, the shard and the first place of these words.

    A pass that takes the whole document in one shard keeps its text; otherwise the taken words are joined by single
    spaces, in order. n_chars, where there is one, is the new text's length. Documents not drawn go.
    """
    held, owned = [], list(docs.columns)

    def name(x: str) -> str:
        held.append(free(x, [*owned, *held]))
        return held[-1]

    size, d, s, z, n, m, uses_, e, mine_, words_, shard_, place_ = map(name, ("_size", "_d", "_s", "_z", "_n", "_m", "_uses", "_e", "_mine", "_words", "_shard", "_place"))
    numbered = docs.withColumn(size, F.size(words(F.col("text"))).cast("long"))
    sized = settle(measure(docs), "sizes") if sized is None else sized
    target = settle(targets(sized), "targets") if target is None else target
    laid = taken(laid_out(sized), slots(target, block, seed, shard_slots), block, ("shard", "place"))
    # Rows that agree in doc_id, source and size are told apart by their order among equals.
    laid = laid.filter("uses IS NOT NULL OR size > 0").withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy("first")))
    laid = laid.filter("uses IS NOT NULL").select(F.col("doc_id").alias(d), F.col("source").alias(s), F.col("size").alias(z), F.col("_n").alias(n), F.col("uses").alias(uses_))
    numbered = numbered.withColumn(m, F.row_number().over(Window.partitionBy("doc_id", "source", size).orderBy(F.xxhash64("text"))))
    on = numbered["doc_id"].eqNullSafe(laid[d]) & numbered["source"].eqNullSafe(laid[s]) & (numbered[size] == laid[z]) & (numbered[m] == laid[n])
    met = numbered.join(laid, on).withColumn(e, F.explode(F.array_distinct(F.transform(uses_, lambda u: F.struct(u["epoch"].alias("epoch"), u["shard"].alias("shard"))))))
    mine = F.filter(uses_, lambda u: (u["epoch"] == F.col(f"{e}.epoch")) & (u["shard"] == F.col(f"{e}.shard")))
    met = met.withColumn(mine_, mine).withColumn(words_, F.aggregate(mine_, F.lit(0).cast("long"), lambda a, u: a + u["n"]))
    part = F.transform(F.array(words(F.col("text"))), lambda w: F.array_join(F.flatten(F.transform(mine_, lambda u: F.slice(w, (u["at"] + 1).cast("int"), u["n"].cast("int")))), " "))[0]
    met = met.withColumn("text", F.when(F.col(words_) == F.col(size), F.col("text")).otherwise(part))
    if "n_chars" in docs.columns:
        met = met.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return met.select(*docs.columns, F.col(f"{e}.shard").alias(shard_), F.array_min(F.transform(mine_, lambda u: u["place"])).alias(place_)), shard_, place_


def mix_documents(docs: DataFrame, block: int = 512, seed: int = 0, shard_slots: int = 4096) -> DataFrame:
    """The rows of mix_placed in the order of the shards and of the places in them, with the columns of docs."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = settle(measure(docs), "sizes")
    target = settle(targets(sized), "targets")
    every = planned(target, block, seed).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    placed, _, place = mix_placed(docs, block, seed, shard_slots, sized, target)
    # Places are numbered from 0, so their ranges are known and nothing need be sampled.
    at = F.expr(f"cast(`{place}` * {parts} div {max(every, 1)} AS int)")
    return placed.repartitionById(parts, at).sortWithinPartitions(place).select(*docs.columns)
