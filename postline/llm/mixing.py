"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame functions only.

1. Sizes in words; targets by weight, none above ``most`` times its source's size (what is
   above is reshared by weight: the water level over sources sorted by limit per weight).
2. The documents of a source are dealt by a hash to about sqrt(rows) blocks. Its target
   is some whole passes over its blocks, then whole blocks in their permuted order, then a part
   of one block: documents in hash order, the last of them in part, so that the words taken
   are the rounded target exactly. Each (block, pass) is a draw; their number is the source's quota.
3. The quotas are split among the output shards by a binary tree. A node gives its left half
   a share of its draws without replacement, source by source, so the counts of a level are
   multivariate hypergeometric, and the leaves add up to the quotas exactly.
4. The draws of a source, permuted by hash, go to the shards by those counts; a shard is dealt by hash to parts,
   and the documents of a part are put in an order of their own by hash.

Defined cases: a null text has size 0, a null source is a source (the last one); documents of size 0 are
drawn with their block and take 0 words; equal rows are rows of their own; with no words at
all every target is 0; an empty table gives an empty mix; other columns are ignored. Only the table of
sources (a row for each) meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from postline.llm.common import WORD, cut, free_name

WEIGHTS = (5, 2, 1)
MOST = 3
SHARDS = 16
SEED = "mix-1"
PART_BYTES = 64 << 20


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(doc_id: Column, text: Column, seed: str) -> Column:
    """32 hex digits that fix a row's block and its place there."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, nth, docs, source_size, target) from (source, size): weights go round the sources by code point, null last."""
    own = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size"))
    own = own.withColumn("nth", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    own = own.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("nth") % len(weights) + 1))
    limit = most * F.col("source_size")
    own = own.withColumn("place", F.row_number().over(W.orderBy(limit / F.col("weight"), "nth")))
    before, after, whole = W.orderBy("place").rowsBetween(W.unboundedPreceding, -1), W.orderBy("place").rowsBetween(0, W.unboundedFollowing), W.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum(limit).over(before), F.lit(0))) / F.sum("weight").over(after)
    own = own.withColumn("level", level)
    first = F.min(F.when(limit / F.col("weight") >= F.col("level"), F.struct("place", "level"))).over(whole)
    own = own.withColumn("first", first)
    target = F.when(F.col("place") < F.col("first.place"), limit.cast("double")).otherwise(F.col("first.level") * F.col("weight"))
    return own.select("source", "nth", "docs", "source_size", target.alias("target"))


def split_quotas(quotas: DataFrame, shards: int, seed: str) -> DataFrame:
    """(nth, shard, draws) from (nth, draws): the splitting tree. Quotas of all sources are one row of the tree's root."""
    draw = F.struct(F.col("nth").cast("int").alias("nth"), F.col("draws").cast("long").alias("draws"))
    tree = quotas.agg(F.array_sort(F.collect_list(draw)).alias("q")).select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "q")
    while shards > 1:
        total = F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x["draws"])
        tree = tree.withColumn("mid", ((F.col("lo") + F.col("hi") + 1) / 2).cast("int")).withColumn("total", total)
        share = F.when(F.col("hi") - F.col("lo") > 1, F.expr("total * (mid - lo) div (hi - lo)")).otherwise(F.col("total"))

        def one_source(s, x):
            # of this source's draws, taken one by one, each goes left with the chance places left / draws left
            number = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.col("lo"), F.col("hi"), x["nth"], i), F.lit(1 << 53)) / F.lit(float(1 << 53))
            step = lambda t, i: F.struct((t["places"] - (number(i) * t["rest"] < t["places"]).cast("long")).alias("places"), (t["rest"] - 1).alias("rest"))
            start = F.struct(s["places"].alias("places"), s["rest"].alias("rest"))
            end = F.when(x["draws"] > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(x["draws"], F.lit(1).cast("long"))), start, step)).otherwise(start)
            return F.struct(end["places"].alias("places"), end["rest"].alias("rest"), F.concat(s["left"], F.array(s["places"] - end["places"])).alias("left"))

        zero = F.struct(share.cast("long").alias("places"), F.col("total").cast("long").alias("rest"), F.array().cast("array<bigint>").alias("left"))
        tree = tree.withColumn("left", F.when(F.col("hi") - F.col("lo") > 1, F.aggregate("q", zero, one_source, lambda s: s["left"])).otherwise(F.transform("q", lambda x: x["draws"])))
        half = lambda left: F.zip_with("q", "left", lambda x, n: F.struct(x["nth"].alias("nth"), (n if left else x["draws"] - n).alias("draws")))
        sides = F.array(F.struct("lo", F.when(F.col("hi") - F.col("lo") > 1, F.col("mid")).otherwise(F.col("hi")).alias("hi"), half(True).alias("q")), F.struct(F.col("mid").alias("lo"), F.col("hi").alias("hi"), half(False).alias("q")))
        tree = tree.select(F.explode(F.slice(sides, F.lit(1), F.when(F.col("hi") - F.col("lo") > 1, 2).otherwise(1))).alias("x")).select("x.*")
        tree = cut(tree, "tree")
        shards = (shards + 1) // 2
    return tree.select(F.col("lo").alias("shard"), F.explode("q").alias("x")).select("x.nth", "shard", "x.draws")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """A row for each row of docs: doc_id, source, key, size, source_size, target, taken, and draws.

    ``draws`` is an array of (shard, copy, words): words is null for a whole copy, else how many
    of the document's first words that copy has.
    """
    return _plan(sizes(docs, id_col, text_col, source_col, seed), shards, seed, weights, most)


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """(doc_id, source, size, bytes, key) of every row of docs."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("bytes"), row_key(F.col(id_col), F.col(text_col), seed).alias("key"))
    return cut(rows, "sizes")


def _plan(rows: DataFrame, shards: int, seed: str, weights: tuple[int, ...], most: int) -> DataFrame:
    aims = targets(rows, weights, most).withColumn("goal", F.floor(F.col("target") + 0.5).cast("long"))
    aims = aims.withColumn("passes", F.when(F.col("source_size") > 0, F.expr("goal div source_size")).otherwise(F.lit(0)).cast("long"))
    aims = aims.withColumn("rest", F.col("goal") - F.col("passes") * F.col("source_size")).withColumn("blocks", F.ceil(F.sqrt("docs")).cast("long"))
    aims = cut(aims, "targets")
    placed = rows.join(aims.withColumnRenamed("source", "_s"), rows.source.eqNullSafe(F.col("_s"))).select("doc_id", "source", "key", "size", "source_size", "target", "nth", F.expr("cast(conv(substring(key, 1, 15), 16, 10) as bigint) % blocks").alias("block"))
    placed = cut(placed, "placed")
    by_block = placed.groupBy("nth", "block").agg(F.sum("size").alias("words")).join(aims.select("nth", "passes", "rest"), "nth")
    before = F.coalesce(F.sum("words").over(W.partitionBy("nth").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.greatest(F.lit(0), F.least(F.col("words"), F.col("rest") - F.col("before")))
    by_block = by_block.withColumn("before", before).withColumn("last", F.when(F.col("words") > 0, left).otherwise(F.lit(0)).cast("long"))
    copies = F.col("passes") + (F.col("last") > 0).cast("long")
    by_block = cut(by_block.select("nth", "block", "words", "passes", "last", copies.alias("copies")), "blocks")

    leaves = split_quotas(by_block.groupBy("nth").agg(F.sum("copies").alias("draws")), shards, seed)
    upto = F.sum("draws").over(W.partitionBy("nth").orderBy("shard"))
    ends = leaves.withColumn("end", upto).groupBy("nth").agg(F.array_sort(F.collect_list("end")).alias("ends"))
    draws = by_block.where("copies > 0").select("nth", "block", "words", "passes", "last", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    draws = draws.withColumn("rank", F.row_number().over(W.partitionBy("nth").orderBy(F.xxhash64(F.lit(seed), "nth", "block", "copy"), "block", "copy")) - 1)
    draws = draws.join(ends, "nth").withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("rank"))))
    part = F.when((F.col("copy") > F.col("passes")) & (F.col("last") < F.col("words")), F.col("last"))
    drawn = draws.groupBy("nth", "block").agg(F.array_sort(F.collect_list(F.struct("copy", "shard", part.alias("words")))).alias("draws"))
    drawn = cut(drawn.withColumn("part", F.aggregate("draws", F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x["words"], F.lit(0)))), "draws")

    # the one block of a source that is taken in part: its documents in hash order, up to the words left
    begun = placed.join(drawn.where("part > 0").select("nth", "block", "part"), ["nth", "block"])
    ahead = F.coalesce(F.sum("size").over(W.partitionBy("nth", "block").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    got = F.greatest(F.lit(0), F.least(F.col("size"), F.col("part") - ahead)).cast("long")
    begun = begun.select("doc_id", "source", "key", "size", "source_size", "target", "nth", "block", got.alias("got"))
    rest = placed.join(drawn.where("part > 0").select("nth", "block"), ["nth", "block"], "left_anti").withColumn("got", F.lit(None).cast("long"))
    rows = rest.unionByName(begun).join(drawn, ["nth", "block"], "left")
    copies = F.transform(F.coalesce("draws", F.array().cast("array<struct<copy: bigint, shard: int, words: bigint>>")), lambda x: F.struct(x["shard"].alias("shard"), x["copy"].alias("copy"), F.when(x["words"].isNotNull(), F.coalesce("got", F.lit(0).cast("long"))).alias("words")))
    copies = F.filter(copies, lambda x: x["words"].isNull() | (x["words"] > 0))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x["words"], F.col("size")))
    return rows.withColumn("draws", copies).select("doc_id", "source", "key", "size", "source_size", "target", taken.alias("taken"), "draws")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS, seed: str = SEED, shard_col: str | None = "__shard", part_bytes: int = PART_BYTES) -> DataFrame:
    """The mix itself: all columns of docs and the shard, a row for each copy, in shards that are shuffled within.

    A shard is written in parts, dealt by hash, of about a quarter of ``part_bytes``, so tasks grow in
    number with the data and not in size. ``shard_col`` gets underscores where docs has that name; None leaves it out.
    """
    rows = sizes(docs, id_col, text_col, source_col, seed)
    total = rows.agg(F.sum("bytes").alias("b")).first().b or 0  # the mix has about as many words as docs
    tasks = max(shards, -(-total // part_bytes))
    parts = -(-4 * tasks // shards)
    planned = _plan(rows, shards, seed, WEIGHTS, MOST)
    # equal rows have the same key and the same fate, but for those of a part; number them to match one to one
    number = F.row_number().over(W.partitionBy("key").orderBy("place"))
    named = planned.select(F.col("key").alias("_key"), "draws")
    repeated = named.groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.first("draws").alias("draws"), F.count_distinct(F.col("draws").cast("string")).alias("kinds"))
    # rows of one key that are drawn alike need no number
    alike = cut(repeated.where("kinds <= 1").select("_key", "draws"), "alike")
    # the columns of docs travel as one struct, so none of their names can clash
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key(F.col(id_col), F.col(text_col), seed).alias("key"))
    one = whole.join(alike, F.col("key") == F.col("_key"))
    unlike = cut(named.join(repeated.where("kinds > 1").select("_key"), "_key"), "unlike")
    numbered = unlike.withColumn("_at", F.row_number().over(W.partitionBy("_key").orderBy(F.col("draws").cast("string"))))
    other = whole.join(unlike.select("_key").distinct(), F.col("key") == F.col("_key"), "left_semi").withColumn("place", F.lit(0)).withColumn("at", number)
    other = other.join(numbered, (F.col("key") == F.col("_key")) & (F.col("at") == F.col("_at")))
    drawn = one.select("row", "key", "draws").unionByName(other.select("row", "key", "draws")).select("row", "key", F.explode("draws").alias("draw"))
    text = F.col("row").getField(text_col)
    first = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), F.col("draw.words").cast("int")), "")
    order = F.xxhash64("key", "draw.copy", F.lit(seed))
    drawn = drawn.select("row", F.when(F.col("draw.words").isNotNull(), first).otherwise(text).alias("text"), F.col("draw.shard").alias("shard"), order.alias("order"), F.pmod(F.xxhash64(order, F.lit(1)), F.lit(parts)).alias("part"))
    drawn = drawn.repartition(tasks, "shard", "part").sortWithinPartitions("shard", "part", "order")
    columns = [F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns]
    return drawn.select(*columns, *([F.col("shard").alias(free_name(docs, shard_col))] if shard_col else []))


def mixing(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the shards of its copies (comma-joined, a number for each copy), for every row of docs."""
    shards = F.array_join(F.transform("draws", lambda x: x["shard"].cast("string")), ",")
    return plan(docs).select("doc_id", "size", "source_size", "target", "taken", shards.alias("shards"))
