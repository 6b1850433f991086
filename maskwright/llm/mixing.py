"""Mixing sources to target weights, in blocks of a fixed number of words.

1. Each source's documents, in a fixed order, form one stream of words, packed into blocks of ``BLOCK``
   words. Packing is arithmetic on running totals, which are summed in chunks: no window holds a source.
2. Targets: sources in code point order (null last) weigh 5, 2, 1, repeating. A source gets at most
   three times its words; what that leaves over goes to the others by weight. Filling up to a common
   level in the order of cap / weight gives this in one pass.
3. Every output shard of ``SHARD`` slots draws its multinomial source counts. Running totals turn a
   shard's count into draw numbers of the source. Draws beyond the source's quota of blocks lapse, and
   a source that fell short makes up the rest in shards of its own, so quotas are met exactly.
4. Draw number n of a source with b blocks takes block perm(n mod b), where perm is a swap-or-not
   permutation, another one for each turn n div b. Documents meet draws by (source, block).

Everything follows from hashes of ``seed``, sources and numbers: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.llm import common as C

BLOCK = 64
SHARD = 4096
CHUNKS = 4096
WEIGHTS = (5, 2, 1)
MOST = 3
ROUNDS = 12
CELLS = 4096


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(C.WORD)), F.lit(0)).cast("bigint")


def _key() -> Column:
    """The source with null as a value of its own."""
    return F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))


def sized(docs: DataFrame) -> DataFrame:
    """(key, source, doc_id, size): ``key`` is the source with null as a value of its own."""
    return docs.select(_key().alias("key"), "source", "doc_id", words_in(F.col("text")).alias("size"))


def targets(sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per source: source_size, target, blocks, quota (of blocks) and first (quotas of those before).

    One task holds one row per source.
    """
    sources = sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy()
    place = (F.row_number().over(named) - 1) % len(WEIGHTS)
    weights = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), place.cast("int") + 1)
    rows = sources.select("*", weights.alias("weight")).select(
        "*", (MOST * F.col("source_size")).cast("double").alias("cap"),
        F.sum("source_size").over(everything).cast("double").alias("all_words"), F.sum("weight").over(everything).alias("all_weight"),
    )
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("key"))
    earlier = filling.rowsBetween(Window.unboundedPreceding, -1)
    capped = F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))
    gone = F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    rows = rows.withColumn("level", (F.col("all_words") - capped) / (F.col("all_weight") - gone))
    # The level at the first source below its cap holds for all after it.
    level = F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "key", "level"))).over(everything)
    target = F.least(F.col("cap"), F.coalesce(level["level"] * F.col("weight"), F.col("cap")))
    blocks = F.ceil(F.col("source_size") / block).cast("bigint")
    rows = rows.select("key", "source", "source_size", target.alias("target"), blocks.alias("blocks"))
    quota = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0)
    return rows.withColumn("quota", quota.cast("bigint")).withColumn(
        "first", F.sum("quota").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0)) - F.col("quota")
    )


def permuted(n: Column, size: Column, seed: Column) -> Column:
    """A pseudorandom permutation of 0..size-1 by ``ROUNDS`` rounds of swap-or-not; it needs no table."""

    def swap(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(seed, r), size) - x, size)
        return F.when(F.xxhash64(seed, r, F.greatest(x, partner)) % 2 == 0, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), n, swap)


def draws(sources: DataFrame, seed: int = 0, shard: int = SHARD) -> DataFrame:
    """(shard, key, n, block): block ``block`` of ``key`` fills a slot of ``shard``, as draw ``n`` of its source.

    ``shard`` is negative where a source makes up for what the multinomial draws left it short of.
    """
    spark = sources.sparkSession
    slots = sources.agg(F.sum("quota")).first()[0] or 0
    width = max(1, -(-slots // CELLS))
    # At most CELLS rows more than there are sources: each source lies in the cells that it touches.
    filled = sources.filter("quota > 0")
    cells = filled.select(
        "key", "first", (F.col("first") + F.col("quota")).alias("end"),
        F.explode(F.sequence((F.col("first") / width).cast("bigint"), ((F.col("first") + F.col("quota") - 1) / width).cast("bigint"))).alias("cell"),
    )
    drawn = spark.range(slots).select(
        (F.col("id") / shard).cast("bigint").alias("shard"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(1, slots))).alias("at")
    ).withColumn("cell", (F.col("at") / width).cast("bigint"))
    counts = (
        drawn.join(F.broadcast(cells), "cell").filter("at >= first AND at < end")
        .groupBy("shard", "key").agg(F.count(F.lit(1)).alias("count"))
        .withColumn("chunk", (F.col("shard") / 1024).cast("bigint"))
    )
    starts = C.running_totals(counts, "key", "chunk", ["shard"], "count", "start")
    totals = counts.groupBy("key").agg(F.sum("count").alias("start"))
    short = (
        filled.join(totals, "key", "left").withColumn("start", F.coalesce("start", F.lit(0)))
        .select("key", F.lit(-1).cast("bigint").alias("shard"), "start", F.col("quota").alias("end"), "quota", "blocks")
    )
    spans = starts.join(filled.select("key", "quota", "blocks"), "key").select(
        "key", "shard", "start", F.least(F.col("start") + F.col("count"), F.col("quota")).alias("end"), "quota", "blocks"
    )
    # Few narrow rows become many: they are dealt out first, or adaptive execution would put them in one task.
    dealt = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = spans.unionByName(short.select(*spans.columns)).filter("start < end").repartition(dealt, "key", "shard").select(
        "shard", "key", "blocks", F.explode(F.sequence("start", F.col("end") - 1)).alias("n")
    )
    turn = (F.col("n") / F.col("blocks")).cast("bigint")
    block = permuted(F.col("n") % F.col("blocks"), F.col("blocks"), F.xxhash64(F.lit(seed), "key", turn))
    return numbered.select("shard", "key", "n", block.alias("block"))


def placed(sizes: DataFrame) -> DataFrame:
    """Adds ``start``: the words of the source before each document."""
    rows = sizes.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(CHUNKS)))
    return C.running_totals(rows, "key", "chunk", ["doc_id", "size"], "size", "start").drop("chunk")


def pieces(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document and block that it reaches into, with the words it has there."""
    first, last = (F.col("start") / block).cast("bigint"), ((F.col("start") + F.col("size") - 1) / block).cast("bigint")
    cut = rows.filter("size > 0").select("*", F.explode(F.sequence(first, last)).alias("block"))
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    return cut.withColumn("words", end - F.greatest(F.col("start"), F.col("block") * block))


def taken(docs: DataFrame, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words that the mix takes, repeats counted).

    A null source is a source; a null or blank text has no words and none are taken; rows that repeat
    a doc_id are documents of their own. No block is drawn more than three times.
    """
    sizes = C.checkpointed(placed(sized(docs)))
    sources = C.checkpointed(targets(sizes, block))
    times = draws(sources, seed).groupBy("key", "block").agg(F.count(F.lit(1)).alias("times"))
    got = (
        pieces(sizes, block).join(times, ["key", "block"], "left")
        .groupBy("key", "start", "doc_id", "size").agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"))
    )
    none = sizes.filter("size = 0").select("key", "start", "doc_id", "size", F.lit(0).cast("bigint").alias("taken"))
    # The table of sources is not marked for broadcast: Spark sees its size.
    return got.unionByName(none).join(sources.select("key", "source", "source_size", "target"), "key").select(
        "doc_id", "size", "source_size", "target", "taken", "source"
    )


def mixed_blocks(docs: DataFrame, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """The mix itself: (shard, source, n, block, tokens), each block with its words in order."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(C.WORD), F.lit(0))
    rows = docs.select(_key().alias("key"), "source", "doc_id", words.alias("list")).withColumn("size", F.size("list").cast("bigint"))
    sizes = placed(rows)
    sources = C.checkpointed(targets(sizes.select("key", "source", "doc_id", "size"), block))
    begin = F.greatest(F.col("start"), F.col("block") * block)
    part = pieces(sizes, block).select(
        "key", "source", "block", begin.alias("begin"), F.slice("list", (begin - F.col("start") + 1).cast("int"), F.col("words").cast("int")).alias("part")
    )
    packed = part.groupBy("key", "source", "block").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("begin", "part"))), lambda p: p["part"])).alias("tokens")
    )
    return draws(sources, seed).join(packed, ["key", "block"]).select("shard", "source", "n", "block", "tokens")


def repeat_documents(docs: DataFrame, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """The documents as often as the mix takes them: taken / size times, rounded so that each source keeps its words.

    Keeps the input's columns. Rows that repeat a doc_id in a source and have equal sizes share what is
    taken of them. A document of rate r has floor(r) copies or one more, the latter by a hash that the
    fraction outweighs more or less. In the order of that difference, documents get one more until their
    words come to what the source's fractions come to: a source is off by half a document at most.
    Which of several rows with equal doc_id, source and text get it is left open.
    """
    unit = ["key", "doc_id", "size", "print"]
    text = F.col("text")
    rows = C.whole_rows(docs, key=_key(), doc_id=F.col("doc_id"), size=words_in(text), print=F.xxhash64(text)).filter("size > 0")
    # Of ``all`` rows together, ``rest`` words remain beside ``least`` whole copies of each.
    rates = (
        taken(docs, seed, block).filter("size > 0").groupBy(_key().alias("key"), "doc_id", "size")
        .agg(F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("all")).filter("taken > 0")
        .select("key", F.col("doc_id").alias("id"), "size", "all", F.expr("taken div (all * size)").alias("least"), F.expr("taken % (all * size)").alias("rest"))
    )
    units = rows.groupBy(*unit).agg(F.count(F.lit(1)).alias("rows"))
    units = units.join(rates, (units["key"] == rates["key"]) & units["doc_id"].eqNullSafe(rates["id"]) & (units["size"] == rates["size"])).select(
        *[units[c] for c in unit], "rows", "all", "least", "rest"
    )
    chance = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "print"), F.lit(1 << 20)) / (1 << 20)
    units = units.withColumn("late", chance - F.col("rest") / (F.col("all") * F.col("size")))
    units = units.withColumn("chunk", F.floor((F.col("late") + 1) * (CHUNKS // 2))).withColumn(
        "words", F.when(F.col("rest") > 0, F.col("rows") * F.col("size")).otherwise(0)
    )
    # Goals are counted in 1024ths of a word: sums of whole numbers are the same in every order.
    chunks = units.groupBy("key", "chunk").agg(F.sum("words").alias("words"), F.sum(F.expr("rest * rows * 1024 div all")).alias("goal"))
    earlier = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    chunks = chunks.select(
        "key", "chunk", (F.sum("words").over(earlier) - F.col("words")).alias("before"), F.sum("goal").over(Window.partitionBy("key")).alias("goal")
    )
    inside = Window.partitionBy("key", "chunk").orderBy("late", "doc_id", "size", "print").rowsBetween(Window.unboundedPreceding, 0)
    within = units.withColumn("within", F.sum("words").over(inside) - F.col("words"))
    open_words = F.col("goal") / 1024 - F.col("before") - F.col("within")
    more = F.least(F.col("rows"), F.greatest(F.lit(0), F.floor(open_words / F.col("size") + 0.5)))
    copies = (
        within.join(chunks, ["key", "chunk"]).withColumn("more", F.when(F.col("rest") > 0, more).otherwise(0)).filter("least > 0 OR more > 0")
        .select(F.col("key").alias("k"), F.col("doc_id").alias("id"), F.col("size").alias("n"), F.col("print").alias("p"), "least", "more")
    )
    same = (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("size") == F.col("n")) & (F.col("print") == F.col("p"))
    number = F.row_number().over(Window.partitionBy(*unit).orderBy(F.lit(0)))
    found = rows.join(copies, same).withColumn("copies", (F.col("least") + (number <= F.col("more")).cast("int")).cast("int"))
    return found.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: one row per document of the whole table."""
    return taken(C.documents(spark, sf_dir, "doc_id", "text", "source"))
