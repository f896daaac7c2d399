"""Mixing sources to target weights with DataFrame operations only.

Words are packed into blocks of fixed length, output shards draw multinomial source counts, and slots take blocks
through each source's pseudorandom permutation of block indexes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, row_key, stored

#: Cells of the unit interval under which drawn numbers and sources' shares meet, at least.
CELLS = 4096
#: Rounds of the permutation, and how often a place outside is permuted on at most.
ROUNDS, WALKS = 4, 64
#: Blocks that a source has at least, where its words suffice; small sources have shorter blocks.
LEAST_BLOCKS = 256
#: What tells rows apart, where the table has it.
IDENTITY = ("doc_id", "text", "lang", "source", "n_chars")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_rank, source_size, weight, target) from (source, source_size).

    Sources by code point, null last, take ``weights`` in turn and divide ``share`` of all sizes by weight. A
    target stops at ``most`` times its source's size, and what is over is shared again by weight until none
    is above: all sources below a level have their full amount, the rest their weight times the level. The
    table has one row per source, so its windows are small.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("source_rank", F.row_number().over(by_name).cast("long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("source_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    full = ranked.withColumn("weight", weight).withColumn("full", F.col("source_size") * F.lit(most))
    level = Window.orderBy(F.col("full") / F.col("weight"), "source_rank")
    over = full.select(
        "*",
        F.coalesce(F.sum("full").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("full_before"),
        F.sum("weight").over(level.rowsBetween(0, Window.unboundedFollowing)).alias("weight_left"),
        (F.sum("source_size").over(Window.partitionBy()) * F.lit(share)).alias("total"),
    ).withColumn("level", (F.col("total") - F.col("full_before")) / F.col("weight_left"))
    capped = over.withColumn("fits", F.col("full") <= F.col("weight") * F.col("level"))
    open_level = F.min(F.when(~F.col("fits"), F.struct(F.col("full_before").alias("b"), "level"))).over(Window.partitionBy())
    return capped.withColumn("open", open_level).select("source", "source_rank", "source_size", "weight", F.when(F.col("fits"), F.col("full")).otherwise(F.col("weight") * F.col("open.level")).alias("target"))


def positions(docs: DataFrame) -> DataFrame:
    """(doc_id, key_a, key_b, source, size, start): where each document's words stand in its source's stream.

    A source's documents follow one another by (bucket, doc_id, key), with about as many buckets as a bucket has
    documents, so that no window holds a whole source: starts add up within a bucket and over buckets apart. The key names a
    row by all its values; equal rows share it and have places of their own.
    """
    sized = stored(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *row_key(*[c for c in IDENTITY if c in docs.columns])))
    rows = sized.count()
    buckets = 1 << max(4, (max(rows, 1).bit_length() + 1) // 2)
    placed = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "key_a", F.lit("bucket")), F.lit(buckets)))
    held = placed.groupBy("source", "bucket").agg(F.sum("size").alias("held"))
    before = held.select("source", "bucket", (F.sum("held").over(Window.partitionBy("source").orderBy("bucket")) - F.col("held")).alias("before"))
    inside = Window.partitionBy("source", "bucket").orderBy("doc_id", "key_a", "key_b").rowsBetween(Window.unboundedPreceding, -1)
    a = placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    on = a["source"].eqNullSafe(before["source"]) & (a["bucket"] == before["bucket"])
    return a.join(before, on).select("doc_id", "key_a", "key_b", a["source"], "size", (F.col("before") + F.col("inside")).alias("start"))


def _unit(*columns: Column) -> Column:
    """A number in [0, 1) drawn from the values alone, the same on every run."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / F.lit(float(1 << 53))


def permuted(k: Column, n: Column, *key: Column) -> Column:
    """The place of index k modulo n under a keyed permutation of 0 .. n - 1, by expressions alone.

    An index is a pair (left, right) below a = ceil(sqrt(n)) and b = ceil(n / a); each round of a Feistel network adds a keyed hash of one
    half to the other, modulo its size, which can be undone. Of the a * b places fewer than a lie beyond n; an index that lands there goes
    on from its place until it is below n, so all of 0 .. n - 1 are met once. A walk longer than ``WALKS`` stops the query (it needs
    as many places outside in a row: impossible up to 4,096 blocks, and of probability n ** -32 beyond).
    """
    bound = F.struct(F.pmod(k, n).alias("x"), n.alias("n"), F.ceil(F.sqrt(n.cast("double"))).cast("long").alias("a"))
    return _let(bound, lambda v: _let(F.struct(v["x"].alias("x"), v["n"].alias("n"), v["a"].alias("a"), F.ceil(v["n"] / v["a"]).cast("long").alias("b")), lambda w: _walk(w, key)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out, and stands in the plan, once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _once(x: Column, a: Column, b: Column, key: tuple[Column, ...], i: int = 0) -> Column:
    """One pass of the network, two rounds at a time."""
    if i == ROUNDS:
        return x

    def two(h: Column) -> Column:
        left = F.pmod(h["left"] + F.pmod(F.xxhash64(*key, F.lit(i), h["right"]), a), a)
        whole = _let(left, lambda new: new * b + F.pmod(h["right"] + F.pmod(F.xxhash64(*key, F.lit(i + 1), new), b), b))
        return _let(whole, lambda y: _once(y, a, b, key, i + 2))

    return _let(F.struct(F.floor(x / b).cast("long").alias("left"), F.pmod(x, b).alias("right")), two)


def _walk(w: Column, key: tuple[Column, ...]) -> Column:
    """The first place below n on the way from x; nearly always it is the next one."""
    on = lambda x: _once(x, w["a"], w["b"], key)
    further = lambda p: F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), p, lambda x, _: F.when(x < w["n"], x).otherwise(on(x)))
    ended = lambda x: F.when(x < w["n"], x).otherwise(F.raise_error(F.lit("a block's walk did not end")).cast("long"))
    return _let(on(w["x"]), lambda p: F.when(p < w["n"], p).otherwise(_let(further(p), ended)))


def manifest(sources: DataFrame, block: int, seed: int) -> DataFrame:
    """(shard, source_rank, block): the block that each slot of each output shard takes.

    ``sources`` has source_rank, source_size, target, and block where its blocks' words are not ``block``. A source's quota of
    slots is its target in blocks. Every slot of every shard draws its source with
    the targets' probabilities, so a shard's counts are multinomial. Draws beyond a source's quota go, in
    shard order, to the sources left short, so that totals are the quotas. The k-th slot of a source takes the block in place
    k of the source's own permutation; a block comes up again only after all others.
    """
    words = F.col("block") if "block" in sources.columns else F.lit(block)
    blocks = F.ceil(F.col("source_size") / words).cast("long")
    quotas = stored(
        sources.where("source_size > 0").select("source_rank", blocks.alias("n_blocks"), F.least(F.round(F.col("target") / F.col("source_size") * blocks), 2 * blocks).cast("long").alias("quota")).where("quota > 0")
    )
    summed = quotas.agg(F.coalesce(F.sum("quota"), F.lit(0)).alias("total"), F.count("*").alias("n")).first()
    total, all_cells = int(summed["total"]), max(CELLS, 2 << summed["n"].bit_length())  # a few sources a cell
    shards = 1 << max(0, total.bit_length() // 2)
    per = max(1, -(-total // shards))
    upto = F.sum("quota").over(Window.orderBy("source_rank"))
    shares = quotas.select("source_rank", "quota", (upto / F.lit(max(total, 1))).alias("high"), ((upto - F.col("quota")) / F.lit(max(total, 1))).alias("low"))
    cells = shares.select("source_rank", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * all_cells), F.least(F.floor(F.col("high") * all_cells), F.lit(all_cells - 1)))).alias("cell"))
    spark = sources.sparkSession
    slots = spark.range(total).select((F.col("id") / per).cast("long").alias("shard"), _unit(F.lit(seed), "id").alias("u")).withColumn("cell", F.floor(F.col("u") * all_cells))
    drawn = slots.join(cells, "cell").where("u >= low and u < high").groupBy("shard", "source_rank").agg(F.count("*").alias("n"))
    by_shard = Window.partitionBy("source_rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = drawn.withColumn("first", F.coalesce(F.sum("n").over(by_shard), F.lit(0))).join(quotas, "source_rank")
    counts = stored(counts.withColumn("kept", F.greatest(F.lit(0), F.least(F.col("n"), F.col("quota") - F.col("first")))))
    own = counts.where("kept > 0").select("shard", "source_rank", "n_blocks", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("kept") - 1)).alias("k"))
    freed = counts.groupBy("shard").agg(F.sum(F.col("n") - F.col("kept")).alias("free")).where("free > 0")
    freed = freed.select("shard", "free", (F.sum("free").over(Window.orderBy("shard")) - F.col("free")).alias("at"))
    freed = freed.select("shard", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("free") - 1)).alias("unit"))
    short = quotas.join(counts.groupBy("source_rank").agg(F.sum("kept").alias("had")), "source_rank", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < quota")
    short = short.select("source_rank", "n_blocks", "had", "quota", (F.sum(F.col("quota") - F.col("had")).over(Window.orderBy("source_rank")) - (F.col("quota") - F.col("had"))).alias("at"))
    short = short.select("source_rank", "n_blocks", F.posexplode(F.sequence(F.col("had"), F.col("quota") - 1)).alias("p", "k"), "at").withColumn("unit", F.col("at") + F.col("p"))
    given = short.hint("merge").join(freed, "unit").select("shard", "source_rank", "n_blocks", "k")
    return own.unionByName(given).select("shard", "source_rank", permuted(F.col("k"), F.col("n_blocks"), F.lit(seed), F.col("source_rank")).alias("block"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, block: int = 128, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """Two tables for ``docs`` (doc_id, text, source): the documents' places, and the mix's pieces.

    Places: (doc_id, key_a, key_b, source, size, start, source_rank, source_size, target), a row per document. Pieces:
    (shard, source_rank, block, start, doc_id, first_word, n_words): in which shard which words of a document
    stand; start is the document's place in its source. Sizes are words (null text: 0) and sources are null-safe. A source's blocks
    have ``block`` words, or as many fewer as make ``LEAST_BLOCKS`` of a small source. A
    document is never taken more than twice, as no block is; a source's taken words differ from its target by
    rounding to blocks. Draws depend on the data and ``seed`` alone. Rows that repeat a doc_id have places of
    their own; very long texts stand in many blocks; an empty table gives none.
    """
    placed = positions(docs)
    sizes = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
    sized = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("source_size") / LEAST_BLOCKS))).cast("long")
    sources = stored(source_targets(sizes, weights, share).withColumn("block", sized))
    places = stored(placed.join(sources, placed["source"].eqNullSafe(sources["source"])).select("doc_id", "key_a", "key_b", placed["source"], "size", "start", "source_rank", "source_size", "target", "block"))
    last, words = F.col("start") + F.col("size") - 1, F.col("words")
    runs = places.where("size > 0").withColumnRenamed("block", "words").select("source_rank", "doc_id", "start", last.alias("last"), "words", F.explode(F.sequence(F.floor(F.col("start") / words), F.floor(last / words))).alias("block"))
    begin, end = F.greatest("start", F.col("block") * words), F.least(F.col("last"), F.col("block") * words + words - 1)
    parts = runs.select("source_rank", "block", "doc_id", "start", (begin - F.col("start")).alias("first_word"), (end - begin + 1).alias("n_words"))
    return places.drop("block"), manifest(sources, block, seed).hint("merge").join(parts, ["source_rank", "block"])


def taken_words(docs: DataFrame) -> DataFrame:
    """The mix summed up by document: (doc_id, size, source_size, target, taken)."""
    places, pieces = mix(docs)
    taken = pieces.groupBy("source_rank", "start").agg(F.sum("n_words").alias("taken"))
    near = (places["source_rank"] == taken["source_rank"]) & (places["start"] == taken["start"]) & (places["size"] > 0)
    return places.join(taken, near, "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang, source, n_chars) as the mix takes them: each with the words taken, in order.

    A document taken whole keeps its text; one taken in part keeps those words and the white space before
    them; what is taken twice stands twice. One of which nothing is taken goes, null and empty texts among them. Equal rows
    are each cut by spans of their own, and rows that share a doc_id are told apart; other columns are left out; n_chars
    counts the new text; an empty table gives no rows.
    """
    docs = docs.select(*IDENTITY)
    places, pieces = mix(docs)
    spans = pieces.groupBy("source_rank", "start", "first_word", "n_words").agg(F.count("*").alias("times"))
    spans = spans.groupBy("source_rank", "start").agg(F.array_sort(F.collect_list(F.struct("first_word", "n_words", "times"))).alias("spans"), F.min("times").alias("low"), F.max("times").alias("high"), F.sum("n_words").alias("covered"))
    spans = spans.withColumnsRenamed({"source_rank": "rank_", "start": "start_"})
    near = (F.col("source_rank") == F.col("rank_")) & (F.col("start") == F.col("start_")) & (F.col("size") > 0)
    chosen = places.join(spans, near).select("key_a", "key_b", "size", "spans", "covered", "low", "high")
    # equal rows are one row here, which meets the spans of each
    one = docs.select(*row_key(*IDENTITY), "doc_id", "text", "lang", "source").groupBy("key_a", "key_b").agg(*[F.first(c).alias(c) for c in ("doc_id", "text", "lang", "source")])
    rows = one.join(chosen, ["key_a", "key_b"])
    words = F.split("text", "(?<=[^\\x20\\x09-\\x0D])(?=[\\x20\\x09-\\x0D])")
    part = lambda x, least: F.when(x["times"] >= least, F.array_join(F.slice(F.col("words"), x["first_word"].cast("int") + 1, x["n_words"].cast("int")), "")).otherwise("")
    whole = (F.col("covered") == F.col("size")) & (F.col("low") == F.col("high"))
    again = F.when(F.col("high") == 2, F.concat(F.lit("\n"), F.col("text"))).otherwise("")
    rows = rows.withColumn("words", F.when(~whole, words))
    pieces_text = F.concat(F.array_join(F.transform("spans", lambda x: part(x, 1)), ""), F.when(F.col("high") == 2, F.lit("\n")).otherwise(""), F.array_join(F.transform("spans", lambda x: part(x, 2)), ""))
    text = F.when(whole, F.concat("text", again)).otherwise(pieces_text)
    out = rows.select("doc_id", text.alias("text"), "lang", "source")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
