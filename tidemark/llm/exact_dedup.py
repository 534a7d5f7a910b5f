"""Exact deduplication by deterministic block naming.

Every text is cut into blocks of a fixed number of characters.  The distinct blocks are sorted, within the partitions of a hash
of them, and numbered: equal blocks share a number and different ones never do, as the blocks themselves are
compared, not digests of them.  Adjacent numbers of a document are then named pair by pair in the
same way, level after level, until one number is left: the document's identity.  The numbers themselves depend on how
many partitions there are; which documents share an identity, and so every result, doesn't.

Cost: the text is shuffled twice (distinct blocks, and blocks to their names); all levels above
move integers only.  The levels are the logarithm of the longest document's blocks.

Skew: counting the blocks combines on the map side.  The most frequent blocks go to their documents by
a broadcast whose size is bounded (HOT_BLOCKS blocks of BLOCK characters) instead of through
one task; every other block goes by the sort-merge join, and as none of these is among the HOT_BLOCKS most frequent, each has
less than one in HOT_BLOCKS of all places.  Names of pairs and groups are written
tables, so their joins have a plain exchange on both sides and Spark splits large partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import K1, K2, drop_stash, first_copies, refuse_reserved, stash, text_of

#: Characters of a block: most documents have several.
BLOCK = 1024
#: At most so many of the most frequent blocks, each in HOT_ROWS places or more, are broadcast (8 MB of characters at most).
HOT_BLOCKS = 8192
HOT_ROWS = 1000
#: Names below zero: no right neighbour, and from -2 down the broadcast blocks.
NO_NEIGHBOUR = -1


def _name_blocks(docs: DataFrame, text: str, doc_id: str, block: int) -> DataFrame:
    """(rid, doc_id, sha, blocks, pos, name): a row for each block; doc_id and sha stand at pos 0."""
    body = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("body")
    ).withColumn("sha", F.unhex(F.sha2("body", 256)))
    pieces = F.when(F.col("body") == "", F.array(F.lit(""))).otherwise(
        F.regexp_extract_all("body", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    )
    cut = body.select("rid", "doc_id", "sha", pieces.alias("pieces"))
    blocks = cut.select("rid", "doc_id", "sha", F.size("pieces").alias("blocks"), F.posexplode("pieces").alias("pos", "block"))
    blocks = blocks.withColumn("sha", F.when(F.col("pos") == 0, F.col("sha")))
    distinct = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("places"))
    hot = distinct.where(F.col("places") >= HOT_ROWS).orderBy(F.desc("places"), "block").limit(HOT_BLOCKS)
    hot = hot.select("block", (-2 - F.monotonically_increasing_id()).alias("hot_name"))
    # sorted within the hash partitions of the aggregate: numbering them shuffles nothing further
    names = distinct.sortWithinPartitions("block").select(
        F.col("block").alias("named"), F.when(F.col("places") > 0, F.monotonically_increasing_id()).alias("cold_name")
    )
    tried = blocks.join(F.broadcast(hot), "block", "left").withColumn(
        # a block that has its name by now travels as a short key that spreads, not as text
        "named", F.when(F.col("hot_name").isNull(), F.col("block")).otherwise(F.col("rid").cast("string"))
    )
    return tried.join(names, "named", "left").select(
        "rid", "doc_id", "sha", "blocks", "pos", F.coalesce("hot_name", "cold_name").alias("name")
    )


def identities(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """One row per document: rid, doc_id, sha (binary SHA-256 of the text), level, name; a written table.

    Two documents have the same text if and only if level and name are equal.
    """
    level0 = stash(_name_blocks(docs, text, doc_id, block), "blocks")
    spent = [level0]
    done = level0.where("blocks = 1").select("rid", "doc_id", "sha", F.lit(0).alias("level"), "name")
    active = level0.where("blocks > 1")
    most = active.agg(F.max("blocks")).first()[0] or 1
    level = 0
    while most > 1:
        level, most = level + 1, (most + 1) // 2
        half = (F.col("pos") / 2).cast("int")
        left = F.col("pos") % 2 == 0
        pairs = active.groupBy("rid", half.alias("pos")).agg(
            F.max("doc_id").alias("doc_id"),
            F.max("sha").alias("sha"),
            F.max("blocks").alias("blocks"),
            F.max(F.when(left, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(~left, F.col("name"))), F.lit(NO_NEIGHBOUR)).alias("b"),
        )
        names = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("places")).sortWithinPartitions("a", "b")
        names = stash(names.select("a", "b", F.monotonically_increasing_id().alias("name")), f"names{level}")
        named = pairs.join(names, ["a", "b"]).withColumn("blocks", ((F.col("blocks") + 1) / 2).cast("int"))
        named = stash(named.select("rid", "doc_id", "sha", "blocks", "pos", "name"), f"level{level}")
        done = done.unionByName(named.where("blocks = 1").select("rid", "doc_id", "sha", F.lit(level).alias("level"), "name"))
        active = named.where("blocks > 1")
        spent += [names, named]
    found = stash(done, "identities")
    for table in spent:
        drop_stash(table)
    return found


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, group.

    Texts are equal when identical after no change; null counts as the empty text and empty texts
    equal each other.  The row with the largest doc_id stays; a null doc_id is smaller than any
    other.  Of rows that repeat both doc_id and text one stays.  Other columns of docs are ignored,
    whatever their names.  An empty table gives no rows.  group names the set of equal texts.
    """
    found = identities(docs, text, doc_id, block)
    groups = found.groupBy("level", "name").agg(
        F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "rid")).alias("last"), F.min("rid").alias("group")
    )
    groups = stash(groups.select("level", "name", "group_size", F.col("last.doc_id").alias("keep_id"), F.col("last.rid").alias("keep_rid"), "group"), "groups")
    return found.join(groups, ["level", "name"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("rid") == F.col("keep_rid")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "group",
    )


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """The rows of docs, all columns, without those that exact_groups() drops; of rows that repeat id and text see first_copies().
    ValueError where docs has one of our own column names."""
    refuse_reserved(docs)
    kept = exact_groups(docs, text, doc_id, block).where("kept").select(
        F.coalesce("keep_id", F.lit(-(2**63))).alias(K1), F.unhex("text_sha256").alias(K2)
    )
    rows = docs.select("*", F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias(K1), F.unhex(F.sha2(text_of(text), 256)).alias(K2))
    # the join leaves the rows of a key together, so numbering them needs no other exchange
    return first_copies(rows.join(kept, [K1, K2], "left_semi"), docs.columns, text, doc_id)
