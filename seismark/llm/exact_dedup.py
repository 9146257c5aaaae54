"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

Pass 1 sets two bits for each row's hash in a blocked filter and keeps the bits that more than one
row has set.  Pass 2 tests each row against those bits.  A row of which a bit was set only once has
no copy and passes straight through; only the others are shuffled by their full SHA-256, grouped and
joined with their group.

Pass 1 moves two small integers a row, counted before the shuffle.  The filter is broadcast; its
size is bits_per_row bits a row and max_filter_bytes at most.  Beyond that bound more unrepeated
rows are sent through the shuffle; results stay the same at every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seismark.llm.shared import free_name, small, written

#: bitmap_construct_agg makes bitmaps of 4096 bytes.
BLOCK_BITS = 32768
#: A group of more rows than this meets them in several tasks, where groups are too many to broadcast.
GROUP_ROWS = 1_000_000
MOST_SALTS = 4096


def with_sha256(docs: DataFrame, text_col: str = "text", name: str = "text_sha256") -> DataFrame:
    """docs with the hex SHA-256 of its text, each run of ASCII white space taken as one space and null as an empty text.

    Plain replacements cost a fraction of a pattern; the pattern runs only over texts with a longer run.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    for space in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(space), F.lit(" "))
    flat = free_name(docs, "flat")
    one = F.when(F.contains(flat, F.lit("  ")), F.regexp_replace(flat, " {2,}", " ")).otherwise(F.col(flat))
    return docs.withColumn(flat, text).withColumn(name, F.sha2(one, 256)).drop(flat)


def _bit(block: Column, at: Column) -> Column:
    """Bit `at` of a bitmap that bitmap_construct_agg made; false for null."""
    byte = F.ascii(F.decode(F.substring(block, (F.shiftright(at, 3) + 1).cast("int"), F.lit(1)), "ISO-8859-1"))
    return F.coalesce(F.getbit(byte, at.bitwiseAND(F.lit(7))) == 1, F.lit(False))


def exact_dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    bits_per_row: int = 16,
    max_filter_bytes: int = 64 << 20,
) -> DataFrame:
    """One row for each row of docs: its id, keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after white-space runs become one space; null counts as empty.
    Of equal texts the row with the smallest id stays (`kept`); a null id comes last.  Of rows that
    repeat an id and a text, one stays.  An empty table gives an empty result.  Other columns of
    docs, whatever their names, are not read.

    Texts are read once: their fingerprints (80 bytes a row) are written to the shared folder, and
    both passes read those.
    """
    prints = with_sha256(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))).select("id", "text_sha256")
    prints = written(prints.withColumn("row", F.monotonically_increasing_id()))
    buckets = max(1, min(max_filter_bytes // (BLOCK_BITS // 8), -(-prints.count() * bits_per_row // BLOCK_BITS)))
    h = F.xxhash64("text_sha256")
    hashed = prints.withColumns({
        "bucket": F.pmod(h, F.lit(buckets)).cast("int"),
        "first": F.shiftrightunsigned(h, 34).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int"),
        "second": F.shiftrightunsigned(h, 49).cast("int"),
    })

    bits = hashed.select("bucket", F.explode(F.array_distinct(F.array("first", "second"))).alias("bit"))
    repeated = bits.groupBy("bucket", "bit").count().where("count > 1")
    blocks = written(repeated.groupBy("bucket").agg(F.bitmap_construct_agg(F.col("bit").cast("long")).alias("block")))
    tested = hashed.join(F.broadcast(blocks), "bucket", "left")  # at most `buckets` rows of 4 KB
    maybe = _bit(F.col("block"), F.col("first")) & _bit(F.col("block"), F.col("second"))

    once = tested.where(~maybe).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    shuffled = tested.where(maybe).select("id", "text_sha256", "row")
    # The first row of a group by id, nulls last, then by the row's own number: counted before the shuffle, however many rows repeat an id and a text.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    groups = shuffled.groupBy("text_sha256").agg(first, F.count(F.lit(1)).alias("group_size")).select("text_sha256", "group_size", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row"))
    # Few groups meet their rows where those are; with many, the join deals the rows of a group out to several tasks.
    groups = written(groups)
    few = small(groups)
    if few is groups:
        salts = F.sequence(F.lit(0), F.least(F.lit(MOST_SALTS - 1), F.floor(F.col("group_size") / GROUP_ROWS)).cast("int"))
        groups = groups.withColumn("salts", F.size(salts)).withColumn("salt", F.explode(salts))
        hot = small(written(groups.where("salts > 1").select("text_sha256", "salts").distinct()))  # at most rows / GROUP_ROWS
        shuffled = shuffled.join(hot, "text_sha256", "left").withColumn("salt", F.pmod(F.xxhash64("row"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
        joined = shuffled.join(groups.drop("salts"), ["text_sha256", "salt"])
    else:
        joined = shuffled.join(few, "text_sha256")
    several = joined.select("id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")
    return once.unionByName(several).withColumnRenamed("id", id_col)


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with the columns of docs.

    Rows that go are found by id; whole rows pass without a shuffle while the ids that go are few
    enough to broadcast.  Only ids that stand on several rows are looked up by id and text.
    """
    plain = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    digest = written(exact_dedup(plain, id_col="id", text_col="text", **options).select("id", "kept", "text_sha256"))
    own, sha = free_name(docs, "own_id"), free_name(docs, "own_sha256")
    several = written(digest.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR id IS NULL").select(F.col("id").alias(own)))
    gone = small(written(digest.where("NOT kept").select(F.col("id").alias(own)).distinct()))
    key = F.col(f"`{id_col}`")
    if several.isEmpty():
        return docs.join(gone, key.eqNullSafe(F.col(own)), "left_anti")
    several = small(several)
    single = docs.join(several, key.eqNullSafe(F.col(own)), "left_anti").join(gone, key.eqNullSafe(F.col(own)), "left_anti")
    many = with_sha256(docs.join(several, key.eqNullSafe(F.col(own)), "left_semi"), text_col, sha)
    kept_id, kept_sha = free_name(docs, "kept_id"), free_name(docs, "kept_sha256")
    kept = digest.where("kept").select(F.col("id").alias(kept_id), F.col("text_sha256").alias(kept_sha))
    many = many.join(kept, key.eqNullSafe(F.col(kept_id)) & (F.col(f"`{sha}`") == F.col(kept_sha)), "left_semi")
    return single.unionByName(many.dropDuplicates([id_col, sha]).drop(sha))
