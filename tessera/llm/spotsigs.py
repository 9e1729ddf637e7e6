"""Document fingerprints by SpotSigs.

Common words are anchors; the first two content words after each run of anchors form a chain, and the
set of a text's chains is its fingerprint. Everything runs on DataFrame functions. Fingerprints are
compared by Jaccard likeness; near_pairs() partitions them by the length of their sets, lets only
lengths meet that can reach the threshold, and joins on each set's rarest chains.

Defined results: case and punctuation don't count; a text without any anchor (or empty, or null) has
its whole text as the only chain, so equal texts have equal fingerprints. Documents are ordered by
descending doc_id, null ids first, then by a hash of the text; a single row is its own next document. Texts of
any length are read whole; columns but doc_id and text are not looked at.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import keyed, materialize

#: Very common words of each language.
ANCHORS = (
    "the of and to a in is it that was for on as with be by at are this from or an which but not he she they we you his her its their has have had will would there been were can all more if no "
    "der die das und ist von zu den mit sich auf für im nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde "
    "le la les de des et en un une du que qui dans est pour pas au sur par plus avec ne se ce il sont ou sa son aux mais comme elle ont "
    "el los las y una por con para su al lo más pero sus este sí porque esta entre cuando muy sin sobre ser también me hasta hay donde"
).split()


def chains(text: Column) -> Column:
    """The sorted distinct chains of a text, as 32-bit numbers."""
    whole = F.coalesce(text, F.lit(""))
    anchors = sorted(set(ANCHORS))
    once = lambda a, f: F.get(F.transform(F.array(a), f), F.lit(0))  # noqa: E731  evaluates a once
    number = lambda c: F.xxhash64(c).bitwiseAND(F.lit(0xFFFFFFFF))
    plain = F.trim(F.regexp_replace(F.lower(whole), r"[^\p{L}\p{N}]+", " "))
    # "." before the first word, nothing in place of an anchor; a long list of constants is looked up as a hash set
    words = F.transform(F.split(F.concat(F.lit(". "), plain), " "), lambda w: F.when(w.isin(anchors), "").otherwise(w))

    def content(w: Column) -> Column:
        """The words that are no anchors, those right after an anchor with a leading space."""
        n = F.size(w) - 1
        return F.filter(F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.when((a == "") & (b != ""), F.concat(F.lit(" "), b)).otherwise(b)), lambda b: b != "")

    def of(c: Column) -> Column:
        chain = lambda b, i: F.when(b.startswith(" "), number(F.concat_ws(" ", F.ltrim(b), F.ltrim(F.coalesce(F.get(c, i + 1), F.lit(""))))))
        return F.filter(F.transform(c, chain), lambda x: x.isNotNull())

    return once(once(once(words, content), of), lambda c: F.when(F.size(c) > 0, F.sort_array(F.array_distinct(c))).otherwise(F.array(number(whole))))


def fingerprint(c: Column) -> Column:
    """Chains as text, eight hexadecimal digits each."""
    return F.array_join(F.transform(c, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets of chains."""
    both = F.size(F.array_intersect(a, b))
    return both.cast("double") / (F.size(a) + F.size(b) - both)


def in_order(docs: DataFrame, per_bucket: int = 1000, most: int = 65_536) -> DataFrame:
    """docs (with _key) with bucket: consecutive ranges of _key of about equal numbers of rows; and the table of copies.

    A copy is a row that also stands in another bucket, as the next one of that bucket's last row. Beyond most * per_bucket
    rows the buckets grow: one task sorts each on disk, and the cuts that the driver holds stay bounded."""
    n = docs.count()
    buckets = max(1, min(most, math.ceil(n / per_bucket)))
    cuts = sorted(set(docs.agg(F.percentile_approx("_key", [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0] or [])) if buckets > 1 and n else []
    steps = F.array(*(F.lit(2**i) for i in range(len(cuts).bit_length() - 1, -1, -1))) if cuts else None
    held = F.from_json(F.lit(json.dumps(cuts)), "array<bigint>")
    place = F.aggregate(steps, F.lit(0), lambda acc, s: F.when(F.get(held, acc + s - 1) <= F.col("_key"), acc + s).otherwise(acc)) if cuts else F.lit(0)
    placed = docs.withColumn("bucket", place)
    tops = sorted((r[0], r[1]) for r in placed.groupBy("bucket").agg(F.max("_key")).collect())  # as many rows as buckets
    to = [(tops[i - 1][1], tops[i][0]) for i in range(len(tops))]  # a bucket's last row is followed by the first of the bucket below, the last bucket by the first of all
    copies = docs.join(F.broadcast(docs.sparkSession.createDataFrame(to, "_key long, bucket int")), "_key")
    return placed.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True)))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, chains, and next_text, next_chains of the next document by descending doc_id."""
    rows = in_order(keyed(docs).drop("_tag")).repartition("bucket")
    rows = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "_key", "bucket", "copy").withColumn("chains", chains(F.col("text")))
    w = Window.partitionBy("bucket").orderBy("copy", F.desc("_key"), F.xxhash64("text"))
    return rows.withColumns({"next_text": F.lead("text").over(w), "next_chains": F.lead("chains").over(w)}).where("not copy")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of docs."""
    n = F.char_length("text")
    half = F.expr("char_length(text) div 2").cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = with_next(docs).withColumn("edited", edited)
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "chains", chains(F.col("edited")).alias("edited_chains"), "next_chains")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("chains")).alias("fingerprint"), fingerprint(F.col("edited_chains")).alias("edited_fingerprint"),
        likeness(F.col("chains"), F.col("edited_chains")).alias("near_edited"), likeness(F.col("chains"), F.col("next_chains")).alias("near_next"),
    )


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, class) of documents with equal fingerprints, and pairs of classes (a, b, likeness) at the threshold or above.

    A class is named by its first doc_id. Rows without doc_id take no part."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), chains(F.col("text").cast("string")).alias("chains"))
    rows = materialize(rows, "chains")
    classes = materialize(rows.groupBy("chains").agg(F.min("doc_id").alias("class")), "classes")
    common = classes.select("class", F.explode("chains").alias("chain"), F.size("chains").alias("n"))
    often = common.groupBy("chain").agg(F.count("*").alias("often"))
    w = Window.partitionBy("class").orderBy("often", "chain")  # a set of one document
    prefix = common.join(often, "chain").withColumn("rank", F.row_number().over(w)).where(F.expr(f"rank <= n - ceil({threshold} * n) + 1 and often > 1"))
    # partitions by length: a set of length class l only meets those of l and l - 1
    band = F.floor(F.log("n") / math.log(1 / threshold)).cast("int")
    short = prefix.select("chain", F.col("class").alias("a"), F.col("n").alias("na"), F.explode(F.array(band, band + 1)).alias("band"))
    long = prefix.select("chain", F.col("class").alias("b"), F.col("n").alias("nb"), band.alias("band"))
    met = short.join(long, ["chain", "band"]).where(f"(na < nb or (na = nb and a < b)) and na >= {threshold} * nb").select("a", "b").distinct()
    sets = lambda c: classes.select(F.col("class").alias(c), F.col("chains").alias(f"s{c}"))
    pairs = met.join(sets("a"), "a").join(sets("b"), "b").select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness")).where(f"likeness >= {threshold}")
    return rows.join(classes, "chains").select("doc_id", "class"), pairs


def near_classes(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, class (first doc_id with the same fingerprint) and n_links (other classes at the threshold or above) of each document."""
    member, pairs = near_pairs(docs, threshold)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("n"))
    return member.join(ends, "class", "left").select("doc_id", "class", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"))
