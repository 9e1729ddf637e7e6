"""Quality rules with adaptive thresholds.

The measures of every text are computed with DataFrame functions. Mergeable quantile sketches (KLL) of
each measure, per language and source, replace fixed cutoffs. A group's quantiles lean on those of its language,
and these on those of all groups, the more the fewer documents there are: n of them weigh n / (n + LEAN), the
sketches above the rest, so nothing switches at any size. The thresholds are joined to the documents and those
beyond them go.

A threshold is the third quartile plus FENCE times the spread of the quartiles, where the spread counts
as LEAST of the measure at least, so that groups without any spread keep what differs a little.

Defined results: null and empty texts have no words and fail the base rules; null languages and sources
are groups of their own; repeated rows count each; measures are rows' own and never depend on their order.
Columns of any name are kept as they are. Very long texts are measured whole, in memory of a few times their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize, words

MEASURES = {"symbols_per_word": 0.1, "dup_lines_per_word": 0.02, "repeats_per_word": 0.1, "chars_per_word": 4.0}
FENCE, LEAN = 3.0, 200
#: Up to so many groups' thresholds (four numbers each) are sent to every task; more are joined by their keys.
MOST_GROUPS = 50_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(w: Column, n: Column, bits: int | None = None) -> Column:
    """Words in 3-word windows that stand twice or more in the array w of n words.

    The windows' hashes, with their places in the low bits, are sorted; equal neighbours whose
    words are equal too repeat. The hash keeps 64 bits less those of the place (bits, if given)."""
    bits = F.length(F.bin(n)) if bits is None else F.lit(bits)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.call_function("shiftleft", F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), bits).bitwiseOR(i.cast("long")))
    s = F.sort_array(hashes)
    high = lambda x: F.call_function("shiftright", x, bits)
    place = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")
    same = lambda x, y: (high(x) == high(y)) & (F.get(w, place(x)) == F.get(w, place(y))) & (F.get(w, place(x) + 1) == F.get(w, place(y) + 1)) & (F.get(w, place(x) + 2) == F.get(w, place(y) + 2))

    def repeats(a: Column, x: Column, i: Column) -> Column:
        near = lambda f: F.coalesce(f(x, F.get(a, i - 1)), F.lit(False)) | F.coalesce(f(x, F.get(a, i + 1)), F.lit(False))
        equal = near(lambda p, q: high(p) == high(q))
        # other windows may stand between two equal ones of the same hash
        return F.when(~equal, False).when(near(same), True).otherwise(F.exists(a, lambda y: (y != x) & same(x, y)))

    keys = lambda a: F.filter(F.transform(a, lambda x, i: F.when(repeats(a, x, i), place(x).cast("long"))), lambda x: x.isNotNull())
    within = lambda a, f: F.get(F.transform(F.array(a), f), F.lit(0))  # noqa: E731  evaluates a once
    covered = lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1), x + 3) - x, F.lit(3).cast("long"))), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return F.when(n < 4, F.lit(0).cast("long")).otherwise(within(s, lambda a: within(F.sort_array(keys(a)), covered)))


def measured(docs: DataFrame) -> DataFrame:
    """docs with COUNTS and base_failed."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumn("_words", words(F.col("text").cast("string"))).withColumn("_n", F.size("_words"))
    out = out.withColumns(
        {
            "n_words": F.col("_n").cast("long"),
            "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": F.get(F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))), F.lit(0)).cast("long"),
            "n_repeat_words": repeated_words(F.col("_words"), F.col("_n")),
        }
    )
    return out.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")).drop("_words", "_n")


def _values() -> dict[str, Column]:
    per = lambda c: (F.col(c) / F.col("n_words")).cast("double")
    return {"symbols_per_word": per("n_symbols"), "dup_lines_per_word": per("n_dup_lines"), "repeats_per_word": per("n_repeat_words"), "chars_per_word": per("word_chars")}


def thresholds(rows: DataFrame) -> DataFrame:
    """lang, source and the most that each measure may be there. rows has _lang, _source, COUNTS and base_failed."""
    values = rows.where("not base_failed").select("_lang", "_source", *(v.alias(m) for m, v in _values().items()))
    own = values.groupBy("_lang", "_source").agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(m).alias(m) for m in MEASURES))
    own = materialize(own, "sketches")  # one row for each group
    merged = lambda by: own.groupBy(*by).agg(F.sum("n").alias("n_up"), *(F.kll_merge_agg_double(m).alias(f"{m}_up") for m in MEASURES))
    lang = merged(["_lang"])
    every = merged([]).select(*(F.col(f"{m}_up").alias(f"{m}_all") for m in MEASURES))
    joined = own.join(lang.withColumnRenamed("_lang", "_l"), F.col("_lang").eqNullSafe(F.col("_l")), "left").join(every, F.lit(True), "left")
    at_rank = lambda sketch, rank: F.kll_sketch_get_quantile_double(sketch, F.lit(rank))
    lean = lambda n, own, above: (own * F.col(n) + above * LEAN) / (F.col(n) + LEAN)
    q = lambda m, rank: lean("n", at_rank(m, rank), lean("n_up", at_rank(f"{m}_up", rank), at_rank(f"{m}_all", rank)))
    limit = lambda m, least: q(m, 0.75) + FENCE * F.greatest(q(m, 0.75) - q(m, 0.25), F.lit(least))
    return joined.select("_lang", "_source", *(limit(m, least).alias(f"most_{m}") for m, least in MEASURES.items()))


def judged(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep of docs (renamed by place to k0, k1, ...), COUNTS, base_failed and kept."""
    grouped = lambda c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")
    given = docs.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)), grouped("text").alias("text"), grouped("lang").alias("_lang"), grouped("source").alias("_source"))
    measures = measured(given).drop("text")
    if "text" in keep:  # texts are measured again rather than written once more
        slim, rows = materialize(measures.select("_lang", "_source", *COUNTS, "base_failed"), "measured"), measures
    else:
        slim = rows = materialize(measures, "measured")
    most = materialize(thresholds(slim).withColumnsRenamed({"_lang": "_l", "_source": "_s"}), "thresholds")
    if rows is not slim:
        discard(slim)
    if most.count() <= MOST_GROUPS:
        most = F.broadcast(most)
    joined = rows.join(most, F.col("_lang").eqNullSafe(F.col("_l")) & F.col("_source").eqNullSafe(F.col("_s")), "left")
    beyond = F.lit(False)
    for m, v in _values().items():
        beyond = beyond | F.coalesce(v > F.col(f"most_{m}"), F.lit(False))
    return joined.select(*(f"k{i}" for i in range(len(keep))), *COUNTS, "base_failed", F.when(F.col("base_failed"), F.lit(False)).otherwise(~beyond).alias("kept"))


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS, base_failed and kept of each row of docs."""
    return judged(docs, ["doc_id"]).select(F.col("k0").cast("long").alias("doc_id"), *COUNTS, "base_failed", "kept")


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with their columns."""
    names = docs.columns
    return judged(docs, names).where("kept").select(*(F.col(f"k{i}").alias(n) for i, n in enumerate(names)))
