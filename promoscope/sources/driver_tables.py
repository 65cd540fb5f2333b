"""Survey responses derived from the driver's parquet tables.

The survey programme's own CSVs are not public, so the survey input is derived
deterministically from the TPC-H-style tables (one response per order):
``orders`` x ``customer`` x ``nation`` plus the order's ``documents`` text as
the free-text comment.  The derivation covers every cleaning rule: clamped,
decimal and unparsable scores, ``.0`` ids, junk cities, all tenure buckets,
channel aliases, 21 calendar sprints plus an unknown and a blank one, all
reasons plus unmapped / blank ones, and both first-time-user languages.

Scale: the two large joins (orders-customer on the customer key,
orders-documents on the order key) are ordinary shuffle joins planned by
Catalyst; ``nation`` is left to Spark's own size-checked broadcast and joined last,
so its names are in no shuffle.  Only the columns used are read (parquet column
pruning).  Counts need no texts: ``survey_raw_counted`` shuffles one short mark per
document in their place.  A re-send has the orders of a few sprints: ``survey_resend`` shuffles
their documents, not all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promoscope.functions.columns import js_trim
from promoscope.operators.rollup import FEEDBACK_MIN_LEN, has_feedback
from promoscope.sources.dims import REASON_THEME, literal_map

# reason picked by order key modulo 26: every known one, one unmapped, and (25) no entry
DERIVED_REASONS: list[str] = [*(reason for reason, _ in REASON_THEME), "Some unmapped reason"]

# sprints re-sent in the upsert input
RESENT_SPRINTS: list[str] = ["Sprint RSP6", "Sprint RSP7"]


#: Bits that ``keep_likely`` has for its keys: 16 MB, whatever their number.
LIKELY_BITS = 1 << 27


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _sprint_label(k: Column) -> Column:
    return (F.when(k <= 13, F.concat(F.lit("Sprint "), (k + 1).cast("string")))
            .when(k <= 20, F.concat(F.lit("Sprint RSP"), (k - 13).cast("string")))
            .when(k == 21, F.lit("Pilot"))
            .otherwise(F.lit("")))


def _half_month(odate: Column) -> Column:
    """The half month of an order date, dealt over the 23 sprint labels."""
    return (F.year(odate) * 24 + (F.month(odate) - 1) * 2 + F.when(F.dayofmonth(odate) > 15, 1).otherwise(0)) % 23


def keep_likely(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` is in ``keys`` (one column), and some others: those whose hash is
    that of a key.  For use before a join that needs no other rows, so that most of the others are not
    shuffled for it.  Every key sets one of ``LIKELY_BITS`` bits, which are broadcast; with more keys the
    bits stay as many, and more other rows pass.
    """
    def place(c: str) -> Column:
        return F.pmod(F.xxhash64(F.col(c).cast("bigint")), F.lit(LIKELY_BITS))

    bits = (keys.select(place(keys.columns[0]).alias("_place"))
                .groupBy(F.bitmap_bucket_number("_place").alias("_bucket"))
                .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits")))
    at = F.bitmap_bit_position(place(key))
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    # a semi join, so that Spark still knows the size of ``df``
    return df.join(F.broadcast(bits), (F.bitmap_bucket_number(place(key)) == F.col("_bucket"))
                   & (F.getbit(byte, (at % 8).cast("int")) == 1), "left_semi")


def survey_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw (all-string) survey rows, one per order."""
    return _survey_rows(spark, sf_dir, table(spark, sf_dir, "documents").select("doc_id", "text"))


def survey_raw_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``survey_raw`` for counts: a comment that counts as one (F7) is a mark that counts too,
    any other is empty.  The marks are made where the texts are read, so no text is shuffled."""
    mark = F.when(has_feedback(js_trim("text")), F.lit("x" * (FEEDBACK_MIN_LEN + 1))).otherwise(F.lit(""))
    return _survey_rows(spark, sf_dir, table(spark, sf_dir, "documents").select("doc_id", mark.alias("text")))


def _survey_rows(spark: SparkSession, sf_dir: str, d: DataFrame) -> DataFrame:
    """``d``: the comments, as doc_id and text."""
    # a price and a time as the few points and the date that are used of them: rows of the joins are narrower
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.floor(F.col("o_totalprice") / 45000).cast("bigint").alias("_points"),
        F.to_date("o_orderdate").alias("_date"), "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")

    j = (o.join(c, o.o_custkey == c.c_custkey, "inner")
          .join(d, d.doc_id == o.o_orderkey, "left")
          .join(n, c.c_nationkey == n.n_nationkey, "inner"))

    odate = F.col("_date")
    # half-month bucket of the order date, computed once and referenced by name
    j = j.withColumn("_k", _half_month(odate))
    key = F.col("o_orderkey")
    k = F.col("_k")
    reasons = literal_map([(str(i), r) for i, r in enumerate(DERIVED_REASONS)])
    score = F.when(key % 101 == 0, F.lit("n/a")).otherwise(F.concat(
        (F.col("_points") + F.col("c_nationkey") % 3 - 1)
        .cast("string"),
        F.when(key % 53 == 0, F.lit(".5")).otherwise(F.lit(""))))
    prio = F.col("o_orderpriority")
    return j.select(
        key.alias("row_seq"),
        F.concat(F.col("o_custkey").cast("string"),
                 F.when(key % 7 == 0, F.lit(".0")).otherwise(F.lit(""))).alias("respondent_id"),
        score.alias("score"),
        F.coalesce(F.col("text"), F.lit("")).alias("feedback"),
        F.coalesce(reasons[(key % 26).cast("string")], F.lit("")).alias("nps_reason_primary"),
        F.col("c_mktsegment").alias("plan_type"),
        F.when(F.col("c_nationkey") == 24, F.lit("#REF!"))
         .when(F.col("c_nationkey") == 23, F.lit("Unknown"))
         .otherwise(F.col("n_name")).alias("city"),
        (key % 400 - 20).cast("string").alias("tenure_days"),
        F.when(key % 17 == 0, F.lit("Early (1-2 mo)"))
         .when(key % 17 == 1, F.lit("Unknown")).otherwise(F.lit("")).alias("tenure_cut"),
        F.when(prio == "1-URGENT", F.lit("Call")).when(prio == "2-HIGH", F.lit(" wa "))
         .when(prio == "3-MEDIUM", F.lit("CT")).when(prio == "4-NOT SPECIFIED", F.lit(""))
         .otherwise(F.lit("Email")).alias("source"),
        _sprint_label(k).alias("sprint_id"),
        odate.cast("string").alias("sprint_start"),
        F.element_at(F.array(F.lit("Yes"), F.lit("No, had wifi"), F.lit("First time"),
                             F.lit("नहीं"), F.lit(""), F.lit("पहले वाई-फाई")),
                     (F.col("o_custkey") % 6 + 1).cast("int")).alias("first_time_user"),
    )


def survey_resend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert input: the re-sent files of ``RESENT_SPRINTS`` with new scores."""
    resent = table(spark, sf_dir, "orders").filter(
        _sprint_label(_half_month(F.to_date("o_orderdate"))).isin(*RESENT_SPRINTS)).select("o_orderkey")
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    raw = _survey_rows(spark, sf_dir, keep_likely(documents, "doc_id", resent))
    return (raw.filter(F.col("sprint_id").isin(*RESENT_SPRINTS))
               .withColumn("score", ((F.col("row_seq") + 3) % 11).cast("string"))
               .withColumn("row_seq", F.col("row_seq") + F.lit(1000000000)))
