"""I-Match document fingerprints over randomised lexicon subsets.

The lexicon is the set of all terms (words) whose inverse document frequency ln(N / df) lies within a
band: common words say little, and the rarest ones are mostly noise.  It is dealt into ``subsets`` random
subsets by hashes of the terms, ``draws`` times, so every term of the band is in a subset.  For every
subset, the document's distinct terms in it are sorted and hashed; a document's fingerprint is the list of
these hashes (subsets without a term of the document have none).  Likeness of two fingerprints is the
number of equal hashes divided by the number of subsets that either document has a hash of.  A document
without a term of the lexicon has the hash of all its distinct terms, sorted, in their place.

Only DataFrame operations are used.  Document frequencies are counted over all documents and all terms,
pre-aggregated.  The texts are shuffled once, by ranges of (id, text hash), to bring each one next to the
following one; everything else is a projection of a row.  For that, the lexicon goes along with the tasks
as a table of buckets: every term of the band is in N / e^9 documents at least, so there are at most e^9
(8103) times as many as a document has distinct terms on average, however many documents there are.  This
is checked: a lexicon of more than ``most_terms`` is joined with the documents' terms instead.

Defined cases: a null text is empty; fingerprints depend on the text alone, so equal texts have equal
ones; texts without a word are alike (the hash of no term); rows with a null id come last in the
order of documents, ties of ids are ordered by the text's hash, and repeated rows are neighbours (rows
equal in id and text stay in one range); the document after the last is the first (a single row is its own
next one); an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promoscope.llm.common import SPACE, text_or_empty
from promoscope.session import scratch_path

HASH_BITS = 23  # of a subset's hash; its number takes the bits above
MOST_SUBSETS = 1 << (31 - HASH_BITS)
TERM_BITS = 55  # of a term's hash, below the number of its subset


def words(text: Column) -> Column:
    return F.split(text, f"{SPACE}+", -1)


def term_hashes(text: Column) -> Column:
    """Hashes of the distinct terms."""
    return F.array_remove(F.array_distinct(F.transform(words(text), lambda w: F.xxhash64(w))),
                          F.xxhash64(F.lit("")))


def whole_hash(hashes: Column) -> Column:
    return F.xxhash64(F.sort_array(hashes))


def subset_of(term: Column, draw: int, subsets: int) -> Column:
    """The subset that a term is dealt to."""
    return F.pmod(F.xxhash64(F.lit(1000 + draw), term), F.lit(subsets)).cast("int")


def with_components(rows: DataFrame, column: str, subsets: int, draws: int) -> DataFrame:
    """The column's terms replaced by (number of the subset, hash of its sorted terms) in one int each.

    The steps are projections of their own, so that each array is made once.
    """
    of = lambda t: [F.shiftleft((F.lit(d * subsets) + subset_of(t, d, subsets)).cast("long"), TERM_BITS).bitwiseOR(
        t.bitwiseAND(F.lit((1 << TERM_BITS) - 1))) for d in range(draws)]
    number = lambda x: F.shiftright(x, TERM_BITS)
    keyed = F.transform(F.col(column), lambda t: of(t)[0]) if draws == 1 else F.flatten(
        F.transform(F.col(column), lambda t: F.array(*of(t))))
    m, starts = F.col("__m"), F.col("__starts")
    rows = rows.withColumn("__m", F.sort_array(keyed))  # by subset, then by term
    places = F.when(F.size(m) > 0, F.sequence(F.lit(0), F.size(m) - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("__starts", F.filter(
        places, lambda i: (i == 0) | (number(m[i]) != number(m[F.greatest(i - 1, F.lit(0))]))))
    end = lambda k: F.coalesce(F.get(starts, k + 1), F.size(m))
    made = F.transform(starts, lambda i, k: packed(number(m[i]).cast("int"), F.xxhash64(F.slice(m, i + 1, end(k) - i))))
    return rows.withColumn(column, made).drop("__m", "__starts")


def packed(number: Column, value: Column) -> Column:
    return F.shiftleft(number, HASH_BITS).bitwiseOR(value.bitwiseAND(F.lit((1 << HASH_BITS) - 1)).cast("int"))


def likeness(a: Column, b: Column, whole_a: Column, whole_b: Column) -> Column:
    """Of two lists of components; two lists without any are compared by their whole hashes."""
    numbers = lambda c: F.transform(c, lambda x: F.shiftright(x, HASH_BITS))
    either = F.size(F.array_union(numbers(a), numbers(b)))
    return F.when(either > 0, F.size(F.array_intersect(a, b)) / F.greatest(either, F.lit(1))).otherwise(
        (whole_a == whole_b).cast("double"))


def said(comps: Column, whole: Column) -> Column:
    """Components in hexadecimal digits, by subset."""
    return F.when(F.size(comps) > 0, F.array_join(F.transform(comps, lambda c: F.hex(c)), ",")).otherwise(
        F.concat(F.lit("all:"), F.hex(whole)))


def range_number(value: Column, cuts: list, kind: str, equal: bool = False) -> Column:
    """How many of the sorted cuts are below the value (or ``equal`` to it), found in two steps of about
    their square root."""
    if not cuts:
        return F.lit(0)
    m = math.isqrt(len(cuts))
    groups = [cuts[i:i + m] for i in range(0, len(cuts), m)]
    array = lambda items: F.array(*[F.lit(c) for c in items]).cast(f"array<{kind}>")
    below = lambda items: F.size(F.filter(items, lambda c: (c <= value) if equal else (c < value)))
    group = below(array([g[0] for g in groups]))
    return F.when(group == 0, F.lit(0)).otherwise(
        (group - 1) * m + below(F.element_at(F.array(*map(array, groups)), F.greatest(group, F.lit(1)))))


def ranges_of(docs: DataFrame, id_col: str, text: Column, range_bytes: int, most_ranges: int) -> Column:
    """The number of the range of a row, from its columns ``id`` and ``tie``: ranges follow one another in the
    order of both.

    Ids are cut at approximate quantiles.  An id that takes several quantiles (or the null ids) has as many
    ranges, which its rows are dealt to by their texts' hashes.
    """
    n, nulls, n_bytes = docs.agg(F.count(F.lit(1)), F.count_if(F.col(id_col).isNull()), F.sum(F.octet_length(text))).first()
    ranges = min(most_ranges, max(1, -(-(n_bytes or 0) // range_bytes)))
    bounds = docs.agg(F.percentile_approx(
        id_col, [i / ranges for i in range(1, ranges)], max(10_000, 10 * ranges))).first()[0] if ranges > 1 else []
    bounds, kind = sorted(bounds or []), docs.schema[id_col].dataType.simpleString()
    share = F.col("tie") / F.lit(2.0**64) + F.lit(0.5)  # of the hashes below this one
    below, upto = (range_number(F.col("id"), bounds, kind, equal) for equal in (False, True))
    of_nulls = max(1, ranges * nulls // max(n, 1))
    deal = lambda first, many: (first + F.least(F.floor(share * many), many - 1)).cast("long")
    return F.when(F.col("id").isNull(), deal(F.lit(len(bounds) + 1), F.lit(of_nulls))).otherwise(
        deal(below, upto - below + 1))


def first_of_ranges(rows: DataFrame) -> DataFrame:
    """(range, text) of the first row of every range; texts are read again rather than sorted for it.

    The keys are broadcast: one for each range, of which there are as many as ``ranges_of`` makes at most.
    """
    place = F.struct(F.col("id").isNull().alias("last"), "id", "tie")
    keys = rows.select("range", place.alias("place")).groupBy("range").agg(F.min("place").alias("p"))
    keys = keys.select(F.col("range").alias("__range"), F.col("p.id").alias("__id"), F.col("p.tie").alias("__tie"))
    same = (F.col("range") == F.col("__range")) & F.col("id").eqNullSafe(F.col("__id")) & (F.col("tie") == F.col("__tie"))
    return rows.join(F.broadcast(keys), same).groupBy("range").agg(F.min("text").alias("text"))


def with_next(rows: DataFrame, firsts: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``rows`` (id, tie, range and ``columns``) in order of (id, tie) with the next row's columns as next_*.

    Every range is ordered by itself; only its first row (``firsts``: range and columns) crosses to the
    range before.
    """
    order = Window.partitionBy("range").orderBy(F.col("id").asc_nulls_last(), "tie")
    by_range = Window.orderBy("range")  # one row per range
    around = by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select(
        F.coalesce(F.lag("range").over(by_range), F.last("range").over(around)).alias("before"),
        *(F.col(c).alias(f"first_{c}") for c in columns))
    led = rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    joined = led.join(after, (F.col("range") == F.col("before")) & F.col(f"next_{columns[0]}").isNull(), "left")
    return joined.select("id", *columns, *(F.coalesce(f"next_{c}", f"first_{c}").alias(f"next_{c}") for c in columns))


def edited(text: Column, next_text: Column) -> Column:
    """The last half of the code points (rounded down) replaced by the first ones of the next text."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(next_text, F.lit(1), half))


def lexicon_of(docs: DataFrame, text_col: str, idf_band: tuple[float, float], folder: str) -> DataFrame:
    """(t): the hashes of the terms whose idf lies in the band, over all documents."""
    terms = docs.select(F.explode(term_hashes(text_or_empty(F.col(text_col)))).alias("t"))
    least, most = (docs.count() / math.exp(idf) for idf in reversed(idf_band))
    lexicon = terms.groupBy("t").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df").between(least, most)).select("t")
    lexicon.write.parquet(f"{folder}/lexicon")
    return docs.sparkSession.read.schema(lexicon.schema).parquet(f"{folder}/lexicon")


def in_lexicon(lexicon: DataFrame, size: int):
    """A test of terms (column to column) by tables that go along with the tasks as constants.

    ``one`` has a place for each remainder of the terms by four times the lexicon's size: the only term of
    that remainder, 0 for none, -1 for several, which are then looked up in ``more``.  Both are variables of
    the session, made once.
    """
    spark, places = lexicon.sparkSession, 4 * max(1, size)
    at = F.pmod("t", F.lit(places))
    lists = lexicon.groupBy(at.alias("b")).agg(F.collect_list("t").alias("ts"))
    every = spark.range(places).withColumnRenamed("id", "b").join(lists, "b", "left")
    only = F.when(F.col("ts").isNull(), F.lit(0)).when(
        (F.size("ts") == 1) & ~F.col("ts")[0].isin(0, -1), F.col("ts")[0]).otherwise(F.lit(-1)).cast("bigint")
    one = every.agg(F.transform(F.sort_array(F.collect_list(F.struct("b", only.alias("v")))), lambda x: x["v"]).alias("a"))
    crowd = every.withColumn("v", only).filter("v = -1").select(F.pmod("b", F.lit(max(1, size))).alias("c"), "ts")
    crowd = crowd.groupBy("c").agg(F.flatten(F.collect_list("ts")).alias("ts"))
    full = spark.range(max(1, size)).withColumnRenamed("id", "c").join(crowd, "c", "left")
    row = F.struct("c", F.coalesce("ts", F.array().cast("array<bigint>")).alias("ts"))
    more = full.agg(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["ts"]).alias("a"))
    one, more = (session_constant(x, kind) for x, kind in ((one, "ARRAY<BIGINT>"), (more, "ARRAY<ARRAY<BIGINT>>")))

    def known(t: Column) -> Column:
        place = F.pmod(t, F.lit(places))
        there = F.element_at(one, place.cast("int") + 1)
        several = F.element_at(more, F.pmod(place, F.lit(max(1, size))).cast("int") + 1)
        return ((there == t) & (t != -1) & (t != 0)) | ((there == -1) & F.array_contains(several, t))

    return known


def session_constant(table: DataFrame, kind: str) -> Column:
    """The only value of a table, as a variable of the session."""
    spark, name = table.sparkSession, f"imatch_{uuid.uuid4().hex}"
    spark.sql(f"DECLARE VARIABLE {name} {kind}")
    spark.sql(f"SET VAR {name} = (SELECT a FROM {{table}})", table=table)
    return F.expr(name)


def known_by_join(rows: DataFrame, column: str, lexicon: DataFrame) -> DataFrame:
    """The column's terms that are in the lexicon, whatever its size, by a join: rows are numbered in the
    shared folder and their terms dealt out by term."""
    folder = scratch_path(rows.sparkSession, "imatch-terms")
    rows.withColumn("__row", F.monotonically_increasing_id()).write.parquet(folder)
    stored = rows.sparkSession.read.parquet(folder)
    terms = stored.select("__row", F.explode(column).alias("t")).join(lexicon, "t")
    found = terms.groupBy("__row").agg(F.collect_list("t").alias("__known"))
    known = F.coalesce("__known", F.array().cast("array<bigint>"))
    return stored.join(found, "__row", "left").withColumn(column, known).select(*rows.columns)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 idf_band: tuple[float, float] = (1.5, 9.0), subsets: int = 256, draws: int = 1,
                 most_terms: int = 4_000_000, range_bytes: int = 16 << 20, most_ranges: int = 1 << 14) -> DataFrame:
    """Per row: id, ``n_chars``, ``edited_sha256``, both fingerprints, ``near_edited``, ``near_next``."""
    if subsets * draws > MOST_SUBSETS:
        raise ValueError(f"at most {MOST_SUBSETS} subsets in all draws")
    lexicon = lexicon_of(docs, text_col, idf_band, scratch_path(docs.sparkSession, "imatch"))
    size = lexicon.count()
    known = in_lexicon(lexicon, size) if size <= most_terms else None

    def marked(rows: DataFrame, text: str, comps: str, whole: str) -> DataFrame:
        rows = rows.withColumn(comps, term_hashes(F.col(text))).withColumn(whole, whole_hash(F.col(comps)))
        rows = rows.withColumn(comps, F.filter(comps, known)) if known else known_by_join(rows, comps, lexicon)
        return with_components(rows, comps, subsets, draws)

    text = text_or_empty(F.col(text_col))
    number = ranges_of(docs, id_col, text, range_bytes, most_ranges)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("tie", F.xxhash64("text"))
    rows, columns = rows.withColumn("range", number), ("text", "own", "whole")
    both = with_next(marked(rows, *columns), marked(first_of_ranges(rows), *columns), columns)
    both = both.withColumn("edited", edited(F.col("text"), F.col("next_text"))).select(
        "id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        "own", "whole", "next_own", "next_whole", "edited")
    out = marked(both, "edited", "other", "other_whole")
    like = lambda comps, whole: likeness(F.col("own"), F.col(comps), F.col("whole"), F.col(whole))
    return out.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", said(F.col("own"), F.col("whole")).alias("fingerprint"),
        said(F.col("other"), F.col("other_whole")).alias("edited_fingerprint"),
        like("other", "other_whole").alias("near_edited"), like("next_own", "next_whole").alias("near_next"))
