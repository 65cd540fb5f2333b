"""Language-model scores by prediction by partial matching (PPM) over bytes.

The model is a trie of byte contexts of up to ``order`` bytes, learnt from all training documents and
kept as tables, one per level: (context, symbol) with counts.  A symbol is a byte or the end of the
text; contexts before the start are filled with the same end mark.  The longest contexts count
occurrences; a shorter one counts the contexts one byte longer in which the symbol occurs (update
exclusion).  In a context seen in training with total count T and D distinct symbols, a symbol with
count c has probability (2c - 1) / 2T, and the escape to the next shorter context D / 2T (method D).
After an escape the symbols of the longer context are excluded from the counts.  Below the empty
context all symbols left are equally likely.
A document's score is the log10 probability of its bytes and its end; this is the pretrained use: the
counts do not change while a document is scored.  (A training document's own counts are in the model.)

The base score is the smoothed unigram model of the contract, from the same pass.

How it runs: documents are dealt into blocks of some tens of MB of text.  A block lists its distinct
words and (context, symbol) pairs with their training counts; Spark sums these over all blocks, works
out the log probability of every pair from the trie's levels with joins, and joins the values back to
the blocks' lists.  A block's task then reads its values first and scores its documents as they come.
So memory is bounded by the distinct keys of a block, whatever the size of the corpus, and nothing is
broadcast or collected but two totals.

Defined cases: a null text is empty (its only token is the end); a null id is the empty string for the
hash that picks held-out documents, so it is in training; repeated rows each count and are each
scored; no training document at all leaves every byte equally likely, and a base score with N = V = 0
is taken as that of one unknown token type; an empty table gives an empty result; only the id and text
columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promoscope.llm.common import ship, text_or_empty
from promoscope.llm.components import tasks
from promoscope.llm.probminhash import Stored, buffers, word_hashes

END = 256  # the end of a text, and what stands before its start
SYMBOLS = 257
BITS = 9  # of a symbol in a key
WORD_KIND, PAIR_KIND = 0, 1
END_WORD = np.int64(0)  # key of the end token; word hashes are odd
SLICE = 1 << 18  # bytes of text worked on at once
PENDING = 1 << 19  # keys of slices that are merged into a block's keys together

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def slices(texts: pa.Array) -> list[tuple[int, int]]:
    """Ranges of rows of about ``SLICE`` bytes."""
    sizes = np.asarray(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False), np.int64)
    which = np.cumsum(sizes) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), len(sizes)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def word_keys(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key and text number of each word, A-Z in lower case."""
    h, doc = word_hashes(_LOWER[raw], at)
    return (h | np.uint64(1)).view(np.int64), doc


def pair_keys(raw: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Key of the context and symbol at every place of every text (its end included), and the text number."""
    n = len(at) - 1
    sizes = np.diff(at)
    begin = np.arange(n) * (order + 1) + at[:-1]  # each text: `order` marks, its bytes, an end
    symbols = np.full(len(raw) + n * (order + 1), END, np.int64)
    doc = np.repeat(np.arange(n), sizes)
    symbols[np.arange(len(raw)) + (doc + 1) * order + doc] = raw
    key = np.zeros(len(symbols) - order, np.int64)
    for k in range(order + 1):
        key = key << BITS | symbols[k:len(symbols) - order + k]
    # windows that start in a text's marks or bytes end at its bytes or its end
    owner = np.repeat(np.arange(n), sizes + 1)
    places = np.arange(len(owner)) + owner * order
    return key[places], owner


class Profile:
    """Distinct keys and their training counts, of the words and pairs of the texts added so far."""

    def __init__(self, order: int):
        self.order = order
        self.found: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]

    def add(self, texts: pa.Array, train: np.ndarray) -> None:
        for a, b in slices(texts):
            raw, at = buffers(texts.slice(a, b - a))
            own = train[a:b].astype(np.float64)
            words, doc = word_keys(raw, at)
            ends = np.full(b - a, END_WORD)
            for kind, keys, owner in ((WORD_KIND, np.append(words, ends), np.append(doc, np.arange(b - a))),
                                      (PAIR_KIND, *pair_keys(raw, at, self.order))):
                codes, some = pd.factorize(keys)
                self.found[kind].append((some, np.bincount(codes, own[owner], len(some)).astype(np.int64)))
                first, *rest = (len(k) for k, _ in self.found[kind])
                if sum(rest) > max(first, PENDING):
                    self.found[kind] = [self.keys(kind)]

    def keys(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        each = self.found[kind]
        codes, keys = pd.factorize(np.concatenate([k for k, _ in each]))
        return keys, np.bincount(codes, np.concatenate([c for _, c in each]), len(keys)).astype(np.int64)


class Values:
    """The values of a block's keys, looked up for its texts."""

    def __init__(self, kinds: np.ndarray, keys: np.ndarray, values: np.ndarray, order: int):
        self.order, self.keys, self.values = order, [], []
        for kind in (WORD_KIND, PAIR_KIND):
            own = kinds == kind
            by = np.argsort(keys[own], kind="stable")
            self.keys.append(keys[own][by])
            self.values.append(values[own][by])

    def look_up(self, kind: int, wanted: np.ndarray) -> np.ndarray:
        codes, some = pd.factorize(wanted)
        at = np.searchsorted(self.keys[kind], some)
        if len(some) and not np.array_equal(self.keys[kind].take(at, mode="clip"), some):
            raise ValueError("a block lists other keys than its texts have")
        return self.values[kind][at][codes]

    def score(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """Per text: tokens, known tokens, sum of log10(c + 0.5) of its tokens, log10 probability."""
        found: list[list[np.ndarray]] = [[], [], [], []]
        for a, b in slices(texts):
            raw, at = buffers(texts.slice(a, b - a))
            n = b - a
            words, doc = word_keys(raw, at)
            doc = np.append(doc, np.arange(n))
            c = self.look_up(WORD_KIND, np.append(words, np.full(n, END_WORD)))
            pairs, owner = pair_keys(raw, at, self.order)
            found[0].append(np.bincount(doc, minlength=n))
            found[1].append(np.bincount(doc[c > 0], minlength=n))
            found[2].append(np.bincount(doc, np.log10(c + 0.5), n))
            found[3].append(np.bincount(owner, self.look_up(PAIR_KIND, pairs), n))
        return tuple(np.concatenate(f) for f in found)


def level(pairs: DataFrame, k: int, few: int) -> DataFrame:
    """(key, ctx, n): counts of the trie's level k, from the rows of the level above it."""
    mask = F.lit((1 << BITS * (k + 1)) - 1)
    got = pairs.groupBy(F.col("key").bitwiseAND(mask).alias("key")).agg(F.count(F.lit(1)).alias("n")).coalesce(few)
    return got.withColumn("ctx", F.shiftright("key", BITS))


def log10(x: Column) -> Column:
    return F.log10(x.cast("double"))


def pair_values(totals: DataFrame, order: int, store: Stored) -> DataFrame:
    """(key, value): the log10 probability of every pair of (key, n), n its training count."""
    few = tasks(totals.count())
    trie = {order: store(totals.filter("n > 0").withColumn("ctx", F.shiftright("key", BITS)), f"level-{order}")}
    for k in range(order - 1, -1, -1):
        trie[k] = store(level(trie[k + 1], k, few), f"level-{k}")
    stats = {k: t.groupBy("ctx").agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("d")).coalesce(few)
             for k, t in trie.items()}
    # what is left of level k's counts after an escape from a context v of level k + 1
    left = {}
    for k in range(order):
        mask = F.lit((1 << BITS * (k + 1)) - 1)
        upper = trie[k + 1].select(F.col("ctx").alias("v"), F.col("key").bitwiseAND(mask).alias("key"))
        lower = trie[k].select("key", F.col("n").alias("seen"))
        gone = upper.join(lower, "key").coalesce(few).groupBy("v").agg(
            F.sum("seen").alias("gone"), F.count(F.lit(1)).alias("dv")).coalesce(few)
        ctx = F.col("v").bitwiseAND(F.lit((1 << BITS * k) - 1))
        rest = gone.withColumn("ctx", ctx).join(stats[k], "ctx").coalesce(few)
        left[k] = store(rest.select("v", (F.col("d") - F.col("dv")).alias("esc"),
                                    (2 * (F.col("t") - F.col("gone"))).alias("den")), f"left-{k}")
    # a pair's value: found in its own context, or by escapes down the levels
    now = totals.withColumn("ctx", F.shiftright("key", BITS)).join(stats[order], "ctx", "left").coalesce(few)
    seen = F.col("n") > 0
    now = now.select(
        "key", F.when(seen, log10((2 * F.col("n") - 1) / (2 * F.col("t"))))
        .when(F.col("t").isNotNull(), log10(F.col("d") / (2 * F.col("t"))))
        .otherwise(F.lit(0.0)).alias("value"), seen.alias("done"), F.col("t").isNotNull().alias("above"),
        F.coalesce("d", F.lit(0)).alias("d"))
    ready, rest = now.filter("done").select("key", "value"), now.filter("not done")
    for k in range(order - 1, -1, -1):
        mask = (1 << BITS * (k + 1)) - 1
        here = rest.select("key", "value", "above").withColumn("low", F.col("key").bitwiseAND(F.lit(mask))).withColumn(
            "v", F.shiftright(F.col("key").bitwiseAND(F.lit((1 << BITS * (k + 2)) - 1)), BITS)).withColumn(
            "ctx", F.shiftright("low", BITS))
        here = (here.join(trie[k].select(F.col("key").alias("low"), "n"), "low", "left").coalesce(few)
                .join(left[k], "v", "left").coalesce(few).join(stats[k], "ctx", "left").coalesce(few))
        known = F.col("t").isNotNull()
        esc = F.when(F.col("above"), F.col("esc")).otherwise(F.col("d"))
        den = F.when(F.col("above"), F.col("den")).otherwise(2 * F.col("t"))
        hit = F.col("n").isNotNull()
        step = here.select(
            "key", (F.col("value") + F.when(hit, log10((2 * F.col("n") - 1) / den))
                    .when(known & (esc > 0), log10(esc / den)).otherwise(F.lit(0.0))).alias("value"),
            hit.alias("done"), known.alias("above"), F.coalesce("d", F.lit(0)).alias("d"))
        step = store(step, f"step-{k}")
        ready = ready.unionByName(step.filter("done").select("key", "value"))
        rest = step.filter("not done")
    # the rest have escaped from the empty context, whose d symbols are excluded
    return ready.unionByName(rest.select("key", (F.col("value") - log10(SYMBOLS - F.col("d"))).alias("value")))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 4,
              folds: int = 5, held_out: int = 1, block_bytes: int = 32 << 20) -> DataFrame:
    """id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` per row."""
    spark = docs.sparkSession
    ship(spark)
    store = Stored(spark, "ppm")
    text = text_or_empty(F.col(text_col))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    dealt = docs.select(
        F.col(id_col).alias("id"), text.alias("text"),
        (F.crc32(name) % folds == held_out).alias("held_out"),
        F.pmod(F.xxhash64(F.col(id_col), text), F.lit(blocks)).cast("int").alias("block"))
    listed = store(list_keys(dealt.repartitionById(blocks, "block"), order), "listed")
    # a word's count over all blocks; one of its rows is marked, to count the words
    same = Window.partitionBy("key")
    words = store(listed.filter(F.col("kind") == WORD_KIND).select(
        "block", "kind", "key", F.sum("n").over(same).cast("double").alias("value"), "n",
        (F.row_number().over(same.orderBy("block")) == 1).alias("first")), "words")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("first") & (F.col("value") > 0))).first()
    of_pairs = listed.filter(F.col("kind") == PAIR_KIND)
    pairs = store(of_pairs.groupBy("key").agg(F.sum("n").alias("n")), "pairs")
    values = store(pair_values(pairs, order, store), "values")
    answers = of_pairs.select("block", "kind", "key").join(values, "key").select("block", "kind", "key", "value")
    scored = score_blocks(dealt, words.select("block", "kind", "key", "value").unionByName(answers), blocks, order)
    weight = math.log10(n + 0.5 * (v + 1))
    return scored.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("known_sum") - F.col("n_tokens") * F.lit(weight)).alias("base_score"), "score")


def rows_where(batch: pa.RecordBatch, wanted: np.ndarray) -> pa.RecordBatch:
    """The wanted rows; without a copy where that is all of them."""
    return batch if wanted.all() else batch.filter(pa.array(wanted))


def list_keys(dealt: DataFrame, order: int) -> DataFrame:
    """(block, kind, key, n): the distinct keys of each block (a partition) and their training counts."""
    schema = T.StructType([
        T.StructField("block", T.IntegerType()), T.StructField("kind", T.ByteType()),
        T.StructField("key", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Profile] = {}
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            for block in np.unique(blocks).tolist():
                own = rows_where(batch, blocks == block)
                train = ~own.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
                made.setdefault(block, Profile(order)).add(own.column("text"), train)
        for block, profile in made.items():
            for kind in (WORD_KIND, PAIR_KIND):
                keys, count = profile.keys(kind)
                by = np.argsort(keys)  # sorted keys take less room
                for at in range(0, len(by), 1 << 16):
                    some = by[at:at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(some), block, np.int32)), pa.array(np.full(len(some), kind, np.int8)),
                         pa.array(keys[some]), pa.array(count[some])], names=schema.names)
        made.clear()
        pa.default_memory_pool().release_unused()  # the worker is used again

    return dealt.mapInArrow(run, schema)


DOCUMENT = 2  # comes after the values of both kinds


def score_blocks(dealt: DataFrame, answers: DataFrame, blocks: int, order: int) -> DataFrame:
    """(id, held_out, n_tokens, n_known, known_sum, score) of every document."""
    rows = answers.unionByName(dealt.withColumn("kind", F.lit(DOCUMENT).cast("byte")), allowMissingColumns=True)
    rows = rows.repartitionById(blocks, "block").sortWithinPartitions("block", "kind")
    id_type = dealt.schema["id"].dataType
    schema = T.StructType([
        T.StructField("id", id_type), T.StructField("held_out", T.BooleanType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
        T.StructField("known_sum", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, got, values = None, [], None
        for batch in batches:
            blocks, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            for now in np.unique(blocks).tolist():
                if now != block:
                    block, got, values = now, [], None
                listing = (blocks == now) & (kinds != DOCUMENT)
                if listing.any():
                    own = rows_where(batch.select(["kind", "key", "value"]), listing)
                    got.append([c.to_numpy() for c in own.columns])
                here = (blocks == now) & (kinds == DOCUMENT)
                if not here.any():
                    continue
                if values is None:
                    values, got = Values(*(np.concatenate(c) for c in zip(*got)), order), []
                docs = rows_where(batch.select(["id", "held_out", "text"]), here)
                tokens, known, total, logp = values.score(docs.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [docs.column("id"), docs.column("held_out"), pa.array(tokens.astype(np.int64)),
                     pa.array(known.astype(np.int64)), pa.array(total.astype(np.float64)),
                     pa.array(logp.astype(np.float64))], names=schema.names)
        values = None
        pa.default_memory_pool().release_unused()  # the worker is used again

    return rows.mapInArrow(run, schema)
