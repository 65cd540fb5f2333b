"""Line dedup: runs, levels and the whole operator against a plain count."""

import random
import time
from collections import defaultdict

from pyspark.sql import functions as F

from promoscope.llm.line_runs import HASH, LineRuns, deduped_documents, drop_frequent_lines, frequent_lines
from promoscope.session import scratch_path

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def plain(rows, min_docs):
    where = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            where[key(line)].add(i)
    gone = {k for k, ids in where.items() if k and len(ids) >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in gone]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_against_a_plain_count(spark):
    rng = random.Random(5)
    lines = ["Shared line", " shared LINE\t", "ÉCOLE", "école", "", "  ", "a", "A", "İ", "x\r", "rare"] + [f"own {i}" for i in range(40)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 12)))) for i in range(80)]
    rows += [(3, "Shared line\nrepeated id"), (None, "a\nnull id"), (None, "a"), (90, None), (91, "\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for min_docs, batches, fanout in ((3, 1, 2), (10, 4, 3), (5, 7, 2)):
        got = drop_frequent_lines(df, min_docs, batches=batches, fanout=fanout)
        got = sorted((tuple(r) for r in got.select("row.doc_id", "n_lines", "n_dropped", "kept").collect()), key=str)
        assert got == plain(rows, min_docs)


def test_runs_are_compacted_by_level_and_stay_sorted(spark):
    runs = LineRuns(spark, scratch_path(spark, "runs"), min_docs=100, fanout=2)
    for b in range(7):
        runs.add(spark.range(b * 10, b * 10 + 50).select(F.col("id").alias("h1"), F.lit(0).cast("long").alias("h2"),
                                                        F.lit(1).cast("long").alias("n_docs")))
    assert {level: len(paths) for level, paths in runs.levels.items() if paths} == {0: 1, 1: 1, 2: 1}
    got = {r["h1"]: r["n_docs"] for r in runs.totals().collect()}
    assert got == {i: sum(b * 10 <= i < b * 10 + 50 for b in range(7)) for i in range(110)}
    for paths in runs.levels.values():
        for path in paths:
            parts = spark.read.parquet(path).select(*HASH, F.input_file_name().alias("f")).collect()
            for f in {r["f"] for r in parts}:
                own = [(r["h1"], r["h2"]) for r in parts if r["f"] == f]
                assert own == sorted(own)


def test_frequent_lines_are_not_added_again(spark):
    runs = LineRuns(spark, scratch_path(spark, "runs"), min_docs=2, fanout=9)
    batch = spark.createDataFrame([(1, 1, 2), (2, 2, 1)], "h1 long, h2 long, n_docs long")
    runs.add(batch)
    runs.add(batch)
    second = spark.read.parquet(runs.levels[0][1]).collect()
    assert [(r["h1"], r["n_docs"]) for r in second] == [(2, 1)]
    assert {r["h1"] for r in runs.frequent().collect()} == {1, 2}


def test_documents_keep_their_columns(spark):
    rows = [(i, f"common\nown {i}", "en", "s", 1) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = deduped_documents(df, min_docs=10)
    assert out.schema == df.schema
    assert sorted(tuple(r) for r in out.collect()) == sorted((i, f"own {i}", "en", "s", len(f"own {i}")) for i in range(12))


def test_only_dataframe_operations(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = drop_frequent_lines(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_very_many_lines(spark):
    """200,000 lines of one document, most of them frequent: linear in the lines."""
    shared = [f"line {i}" for i in range(120_000)]
    text = "\n".join(x for i, line in enumerate(shared) for x in ([line, f"own {i}"] if i % 3 else [line, line]))
    rows = [(i, "\n".join(shared)) for i in range(2)] + [(2, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    started = time.time()
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept"]) for r in drop_frequent_lines(df, 3).select("row.doc_id", "n_lines", "n_dropped", "kept").collect()}
    assert time.time() - started < 60
    assert got[0] == got[1] == (120_000, 120_000, "")
    assert got[2] == (240_000, 160_000, "\n".join(f"own {i}" for i in range(120_000) if i % 3))


def test_a_third_of_all_rows_under_one_id(spark):
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, f"own {i % 200}\ncommon\nline {i % 40}") for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = drop_frequent_lines(df, min_docs=10).select("row.doc_id", "n_lines", "n_dropped", "kept").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows, 10)
    drops = frequent_lines(df, 10, "doc_id", "text", 4, 3)
    assert max(r["count"] for r in drops.groupBy("__id", "t1", "t2").count().collect()) == 1
