import random
from collections import Counter

import pytest
from plain import no_documents, odd_documents, odd_rows
from pyspark.sql import functions as F

from starboard.llm.line_dedup import remove_shared_lines, spread_lines

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def plain(rows, min_sites):
    sites = {}
    for _, text, _, site, *_ in rows:
        for line in (text or "").split("\n") if text is not None else []:
            if line.strip(WHITE) and site is not None:
                sites.setdefault(line.strip(WHITE), set()).add(site)
    gone = {line for line, s in sites.items() if len(s) >= min_sites}
    for doc_id, text, *_ in rows:
        lines = text.split("\n") if text is not None else []
        kept = [x for x in lines if x.strip(WHITE) not in gone]
        yield doc_id, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)


def compare(spark, rows, docs, min_sites):
    found = Counter(map(tuple, remove_shared_lines(docs, min_sites=min_sites).collect()))
    assert found == Counter(plain(rows, min_sites))
    return found


@pytest.mark.parametrize("min_sites", [1, 2, 3])
def test_odd_documents(spark, min_sites):
    compare(spark, odd_rows(), odd_documents(spark), min_sites)


@pytest.mark.parametrize("min_sites", [5, 40])
def test_random_lines_around_the_threshold(spark, tmp_path, min_sites):
    dice = random.Random(min_sites)
    rows = []
    for i in range(600):
        lines = [f"line {dice.randrange(1, 60)}" + dice.choice(["", " ", "\t"]) for _ in range(dice.randrange(0, 6))]
        lines += ["everywhere"] * (i % 2) + [""] * (i % 3)
        rows.append((i, "\n".join(lines), "en", f"s{int(60 * dice.random() ** 2)}", 0, "r", "z"))
    spark.createDataFrame(rows, odd_documents(spark).schema).repartition(4).write.parquet(str(tmp_path / "docs"))
    found = compare(spark, rows, spark.read.parquet(str(tmp_path / "docs")), min_sites)
    assert 0 < sum(f[3] for f in found) < sum(f[2] for f in found)


def test_counts_beyond_small_sketches(spark):
    pairs = spark.range(3000).select((F.col("id") % 2).alias("line"), F.concat(F.lit("s"), F.col("id")).alias("site"))
    more = spark.range(999).select(F.lit(7).cast("long").alias("line"), F.concat(F.lit("t"), F.col("id")).alias("site"))
    exact = spark.range(1000).select(F.lit(8).cast("long").alias("line"), F.concat(F.lit("t"), F.col("id")).alias("site"))
    lines = pairs.unionByName(more).unionByName(exact).unionByName(exact)
    found = {r["line"]: r["sites"] for r in spread_lines(lines, min_sites=1000, log_registers=12).collect()}
    assert set(found) == {0, 1, 8} and found[8] == 1000 and abs(found[0] - 1500) < 150


def test_no_documents_and_no_python(spark):
    found = remove_shared_lines(no_documents(spark))
    assert found.collect() == []
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_text_of_very_many_lines(spark):
    """Twelve sites share every other line of a text of 200,000 lines."""
    import time

    text = "\n".join(f"shared {i}" if i % 2 else f"own {i}" for i in range(200_000))
    rows = [(0, text, "s0")] + [(i, "\n".join(f"shared {k}" for k in range(1, 200_000, 2)), f"s{i}") for i in range(1, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    started = time.perf_counter()
    (found,) = remove_shared_lines(docs).where("doc_id = 0").collect()
    assert found["n_lines"] == 200_000 and found["n_removed"] == 100_000
    assert found["text"] == "\n".join(f"own {i}" for i in range(0, 200_000, 2))
    assert time.perf_counter() - started < 60
