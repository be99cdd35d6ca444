import pytest
import xxhash
from plain import WORDS, no_documents, odd_documents, odd_rows
from pyspark.sql import functions as F

from starboard.llm import fingerprints as fp


def plain_hashes(text, width=5):
    words = WORDS.findall((text or "").lower())
    out = []
    for i in range(max(1, len(words) - width + 1)) if words else []:
        seed = 42
        for w in words[i : i + width]:
            seed = xxhash.xxh64_intdigest(w.encode(), seed=seed)
        out.append(seed)
    return out


def plain_sketch(text, bits=fp.SCALE_BITS):
    hashes = plain_hashes(text)
    small = sorted({h for h in hashes if h < 1 << (64 - bits)})
    return small or ([min(hashes)] if hashes else [])


def edited(rows):
    """(row, next row, edited text) in descending order of id, nulls last, repeats in the order they stand."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for a, b in zip(order, order[1:] + order[:1]):
        own, other = a[1] or "", b[1] or ""
        yield a, b, own[: len(own) - len(own) // 2] + other[: len(own) // 2]


@pytest.mark.parametrize("partitions", [1, 5])
def test_against_plain_python(spark, partitions):
    docs = odd_documents(spark).coalesce(partitions)
    found = fp.fingerprint_edited(docs)
    rows = found.select(
        "*",
        fp.resemblance(F.col("own"), F.col("edited_sketch")).alias("near"),
        fp.resemblance(F.col("own"), F.col("next_sketch")).alias("next"),
        fp.as_text(F.col("own")).alias("text"),
    ).collect()

    def unsigned(hashes):
        return sorted(h & (1 << 64) - 1 for h in hashes)

    def near(a, b):
        return len({*a} & {*b}) / len({*a} | {*b}) if a or b else 1.0

    def row(i, n, text, own, changed, other):
        return (str(i), n, text, own, changed, other, round(near(own, changed), 9), round(near(own, other), 9))

    got = sorted(
        row(r["doc_id"], r["n_chars"], r["edited"], unsigned(r["own"]), unsigned(r["edited_sketch"]), unsigned(r["next_sketch"]))
        for r in rows
    )
    want = sorted(
        row(a[0], len(a[1] or ""), text, plain_sketch(a[1]), plain_sketch(text), plain_sketch(b[1]))
        for a, b, text in edited(odd_rows())
    )
    assert got == want
    for r in rows:
        own = unsigned(r["own"])
        assert r["near"] == pytest.approx(near(own, unsigned(r["edited_sketch"])))
        assert r["next"] == pytest.approx(near(own, unsigned(r["next_sketch"])))
        assert r["text"] == "".join(f"{h & (1 << 64) - 1:016x}" for h in r["own"])


def test_estimates_of_very_unequal_documents(spark):
    words = [f"w{i}" for i in range(6000)]
    long, part = " ".join(words), " ".join(words[1000:2200])
    half = " ".join(words[:600] + [f"x{i}" for i in range(600)])
    df = spark.createDataFrame([(long, part, half)], "a string, b string, c string")
    a, b, c = (fp.sketch(F.col(x)) for x in "abc")
    r = df.select(
        fp.containment(b, a).alias("whole"), fp.containment(c, a).alias("half"), fp.containment(a, b).alias("fifth"),
        fp.containment(fp.merged(b, c), a).alias("both"), fp.resemblance(a, b).alias("near"),
    ).first()
    assert r["whole"] == 1.0 and r["half"] == pytest.approx(0.5, abs=0.12) and r["fifth"] == pytest.approx(0.2, abs=0.05)
    assert r["both"] == pytest.approx(0.75, abs=0.1) and r["near"] == pytest.approx(0.2, abs=0.05)


def test_merging_sketches_is_sketching_the_union(spark):
    texts = [" ".join(f"a{i}" for i in range(400)), " ".join(f"a{i}" for i in range(200, 900))]
    df = spark.createDataFrame([tuple(texts)], "a string, b string")
    r = df.select(fp.merged(fp.sketch(F.col("a")), fp.sketch(F.col("b"))).alias("m")).first()
    assert list(r["m"]) == sorted({*plain_sketch(texts[0]), *plain_sketch(texts[1])})


def test_one_and_no_documents(spark):
    one = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    r = fp.fingerprint_edited(one).first()
    assert r["edited"] == "a b c da b c " and r["own"] == r["next_sketch"]
    assert fp.fingerprint_edited(no_documents(spark)).collect() == []


def test_no_python_in_the_plan(spark):
    found = fp.fingerprint_edited(odd_documents(spark))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_containment_of_short_texts(spark):
    """Short runs of words of long texts: contained as a whole, or without support; never an estimate of nothing."""
    import random

    dice = random.Random(9)
    rows = []
    for i in range(400):
        long = [f"w{dice.randrange(10**6)}" for _ in range(400)]
        at = dice.randrange(390)
        rows.append((i, " ".join(long[at : at + dice.choice([5, 8, 12, 40])]), " ".join(long)))
    docs = spark.createDataFrame(rows, "i int, short string, long string")
    docs = docs.select("i", fp.sketch(F.col("short")).alias("a"), fp.sketch(F.col("long")).alias("b"))
    found = docs.select(fp.containment(F.col("a"), F.col("b")).alias("c"), F.size(fp.supported(F.col("a"))).alias("n")).collect()
    assert {r["c"] for r in found if r["n"]} == {1.0} and {r["c"] for r in found if not r["n"]} == {None}
    assert 20 < sum(r["n"] > 0 for r in found) < 400


def test_merged_is_the_sketch_of_both_texts(spark):
    import random

    dice = random.Random(3)
    texts = [" ".join(f"w{dice.randrange(10**6)}" for _ in range(dice.choice([0, 5, 6, 9, 60]))) for _ in range(300)]
    rows = [(a, b) for a, b in zip(texts, texts[1:])]
    docs = spark.createDataFrame(rows, "a string, b string")
    both = F.flatten(F.array(fp.shingle_hashes(F.col("a")), fp.shingle_hashes(F.col("b"))))
    found = docs.select(both.alias("hashes"), fp.merged(fp.sketch(F.col("a")), fp.sketch(F.col("b"))).alias("m")).collect()
    for r in found:
        hashes = {h & (1 << 64) - 1 for h in r["hashes"]}
        small = {h for h in hashes if h < 1 << (64 - fp.SCALE_BITS)}
        assert {h & (1 << 64) - 1 for h in r["m"]} == (small or ({min(hashes)} if hashes else set()))
