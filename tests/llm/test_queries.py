"""Registered queries: odd tables, SQL, and the pipeline against plain Python."""

import base64
import hashlib
import random
from collections import Counter

import duckdb
import pytest
from plain import components, fingerprint, no_documents, normalised, odd_documents, odd_rows

import corpus_pipeline
from starboard.llm.language import Profiles, learn_profiles
from starboard.llm.queries import QUERIES, SQL

ON_DOCUMENTS = [n for n in QUERIES if n.split("_")[0] not in ("op8", "op11", "op12", "reply")]


def written(docs, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = docs.sparkSession.createDataFrame([(0, 1, 0), (1, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ON_DOCUMENTS)
@pytest.mark.parametrize("full", [True, False])
def test_odd_and_empty_tables(spark, tmp_path, name, full):
    rows = QUERIES[name](spark, written(odd_documents(spark) if full else no_documents(spark), tmp_path)).collect()
    if not full:
        assert rows == []
    elif name not in ("op5_best_fit_packing", "op13_phrase_collocations"):
        assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in odd_rows())


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    result = con.execute(SQL[name])
    columns = [d[0] for d in result.description]
    want = Counter(result.fetchall())
    assert Counter(map(tuple, QUERIES[name](spark, sf).select(*columns).collect())) == want


def stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, folder)
        path = f"{folder}/{name.replace(' ', '-')}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        yield name, before, docs


def test_pipeline_against_plain_python(spark, tmp_path):
    folder = written(odd_documents(spark).repartition(3), tmp_path)
    rows = {}
    for name, before, after in stages(spark, folder):
        rows[name] = [tuple(r) for r in after.collect()]
        if name != "pack":
            assert after.columns == before.columns
    profiles = Profiles(learn_profiles(odd_documents(spark).where("doc_id IS NULL OR crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 <> 2")), 400)
    known = [r for r in odd_rows() if profiles.best(r[1])[0] != "und"]
    assert Counter(rows["language"]) == Counter(known)
    assert {r[1] for r in odd_rows()} - {r[1] for r in known} == {None, "", " \t\n", "123 456"}

    by_id = sorted(known, key=lambda r: (r[0] is None, r[0] or 0))
    unique = {}
    for r in by_id:
        unique.setdefault(normalised(r[1]), r)
    assert Counter(rows["exact dedup"]) == Counter(unique.values())

    left = list(unique.values())
    firsts = set(components([fingerprint(r[1]) for r in left]))
    assert Counter(rows["near dedup"]) == Counter(left[i] for i in firsts)
    assert Counter(rows["mix"]) == Counter(rows["near dedup"])
    assert Counter(r[0] for r in rows["pack"] if r[1] == 0) == Counter(r[0] for r in rows["mix"])


def test_the_mix_is_the_order_of_the_rows(spark, tmp_path):
    names = ["a"] * 2000 + ["b"] * 1000 + ["c"] * 1000
    docs = spark.createDataFrame([(i, str(i), "en", s, 1) for i, s in enumerate(names)], "doc_id long, text string, lang string, source string, n_chars long")
    path = str(tmp_path / "mixed")
    corpus_pipeline.mixed(spark, docs, "").write.parquet(path)
    rows = spark.read.parquet(path).selectExpr("source", "_metadata.file_name AS f", "_metadata.row_index AS i").collect()
    order = [r["source"] for r in sorted(rows, key=lambda r: (r["f"], r["i"]))]
    share = {"a": 2**0.5, "b": 1, "c": 1}
    for n in range(200, 2600, 200):
        for s, w in share.items():
            assert abs(order[:n].count(s) - n * w / sum(share.values())) < 2 * 64


def test_pipeline_of_no_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(no_documents(spark), tmp_path)).collect() == []


def test_pipeline_catches_copies_and_keeps_the_rest(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()}
    texts = {}
    for r in sorted(docs, key=lambda r: r["doc_id"]):
        texts.setdefault(hashlib.sha256(normalised(r["text"]).encode()).hexdigest(), r)
    left = list(texts.values())
    firsts = components([fingerprint(r["text"]) for r in left])
    assert kept == {left[i]["doc_id"] for i in set(firsts)}


FOREIGN = {
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw, są oni obdarzeni rozumem i "
    "sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan, heille on annettu järki ja "
    "omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar, akıl ve vicdana sahiptirler ve birbirlerine "
    "karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "vi": "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền lợi, mọi con người đều được tạo hóa "
    "ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình anh em.",
}


def test_foreign_text_and_letter_noise_go_and_short_clean_texts_stay(spark, tmp_path):
    dice = random.Random(5)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    clean = [r["text"].split() for r in docs.where("n_chars > 500").orderBy("doc_id").limit(200).collect()]
    short = [" ".join(w[at : at + n]) for w in clean for n in (1, 2, 4, 12) for at in [dice.randrange(len(w) - n)]]
    short = [t for t in short if sum(c.isalpha() for c in t) > 1]
    letters = "abcdefghijklmnopqrstuvwxyz"
    noise = [" ".join("".join(dice.choices(letters, k=dice.randrange(2, 10))) for _ in range(n)) for n in (40, 200, 2000)]
    coded = [base64.b64encode(dice.randbytes(n)).decode() for n in (300, 3000)]
    added = [(10**9 + 4 * i, t, None, "s0", len(t)) for i, t in enumerate([*FOREIGN.values(), *noise, *coded, *short])]
    both = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(
        spark.createDataFrame(added, "doc_id long, text string, lang string, source string, n_chars long")
    )
    folder = written(both, tmp_path)
    kept = corpus_pipeline.in_known_language(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    kept = {r["doc_id"] for r in kept.select("doc_id").collect()}
    unlike = len(FOREIGN) + len(noise) + len(coded)
    assert not kept & {r[0] for r in added[:unlike]}
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} <= kept
    stay = [r[0] in kept for r in added[unlike:]]
    assert len(stay) > 600 and sum(stay) >= 0.99 * len(stay)


@pytest.mark.parametrize("rows", [200, 1000, 10_000])
def test_language_threshold_on_tables_of_any_size(spark, tmp_path, rows):
    """What stays of noise, foreign and clean text must not depend on how many rows there are to learn from."""
    dice = random.Random(rows)
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").orderBy("doc_id").limit(rows)
    letters = "abcdefghijklmnopqrstuvwxyz"
    noise = [" ".join("".join(dice.choices(letters, k=dice.randrange(2, 10))) for _ in range(n)) for n in (16, 32, 64, 500) for _ in range(25)]
    foreign = [" ".join(t.split()[i : i + 18]) for t in FOREIGN.values() for i in range(5)]
    added = [(10**9 + i, t, None, "s0", len(t)) for i, t in enumerate([*noise, *foreign])]
    both = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(
        spark.createDataFrame(added, "doc_id long, text string, lang string, source string, n_chars long")
    )
    folder = written(both, tmp_path)
    kept = corpus_pipeline.in_known_language(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    lost = docs.where("text IS NOT NULL").count() - sum(i < 10**9 for i in ids)
    stay = [sum(10**9 + first <= i < 10**9 + end for i in ids) for first, end in ((0, 100), (100, 120))]
    print(rows, "noise", stay[0], "of 100, foreign", stay[1], "of 20, clean lost", lost)
    assert stay[0] <= 1 and stay[1] <= 2 and lost <= rows / 1000


def test_two_runs_agree_whatever_the_files(spark, tmp_path):
    """Rows with one id and other texts, and rows without an id; the second run has the rows in other files."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    again = docs.limit(40).selectExpr("IF(doc_id % 2 = 0, doc_id, NULL) AS doc_id", "concat(text, ' ', doc_id, ' x y z ', n_chars) AS text", "lang", "source", "n_chars")
    both = docs.select(*again.columns).unionByName(again)
    shown = []
    for folder, files in ((tmp_path / "a", 2), (tmp_path / "b", 5)):
        both.repartition(files).write.parquet(f"{folder}/documents.parquet")
        run, order = str(folder), []
        for name, _, after in stages(spark, run):
            if name == "mix":
                after = after.selectExpr("doc_id", "text", "_metadata.file_name AS f", "_metadata.row_index AS i")
                order = [(r["doc_id"], r["text"]) for r in sorted(after.collect(), key=lambda r: (r["f"], r["i"]))]
        shown.append(order)
    assert shown[0] == shown[1] and len(shown[0]) > 150


def test_packing_finds_the_mix_again_whatever_the_files(spark, tmp_path):
    """The mix written in order and in any order: the same sequences begin in the same order."""
    rows = [(i, f"w{i % 97} " * (i % 50 + 1) + str(i), "en", "abc"[i % 7 % 3], 1) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    in_order, shuffled = str(tmp_path / "a"), str(tmp_path / "b")
    corpus_pipeline.mixed(spark, docs, "").write.parquet(in_order)
    spark.read.parquet(in_order).orderBy("text").repartition(3).write.parquet(shuffled)
    order = spark.read.parquet(in_order).selectExpr("doc_id", "_metadata.file_name AS f", "_metadata.row_index AS i").collect()
    at = {r["doc_id"]: n for n, r in enumerate(sorted(order, key=lambda r: (r["f"], r["i"])))}
    for path in (in_order, shuffled):
        found = corpus_pipeline.packed(spark, spark.read.parquet(path), "").collect()
        assert Counter(r["doc_id"] for r in found if r["piece"] == 0) == Counter(range(3000))
        found.sort(key=lambda r: (r["sequence_id"], r["offset"]))
        heads = [at[r["doc_id"]] for r in found if r["offset"] == 0]
        assert heads == sorted(heads) and len(heads) < 150


def test_sequences_follow_the_mix(spark, tmp_path):
    """Sources of unequal size and length, in several files of which the last are the largest."""
    words = {"a": 500, "b": 60, "c": 5}
    names = ["a"] * 2000 + ["b"] * 1000 + ["c"] * 1000
    rows = [(i, " ".join(f"w{(i + k) % 97}" for k in range(words[s])), "en", s, 1) for i, s in enumerate(names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    path, key = str(tmp_path / "mixed"), "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        corpus_pipeline.mixed(spark, docs, "").write.parquet(path)
        found = corpus_pipeline.packed(spark, spark.read.parquet(path), "").select("doc_id", "sequence_id", "offset").collect()
    finally:
        spark.conf.set(key, before)
    assert len(list((tmp_path / "mixed").glob("part-*"))) > 1
    order = spark.read.parquet(path).selectExpr("doc_id", "_metadata.file_name AS f", "_metadata.row_index AS i").collect()
    at = {r["doc_id"]: n for n, r in enumerate(sorted(order, key=lambda r: (r["f"], r["i"])))}
    found.sort(key=lambda r: (r["sequence_id"], r["offset"]))
    heads = [at[r["doc_id"]] for r in found if r["offset"] == 0]
    assert heads == sorted(heads)
    share = {"a": 2**0.5, "b": 1, "c": 1}
    total = sum(share.values())
    for n in range(200, 2600, 200):
        had = Counter(names[r["doc_id"]] for r in found[:n])
        assert all(abs(had[s] - n * w / total) < 3 * 64 for s, w in share.items()), (n, had)
