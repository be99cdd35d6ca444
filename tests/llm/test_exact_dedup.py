import hashlib
from collections import Counter

import pytest
from plain import no_documents, normalised, odd_documents, odd_rows

from starboard.llm.exact_dedup import exact_dedup


@pytest.mark.parametrize("block_bytes", [1, 64, 4096])
def test_against_plain_python(spark, block_bytes):
    if block_bytes == 1:
        rows = [r for r in odd_rows() if len(r[1] or "") < 500]
    else:
        rows = odd_rows()
    docs = spark.createDataFrame(rows, odd_documents(spark).schema).repartition(5)
    groups = {}
    for r in rows:
        groups.setdefault(normalised(r[1]), []).append(r[0])
    least = {t: min(ids, key=lambda i: (i is None, i)) for t, ids in groups.items()}
    want = Counter((r[0], least[t := normalised(r[1])], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for r in rows)
    found = exact_dedup(docs, block_bytes=block_bytes).collect()
    assert Counter((r["doc_id"], r["keep"]["doc_id"], r["group_size"], r["text_sha256"]) for r in found) == want
    assert sum(r["kept"] for r in found) == len(groups)
    assert all(r["kept"] == (r["keep"]["_row"] == r["_row"]) for r in found)


def test_texts_that_share_all_blocks_but_the_last(spark):
    long = "".join(chr(97 + i * i % 26) for i in range(1000))
    texts = [long, long + "a", long + "b", long[:-1], long + "a", long * 2, long + long]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["keep"]["doc_id"] for r in exact_dedup(docs, block_bytes=16).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 1, 5: 5, 6: 5}


def test_no_documents(spark):
    assert exact_dedup(no_documents(spark)).collect() == []
