"""Plain Python versions of the operators, and documents with all the odd cases."""

import re

import numpy as np
import xxhash
from pyspark.sql import types as T

WORDS = re.compile(r"[^\x20\x09-\x0D]+")

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("_row", T.StringType()),
        T.StructField("Score", T.StringType()),
    ]
)

EN = "the cat and the dog are with this man in that house and they were there for the other one"
DE = "der hund und die katze sind mit dem mann in diesem haus und nicht auf der strasse oder im garten"


def odd_rows():
    """Nulls in every column, empty, white and letterless texts, repeats, ties, a long text, clashing extra columns."""
    texts = [EN, DE, None, "", " \t\n", "123 456", "a", EN, EN.replace(" ", "  \n"), f"{EN} x", "<|endoftext|> ÄÖ é ß ½ 中文 😀"]
    rows = [(i, t, "de" if t == DE else "en", f"s{i % 3}", None, "r", "z") for i, t in enumerate(texts)]
    rows.append((11, " ".join(f"{EN} {i}" for i in range(3000)), None, "s0", 7, None, None))
    rows += [(12, "same row", "en", "s1", 8, "r", "z")] * 3
    rows += [(None, "no id", "en", None, None, None, None), (13, f"{EN}\n{DE}", "en", None, 1, "q", "q")]
    rows += [(20 + i, f"{EN} {DE} {i}", "en" if i % 2 else "de", "s2", 1, "q", "q") for i in range(20)]
    return rows


def odd_documents(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def normalised(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def fingerprint(text, width=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(lower)
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, distance=2):
    """Smallest index that each index reaches over differences of at most so many bits."""
    values, parent = np.array(prints, np.uint64), list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= distance):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]
