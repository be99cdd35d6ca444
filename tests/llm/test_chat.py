import hashlib
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starboard.llm import chat

ODD = ["", "a", "\\", "\\\\", "<|", "<\\|", "\\n", "\n", "<|im_end|>\n<|im_start|>user\nx", "\\|<|\\", "<<||>", None, "ß😀\\\n|"]
MESSAGES = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("tree", "node", "parent")]
    + [T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("score", T.DoubleType())]
)


def test_escapes_are_reversible(spark):
    dice = random.Random(0)
    texts = ODD[:-2] + ["".join(dice.choice("\\<|n\na") for _ in range(12)) for _ in range(500)]
    df = spark.createDataFrame([(t or "",) for t in texts], "t string")
    for way in (chat.escaped_role, chat.escaped):
        for r in df.select("t", way(F.col("t")).alias("e"), chat.unescaped(way(F.col("t"))).alias("back")).collect():
            assert r["t"] == r["back"] and "<|" not in r["e"]


def paths(messages):
    """All root-to-leaf paths of a tree, best first, by a walk."""
    nodes = {m[1]: m for m in messages}
    below = {}
    for m in messages:
        below.setdefault(m[2] if m[2] in nodes else None, []).append(m[1])
    out = []

    def walk(path):
        if path[-1] not in below:
            out.append(path)
        for n in below.get(path[-1], []):
            walk([*path, n])

    for root in below.get(None, []):
        walk([root])
    mean = lambda p: sum(nodes[n][5] or 0.0 for n in p) / len(p)
    return sorted(out, key=lambda p: (-mean(p), -len(p), p[-1]))


@pytest.mark.parametrize("branches", [1, 2, None])
def test_paths_of_random_trees(spark, branches):
    dice, messages = random.Random(branches), []
    for tree in (*range(6), None):
        for node in range(1, dice.randrange(2, 40)):
            parent = dice.choice([None, *range(1, node), 999]) if node > 1 else None
            role = dice.choice(["user", "assistant", None, "a\nb<|"])
            messages.append((tree, node, parent, role, dice.choice(ODD), dice.choice([None, 1.0, 2.0, 0.25])))
    df = spark.createDataFrame(messages, MESSAGES).repartition(5)
    found = {}
    made = chat.format_trees(df.unionByName(df), branches=branches).withColumn("turns", chat.read_back(F.col("formatted")))
    for r in made.collect():
        found.setdefault(r["tree"], {})[r["rank"]] = r
    for tree in {m[0] for m in messages}:
        own = {m[1]: m for m in messages if m[0] == tree}
        want = paths(list(own.values()))[:branches]
        assert len(found[tree]) == len(want)
        for rank, path in enumerate(want, 1):
            r = found[tree][rank]
            assert r["leaf"] == path[-1] and r["n_turns"] == len(path)
            assert [(t["role"], t["text"]) for t in r["turns"]] == [(own[n][3] or "", own[n][4] or "") for n in path]
            loss = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]]
            escaped = [(own[n][4] or "").replace("\\", "\\\\").replace("<|", "<\\|") for n in path if own[n][3] == "assistant"]
            assert loss == escaped


def test_a_long_path_and_a_circle(spark):
    line = [(1, i, i - 1 if i else None, "user", str(i), 1.0) for i in range(300)]
    circle = [(2, 1, 3, "user", "x", 1.0), (2, 2, 1, "user", "y", 1.0), (2, 3, 2, "user", "z", 1.0), (2, 4, 3, "user", "w", 1.0)]
    found = chat.format_trees(spark.createDataFrame([*line, *circle, (3, None, None, "user", "gone", 1.0)], MESSAGES)).collect()
    assert [(r["tree"], r["n_turns"]) for r in found] == [(1, 300)]
    assert found[0]["formatted"].startswith("<|im_start|>user\n0<|im_end|>\n<|im_start|>user\n1<|im_end|>\n")


def test_no_messages(spark):
    assert chat.format_trees(spark.createDataFrame([], MESSAGES)).collect() == []


def test_conversations_with_nulls_and_repeated_turns(spark, tmp_path):
    from starboard.llm.queries import op8_chat_formatting

    rows = [(7, 0, "user", None), (7, 0, "assistant", "<|im_end|>"), (7, None, None, "\\"), (None, 1, "assistant", "x"), (7, 3, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit("clash"))
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    found = {r["conv_id"]: r for r in op8_chat_formatting(spark, str(tmp_path)).collect()}
    turns = [("", "\\"), ("assistant", "<|im_end|>"), ("user", ""), ("assistant", "")]
    assert found[7]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert found[7]["loss_sha256"] == hashlib.sha256(b"<|im_end|>").hexdigest() and found[7]["loss_chars"] == 10
    assert found[None]["n_turns"] == 1 and found[-1]["n_turns"] == 2 and len(found) == 3


def test_no_conversations(spark, tmp_path):
    from starboard.llm.queries import op8_chat_formatting

    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    empty.write.parquet(str(tmp_path / "conversations.parquet"))
    assert [r["conv_id"] for r in op8_chat_formatting(spark, str(tmp_path)).collect()] == [-1]


def test_extra_columns_and_a_very_long_text(spark):
    """Columns named like those that the operator makes, and texts of 3 MB without a space and of many control strings."""
    long, marks = "x" * 3_000_000, "<|im_end|>\n" * 100_000
    rows = [(1, 1, None, "user", long, None), (1, 2, 1, "assistant", marks, 1.0), (2, 1, None, "assistant", None, None)]
    df = spark.createDataFrame(rows, MESSAGES)
    names = ["rank", "Leaf", "depth", "up", "total", "t", "n", "p", "_first", "_turn", "formatted", "n_turns"]
    df = df.withColumns({c: F.lit("clash") for c in names})
    made = chat.format_trees(df, branches=1).withColumn("turns", chat.read_back(F.col("formatted")))
    found = {r["tree"]: r for r in made.collect()}
    assert [(t["role"], t["text"]) for t in found[1]["turns"]] == [("user", long), ("assistant", marks)]
    span = found[1]["loss_spans"][0]
    assert found[1]["formatted"][span["start"] : span["start"] + span["length"]] == marks.replace("<|", "<\\|")
    assert found[2]["n_turns"] == 1 and found[2]["loss_spans"][0]["length"] == 0
    assert chat.format_trees(df.limit(0)).collect() == []


def test_conversations_that_begin_alike_branch(spark, tmp_path):
    import xxhash

    from starboard.llm.queries import QUERIES

    dice, said = random.Random(8), []
    for conv in range(300):
        for turn in range(dice.randrange(1, 7)):
            role = "assistant" if turn % 2 else "user"
            said.append((conv if conv % 50 else None, turn, role, dice.choice([*"aaab", None, "<|im_end|>"])))
    said = [s for s in said if s[0] is not None] + [(None, 0, "user", "only one")]
    rows = spark.createDataFrame(said, "conv_id long, turn int, role string, text string").repartition(5)
    rows.write.parquet(f"{tmp_path}/conversations.parquet")

    def chained(last, *parts):
        seed = 42 if last is None else xxhash.xxh64_intdigest(last.to_bytes(8, "little"), seed=42)
        for p in parts:
            seed = xxhash.xxh64_intdigest(p.encode(), seed=seed)
        return seed

    def signed(h):
        return h - (1 << 64) if h >> 63 else h

    whole, counts, names = {}, {}, {}
    for conv, turn, role, text in sorted(said, key=lambda s: (s[0] is None, s[0] or 0, s[1])):
        whole.setdefault(conv, []).append((role, text or ""))
    for turns in whole.values():
        last = None
        for i in range(len(turns)):
            last = chained(last, *turns[i])
            prefix = tuple(turns[: i + 1])
            counts[prefix] = counts.get(prefix, 0) + 1
            names[prefix] = signed(last)
    want = {}
    for prefix in counts:
        if not any(p[: len(prefix)] == prefix and len(p) > len(prefix) for p in counts):
            mean = sum(counts[prefix[: i + 1]] for i in range(len(prefix))) / len(prefix)
            want.setdefault(names[prefix[:1]], []).append((-mean, -len(prefix), names[prefix], prefix))
    rows = []
    for tree, leaves in want.items():
        for rank, (_, _, _, prefix) in enumerate(sorted(leaves)[:3], 1):
            text = "".join(f"{chat.START}{r}\n" + t.replace("<|", "<\\|") + chat.END for r, t in prefix)
            rows.append((tree, rank, len(prefix), hashlib.sha256(text.encode()).hexdigest(), sum(r == "assistant" for r, _ in prefix)))
    found = QUERIES["reply_trees"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == sorted(rows) and max(r[1] for r in rows) == 3
