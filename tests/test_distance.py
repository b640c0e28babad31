import random

from pyspark.sql import functions as F

from quillspark.functions.distance import prefix_within


def plain(query, key, most):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    return any(distance(query, key[:n]) <= most for n in range(len(key) + 1))


# Pairs with known answers.
TABLE = [("солнечо", "солнечногорск", 1, True), ("солнечо", "солнечногорск", 0, False), ("kat", "katze", 0, True), ("kat", "cat", 1, True), ("kat", "dog", 2, False), ("berlim", "berlin", 1, True), ("be", "xyz", 2, True), ("", "", 0, True)]


def test_table(spark):
    for most in (0, 1, 2):
        rows = [(q, k, w) for q, k, m, w in TABLE if m == most]
        got = spark.createDataFrame(rows, "q string, k string, w boolean").select("w", prefix_within(F.col("k"), F.col("q"), most).alias("x")).collect()
        assert [r["x"] for r in got] == [r["w"] for r in got]


def test_column_agrees_with_plain(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abя\U0001f600") for _ in range(rng.randrange(0, 7)))
    pairs = [(word(), word()) for _ in range(600)]
    got = spark.createDataFrame(pairs, "q string, k string").select("q", "k", prefix_within(F.col("k"), F.col("q"), 1).alias("one"), prefix_within(F.col("k"), F.col("q"), 2).alias("two")).collect()
    for r in got:
        assert (r["one"], r["two"]) == (plain(r["q"], r["k"], 1), plain(r["q"], r["k"], 2))
