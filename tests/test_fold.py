import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quillspark.functions.fold import normalize, normalize_col

CASES = [
    ("Berlin", "berlin"), ("NEW YORK", "new york"), ("Café", "cafe"), ("Zürich", "zurich"), ("São Paulo", "sao paulo"), ("Đà Nẵng", "đa nang"),
    ("New---York", "new york"), ("a_b/c,d.e", "ab c d e"), ("O'Brien", "obrien"), ("St. John's", "st johns"), ("Val-d'Or", "val dor"), ("a  -_/,. b", "a b"),
    ("(New) York", "new york"), ("ﬁnd", "find"), ("m²", "m2"), ("ＦＵＬＬ", "full"), ("", ""), ("---", ""), (" - _ / ", ""), ("́", ""), ("Солнечногорск", "солнечногорск"),
    ("ΟΔΟΣ", "οδος"), ("й ё", "и е"), ("a\x1cb", "ab"), ("\U0001f150", "\U0001f150"), (None, ""),
]


@pytest.mark.parametrize("text,key", CASES)
def test_fold(text, key):
    assert normalize(text) == key


@given(st.text(max_size=20))
def test_twice_is_once(text):
    once = normalize(text)
    assert normalize(once) == once


def test_column_agrees_with_scalar(spark):
    rng = random.Random(3)
    texts = [c[0] for c in CASES] + ["".join(chr(rng.choice([rng.randrange(1, 128), rng.randrange(160, 0x600), rng.randrange(0x1E00, 0x2200)])) for _ in range(12)) for _ in range(400)] + [f"a{chr(p)}b" for p in range(1, 128)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", normalize_col("t").alias("k")).collect()
    for r in rows:
        text = texts[r["i"]]
        assert r["k"] == (None if text is None else normalize(text)), repr(text)


def test_unassigned_and_all_planes_are_idempotent():
    for point in range(0x110000):
        if not 0xD800 <= point < 0xE000:
            once = normalize(f"a{chr(point)}b")
            assert normalize(once) == once
