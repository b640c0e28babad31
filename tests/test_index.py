import pytest
from pyspark.sql import functions as F

from quillspark import EditBoundError, IndexBuilder, IndexFormatError, SuggestIndex
from quillspark.adapters import delimited, variants
from quillspark.operators import links, suggest
from quillspark.functions.order import parse_unsigned, to_signed, to_unsigned


def build(spark, rows):
    """rows: (group, rank, payload, keys)."""
    builder = IndexBuilder(spark)
    for group, rank, payload, keys in rows:
        record = builder.add_record(group, rank, payload)
        for key in keys:
            builder.add_key(key, record)
    return builder.build()


CITIES = [(1, 3_600_000, b"Berlin", ["berlin", "ber"]), (2, 130_000, b"Bern", ["bern", "ber"]), (3, 280_000, b"Bergen", ["bergen", "ber"]), (4, 2_100_000, b"Paris", ["paris"])]


@pytest.fixture(scope="module")
def cities(spark):
    return build(spark, CITIES)


def names(index, *args, **kw):
    return [p.decode() for _, _, p in index.suggest_rows(*args, **kw)]


def test_rank_order_and_limit(cities):
    assert names(cities, "ber") == ["Berlin", "Bergen", "Bern"]
    assert names(cities, "BÉR", 2) == ["Berlin", "Bergen"]
    assert names(cities, "ber", 100) == ["Berlin", "Bergen", "Bern"]
    assert names(cities, "zzz") == names(cities, "") == names(cities, " - ") == names(cities, "ber", 0) == []


def test_guards_come_before_the_edit_bound(cities):
    assert names(cities, "", 8, 99) == names(cities, "ber", 0, 99) == []
    with pytest.raises(EditBoundError):
        cities.suggest("ber", 8, 99)
    with pytest.raises(IOError):
        cities.suggest("ber", 8, 3)
    for bad in ((-1, 0), (8, -1)):
        with pytest.raises(ValueError):
            cities.suggest("ber", *bad)


def test_fuzzy(spark):
    index = build(spark, [(1, 52_798, b"S", ["солнечногорск"]), (2, 3_600_000, b"B", ["berlin"])])
    assert names(index, "солнечо") == [] and names(index, "солнечо", 8, 1) == ["S"]
    assert names(index, "berlim", 8, 1) == ["B"] and names(index, "xerlin", 8, 2) == []
    assert names(index, "be", 8, 2) == ["B"] and names(index, "bz", 8, 2) == ["B"]
    assert names(index, "ber", 8, 0) == names(index, "ber")


def test_groups_ties_and_extremes(spark):
    index = build(spark, [
        (42, 10, b"low", ["x"]), (42, 999, b"high", ["x", "xx"]), (7, 100, b"Beta", ["tie"]), (8, 100, b"Alpha", ["tie"]), (1, -100, b"a", ["neg"]), (2, -1, b"b", ["neg"]),
        (2**64 - 1, -(2**63), b"\x00\xff", ["ext"]), (5, -(2**63), b"\x00\xff", ["ext"]), (9, 2**63 - 1, b"", ["ext"]), (6, 1, b"none", []), (11, 5, b"Z", ["zürich"]),
    ])
    assert names(index, "x") == ["high"] and names(index, "tie") == ["Alpha", "Beta"] and names(index, "neg") == ["b", "a"]
    assert index.suggest_rows("ext") == [(2**63 - 1, 9, b""), (-(2**63), 5, b"\x00\xff"), (-(2**63), 2**64 - 1, b"\x00\xff")]
    assert len(index) == 11 and names(index, "zür") == [] and not index.is_empty


def test_empty_duplicates_and_dangling(spark):
    empty = SuggestIndex.empty(spark)
    assert len(empty) == 0 and names(empty, "a") == []
    builder = IndexBuilder(spark)
    ids = [builder.add_record(k, k, b"p%d" % k) for k in range(3)]
    for i in (2, 0, 0, 1):
        builder.add_key("k", ids[i])
    builder.add_key("j", 0)
    index = builder.build()
    assert index.posting(1) == [0, 1, 2] and index.posting(0) == [0] and index.counts() == {"records": 3, "links": 4, "keys": 2}
    assert index.record(1)["rank"] == 1
    for bad in (index.record, index.posting):
        with pytest.raises(IndexFormatError):
            bad(9)
    builder.add_key("d", 99)
    with pytest.raises(IndexFormatError):
        builder.build()


def test_store_and_reopen(spark, cities, tmp_path):
    path = str(tmp_path / "index")
    first = cities.write(path)
    again, other = SuggestIndex.open(spark, path), SuggestIndex.open(spark, path)
    assert len(again) == 4 and again.build_id == first["build"] and names(again, "ber") == names(other, "ber") == ["Berlin", "Bergen", "Bern"]
    assert sorted(map(tuple, again.covering.select("key", "record_id").collect())) == sorted(map(tuple, cities.covering.select("key", "record_id").collect()))
    plan = again.suggest("ber")._jdf.queryExecution().toString()
    assert "StringStartsWith(key,ber)" in plan and "TakeOrderedAndProject" in plan and "Join" not in plan
    assert cities.write(path)["build"] != first["build"] and names(SuggestIndex.open(spark, path), "ber")[0] == "Berlin"
    with pytest.raises(IndexFormatError):
        SuggestIndex.open(spark, str(tmp_path / "none"))
    (tmp_path / "index" / ".manifest.json.crc").unlink(missing_ok=True)
    (tmp_path / "index" / "manifest.json").write_text('{"version": 99, "build": "x"}')
    with pytest.raises(IndexFormatError):
        SuggestIndex.open(spark, path)


def test_places_of_keys(spark, tmp_path, monkeypatch):
    """The key at a place, found in memory step by step and by number in a stored index."""
    monkeypatch.setattr(links, "FEW_KEYS", 2)
    keys = sorted({"a", "ab", "abc", "abcd", "abce", "b", "ba", "é", "中", "z z"})
    index = build(spark, [(k, k, b"p", [key]) for k, key in enumerate(keys)])
    index.write(str(tmp_path / "k"))
    stored = SuggestIndex.open(spark, str(tmp_path / "k"))
    order = sorted(keys, key=lambda k: k.encode())
    for n, key in enumerate(order):
        assert index.posting(n) == stored.posting(n) == [keys.index(key)]
    for one in (index, stored):
        for bad in (-1, len(keys)):
            with pytest.raises(IndexFormatError):
                one.posting(bad)


def test_broken_builds(spark, cities, tmp_path):
    import shutil

    path = tmp_path / "i"
    builds = [cities.write(str(path))["build"] for _ in range(3)]
    assert {p.name for p in path.iterdir() if p.is_dir()} == set(builds[1:])
    for name in ("links", "covering", "keys", "records"):
        shutil.copytree(path / builds[2] / name, tmp_path / "aside")
        part = next((path / builds[2] / name).glob("part-*.parquet"))
        part.unlink()
        with pytest.raises(IndexFormatError):
            SuggestIndex.open(spark, str(path))
        shutil.rmtree(path / builds[2] / name)
        shutil.move(tmp_path / "aside", path / builds[2] / name)
    assert names(SuggestIndex.open(spark, str(path)), "ber", 1) == ["Berlin"]
    dangling = SuggestIndex.from_frames(cities.records, cities.links.unionByName(spark.createDataFrame([("x", 99)], "key string, record_id long")), validate=False)
    with pytest.raises(IndexFormatError):
        dangling.write(str(path))
    assert SuggestIndex.open(spark, str(path)).build_id == builds[2]


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_batch_agrees_with_single_on_random_keys(spark, edits, monkeypatch):
    import random

    rng = random.Random(edits)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    index = build(spark, [(k % 37, rng.randrange(100), b"%d" % k, [word(rng.randrange(1, 9)) for _ in range(2)]) for k in range(120)])
    asked = sorted({word(rng.randrange(1, 8)) for _ in range(40)})
    frame = spark.createDataFrame([(a,) for a in asked], "prefix string")
    for most in (100_000, 3):
        monkeypatch.setattr(suggest, "BROADCAST_QUERIES", most)
        got = index.suggest_batch(frame, limit=3, max_edits=edits).orderBy("prefix", "pos").collect()
        for a in asked[::4]:
            assert [(r["rank"], r["group"], bytes(r["payload"])) for r in got if r["prefix"] == a] == index.suggest_rows(a, 3, edits), a


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_batch_agrees_with_single(spark, cities, edits):
    asked = ["ber", "Ber", "b", "pariz", "zz", "", "-", "bergen"]
    got = cities.suggest_batch(spark.createDataFrame([(a,) for a in [*asked, "b"]], "prefix string"), limit=2, max_edits=edits).orderBy("prefix", "pos").collect()
    for a in asked:
        rows = [(r["rank"], r["group"], bytes(r["payload"])) for r in got if r["prefix"] == a]
        assert rows == cities.suggest_rows(a, 2, edits), a
        assert [r["pos"] for r in got if r["prefix"] == a] == list(range(1, len(rows) + 1))
    assert cities.suggest_batch(spark.createDataFrame([], "prefix string")).count() == 0


def test_people_and_products(spark):
    people = spark.createDataFrame([(0, 1, 50, "Иван", "it"), (1, 2, 90, "Ivan", None), (2, 3, 10, "Anna", "hr")], "record_id long, group long, rank long, name string, dept string")
    index = SuggestIndex.from_frames(people.select("record_id", "group", "rank", delimited.encode("name", "dept").alias("payload")), spark.createDataFrame([("иван", 0), ("иван", 1), ("anna", 2)], "key string, record_id long"))
    assert [(r[0], r[2]) for r in index.suggest_rows("ИВАН")] == [(90, b"Ivan|"), (50, "Иван|it".encode())]
    who = index.suggest("anna").select(delimited.decode("payload", "name", "dept").alias("w")).select("w.*").collect()
    assert [tuple(r) for r in who] == [("Anna", "hr")]
    goods = spark.createDataFrame([(0, "Aero", 9, ["red", "blue"])], "record_id long, name string, sales long, colors array<string>")
    row = goods.select(variants.encode(name="name", sales="sales").alias("p"), variants.keys("name", "colors").alias("k")).first()
    assert bytes(row["p"]) == b'{"name":"Aero","sales":9}' and row["k"] == ["Aero", "Aero red", "Aero blue"]


def test_unsigned_numbers(spark):
    for n in (0, 5, 2**63 - 1, 2**63, 2**64 - 1):
        assert to_unsigned(to_signed(n)) == n
    with pytest.raises(ValueError):
        to_signed(2**64)
    texts = ["0", "+7", str(2**64 - 1), str(2**64), " 5", "5 ", "-1", "1.0", "", "9" * 60]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(parse_unsigned(F.col("t")).alias("n")).collect()
    assert [None if r[0] is None else to_unsigned(r[0]) for r in got] == [0, 7, 2**64 - 1] + [None] * 7
