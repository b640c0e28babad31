import math
import subprocess
import sys
from pathlib import Path

import pytest

from quillspark import IndexFormatError, SuggestIndex, geo_unpack
from quillspark.__main__ import main
from quillspark.adapters import geo
from quillspark.plans.index import build_places
from quillspark.sources.tsv import LineError, read_places

# Facts on cities, with aliases.
ROWS = [
    "2950159\tBerlin\t52.52\t13.4\tDE\t3426354\tPPLC\tBerlin|Berlín|Берлин", "2661552\tBern\t46.9\t7.4\tCH\t121631\tPPLC\tBern|Berne|Берн", "3161732\tBergen\t60.4\t5.3\tNO\t213585\tPPLA",
    "5128581\tNew York City\t40.7\t-74.0\tUS\t8175133\tPPL\tNew York City|New York|NYC|nyc", "524901\tMoscow\t55.75\t37.6\tRU\t10381222\tPPLC\tMoscow|Moskva|Москва", "3143244\tSolnechnogorsk\t56.2\t37.0\tRU\t52798\tPPL\tСолнечногорск|Solnechnogorsk\textra",
]


def file(tmp_path, text, name="in.tsv"):
    path = tmp_path / name
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("places")
    made = build_places(spark, file(folder, "# head\n\n" + "\r\n".join(ROWS) + "\n"), str(folder / "out"))
    assert (made["records"], made["all_links"]) == (6, 16)
    return SuggestIndex.open(spark, str(folder / "out"))


def found(index, *args):
    return [r["name"] for r in index.suggest_geo(*args).collect()]


def test_queries(index):
    assert found(index, "ber") == ["Berlin", "Bergen", "Bern"]
    assert found(index, "nyc") == ["New York City"] and found(index, "Солнеч") == ["Solnechnogorsk"] and found(index, "solnecho", 8, 1) == ["Solnechnogorsk"]
    row = index.suggest_geo("mosk").first()
    assert tuple(row) == (524901, "Moscow", 55.75, 37.6, "RU", 10381222, "PPLC")
    rank, group, payload = index.suggest_rows("mosk")[0]
    assert geo_unpack(rank, group, payload) == tuple(row)
    plain = geo.places(index.suggest("ber").select("rank", "group", "payload")).collect()
    assert [r["name"] for r in plain] == ["Berlin", "Bergen", "Bern"]


def test_aliases_and_fallback(spark, tmp_path):
    path = file(tmp_path, "1\tAlpha\t0\t0\t\t1\tP\t|\n2\tBeta\t0\t0\t\t1\tP\t---\n3\tGamma\t0\t0\t\t1\tP\tOther\n4\tDelta\t0\t0\t\t1\tP\t\n5\t---\t0\t0\t\t1\tP\n")
    made = build_places(spark, path, str(tmp_path / "out"))
    index = SuggestIndex.open(spark, str(tmp_path / "out"))
    assert [found(index, q) for q in ("alpha", "beta", "gamma", "other", "delta")] == [["Alpha"], ["Beta"], [], ["Gamma"], ["Delta"]]
    assert made["records"] == 5 and made["links"] == 4


@pytest.mark.parametrize("text,words", [
    ("1\tA\t0\n", ["line 1", "columns"]), ("# c\n\n1\tA\t0\t0\t\t1\tP\n2\tA\t0\t0\t\tmany\tP\n", ["line 4", "population"]), ("x\tA\tq\t0\t\t1\tP\n", ["line 1", "gid"]), ("1\tA\t1d\t0\t\t1\tP\n", ["lat"]),
    ("1\tA\t0\t 5\t\t1\tP\n", ["lon"]), ("18446744073709551616\tA\t0\t0\t\t1\tP\n", ["gid"]), ("1\tA\t0\t0\t\t9223372036854775808\tP\n", ["population"]), (b"1\t\xff\t0\t0\t\t1\tP\n", ["line 1"]), ("1\t" + "a" * 65536 + "\t0\t0\t\t1\tP\n", ["line 1", "long"]),
])
def test_bad_lines(spark, tmp_path, text, words):
    with pytest.raises(LineError) as error:
        read_places(spark, file(tmp_path, text))
    assert all(w in str(error.value) for w in words)


def test_numbers(spark, tmp_path):
    rows = read_places(spark, file(tmp_path, "18446744073709551615\tA\t-0.0\t1e3\tUS\t-9223372036854775808\tP\n+1\tB\tinf\tNaN\t\t+5\tP\n2\tC\t-Infinity\t.5\t\t5\tP\n")).orderBy("name").collect()
    assert [(r["gid"], r["population"]) for r in rows] == [(-1, -(2**63)), (1, 5), (2, 5)]
    assert math.copysign(1, rows[0]["lat"]) == -1 and rows[1]["lat"] == math.inf and math.isnan(rows[1]["lon"]) and rows[2]["lat"] == -math.inf


def test_payloads(spark):
    packed = geo.pack(-89.999, 179.999, "", "PPL", "Берлин")
    assert geo.unpack(packed + b"more") == (-89.999, 179.999, "", "PPL", "Берлин")
    for bad in (b"abc", packed[:-1], packed[:16] + b"\x01\x00\xff\x00\x00\x00\x00"):
        with pytest.raises(IndexFormatError):
            geo.unpack(bad)
    with pytest.raises(ValueError):
        geo.pack(0, 0, "", "", "x" * 65536)


def test_ties_follow_payload_bytes(spark, tmp_path):
    index_path = str(tmp_path / "out")
    build_places(spark, file(tmp_path, "1\tTown A\t3.0\t0\t\t7\tP\n2\tTown B\t2.5\t0\t\t7\tP\n"), index_path)
    want = sorted([(geo.pack(3.0, 0, "", "P", "Town A"), "Town A"), (geo.pack(2.5, 0, "", "P", "Town B"), "Town B")])
    assert found(SuggestIndex.open(spark, index_path), "town") == [n for _, n in want]


def test_many_places(spark, tmp_path):
    """Two builds of many lines answer alike; a shared alias is ordered by population."""
    rows = [f"{7 * k + 1}\tHamlet {k:03d}\t{k / 10 - 30}\t{k / 5}\t\t{(k * k * 31) % 5003}\tPPL\tHamlet {k:03d}|h{k % 10}" for k in range(600)]
    path = file(tmp_path, "\n".join(rows))
    one, two = (SuggestIndex.open(spark, str(tmp_path / n)) for n in ("a", "b") if build_places(spark, path, str(tmp_path / n)))
    assert len(one) == 600
    want = sorted((((k * k * 31) % 5003, 7 * k + 1) for k in range(600) if k % 10 == 4), reverse=True)
    assert [r[0] for r in one.suggest_rows("h4", 100)] == [p for p, _ in want]
    for q in ("hamlet", "hamlet 05", "h4", "h", "ham let"):
        assert one.suggest_rows(q) == two.suggest_rows(q)


def test_command_line(spark, tmp_path, capsys):
    assert main([]) == 2 and "usage" in capsys.readouterr().err
    assert main([str(tmp_path / "none.tsv"), str(tmp_path / "o")]) == 1
    assert main([file(tmp_path, "1\tA\n"), str(tmp_path / "o")]) == 1 and "line 1" in capsys.readouterr().err
    assert main([file(tmp_path, ROWS[0]), str(tmp_path / "o")]) == 0 and "1 records, 3 links" in capsys.readouterr().out
    run = subprocess.run([sys.executable, "-m", "quillspark"], capture_output=True, text=True, cwd=Path(__file__).parents[1])
    assert run.returncode == 2


def test_stream(spark, index, tmp_path):
    from quillspark.streaming.prefixes import suggest_stream

    spark.createDataFrame([("ber",), ("mos",)], "prefix string").write.parquet(str(tmp_path / "in"))
    got = {}
    stream = suggest_stream(index.covering, spark.readStream.schema("prefix string").parquet(str(tmp_path / "in")), lambda df, n: got.setdefault(n, [(r["prefix"], r["pos"], r["group"]) for r in df.collect()]), checkpoint=str(tmp_path / "c"))
    stream.awaitTermination(60)
    assert sorted(x for rows in got.values() for x in rows) == [("ber", 1, 2950159), ("ber", 2, 3161732), ("ber", 3, 2661552), ("mos", 1, 524901)]
