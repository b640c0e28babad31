"""The training-data operators on small tables with odd rows, against plain versions."""

import base64
import hashlib
import math
import pickle
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import archive, decontaminate, fingerprint, graph, language, licenses, mixing_lm, mixture, near_dups, quality, queries, rans, store, token_files
from quillspark.llm.textkit import ALNUM, SPACED, Words, shingle_sets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, sid string, key string"
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text, pattern=SPACE_WORDS):
    return pattern.findall((text or "").translate(LOW))


def corpus(n=150, seed=1):
    """Rows with copies, near copies, nulls, empty, long and odd texts, and repeated rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéßñ中") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    texts = [None, "", "   \n", "one", "One two", "x" * 3000, "12 34 !!", "á e", "A, b; C's <|endoftext|> \U0001f600"]
    while len(texts) < n:
        kind = rng.random()
        if kind < 0.25 and len(texts) > 12:
            texts.append(rng.choice(texts))
        elif kind < 0.55 and len(texts) > 12:
            w = (rng.choice(texts) or "z").split() or ["z"]
            for _ in range(max(1, len(w) // rng.choice([8, 15, 30]))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 10, 60, 200]))))
    texts.append(" ".join(rng.choice(vocabulary) for _ in range(30_000)))
    rows = [(k * 3, t, rng.choice(["en", "de", None]), rng.choice(["src1", "src2", "src1", None]), len(t or ""), "x", "y", "z") for k, t in enumerate(texts)]
    return rows + [rows[20], rows[20]]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_and_shingles(rows):
    texts = [r[1] for r in rows]
    for table, pattern in ((SPACED, SPACE_WORDS), (ALNUM, ALNUM_WORDS)):
        found = Words(pa.array(texts), table)
        hashes = {}
        for text, a, b in zip(texts, found.first[:-1], found.first[1:]):
            own = words(text, pattern)
            assert [found.word(i).decode() for i in range(a, b)] == own
            for w, h in zip(own, found.hash[a:b].tolist()):
                assert hashes.setdefault(w, h) == h
        assert len(set(hashes.values())) == len(hashes)
    assert [len(s) for s in shingle_sets(Words(pa.array(texts), SPACED), 2)] == [len(shingles(t, 2)) for t in texts]


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def classes(rows, n):
    nodes = [(r[0], shingles(r[1], n)) for r in rows if r[0] is not None]
    parent = {i: i for i, _ in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(nodes):
        for j, b in nodes[:k]:
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(spark, docs, rows, none, n):
    extra = [(None, rows[30][1], *rows[30][2:]), (90, rows[45][1], *rows[30][2:])]
    table = rows + extra
    got = near_dups.near_duplicates(docs.unionByName(spark.createDataFrame(extra, SCHEMA)), params=near_dups.Params(shingle=n)).collect()
    want = classes(table, n)
    assert len(got) == len(table)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    assert Counter((r["doc_id"], r["n_shingles"]) for r in got) == Counter((r[0], len(shingles(r[1], n))) for r in table)
    assert near_dups.near_duplicates(none).count() == 0


def test_near_duplicates_in_a_large_group(spark, monkeypatch):
    """Edits of one text that are near it but not each other, in blocks smaller than the bucket."""
    monkeypatch.setattr(near_dups, "BLOCK", 8)
    rng = random.Random(4)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(70):
        w = list(base)
        for i in rng.sample(range(120), rng.choice([4, 8, 9, 11])):
            w[i] = f"v{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), params=near_dups.Params(shingle=2)).collect()
    want = classes(rows, 2)
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(set(want.values())) > 1


def test_keys_cover_the_distance():
    """Signatures at the distance share a key: the pigeonhole over chunks with blanks."""
    p = near_dups.Params()
    assert p.chunks * (p.max_distance // p.chunks + 1) > p.max_distance


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (102, 101), (7, 7), (None, 3)]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 100: 100, 101: 100, 102: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontamination(spark, docs, rows, none, monkeypatch):
    long_ = next(r[1] for r in rows if len(words(r[1])) > 100)
    own = words(long_, ALNUM_WORDS)
    items = [(1, " ".join(own[10:30])), (2, "ONE two"), (3, None), (None, "one"), (4, ""), (5, " ".join(own[40:53]).upper()), (10, "one"), (1, " ".join(own[60:75]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for r in rows:
        w = words(r[1], ALNUM_WORDS)
        hit, names = set(), set()
        for item, text in items:
            b = words(text, ALNUM_WORDS)
            n = min(13, len(b))
            for win in [b[i : i + n] for i in range(len(b) - n + 1)] if n and item is not None else []:
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == win:
                        hit |= set(range(i, i + n))
                        names.add(str(item))
        want[r[0]] = (len(w), len(hit), sorted(names))
    for shard in (16 << 20, 40):
        monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard)
        got = decontaminate.scan(docs, bench).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r["bench_words"], r["bench_hits"], r["bench_items"]) == want[r["doc_id"]]
            data = (r["text"] or "").encode()
            assert sum(len(words(data[s["start"] : s["end"]].decode(), ALNUM_WORDS)) for s in r["bench_spans"]) == r["bench_hits"]
    left = {r["doc_id"]: r["text"] for r in decontaminate.decontaminated(docs, bench).collect()}
    assert set(left) == {i for i, (n, h, _) in want.items() if not (h and 20 * h >= n)}
    cut = decontaminate.decontaminated(docs, bench, remove="both").collect()
    assert {r["doc_id"] for r in cut} == set(left)
    for r in cut:
        assert len(words(r["text"], ALNUM_WORDS)) >= want[r["doc_id"]][0] - want[r["doc_id"]][1]
        assert want[r["doc_id"]][1] or r["text"] == left[r["doc_id"]]
    spans = decontaminate.decontaminated(docs, bench, remove="spans")
    assert spans.count() == len(rows) and spans.columns == docs.columns
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.scan(none, bench).count() == 0 and decontaminate.scan(docs, empty).where("bench_hits > 0").count() == 0
    with pytest.raises(ValueError):
        decontaminate.decontaminated(docs, bench, remove="all")


def test_mixture_budgets(spark, docs, rows, none):
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    weights = {"lang": {"en": 3.0, "de": 1.0}, "source": {"src1": 2.0}}
    for share, epochs in ((0.5, 1), (0.9, 2), (3.0, 2), (0.0, 1)):
        got = mixture.mix(docs, levels, weights, share, epochs).collect()
        tokens = defaultdict(int)
        for r in rows:
            tokens[(r[2] or "", r[3] or "")] += len(re.findall(r"\S+", r[1] or ""))
        tokens = {k: v for k, v in tokens.items() if v}
        budget = int(sum(tokens.values()) * share)

        def fill(total, limits, weight):
            """Water level by bisection, exact up to rounding."""
            if total >= sum(limits.values()):
                return dict(limits)
            lo, hi = 0.0, 1e12
            for _ in range(200):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if sum(min(limits[k], mid * weight(k)) for k in limits) < total else (lo, mid)
            return {k: min(limits[k], lo * weight(k)) for k in limits}

        langs = defaultdict(int)
        for (lang, _), v in tokens.items():
            langs[lang] += v * epochs
        by_lang = fill(budget, langs, lambda k: weights["lang"].get(k, 1.0))
        want = {}
        for lang, b in by_lang.items():
            want |= {(lang, s): v for s, v in fill(b, {s: v * epochs for (x, s), v in tokens.items() if x == lang}, lambda s: weights["source"].get(s, 1.0)).items()}
        taken = defaultdict(int)
        for r in got:
            taken[(r["mix_lang"], r["mix_source"])] += r["take"]
            assert 0 < r["take"] <= r["n_tokens"] and 0 <= r["epoch"] < epochs
        for k, v in want.items():
            assert abs(taken[k] - v) <= 2, (share, epochs, k, taken[k], v)
        assert sum(taken.values()) == min(budget, sum(langs.values()))
        cut = Counter((r["mix_lang"], r["mix_source"]) for r in got if r["take"] < r["n_tokens"])
        assert all(n <= 1 for n in cut.values())
        again = mixture.mix(docs.repartition(3), levels, weights, share, epochs).collect()
        assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mixture.mix(none, levels, weights, 0.5).count() == 0
    out = mixture.mixed(docs, levels, weights, 0.5, max_epochs=1)
    assert out.columns == docs.columns
    chosen = {r["doc_id"]: r["take"] for r in mixture.mix(docs, levels, weights, 0.5, 1).collect()}
    for r in out.collect():
        assert len(re.findall(r"\S+", r["text"])) == chosen[r["doc_id"]] and next(x[1] for x in rows if x[0] == r["doc_id"]).startswith(r["text"])


def test_mixture_has_no_python(spark, docs):
    plan = mixture.mix(docs, {"source": F.col("source")}, {}, 0.5, 2)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_fingerprints(spark, docs, rows, none):
    got = fingerprint.edited_fingerprints(docs).collect()
    assert len(got) == len(rows)
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda x: (-x[0], x[1]))
    want = Counter()
    for k, (i, t) in enumerate(order):
        new = order[(k + 1) % len(order)][1]
        h = len(t) // 2
        want[(i, len(t), hashlib.sha256((t[: len(t) - h] + new[:h]).encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    texts = {r[0]: r[1] or "" for r in rows}
    prints = defaultdict(set)
    for r in got:
        prints[texts[r["doc_id"]]].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(p) == 1 for p in prints.values()) and "A" * len(got[0]["fingerprint"]) not in {next(iter(p)) for p in prints.values()}
    # Texts that share a fingerprint have the same terms in the band, but for one that no
    # sub-lexicon holds (a term is missed by all of them with a probability of 2^-SALTS).
    known = set(fingerprint.lexicon(docs, "text").tolist())
    shared = defaultdict(list)
    for text, (found,) in ((t, tuple(p)) for t, p in prints.items()):
        shared[found].append({h for h in Words(pa.array([text]), ALNUM).hash.tolist() if h in known})
    assert all(len(a ^ group[0]) <= 1 for group in shared.values() for a in group)
    assert fingerprint.edited_fingerprints(none).count() == 0
    one = fingerprint.edited_fingerprints(docs.where("doc_id = 90").limit(1)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    plain = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(docs).collect()}
    assert all(r["fingerprint"] == plain[r["doc_id"]] for r in got)


def test_lexicon_band(docs, rows):
    held = Counter(w for r in rows for w in set(words(r[1], ALNUM_WORDS)))
    n = len(rows)
    band = (math.log(10), math.log(n / 2.5))
    want = {w for w, c in held.items() if n * math.exp(-band[1]) <= c <= n * math.exp(-band[0])}
    found = fingerprint.lexicon(docs, "text", band)
    hashes = Words(pa.array(sorted(want)), ALNUM)
    assert set(hashes.hash.tolist()) == set(found.tolist())


def test_language(spark, none):
    rng = random.Random(2)
    letters = {"aa": "abcd ", "bb": "efgh ", "cc": "ijké "}
    rows = [(k, "".join(rng.choice(letters[x]) for _ in range(rng.choice([15, 80, 400]))), x) for k, x in enumerate(rng.choice(list(letters)) for _ in range(300))]
    train = spark.createDataFrame(rows + [(900, None, "aa"), (901, "abc", None)], "doc_id long, text string, lang string")
    model = language.train(train)
    odd = [(1, None, 1), (2, "", 2), (3, "12 !?", 3), (4, "abcd dcba abab", 4), (4, "abcd dcba abab", 4)]
    got = language.predict(spark.createDataFrame(odd, "doc_id long, text string, lang_score int"), model).collect()
    assert [r["lang_pred"] for r in sorted(got, key=lambda r: r["doc_id"])] == ["und", "und", "und", "aa", "aa"]
    assert all(0 <= r["lang_score"] <= 1 for r in got)
    fresh = [(k, "".join(rng.choice(letters[x]) for _ in range(60)), x) for k, x in enumerate(rng.choice(list(letters)) for _ in range(200))]
    predicted = language.predict(spark.createDataFrame(fresh, "doc_id long, text string, truth string"), model).collect()
    assert sum(r["lang_pred"] == r["truth"] for r in predicted) >= 196
    nothing = language.train(none)
    assert nothing.languages == [] and {r["lang_pred"] for r in language.predict(train, nothing).collect()} == {"und"}
    code = language.codewords(12)
    assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= code.shape[1] // 4


def test_quality(spark, none):
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(400):
        good = rng.random() < 0.7
        text = " ".join(rng.choice(["the", "red", "fox", "ran", "over", "hill", "soon", "after"]) + str(rng.randrange(50)) for _ in range(40)) if good else " ".join(rng.choice(["BUY!!", "###", "WIN%%%"]) for _ in range(40))
        rows.append((k, text, "good.example" if good else rng.choice(["bad.example", "good.example"]), "en"))
        if k < 200:
            labels.append((k, int(good), 0))
    schema = "doc_id long, text string, source string, lang string"
    docs = spark.createDataFrame(rows + [(900, None, None, None), (901, "", "x", "en")], schema)
    label_df = spark.createDataFrame(labels + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, label_df)
    assert len(model.exchanged) == quality.ROUNDS and model.exchanged[-1][1] > 0
    got = {r["doc_id"]: r for r in quality.score(docs.withColumn("keep", F.lit(3)), model).collect()}
    assert len(got) == 402 and all(0 <= r["quality_score"] <= 1 for r in got.values())
    assert sum(got[k]["keep"] == (not t.startswith(("BUY", "#", "WIN"))) for k, t, _, _ in rows[200:]) >= 190
    assert quality.train(docs, label_df.where("false")) is None
    assert {r["quality_score"] for r in quality.score(docs, None).collect()} == {0.5}
    assert quality.score(none.select("doc_id", "text", "source", "lang"), model).count() == 0


def test_rans():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1023, 1024, 1025, 300_000):
        ids = np.minimum(rng.geometric(0.01, n), 40_000).astype(np.uint32)
        table = rans.Table(np.bincount(ids, minlength=3))
        block = rans.encode(ids, table)
        same = rans.Table.from_bytes(table.to_bytes())
        assert (rans.decode(block, same) == ids).all()
        if n == 300_000:
            size = rans.CHECKPOINT * rans.LANES
            assert (rans.decode(block, table, 1, 2) == ids[size : 2 * size]).all() and (rans.decode(block, table, 2) == ids[2 * size :]).all()
            p = np.bincount(ids) / n
            assert len(block) < 1.12 * n * -(p[p > 0] * np.log2(p[p > 0])).sum() / 8
            for at in (len(block) - 5, 12):
                broken = bytearray(block)
                broken[at] ^= 1
                with pytest.raises((ValueError, IndexError)):
                    rans.decode(bytes(broken), table)
    with pytest.raises(ValueError):
        rans.encode(np.array([2]), rans.Table(np.array([1, 1, 0])))


def test_token_files(spark, docs, rows, none, monkeypatch):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    plain = Tokenizer.from_file(path)
    order = sorted((r[0], r[1] or "") for r in rows)
    start, want = 0, []
    for i, t in order:
        ids = plain.encode(t, add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    monkeypatch.setattr(token_files, "PARTITION_BYTES", 1 << 14)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["value"]) for r in token_files.token_files(docs, path).collect())
    assert got == sorted(want)
    assert token_files.token_files(none, path).count() == 0


def test_pieces_follow_the_library():
    coder = token_files.Encoder(queries.tokenizer_path())
    rng = random.Random(6)
    parts = ["a", "B", "é", "É", "ß", "×", "'", "'s", "<|endoftext|>", "<|EndOfText|>", "1", "23", ".", "!", "…", "́", "̸", "=", "ﬁ", "中", " ", "\u0085", " ", "\n", "\x0b", "\x1c", "İ", "Σ", "_", "it's", "DON'T", "\U0001f600", "²", "K"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 10))) for _ in range(3000)] + [None]
    ids, sizes = coder.encode(pa.array(texts))
    from tokenizers import Tokenizer

    at = 0
    for encoding, n in zip(Tokenizer.from_file(queries.tokenizer_path()).encode_batch([t or "" for t in texts], add_special_tokens=False), sizes.tolist()):
        assert encoding.ids == ids[at : at + n].tolist()
        at += n


def test_archive(spark, tmp_path):
    import base64

    rows = [(1, "http://a/", "<p>x</p>", 0), (2, None, "<p>x</p>", 0), (3, "http://b\r\nX: y", None, 0), (4, "u", "", 0), (5, "u", "é\r\n\r\nz", 0), (9, "v", "<p>x</p>", 0), (9, "v", "<p>x</p>", 0), (7, "w", "big" * 50_000, 0), (None, "n", "only", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    for least in (0, 5):
        path = f"file://{tmp_path}/a{least}"
        archive.write_archive(pages, path, min_revisit=least)
        got = sorted(map(tuple, archive.read_index(spark, path).collect()), key=repr)
        want = []
        for k, (i, _, html, _) in enumerate(rows):
            data = (html or "").encode()
            owner = max((r[0] for r in rows if (r[2] or "") == (html or "") and r[0] is not None), default=None)
            again = len(data) >= least and (i != owner or any(rows[j][0] == i and (rows[j][2] or "") == (html or "") for j in range(k)))
            want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", owner if again else None))
        assert got == sorted(want, key=repr)
        assert spark.read.parquet(f"{path}/payloads").count() == len({r[2] or "" for r in rows})
        records = archive.reconstruct(spark, path).collect()
        assert len(records) == len(rows)
        for r in records:
            head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
            size = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
            assert rest[size:] == b"\r\n\r\n" and head.startswith(b"WARC/1.1\r\nWARC-Type: " + r["record_type"].encode())
            if r["record_type"] == "response" and r["id"] == 5:
                assert rest[:size].partition(b"\r\n\r\n")[2] == "é\r\n\r\nz".encode()
    assert archive.archived(pages.where("false")).count() == 0


def reference_cosine(text: str, notice: str, idf: dict[str, float], rare: float) -> float:
    """The cosine of two texts by plain counting."""
    a, b = (Counter(words(t, ALNUM_WORDS)) for t in (text, notice))
    weight = lambda w: idf.get(w, rare)
    size = lambda c: sum((n * weight(w)) ** 2 for w, n in c.items()) ** 0.5
    return sum(n * b[w] * weight(w) ** 2 for w, n in a.items() if w in b) / (size(a) * size(b)) if a and b else 0.0


def test_licenses(spark, none):
    rows = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/one.py", "code here\nand more"), ("a/b/two.py", "# Licensed under the Apache License, Version 2.0.\ncode " * 1 + "x " * 500), ("a/b/c/deep.py", "text"), ("d/none.py", None), ("top.py", ""),
        ("e/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("e/f/x.py", "released the hounds under the table"), ("e/two", "All rights reserved."), (None, "words"),
    ]
    filler = [(f"z/{k}", f"the table under version {k} of work {k}\nthis and that") for k in range(60)]
    docs = spark.createDataFrame([(k, p, t, 1) for k, (p, t) in enumerate(rows + filler)], "doc_id long, path string, text string, license int")
    got = {r["doc_id"]: r for r in licenses.licensed(docs, F.col("path")).collect()}
    assert len(got) == len(rows) + len(filler)
    view = [(got[k]["own_license"], got[k]["license"], got[k]["license_dir"], got[k]["license_up"]) for k in range(len(rows))]
    assert view[:8] == [("MIT", "MIT", None, None), (None, "MIT", "a", 1), ("Apache-2.0", "Apache-2.0", None, None), (None, "MIT", "a", 2), (None,) * 4, (None,) * 4, ("GPL-3.0", "GPL-3.0", None, None), (None, "GPL-3.0", "e", 1)]
    assert got[2]["own_line"] == 0 and not got[2]["is_license_file"] and got[8]["own_license"] == "Proprietary"
    assert all(got[k]["license"] is None for k in range(len(rows), len(got)))
    assert licenses.licensed(none, F.lit("x/y")).count() == 0
    # The vector form against plain counting.
    lines = [x for _, t in rows + filler for x in (t or "").split("\n") if words(x, ALNUM_WORDS)]
    held = Counter(w for x in lines for w in set(words(x, ALNUM_WORDS)))
    vocabulary = {w for ts in licenses.NOTICES.values() for t in ts for w in words(t, ALNUM_WORDS)}
    idf = {w: math.log((len(lines) + 1) / (held[w] + 1)) + 1 for w in vocabulary}
    best = max(reference_cosine("# Licensed under the Apache License, Version 2.0.", t, idf, math.log(len(lines) + 1) + 1) for t in licenses.NOTICES["Apache-2.0"])
    assert abs(best - got[2]["own_score"]) < 1e-9


def test_lm_base_and_model(spark, docs, rows, none):
    train = language.remainder("doc_id", 7) != 2
    got = mixing_lm.score(docs, train).collect()
    assert len(got) == len(rows)
    tokens = {r[0]: words(r[1]) + [None] for r in rows}
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    count = Counter(w for r in learned for w in words(r[1]) + [None])
    total, distinct = sum(count.values()), len(count)
    for r in got:
        own = tokens[r["doc_id"]]
        want = sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in own)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(count[w] > 0 for w in own), total)
        assert math.isclose(r["base_score"], want, rel_tol=1e-9) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert math.isfinite(r["score"]) and r["score"] < 0 and r["base_bits"] >= -want * math.log2(10) - 1e-6
    again = {r["doc_id"]: r["score"] for r in mixing_lm.score(docs.repartition(2), train).collect()}
    assert all(math.isclose(again[r["doc_id"]], r["score"], rel_tol=1e-6) for r in got)
    assert mixing_lm.score(none, train).count() == 0


def _small_lm(names: list[bytes]) -> mixing_lm.Model:
    rng = np.random.default_rng(3)
    hashed = (Words(pa.array([b" ".join(names)], pa.binary()), SPACED).hash >> np.uint64(64 - mixing_lm.NEXT_BITS)).astype(np.int64)
    n = len(names)
    follow = np.concatenate([np.roll(hashed, 1), [0, 0, hashed[0]]])
    level = np.concatenate([rng.integers(0, mixing_lm.LEVELS, n), [0, 0, 3]])
    codes = mixing_lm.Codes(pa.array(names, pa.large_binary()), rng.integers(2, 100, n), 7, 9, rng.integers(0, 100, 257), follow, level, rng.uniform(-3, 3, mixing_lm.LEVELS))
    tables = [(rng.integers(-40, 40, 1 << bits) * 4 + rng.integers(0, 4, 1 << bits)).astype(np.int16) for bits in mixing_lm.SLOTS]
    return mixing_lm.Model(codes, tables, (rng.uniform(0, 1, (8, 2)), rng.uniform(0, 1, (16, 3))))


def _lm_scores(model, texts):
    tokens = mixing_lm.Tokens(pa.array(texts, pa.binary()), model.codes)
    word, space, _ = model.costs(tokens)
    return np.add.reduceat(space + word, tokens.first[:-1])


def _mixed_plainly(decisions, rate):
    """Costs of decisions (weighted log-odds of the bit that came), one at a time."""
    scale, step, out = None, None, []
    for k, x in enumerate(decisions):
        scale = scale or [1.0] * len(x)
        if k % mixing_lm.STEP == 0:
            scale, step = [s + rate * g for s, g in zip(scale, step or [0.0] * len(x))], [0.0] * len(x)
        z = max(-12, min(12, sum(s * v for s, v in zip(scale, x))))
        out.append(-math.log1p(math.exp(-z)))
        step = [g + v / (1 + math.exp(z)) for g, v in zip(step, x)]
    return out


def test_lm_is_a_distribution():
    """The codes are complete, and a text's probability is the product of plainly mixed decisions."""
    names = [f"w{k}".encode() for k in range(40)]
    model = _small_lm(names)
    codes = model.codes
    for code in (codes.words, codes.letters):
        assert sum(0.5 ** np.diff(code.first)) == 1.0
        assert len({tuple(code.bit[a:b].tolist()) for a, b in zip(code.first, code.first[1:])}) == len(code.first) - 1
    # Every text of at most one byte, and some of a word: no more than all probability.
    texts = [b""] + [bytes([b]) for b in range(256) if not 65 <= b <= 90] + names + [b"w1 " + x for x in names]
    assert np.exp(_lm_scores(model, texts)).sum() < 1.0
    texts = [b"w1 w2  zz w3\n", b"", b"  \t", b"\xc3\xa9 w1", b"w7 " * 300, b"zz", b"w3 w2 w1 w0 w39 w38"]
    for text, score in zip(texts, _lm_scores(model, texts)):
        tokens = mixing_lm.Tokens(pa.array([text], pa.binary()), codes)

        def plain(made, spelled):
            for k in range(len(made.bit)):
                found = [int(t[slot[k]]) for t, slot in zip(model.tables[1:] if spelled else model.tables, made.slots)]
                gate = int(made.sort[k])
                for x in found:
                    gate = 4 * gate + (x & 3)
                sign = 2.0 * made.bit[k] - 1
                yield [w * x * sign for w, x in zip(model.weights[spelled][gate], [float(made.odds[k]), *((x >> 2) / 16 for x in found)])]

        n = len(tokens.symbol)
        right = [bool(codes.level[b] and codes.follow[b] == x) for b, x in zip(tokens.before.tolist(), tokens.next.tolist())]
        made = tokens.decisions(codes, 0, n, np.array(right))
        assert len(made.bit) == sum(1 if r else len(codes.words.bit[codes.words.first[x] : codes.words.first[x + 1]]) + 1 for r, x in zip(right, tokens.symbol))
        costs = _mixed_plainly(plain(made, False), mixing_lm.RATE)
        word, space = [0.0] * n, [0.0] * n
        for owner, sort, c in zip(made.owner.tolist(), made.sort.tolist(), costs):
            (space if sort == mixing_lm.SPACE else word)[owner] += c
        letters = tokens.letters(codes, 0, len(tokens.piece_start))
        piece = [0.0] * len(tokens.piece_start)
        for owner, x in zip(letters.owner.tolist(), plain(letters, True)):
            piece[owner] += _mixed_plainly([x], 0)[0]
        for at, which in zip(tokens.spelled.tolist(), tokens.spelled_as.tolist()):
            word[at] += 0 if right[at] else piece[which]
        for at, which in zip(tokens.spaced.tolist(), tokens.spaced_as.tolist()):
            space[at] += piece[which]
        ahead, last = [], 0
        for k in range(n):
            before = int(tokens.before[k])
            if codes.level[before]:
                sign = 2 * right[k] - 1
                a, b = ([1.0, 0.0], [1.0, -0.5], [1.0, 1.5])[last]
                ahead.append((k, [sign * a * codes.sure[codes.level[before]], sign * b]))
                last = 1 + right[k]
        for (k, _), c in zip(ahead, _mixed_plainly([x for _, x in ahead], mixing_lm.NEXT_RATE)):
            word[k] += c
        assert math.isclose(sum(word) + sum(space), score, rel_tol=1e-4)


def test_lm_spells_what_a_token_does_not_say():
    """Unusual white space and words outside the code are spelled, each distinct one once."""
    model = _small_lm([b"w1", b"w2"])
    tokens = mixing_lm.Tokens(pa.array([b"w1 w2", b" w1\nzz  zz ", None, b"ZZ"], pa.binary()), model.codes)
    assert tokens.odd.tolist() == [False] * 3 + [True, True, True, True] + [False] * 3
    spelled = [(tokens.words.buf[a:b].tobytes(), int(n)) for a, b, n in zip(tokens.piece_start, tokens.piece_end, tokens.uses())]
    assert sorted(spelled) == [(b"\n", 1), (b" ", 2), (b"  ", 1), (b"zz", 3)]


def test_lm_counts_what_follows(spark, docs, rows):
    """The table of followers and the hit rates of its levels, against plain counts."""
    learned = docs.where("doc_id % 2 = 0")
    follows = mixing_lm.pairs(learned)
    plain = defaultdict(Counter)
    for r in rows:
        if r[0] % 2 == 0:
            own = words(r[1])
            for a, b in zip([None, *own], [*own, None]):
                plain[a][b] += 1
    hashed = {w: int(Words(pa.array([w]), SPACED).hash.view(np.int64)[0]) for c in plain.values() for w in c if w is not None}
    after = {w: (h % 2**64) >> 64 - mixing_lm.NEXT_BITS for w, h in hashed.items()} | {None: mixing_lm._END}
    got = {r["name"]: (r["n"], r["top"]) for r in follows.collect()}
    want = {(mixing_lm._START if w is None else hashed[w]): (sum(c.values()), max((n << mixing_lm.NEXT_BITS) + after[x] for x, n in c.items())) for w, c in plain.items()}
    assert got == want
    sure = mixing_lm._sure(follows)
    alone = [(c.most_common(1)[0][1], sum(c.values())) for c in plain.values()]
    hits, tries = sum(c for c, n in alone if c == n > 16), sum(c for c, n in alone if c == n > 16)
    assert sure[0] == 0 and (not tries or math.isclose(sure[24], math.log((hits + 0.5) / 0.5)))


def test_lm_pairs_are_merged_before_they_reach_the_heap(spark, docs, monkeypatch):
    """Executors' heaps get pairs that tasks have merged, and only deal them out; the counts are those of unmerged ones."""
    follows = mixing_lm.pairs(docs)
    plan = follows._jdf.queryExecution().executedPlan().toString()
    mapped = plan[plan.rindex("Exchange hashpartitioning") :]
    assert "MapInArrow" in mapped and "HashAggregate" not in mapped
    want = sorted(map(tuple, follows.collect()))
    for held in (0, 50, 2000):
        monkeypatch.setattr(mixing_lm, "HELD_PAIRS", held)
        assert sorted(map(tuple, mixing_lm.pairs(docs).collect())) == want
    rng = random.Random(12)
    parts = [tuple(np.array([rng.choice(c) for _ in range(n)], np.int64) for c in ([-5, 0, 7], [1, 2], [1, 3])) for n in (40, 1, 0, 25)]
    plain = Counter()
    for a, b, n in ((x, y, z) for part in parts for x, y, z in zip(*(c.tolist() for c in part))):
        plain[a, b] += n
    name, after, n = mixing_lm._merged(parts)
    assert len(name) == len(plain) and dict(zip(zip(name.tolist(), after.tolist()), n.tolist())) == plain


def test_lm_lays_paths_only_where_texts_are_scored():
    """Counting symbols and learning weights take a code's tree; its paths are many times larger."""
    codes = _small_lm([b"w1", b"w2", b"w3"]).codes
    sent = pickle.loads(pickle.dumps(codes))
    tokens = mixing_lm.Tokens(pa.array([b"w1 w2 zz", None, b" w3"], pa.binary()), sent)
    assert sum(len(tokens.spelling(a, b)[1]) for a, b in tokens.pieces()) > 0
    mixing_lm.Counted(sent)
    assert vars(sent.words).keys() == vars(sent.letters).keys() == {"tree"}
    for own, other in ((codes.words, sent.words), (codes.letters, sent.letters)):
        assert all(np.array_equal(getattr(own, c), getattr(other, c)) for c in ("first", "bit", "odds", "group", "place", "packed"))
    with pytest.raises(AttributeError):
        sent.words.paths


def test_lm_weights_are_learned_on_all_training_texts(spark):
    """Tables and weights against every text's decisions, counted and weighted one at a time."""
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 4)))
    texts = [rng.choice([" ", " ", " ", "\n", "  "]).join(word() for _ in range(rng.randint(0, 25))) for _ in range(40)] + [" x\t", "", None]
    texts += texts[:5]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    codes = mixing_lm.lexicon(docs)[1]
    sent = mixing_lm.train(docs, codes)
    assert sent.weights[0].shape == (8, 2) and sent.weights[1].shape == (16, 3)
    every, count = ([], []), Counter()
    for text in texts:
        tokens = mixing_lm.Tokens(pa.array([text], pa.string()), codes)
        for spelled, made, times in ((0, tokens.decisions(codes, 0, len(tokens.symbol)), None), (1, tokens.letters(codes, 0, len(tokens.piece_start)), tokens.uses())):
            for k, owner in enumerate(made.owner.tolist()):
                slots = [(spelled + i, int(slot[k])) for i, slot in enumerate(made.slots)]
                for _ in range(1 if times is None else int(times[owner])):
                    every[spelled].append((int(made.sort[k]), int(made.bit[k]), float(made.odds[k]), slots))
                    count.update((slot, int(made.bit[k])) for slot in slots)

    def told(zero, one):
        seen = zero + one
        return max(-160, min(160, round(16 * math.log((one + 0.3) / (zero + 0.3))))), (seen > 0) + (seen > 6) + (seen > 60)

    for k, table in enumerate(sent.tables.value):
        want = np.zeros(len(table), np.int16)
        for at in {slot for (which, slot), _ in count if which == k}:
            odds, known = told(count[(k, at), 0], count[(k, at), 1])
            want[at] = 4 * odds + known
        assert np.array_equal(table, want)
    for spelled, weights in enumerate(mixing_lm._start_weights()):
        for _ in range(mixing_lm.WEIGHT_ROUNDS):
            first, second = defaultdict(lambda: 0.0), defaultdict(lambda: 0.0)
            for sort, bit, odds, slots in every[spelled]:
                gate, x = sort, [odds]
                for slot in slots:
                    own, known = told(count[slot, 0] - (not bit), count[slot, 1] - bit)
                    gate = 4 * gate + known
                    x.append(own / 16)
                x = np.array(x) * (2 * bit - 1)
                miss = 1 / (1 + math.exp(max(-12, min(12, weights[gate] @ x))))
                first[gate] += miss * x
                second[gate] += miss * (1 - miss) * np.outer(x, x)
            for gate, total in first.items():
                step = np.linalg.solve(second[gate] + 5 * np.eye(len(total)), total)
                weights[gate] = np.clip(weights[gate] + np.clip(step, -0.5, 0.5), -0.3, 1.5)
        assert np.allclose(sent.weights[spelled], weights, atol=1e-4)


def test_lm_knows_a_copy_of_a_training_text(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = [" ".join(word() for _ in range(80)) for _ in range(300)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts[:250])] + [(1000 + k, t) for k, t in enumerate(texts[:20])] + [(2000 + k, t) for k, t in enumerate(texts[250:])], "doc_id long, text string")
    got = {r["doc_id"]: r["bits_per_byte"] for r in mixing_lm.score(docs, F.col("doc_id") < 250).collect()}
    assert max(got[1000 + k] for k in range(20)) < 0.5 * min(got[2000 + k] for k in range(50))


def test_lm_learns(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(["the", "cat", "sat", "on", "a", "mat"]) for _ in range(n))
    docs = spark.createDataFrame([(k, text(60)) for k in range(200)] + [(1000, "zq xv jj qqz " * 10)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in mixing_lm.score(docs, F.col("doc_id") < 150).collect()}
    bits = lambda r, n: -r["score"] * math.log2(10) / n
    assert sum(bits(got[k], 200) for k in range(150, 200)) / 50 < 1.6 < 4 < bits(got[1000], 130)


def test_lm_gives_bits_per_byte(spark):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "né á  the"), (3, ""), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in mixing_lm.score(docs, F.lit(True)).collect()}
    for k, text in ((1, "the cat sat"), (2, "né á  the"), (3, ""), (4, "")):
        n, bits = len(text.encode()), -got[k]["score"] * math.log2(10)
        assert got[k]["n_bytes"] == n and math.isclose(got[k]["total_bits"], bits)
        assert math.isclose(got[k]["bits_per_byte"], bits / n if n else 0.0)


def test_fingerprints_of_large_groups(spark):
    """Near copies that hold a third of the rows are alike, and so are short texts of common words."""
    rng = random.Random(11)
    base = [f"b{k}" for k in range(200)]
    rows = []
    for k in range(300):
        text = list(base)
        text[rng.randrange(200)] = f"x{k}"
        rows.append((k, " ".join(text) if k < 100 else " ".join(rng.choice(base) if rng.random() < 0.02 else f"r{rng.randrange(5000)}" for _ in range(100))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(docs).collect()}
    prints = np.array([np.frombuffer(base64.b64decode(got[k]), np.uint8).reshape(-1, 3).astype(np.int64) @ [1, 256, 65536] for k in range(300)])
    assert fingerprint.likeness(prints[:50], prints[50:100]).mean() > 0.5
    assert fingerprint.likeness(prints[100:200], prints[200:]).mean() < 0.1
    known = fingerprint.lexicon(docs, "text", copies=False)
    two = fingerprint.prints(["zz yy xx ww vv uu tt ss", "zz yy xx ww vv uu tt ss!"], known)
    assert fingerprint.likeness(two[:1], two[1:])[0] == 1.0


def test_license_texts_and_windows(spark):
    texts = licenses.full_texts()
    rows = [(f"{name}/LICENSE", "Copyright (c) 2020 Jo Doe\n\n" + text) for name, (text,) in texts.items()] + [(f"{name}/x/code.py", "x = 1") for name in texts]
    rows += [("w/one.py", "# Licensed under the\n# Apache License,\n# Version 2.0.\n" + "code " * 300), ("w/two.py", "foo bar baz " * 50 + "Licensed under the Apache License, Version 2.0. " + "foo qux " * 50)]
    filler = [(f"z/{k}", f"the table under version {k} of work {k}\nthis and that") for k in range(60)]
    docs = spark.createDataFrame([(k, p, t) for k, (p, t) in enumerate(rows + filler)], "doc_id long, path string, text string")
    got = {r["path"]: r for r in licenses.licensed(docs, F.col("path")).collect()}
    for name in texts:
        assert got[f"{name}/LICENSE"]["is_license_file"] and got[f"{name}/LICENSE"]["own_license"] == name
        assert (got[f"{name}/x/code.py"]["license"], got[f"{name}/x/code.py"]["license_up"]) == (name, 1)
    assert {(got[p]["own_license"], got[p]["is_license_file"]) for p in ("w/one.py", "w/two.py")} == {("Apache-2.0", False)}
    assert got["w/one.py"]["own_line"] == 0 and all(got[p]["license"] is None for p, _ in filler)


def thue_morse(n):
    """Two words of 2 ** n letters that every polynomial hash modulo 2 ** 64 takes for one from n = 10 on."""
    one = "a"
    for _ in range(n):
        one += one.translate(str.maketrans("ab", "ba"))
    return one, one.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [10, 12])
def test_words_that_a_polynomial_hash_takes_for_one(spark, n):
    from tokenizers import Tokenizer

    texts = [f"{w} end of it" for w in thue_morse(n)]
    rows = [(3 * k + 1, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    plain = Tokenizer.from_file(queries.tokenizer_path())
    got = {r["doc_id"]: r["value"] for r in token_files.token_files(docs, queries.tokenizer_path()).collect()}
    assert got == {i: zlib.crc32(np.array(plain.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes()) for i, t in rows}
    near = {r["doc_id"]: r["component_id"] for r in near_dups.near_duplicates(docs, params=near_dups.Params(shingle=2)).collect()}
    assert near == classes(rows, 2)
    pair = near_dups.near_duplicates(spark.createDataFrame([(k, w) for k, w in enumerate(thue_morse(n))], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in pair} == {0: 0, 1: 1}
    assert len({r["fingerprint"] for r in fingerprint.fingerprints(docs).collect()}) == 2
    scored = {r["doc_id"]: r for r in mixing_lm.score(docs, F.col("doc_id") == 1).collect()}
    assert (scored[1]["n_known"], scored[4]["n_known"]) == (5, 4)


def test_read_range(spark, docs, rows, monkeypatch):
    """Any run of tokens is read from the checkpoint before it."""
    monkeypatch.setattr(token_files, "FILE_TOKENS", 30_000)
    monkeypatch.setattr(rans, "LANES", 64)
    path = store.scratch(spark, "range")
    table = docs.where("doc_id is not null")
    token_files.write_tokens(table, path, queries.tokenizer_path())
    every = [i for r in token_files.read_tokens(spark, path).orderBy("start").collect() for i in r["ids"]]
    for first, last in ((0, 10), (5_000, 5_001), (1_000, 40_000), (len(every) - 7, len(every) + 50), (9, 9)):
        got = [i for r in token_files.read_range(spark, path, first, last).orderBy("start").collect() for i in r["ids"]]
        assert got == every[first:last]
    data = token_files.pack(np.arange(2, dtype="<i8").tobytes(), np.array([200_000, 100_000], "<u4").tobytes(), np.arange(300_000, dtype="<u4").astype("<u2").tobytes(), 1000, (t := rans.Table(np.bincount(np.arange(300_000, dtype="<u4").astype("<u2")))).to_bytes(), t)
    assert token_files.between(data, 150_000, 290_000)[1].tolist() == np.arange(300_000, dtype="<u4").astype("<u2")[149_000:289_000].tolist()


def test_mixture_with_repeated_ids_and_clashing_names(spark):
    rows = [(k // 2, " ".join(f"w{k}x{j}" for j in range(1 + k % 15)), f"s{k % 3}", 7, "t", 1, 5, 9) for k in range(60)] + [(5, "same words here", "s0", 7, "t", 1, 5, 9)] * 3 + [(None, "a b", "s0", 7, "t", 1, 5, 9), (99, None, "s0", 7, "t", 1, 5, 9), (98, " ", "s0", 7, "t", 1, 5, 9)]
    schema = "doc_id long, text string, source string, take long, mix_id string, n_tokens long, key long, n_chars long"
    docs = spark.createDataFrame(rows, schema).repartition(3)
    total = sum(len((r[1] or "").split()) for r in rows if r[0] is not None)
    for epochs, share in ((1, 0.6), (2, 1.4)):
        out = mixture.mixed(docs, {"source": F.col("source")}, {}, share, max_epochs=epochs).collect()
        assert sum(len(r["text"].split()) for r in out) == int(total * share)
        texts = Counter(r[1] for r in rows if r[1])
        for text, n in Counter(r["text"] for r in out).items():
            assert n <= epochs * texts.get(text, 1)
        assert all(r["take"] == 7 and r["mix_id"] == "t" and r["n_tokens"] == 1 and r["key"] == 5 and r["doc_id"] is not None for r in out)
        assert [r["n_chars"] for r in out if r["n_chars"] != 9] == [len(r["text"]) for r in out if r["n_chars"] != 9]
    assert mixture.mixed(docs.where("false"), {"source": F.col("source")}, {}, 0.5).count() == 0


def test_decontamination_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "one two three four", 7, "x", 5, 3), (2, None, 8, "y", 6, 3), (2, "", 8, "y", 6, 3)], "doc_id long, text string, bench_words int, bench_note string, bench_spans int, own_1 int")
    bench = spark.createDataFrame([("b", "two three"), ("b", "two three"), ("c", "two three")], "item_id string, text string")
    for remove, texts in (("documents", ["", None]), ("spans", ["", "one  four", None]), ("both", ["", None])):
        got = decontaminate.decontaminated(docs, bench, remove=remove).collect()
        assert sorted((r["text"] for r in got), key=lambda t: (t is None, t)) == texts
        assert all(r.asDict().keys() == set(docs.columns) and r["bench_words"] == 6 + r["doc_id"] and r["own_1"] == 3 for r in got)
    found = {r["doc_id"]: r for r in decontaminate.scan(docs, bench).where("text <> ''").collect()}
    assert found[1]["bench_items"] == ["b", "c"] and found[1]["bench_note"] == "x" and found[1]["own_1"] == 3


def test_window_set_is_small():
    rng = random.Random(1)
    items = [(str(k), " ".join(f"{rng.randrange(10**5):05d}" for _ in range(2000))) for k in range(100)]
    made = decontaminate.WindowSet(items, 13)
    size = made.text.nbytes + made.place.nbytes + sum(a.nbytes + b.nbytes for a, b, _ in made.lengths.values())
    assert size < 4 * sum(len(t) for _, t in items)


def test_licenses_in_a_hot_directory(spark, monkeypatch):
    rows = [("d/LICENSE", "Released under the MIT License.")] + [(f"d/{k}", "code") for k in range(200)] + [("e/x", "code")]
    docs = spark.createDataFrame([(k, p, t) for k, (p, t) in enumerate(rows)], "doc_id long, path string, text string")
    monkeypatch.setattr(licenses, "BROADCAST_DIRS", 0)
    got = licenses.licensed(docs, F.col("path")).collect()
    assert Counter((r["license"], r["license_up"]) for r in got) == {("MIT", None): 1, ("MIT", 0): 200, (None, None): 1}


def test_shared_folder(spark, monkeypatch):
    class Context:
        master, applicationId = "yarn", "x"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": lambda self, *a: None})()

    with pytest.raises(RuntimeError):
        store.scratch(Session(), "t")
    assert store.scratch(spark, "t").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_mixture_takes_the_rows_that_come_first(spark, docs, rows):
    """Which rows are chosen: a leaf's whole epochs, then the least seeded hashes up to its budget."""
    levels, seed = {"source": F.col("source")}, 17
    got = mixture.mix(docs, levels, {"source": {"src1": 2.0}}, 1.3, 3, seed=seed).collect()
    taken = Counter()
    for r in got:
        taken[r["mix_source"]] += r["take"]
    leaves = defaultdict(list)
    for r in rows:
        n = len(re.findall(r"\S+", r[1] or ""))
        if n:
            leaves[r[3] or ""].append((r[0], n))
    want = Counter()
    for leaf, members in leaves.items():
        whole, rest = divmod(taken[leaf], sum(n for _, n in members))
        want.update((leaf, i, e, n, n) for i, n in members for e in range(whole))
        keys = spark.createDataFrame(members, "id long, n long").select("id", "n", F.xxhash64(F.lit(seed), F.lit(whole), F.col("id")).alias("h")).collect()
        for h, i, n in sorted((k["h"] % 2**64, k["id"], k["n"]) for k in keys):
            if rest > 0:
                want[leaf, i, whole, n, min(n, rest)] += 1
            rest -= n
    assert Counter((r["mix_source"], r["doc_id"], r["epoch"], r["n_tokens"], r["take"]) for r in got) == want


SF = "/root/testdata/sf0.001"


def plain_languages(rows):
    """Error-correcting codes by plain counting: {doc_id: (language, score)}; rows are those of documents."""
    fold = lambda t: bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in t.encode())

    def grams(text):
        data = fold(text)
        for k, n in enumerate(language.ORDERS):
            for i in range(len(data) - n + 1):
                x = int.from_bytes(data[i : i + n], "little")
                if data[i : i + n] != b" " * n:
                    yield k, max((((x ^ (n * 0x51ED27)) * 0x9E3779B1) % 2**32) >> 17, 1)

    taught = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1 and r[1] is not None and r[2] is not None]
    names = sorted({r[2] for r in taught})
    code = language.codewords(len(names))
    counts = defaultdict(Counter)
    for r in taught:
        counts[r[2]].update(grams(r[1]))
    bits = range(code.shape[1])
    side = {(b, s): sum((counts[x] for x, c in zip(names, code) if c[b] == s), Counter()) for b in bits for s in (1, -1)}
    total = {(b, s, k): sum(n for (o, _), n in side[b, s].items() if o == k) + 0.5 * (language.BUCKETS - 1) for b in bits for s in (1, -1) for k in (0, 1)}

    def margins(text):
        own = Counter(grams(text))
        out = [0.0] * len(bits)
        for k in (0, 1):
            n = sum(c for (o, _), c in own.items() if o == k)
            for b in bits if n else ():
                gain = sum(c * (math.log((side[b, 1][g] + 0.5) / total[b, 1, k]) - math.log((side[b, -1][g] + 0.5) / total[b, -1, k])) for g, c in own.items() if g[0] == k)
                out[b] += gain / n * language.SATURATION * n / (language.SATURATION + n) / len(language.ORDERS)
        return out

    right, seen = defaultdict(Counter), Counter()
    for r in taught:
        seen[r[2]] += 1
        right[r[2]].update(b for b, m in enumerate(margins(r[1])) if m * code[names.index(r[2])][b] > 0)
    trust = {x: [(right[x][b] + 1) / (seen[x] + 2) for b in bits] for x in names}
    trust = {x: [len(bits) * v / sum(t) for v in t] for x, t in trust.items()}
    out = {}
    for r in rows:
        if not r[1] or not any(map(str.isalpha, r[1])):
            out[r[0]] = ("und", 0.0)
            continue
        m = margins(r[1])
        loss = [sum(math.log1p(math.exp(-v * c)) * t for v, c, t in zip(m, word, trust[x])) for x, word in zip(names, code)]
        out[r[0]] = (names[loss.index(min(loss))], 1 / sum(math.exp(min(loss) - x) for x in loss))
    return out


def test_language_query_against_plain_counting(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    got = {r["doc_id"]: r for r in queries.op4_language_id(spark, SF).collect()}
    want = plain_languages(rows)
    assert got.keys() == want.keys()
    for i, (name, score) in want.items():
        assert got[i]["lang_pred"] == name and math.isclose(got[i]["score"], score, rel_tol=1e-3, abs_tol=1e-3)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
    held = [r for r in rows if r[2] and got[r[0]]["held_out"]]
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in held) >= 0.97 * len(held)


def test_quality_query_against_a_plain_sum(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    got = {r["doc_id"]: r for r in queries.op5_quality_cotraining(spark, SF).collect()}
    rows = docs.select("doc_id", "text", "source", "lang", "n_chars").collect()
    assert got.keys() == {r["doc_id"] for r in rows}
    for r in rows[:60]:
        text = r["text"] or ""
        own = words(text, ALNUM_WORDS)
        data = text.encode()
        at = lambda w: int(Words(pa.array([w]), ALNUM).hash[0])
        bins = [
            sum(b < 128 and not chr(b).isalnum() and chr(b) not in " \t\n\x0b\x0c\r" for b in data) / max(len(data), 1) * 4 * quality.BINS, sum(65 <= b <= 90 for b in data) / max(len(data), 1) * 2 * quality.BINS,
            len(set(own)) / max(len(own), 1) * quality.BINS, sum(len(w.encode()) for w in own) / max(len(own), 1) * 2, sum(48 <= b <= 57 for b in data) / max(len(data), 1) * 4 * quality.BINS,
        ]
        seen = {at(w) >> 64 - quality.WORD_BITS for w in own} | {(1 << quality.WORD_BITS) + k * quality.BINS + min(int(x), quality.BINS - 1) for k, x in enumerate(bins)}
        odds = max(-20, min(20, sum(model.text[f] for f in seen) / len(seen) ** 0.25 + model.text[-1]))
        a, b = model.text_curve
        assert math.isclose(got[r["doc_id"]]["text_score"], 1 / (1 + math.exp(-(a * odds + b))), abs_tol=1e-9)


def test_quality_on_held_out_labels(spark):
    """Half of the labels teach, the others tell: pseudo-labels flow in all rounds, and the
    combination is no worse than either view."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0
    model = quality.train(docs, labels.where(half))
    given = [a + b for a, b in model.exchanged]
    assert len(given) == quality.ROUNDS and all(x < y for x, y in zip([0, *given], given))
    out = quality.score(docs, model).join(labels.where(~half), "doc_id").selectExpr("quality_score", "text_score", "meta_score", "quality = 1 AND toxic = 0 AS good").toPandas()

    def ranked(column):
        rank = out[column].rank()
        n = out["good"].sum()
        return (rank[out["good"]].sum() - n * (n + 1) / 2) / (n * (len(out) - n))

    both, text, meta = (ranked(c) for c in ("quality_score", "text_score", "meta_score"))
    assert both >= max(text, meta) - 0.005 and both > 0.9
    toxic = docs.where("text rlike '(?i)(moron|idiot|scum|worthless).*(moron|idiot|scum|worthless)'")
    found = quality.score(toxic, model).selectExpr("avg(CAST(quality_score < 0.5 AS int))").first()[0]
    assert found > 0.75


def test_license_query_against_plain_cosines(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in queries.op8_license_scan(spark, SF).collect()}
    assert got.keys() == {r["doc_id"] for r in rows}
    lines = [words(x, ALNUM_WORDS) for r in rows for x in (r["text"] or "").split("\n")]
    lines = [x for x in lines if x]
    held = Counter(w for x in lines for w in set(x))
    notices = {n: ts for n, ts in licenses.NOTICES.items()}
    vocabulary = {w for ts in [*notices.values(), *licenses.full_texts().values()] for t in ts for w in words(t, ALNUM_WORDS)}
    idf = {w: math.log((len(lines) + 1) / (held[w] + 1)) + 1 for w in vocabulary}
    rare = math.log(len(lines) + 1) + 1
    for r in rows:
        text, best = r["text"] or "", 0.0
        parts = [" ".join(x) for x in (words(y, ALNUM_WORDS) for y in text.split("\n")) if x]
        own = words(text, ALNUM_WORDS)
        for ts in notices.values():
            for t in ts:
                w = words(t, ALNUM_WORDS)
                uncommon = set(w) & {"license", "licensed", "rights", "spdx", "domain", "cc", "governed", "redistribute"}
                for i in range(len(own) - len(w) + 1):
                    if uncommon & set(own[i : i + len(w)]):
                        best = max(best, reference_cosine(" ".join(own[i : i + len(w)]), t, idf, rare))
                best = max([best, *(reference_cosine(p, t, idf, rare) for p in parts if uncommon & set(p.split()))])
        score = got[r["doc_id"]]["own_score"]
        assert (score is None and best < licenses.THRESHOLD + 1e-9) or got[r["doc_id"]]["is_license_file"] or math.isclose(score, best, abs_tol=1e-9)


@pytest.mark.parametrize("scan", ["language", "near", "tokens", "lm", "fingerprints", "licenses", "quality"])
def test_texts_of_several_slices(spark, scan):
    """Texts far longer than a slice, beside short ones, give what they give alone."""
    rng = random.Random(12)
    long_ = " ".join(f"w{rng.randrange(4000)}" for _ in range(260_000))
    rows = [(1, "the cat sat on the mat", "en"), (2, long_, "en"), (3, long_ + " more", "de"), (4, None, None), (5, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    assert len(long_) > 1 << 20
    if scan == "language":
        assert language.predict(docs, language.train(docs)).count() == 5
    elif scan == "near":
        got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in near_dups.near_duplicates(docs).collect()}
        assert got == {1: (1, 2), 2: (2, len(shingles(long_, 5))), 3: (2, len(shingles(long_, 5)) + 1), 4: (4, 0), 5: (5, 0)}
    elif scan == "tokens":
        from tokenizers import Tokenizer

        plain = Tokenizer.from_file(queries.tokenizer_path())
        got = {r["doc_id"]: r["value"] for r in token_files.token_files(docs, queries.tokenizer_path()).collect()}
        assert got == {i: zlib.crc32(np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t, _ in rows}
    elif scan == "lm":
        got = {r["doc_id"]: r for r in mixing_lm.score(docs, F.col("doc_id") != 3).collect()}
        assert got[3]["n_tokens"] == 260_002 and got[3]["n_known"] == 260_001 and got[4]["n_tokens"] == 1
    elif scan == "fingerprints":
        got = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(docs).collect()}
        assert len(got) == 5 and got[4] == got[5]
    elif scan == "licenses":
        assert licenses.licensed(docs, F.lit("a/b")).count() == 5
    else:
        table = docs.withColumn("source", F.lit(None).cast("string"))
        model = quality.train(table, spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int"))
        assert quality.score(table, model).count() == 5
