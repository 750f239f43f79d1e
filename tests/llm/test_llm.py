import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandmill.llm import bpe, imatch, langid, lines, minhash, mixing, neighbours, quality, queries, records, substring, text
from strandmill.llm.components import components
from tests.conftest import DATA
from tests.llm import brute
from tests.llm.conftest import corpus

PATH = queries._tokenizer()


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_sql(spark, same, name):
    same(queries.QUERIES[name](spark, DATA), queries.ORACLE_SQL[name])


def test_words_and_shingles():
    texts = pa.array(["a  b\tc", None, "", "x" * 10, " é b c d e f"])
    for _, _, data, offsets in text.blocks(texts):
        w = text.words(data, offsets)
        assert np.diff(w.first).tolist() == [3, 0, 0, 1, 6]
        doc, h = text.shingles(w)
        assert Counter(doc.tolist()) == {0: 1, 3: 1, 4: 2} and len(set(h.tolist())) == 4
    assert [b for _, b, _, _ in text.blocks(pa.array(["a" * (1 << 20), "b"]))] == [1, 2]


# near-duplicates


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    n, m = 400, 256
    h = text.stream(5, n)
    for share, weight in ((0.5, 1), (0.8, 7), (0.9, 30)):
        a, b = rng.integers(1, weight + 1, n), rng.integers(1, weight + 1, n)
        same = rng.random(n) < share
        b = np.where(same, a, b)
        s = [minhash.signatures(np.zeros(n, int), h, x, 1, m)[0] for x in (a, b)]
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((s[0] == s[1]).mean() - true) < 4 * np.sqrt(true * (1 - true) / m) + 1e-9
    assert np.isinf(minhash.signatures(np.zeros(0, int), h[:0], h[:0].astype(int), 2, 4)).all()


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for p in links for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert got == {x: find(x) for x in root if any(x in p and p[0] != p[1] for p in links)}


def test_near_duplicates_equal_brute_force(spark, docs, rows):
    got = {r["doc_id"]: (r["class_id"], r["keep"]) for r in minhash.near_duplicates(docs).collect()}
    want = brute.near_classes([(r["doc_id"], r["text"]) for r in rows])
    assert got == {i: (c, i == c) for i, c in want.items()} and len(set(want.values())) < len(want)


def test_chain_of_near_copies_is_one_class(spark):
    """Each text is near its neighbours only; far members of a pivot are linked through others, or with each other."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = []
    for i in range(40):
        w = list(base)
        for k in range(i):
            w[(k * 5) % 200] = f"new{k}"
        texts.append((i, " ".join(w)))
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == brute.near_classes(texts)


# neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[50:90] = x[7]  # a common vector
    vectors = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] + [1.0] * 7), (1003, [1.0, 2.0]), (1004, [None] + [1.0] * 7), (1005, [float("inf")] * 8), (None, x[3].tolist())]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("distance", F.lit(0))
    got = neighbours.search(df, lambda i: i % 10 == 0).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(by) == set(range(0, 600, 10))
    hit = 0
    for q, found in by.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        want = [(i, d[i]) for i in np.lexsort((np.arange(600), d)) if i != q][:10]
        assert len(found) == 10 and all(np.isclose(s, d[i], rtol=0, atol=1e-12) for i, s in found) and found == sorted(found, key=lambda p: (p[1], p[0]))
        hit += len({i for i, _ in found} & {i for i, _ in want})
        if 50 <= q < 90:
            assert [i for i, _ in found] == [i for i, _ in want]
    assert hit >= 0.9 * 10 * len(by)
    few = neighbours.search(df.where("vec_id < 4"), lambda i: i == 0).collect()
    assert len(few) == 3
    assert neighbours.search(df.where("false"), lambda i: i == 0).count() == 0


def test_recall_on_the_table(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    got = {(r["query_id"], r["vec_id"]) for r in neighbours.search(df, lambda i: i % 100 == 0).collect()}
    rows = df.orderBy("vec_id").collect()
    x, ids = np.array([r["embedding"] for r in rows]), np.array([r["vec_id"] for r in rows])
    want = set()
    for q in ids[ids % 100 == 0]:
        d = ((x - x[ids == q]) ** 2).sum(1)
        d[ids == q] = np.inf
        want |= {(q, i) for i in ids[np.argsort(d)[:10]]}
    assert len(got & want) >= 0.9 * len(want)


def test_nearest_is_exact():
    """With ties, and with small differences of large vectors."""
    rng = np.random.default_rng(3)
    for x in (rng.integers(0, 2, (2000, 12)), 1e6 + 1e-3 * rng.normal(size=(2000, 12)), rng.normal(size=(2000, 12)) * 10.0 ** rng.integers(-150, 150, (2000, 1)), rng.normal(size=(5, 3))):
        x = x.astype(float)
        index, distance = neighbours.nearest(x[:40], x, 11)
        for i, q in enumerate(x[:40]):
            d = np.sqrt(((x - q) ** 2).sum(1))
            want = np.lexsort((np.arange(len(x)), d))[:11]
            assert index[i].tolist() == want.tolist() and distance[i].tolist() == d[want].tolist()


def test_neighbours_of_repeated_ids(spark):
    """Rows that repeat an id count once if their vectors are equal; otherwise each is a candidate."""
    rows = [(0, [0.0, 1.0]), (1, [0.0, 2.0]), (1, [0.0, 2.0]), (1, [0.0, 4.0]), (2, [0.0, 3.0])]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), lambda i: i == 0).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1, 1.0), (2, 2, 2.0), (3, 1, 3.0)]


# fingerprints


def test_imatch(spark, docs, rows):
    out = {r["doc_id"]: r for r in imatch.compare_edited(docs, least=0.02).collect()}
    rows = sorted(rows, key=lambda r: r["doc_id"])
    for i, r in enumerate(rows):
        t, after = r["text"], rows[(i + 1) % len(rows)]["text"]
        half = len(t) // 2
        got = out[r["doc_id"]]
        assert (got["n_chars"], got["edited_sha256"]) == (len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest())
        assert 0 <= got["near_edited"] <= 1 and 0 <= got["near_next"] <= 1
        for other in rows[:i]:
            if other["text"] == t:
                assert out[other["doc_id"]]["fingerprint"] == got["fingerprint"]
        if t == after:
            assert got["near_next"] == 1
    assert np.mean([r["near_edited"] for r in out.values()]) > 2 * np.mean([r["near_next"] for r in out.values()])
    plain = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprint(docs, least=0.02).collect()}
    assert plain == {i: r["fingerprint"] for i, r in out.items()}


def test_imatch_equals_brute_force(spark, docs, rows):
    got = {r["doc_id"]: tuple(r)[1:] for r in imatch.compare_edited(docs, least=0.02).collect()}
    want = brute.imatch([(r["doc_id"], r["text"]) for r in rows], 0.02, imatch.MOST)
    assert got == want


def test_lexicon_and_word_order(spark, docs, rows):
    df = Counter(w for r in rows for w in set(brute.words(r["text"].lower())))
    want = sum(max(2, 0.02 * len(rows)) <= n <= 0.2 * len(rows) for n in df.values())
    assert imatch.lexicon(docs, 0.02, 0.2).count() == want
    two = spark.createDataFrame([(1, "one two three"), (2, "three  Two one one"), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprint(two).collect()}
    assert got[1] == got[2] != got[3]


def test_following(spark):
    for ids in (random.Random(1).sample(range(-(10**7), 10**7), 300), list({random.Random(k).randrange(-(2**63), 2**63) for k in range(300)}), [7], []):
        ids = sorted(ids)
        got = {r["k"]: r["next"] for r in imatch.following(spark.createDataFrame([(i,) for i in ids], "k long"), "k").collect()}
        assert got == dict(zip(ids, [*ids[1:], None]))


# substrings


@pytest.mark.parametrize("batches,fan_out", [(1, 4), (3, 1)])
def test_substrings_equal_brute_force(spark, batches, fan_out):
    rng = random.Random(batches)
    passages = [[rng.choice("abcdefgh") for _ in range(rng.randint(20, 40))] for _ in range(6)]
    rows = []
    for i in range(40):
        w = [rng.choice("abc") if i % 4 == 0 else f"u{rng.randrange(10**9)}" for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(passages)
        rows.append((rng.randrange(10**6) * 100 + i, " ".join(w)))
    rows += [(5, "x " * 70), (6, None), (None, "x " * 70), (7, "")]
    got = sorted(tuple(r) for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), batches=batches, fan_out=fan_out, with_text=False).fillna(-1, ["doc_id"]).collect())
    want = sorted((-1 if rows[k][0] is None else rows[k][0], *v) for k, v in brute.remove_repeats(rows).items())
    assert got == want and any(r[2] for r in want)


def test_long_words_are_told_apart(spark):
    """Polynomials modulo 2^64 can't tell a Thue-Morse word from its complement, whatever their base is."""
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{k}" for k in range(19))
    rows = [(1, f"{word} {rest}"), (2, f"{other} {rest}"), (3, f"{word} {rest}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring.remove_repeats(df, with_text=False).collect()} == {1: 0, 2: 0, 3: 20}
    near = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame([(1, " ".join([word] * 5)), (2, " ".join([other] * 5))], "doc_id long, text string")).collect()}
    assert near == {1: 1, 2: 2}


def test_substring_text(spark):
    p = " ".join(f"w{i}" for i in range(25))
    out = substring.remove_repeats(spark.createDataFrame([(1, f"a {p} b"), (2, f"c\n{p}  d")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["kept_text"] for r in out] == [f"a {p} b", "c d"]


# lines


def test_lines_equal_brute_force(spark, docs, rows):
    got = {r["doc_id"]: r["text"] for r in lines.drop_lines(docs).collect()}
    want = brute.drop_lines([(r["doc_id"], r["text"]) for r in rows])
    assert got == {r["doc_id"]: t for r, t in zip(rows, want)} and got != {r["doc_id"]: r["text"] for r in rows}


def _dropped(spark, texts):
    """Lines dropped of each text, in order; Spark, brute force and SQL agree."""
    import duckdb
    import pandas as pd

    rows = list(enumerate(texts))
    out = lines.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["text"] for r in out] == brute.drop_lines(rows)
    with duckdb.connect() as c:
        c.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
        want = c.sql(f"select n_dropped from ({lines.ORACLE}) order by doc_id").fetchall()
    assert [(r["n_dropped"],) for r in out] == want
    return [r["n_dropped"] for r in out]


def _own(rng, n=12):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_lines_of_copies_stay(spark):
    t = "one line that all copies of it have here\nand another line in them that is the same"
    assert _dropped(spark, [t] * 50) == [0] * 50
    rng = random.Random(1)
    base = [_own(rng).split(" ") for _ in range(40)]
    near = []
    for _ in range(60):  # near copies: each line of each is as it was, or has a word of its own
        near.append("\n".join(" ".join([*w[:5], _own(rng, 1), *w[6:]] if rng.random() < 0.1 else w) for w in base))
    assert sum(_dropped(spark, near)) < 0.1 * 40 * 60  # a sketch misses a few


def test_digits_vary(spark):
    texts = [f"unique {'abcdefgh'[i]} {'qrstuvwx'[i]} start\nseen 12:3{i} by user{i} on this day of the month" for i in range(8)]
    assert _dropped(spark, texts) == [0] + [1] * 7
    assert _dropped(spark, [f"unique {'abcdefgh'[i]} start\n{i} {i + 1} | {i}" for i in range(8)]) == [0] * 8


@pytest.mark.parametrize("gap", ["\n", "\n\n"])
def test_blocks_and_blank_lines(spark, gap):
    """All lines of a block go, between blank lines too; blank lines stay."""
    rng = random.Random(2)
    footer = ["All of this is free to copy", "as long as this notice stays", "Contact us", "Home", "Read more on the next page"]
    texts = [gap.join([*[_own(rng) for _ in range(6)], *footer]) for _ in range(40)]
    assert _dropped(spark, texts) == [0] + [5] * 39


def test_short_lines(spark):
    rng = random.Random(3)
    texts = [f"{_own(rng)}\n{_own(rng)}\nRead more\nHome" for _ in range(30)]
    assert _dropped(spark, texts) == [0] + [2] * 29
    assert _dropped(spark, [f"{_own(rng)}\n{_own(rng, 2)}" for _ in range(30)]) == [0] * 30


def test_words_vary(spark):
    """A name in a line of any length is a field; lines that only begin alike are no template."""
    rng = random.Random(4)
    texts = [f"{_own(rng)}\nPosted by {_own(rng, 1)}q in News\n{_own(rng)}\nThis page was last seen by {_own(rng, 1)}q and all of the others who have been here before today\n{_own(rng)}" for _ in range(40)]
    assert _dropped(spark, texts) == [0] + [2] * 39
    assert _dropped(spark, [f"{_own(rng)}\nthen the {_own(rng, 6)}\n{_own(rng)}" for _ in range(40)]) == [0] * 40


def test_two_texts_are_no_recurrence(spark):
    rng = random.Random(5)
    assert _dropped(spark, [f"{_own(rng)}\nsaid once and then again by two" for _ in range(2)] + [_own(rng)] * 3) == [0] * 5


# quality


def test_quality_on_labels(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    seen, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    ratio, share = quality.fit(docs, seen)
    out = quality.resample(docs, ratio, share).join(held, "doc_id").collect()
    good, bad = ([r["log_weight"] for r in out if r["quality"] == q] for q in (1, 0))
    assert 0.5 < share < 1 and np.mean([g > b for g in good for b in bad]) > 0.9


def test_quality_counts_and_threshold(spark):
    texts = ["aa bb aa, bb", "aa", None, "", "X1 !!"]
    rows = [b for x in (pa.array(texts),) for a, c, d, o in text.blocks(x) for b in zip(*quality.features(d, o))]
    n = Counter(r for r, _ in rows)
    assert n[0] == 5 + 4 + 3 and n[1] == 1 and n[4] == 2 + 1
    values = [5, -3, 2**62, -(2**62), 7, 7, 0]
    df = spark.createDataFrame([(v,) for v in values], "key long")
    for k in range(1, len(values) + 1):
        assert quality.kth_largest(df, "key", k) == sorted(values, reverse=True)[k - 1]
    assert quality.kth_largest(df, "key", len(values) + 1) is None
    x = np.array([-np.inf, -2.5, -0.0, 0.0, 1e-300, 3.0])
    assert (np.diff(quality.sortable(x)) >= 0).all()
    docs = spark.createDataFrame([(i, "good text") for i in range(100)], "doc_id long, text string")
    out = quality.resample(docs, quality.Ratio(np.zeros(quality.FEATURES)), 0.3)
    again = quality.resample(docs, quality.Ratio(np.zeros(quality.FEATURES)), 0.3)
    assert out.where("keep").count() == 30 and out.orderBy("doc_id").collect() == again.orderBy("doc_id").collect()


def test_quality_equals_brute_force(spark, docs, rows):
    labels = [(r["doc_id"], int(i % 3 > 0)) for i, r in enumerate(rows) if i % 2]
    got = {r["doc_id"]: (r["log_weight"], r["score"], r["keep"]) for r in quality.select_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    want = brute.quality([(r["doc_id"], r["text"]) for r in rows], dict(labels))
    assert all(np.allclose(got[i][:2], want[i][:2], atol=1e-9) and got[i][2] == want[i][2] for i in want) and got.keys() == want.keys()


# mixing


def test_mixing_equals_brute_force(spark, docs, rows):
    got = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    want = brute.copies([(r["doc_id"], r["text"], r["source"]) for r in rows])
    assert got == {r["doc_id"]: c for r, c in zip(rows, want)}
    mixed = Counter(r["doc_id"] for r in mixing.mixed(docs).collect())
    assert mixed == Counter({i: c for i, c in got.items() if c})


def test_targets_reshare(spark):
    sizes = {"a": 10, "b": 100, "c": 1000, "d": 3, None: 50}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = brute.targets(sizes)
    assert all(np.isclose(got[s], want[s]) for s in sizes) and np.isclose(sum(got.values()), 1.5 * sum(sizes.values()))


# tokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def odd_texts(n=800):
    rng = random.Random(5)
    parts = ["a", "b", " ", "  ", "the", "\n", "é", "1", "'s", "!!", "日", "ing", "\t", "\xa0", " ", "<|endoftext|>", "’s", "\x1c", "\U00010ec5", "e", "́", "ß", " x", "\x00", "aaaaaaaaaaaa", " "]
    return ["", " ", "a" * 300, " " * 300 + "x", "é" * 200, "日本語" * 60] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_bpe_equals_library(library):
    texts = odd_texts()
    for encoder in (bpe.Encoder(bpe.load(PATH)), records.library_encoder(PATH), bpe.Encoder(bpe.load(PATH), remembered=3)):
        for t, got in zip(texts, encoder.encode(texts)):
            ids = library.encode(t, add_special_tokens=False).ids
            assert np.frombuffer(got, "<u4").tolist() == ids
            assert "".join(bpe.decode(encoder.m, np.array(ids, "<u4"), 5)) == library.decode(ids, skip_special_tokens=False)


def test_stream_equals_library(library, monkeypatch):
    monkeypatch.setattr(bpe.Stream, "LONG", 60)
    rng = random.Random(6)
    for t in odd_texts(300):
        stream, out, k = bpe.StreamEncoder(bpe.load(PATH)), [], 0
        while k < len(t):
            n = rng.randint(1, 50)
            out += stream.feed(t[k : k + n])
            k += n
        assert out + stream.finish() == library.encode(t, add_special_tokens=False).ids


def test_stream_memory_is_constant():
    stream = bpe.StreamEncoder(bpe.load(PATH))
    most = 0
    for part in ["ab" * 500] * 40 + [" word"] * 3000:
        stream.feed(part)
        most = max(most, len(stream.stream.text) + (len(stream.stream.run.tail) if stream.stream.run else 0))
    assert most < 3 * bpe.Stream.LONG


def test_decode_malformed(library):
    for ids in ([222], [220, 162, 222, 100], [50256, 7]):
        assert "".join(bpe.decode(bpe.load(PATH), np.array(ids, "<u4"), 1)) == library.decode(ids, skip_special_tokens=False)


def test_crc32c():
    data = np.frombuffer(b"123456789" + bytes(32) + b"\xff" * 32 + b"a", np.uint8)
    assert [hex(x) for x in records.crc32c(data, [9, 0, 32, 32, 1])] == ["0xe3069283", "0x0", "0x8a9136aa", "0x62a8ab43", "0xc1d04330"]


def test_frames():
    ids = [np.array(x, "<u2") for x in ([1, 2, 3], [], [50256] * 1000)]
    raw = b"".join(records.frame(ids))
    at = np.cumsum([0, 16 + 6, 16])
    got, counts = records.unframe(np.frombuffer(raw, np.uint8), at, "<u2")
    assert counts.tolist() == [3, 0, 1000] and got.tolist() == np.concatenate(ids).tolist()
    for k in (0, 13, len(raw) - 1):
        broken = bytearray(raw)
        broken[k] ^= 1
        with pytest.raises((ValueError, IndexError)):
            records.unframe(np.frombuffer(bytes(broken), np.uint8), at, "<u2")


def test_round_trip(spark, library, docs, rows):
    got = {r["doc_id"]: tuple(r)[1:] for r in records.round_trip(docs, PATH).collect()}
    at = 0
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        ids = np.array([*library.encode(r["text"], add_special_tokens=False).ids, 2], "<u4")
        assert got[r["doc_id"]] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_encode_decode(spark, library, docs, rows):
    for r in bpe.encode_decode(docs, PATH).join(docs.select("doc_id", "text"), "doc_id").collect():
        ids = library.encode(r["text"], add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == r["text"]
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


# languages


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = langid.identify_held_out(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.9
    assert np.mean([r["accepted"] for r in out]) > 0.97 and all(0 <= r["score"] <= 1 for r in out)


def test_language_equals_a_plain_forward_pass(spark, docs, rows):
    model = langid.train(docs)
    for r in langid.identify(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect():
        p, like = brute.language(model, r["text"])
        best = max(range(len(p)), key=lambda k: p[k])
        assert r["lang_pred"] == model.languages[best] and np.isclose(r["score"], p[best], atol=1e-6)
        assert r["accepted"] == (p[best] >= model.threshold and like[best] >= model.least) or min(abs(p[best] - model.threshold), abs(like[best] - model.least)) < 1e-5


def test_language_is_of_the_text_alone(spark, docs):
    model = langid.train(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !? 34"), (4, "kalomi tu")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0) and got[4][0] in ("en", "de")
    again = langid.train(docs)
    assert np.array_equal(model.logits, again.logits)
    assert langid.train(docs.where("lang is null")) is None
    assert langid.identify(odd, None).where("accepted").count() == 1


def test_language_rejects_unseen_languages_and_garbage(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rng = random.Random(3)
    polish = "nie na się że jest jak tak przez przy był dla czy już tylko jego może być ale który miasto wojna polska rząd między człowiek życie ludzie dzień czas praca szkoła książka droga dom woda ziemia słowo świat kraj".split()
    texts = [" ".join(rng.choice(polish) for _ in range(rng.randint(20, 200))) for _ in range(100)]
    texts += [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(20, 200))) for _ in range(100)]
    odd = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for langs in (["en", "de", "fr", "es"], ["en", "de"], ["en"]):
        known = docs.where(docs.lang.isin(langs))
        model = langid.train(known)
        assert langid.accepted(odd, model).count() <= 2
        assert langid.accepted(known, model).count() >= 0.98 * known.count()


def test_language_learns_from_whole_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "fit", lambda counts, checks, labels: seen.append((counts, labels)))
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 9))) for _ in range(n)) for n in (3, 800, 4000)]
    langid.train(spark.createDataFrame([(i, t, f"l{i}") for i, t in enumerate(texts)], "doc_id long, text string, lang string"))
    (counts, labels), = seen
    assert labels == ["l0", "l1", "l2"]
    for t, (_, c) in zip(texts, counts):
        assert c.sum() == 3 * len(t.encode()) - 3
    monkeypatch.setattr(langid, "BLOCK", 1000)
    for t, (i, c) in zip(texts, counts):
        j, d = langid.counted(t.encode())
        assert np.array_equal(i, j) and np.array_equal(c, d)


# edges


def test_operators_on_messy_rows(spark, messy):
    n = messy.count()
    assert minhash.near_duplicates(messy).count() == n
    near = [(r["doc_id"], r["class_id"]) for r in minhash.near_duplicates(messy).collect()]
    by = dict(near)
    assert by[None] is None and by[3] == by[4] == 3 and by[6] == by[7] == 6 and by[1] == 1 and by[2] == 2
    for out in (substring.remove_repeats(messy, with_text=False), imatch.compare_edited(messy), lines.drop_digest(messy), mixing.mix(messy), bpe.encode_decode(messy, PATH), records.round_trip(messy, PATH), langid.identify_held_out(messy)):
        assert out.count() == n
    labels = spark.createDataFrame([(1, 1), (1, 0), (6, None), (None, 1), (8, 0)], "doc_id long, quality int")
    assert quality.select_quality(messy, labels).count() == n
    assert quality.select_quality(messy, labels.where("false")).where("keep").count() == n
    for out in (lines.drop_lines(messy).drop("n_lines", "n_dropped"), mixing.mixed(messy), minhash.one_of_each(messy), langid.accepted(messy, langid.train(messy))):
        assert out.columns == messy.columns and out.count() > 0
    kept = minhash.one_of_each(messy)
    assert kept.where("doc_id = 1").count() == 1 and kept.where("doc_id is null").count() == 2
    assert bpe.with_ids(messy, PATH).select("document.*").columns == messy.columns


def test_operators_on_no_rows(spark, messy):
    none = messy.where("false")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for out in (
        minhash.near_duplicates(none), substring.remove_repeats(none), imatch.compare_edited(none), lines.drop_digest(none), mixing.mix(none), bpe.encode_decode(none, PATH), records.round_trip(none, PATH),
        langid.identify_held_out(none), quality.select_quality(none, labels), minhash.one_of_each(none), mixing.mixed(none), imatch.fingerprint(none),
    ):
        assert out.count() == 0


def test_all_texts_null(spark):
    nulls = spark.createDataFrame([(1, None, None, None), (2, None, None, None)], "doc_id long, text string, lang string, source string")
    for out in (minhash.near_duplicates(nulls), substring.remove_repeats(nulls), imatch.compare_edited(nulls), lines.drop_digest(nulls), mixing.mix(nulls), bpe.encode_decode(nulls, PATH), records.round_trip(nulls, PATH), langid.identify_held_out(nulls)):
        assert out.count() == 2


def test_corpus_has_what_it_should():
    texts = corpus()
    assert len(set(texts)) < len(texts)
