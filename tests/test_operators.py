import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.functions import matrix as M
from strandmill.operators import dedup
from strandmill.operators import windows as W
from strandmill.plans import em, report
from strandmill.sources import readers, writers
from strandmill.streaming import counts as streaming


def table(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string")


@pytest.mark.parametrize(
    "pattern,text,n",
    [("A", "CCCGGGTT", 0), ("A", "CACGGATT", 2), ("A", "AACCGGTTAA", 4), ("T", "A", 0), ("T", "", 0), ("TA", "TATATAT", 3), ("A", "AAAAA", 5), ("R", "AGTAGAC", 5), ("", "AGT", 3)],
)
def test_pattern_counts(spark, pattern, text, n):
    assert W.count_pattern(table(spark, [text]), pattern).first()["n"] == n


def greedy(seqs, radius):
    counts = {s: seqs.count(s) for s in seqs}
    left, kept = sorted(counts, key=lambda s: (-counts[s], s)), []
    while left:
        kept.append(left[0])
        left = [s for s in left[1:] if len(s) != len(kept[-1]) or sum(a != b for a, b in zip(s, kept[-1])) > radius]
    return sorted((s, counts[s]) for s in kept)


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_dedup_is_greedy(spark, radius):
    rng = random.Random(radius)
    seqs = ["".join(rng.choice("ACG") for _ in range(rng.choice([4, 5]))) for _ in range(150)]
    got = sorted((r["seq"], r["n"]) for r in dedup.within(table(spark, seqs), radius).collect())
    assert got == greedy(seqs, radius)


def planted(spark, n, motif, seed, every=2, length=20):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = "".join(rng.choice("ACGT") for _ in range(length))
        if i % every == 0:
            at = rng.randrange(length - len(motif) + 1)
            s = s[:at] + "".join(c if rng.random() < 0.9 else rng.choice("ACGT") for c in motif) + s[at + len(motif) :]
        out.append(s)
    return table(spark, out)


def test_em_finds_planted_motif(spark):
    reads = planted(spark, 1500, "GACCTGTC", 1)
    result = em.fit(reads, ["GACCTGTC"], em.Config(max_iter=20, prior="addone"))
    assert M.best_string(em.ppm(result.state.models[0])) in ("GACCTGTC", "GACAGGTC")
    assert 0.3 < result.state.lambdas[0] < 0.7 and len(result.history) >= 1
    assert report.history(spark, result).count() == len(result.history)


def test_likelihood_rises_without_gate(spark):
    reads = planted(spark, 600, "GACCTGTC", 2)
    result = em.fit(reads, ["GACCTGTC"], em.Config(max_iter=6, gate=False, adjust_seeds=False, epsilon=1e-9), meme_init=True)
    ll = [h["ll"] for h in result.history]
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(ll, ll[1:])), ll


@pytest.mark.parametrize("model", ["adm-unfixed", "adm-fixed"])
def test_em_order_one(spark, model):
    reads = planted(spark, 800, "GACCTGT", 3)
    result = em.fit(reads, ["GACCTGT"], em.Config(model=model, max_iter=5, prior="dirichlet"))
    t = result.state.models[0]
    assert np.allclose(t[0, :, 0].sum(), 1, atol=1e-6) and M.best_string(em.ppm(t)) == "GACCTGT"


def test_em_finds_pair(spark):
    rng = random.Random(5)
    seqs = []
    for i in range(900):
        s = "".join(rng.choice("ACGT") for _ in range(30))
        if i % 2:
            at = rng.randrange(12)
            s = s[:at] + "GACCTA" + s[at + 6 : at + 9] + "GACCTA" + s[at + 15 :]
        seqs.append(s)
    cfg = em.Config(cob=((0, 0),), dmin=-2, dmax=6, max_iter=8, prior="addone")
    result = em.fit(table(spark, seqs), ["GACCTA"], cfg)
    best = report.best_cases(report.cob_table(spark, result.state)).first()
    assert (best["orient"], best["d"]) == ("HT", 3) and best["lambda"] > 0.2


def test_overlapping_pair_and_reports(spark, tmp_path):
    reads = planted(spark, 600, "GACCTACCTA", 7)
    cfg = em.Config(cob=((0, 0),), dmin=-3, dmax=2, max_gap=1, max_iter=3, prior="addone")
    result = em.fit(reads, ["GACCTA"], cfg)
    names = writers.write_result(spark, f"file://{tmp_path}", result, cfg, ["x"])
    assert {"monomer_weights.txt", "x.pfm", "x-x.cob"} <= set(names)
    assert np.allclose(readers.read_matrix(spark, f"file://{tmp_path}/x.pfm"), em.ppm(result.state.models[0]), atol=1e-6)
    cob = readers.read_cob(spark, f"file://{tmp_path}/x-x.cob")
    assert np.isclose(cob["HT", 2], result.state.pairs[0].lambdas["HT", 2], atol=1e-5)
    assert report.deviations(spark, result.state).count() >= 0 and report.cob_matrix(report.cob_table(spark, result.state), [-1, 0]).count() == 3
    assert "<svg" in report.logo_svg(em.ppm(result.state.models[0]))


def test_rna_unbound_flanks(spark):
    reads = table(spark, ["ACGUACGUGACC", "GGGGGGGGGGGG", "UUGACCUUGACC"])
    cfg = em.Config(rna=True, max_iter=1)
    state = em.State([em.tensor(M.from_seed("GACC", 0.97))], ["GACC"], [0.5], np.full(4, 0.25))
    assert [r["read_id"] for r in em.unbound(reads, state, cfg).collect()] == [1]
    f = em.flanks(reads, state, cfg)["m", 0]
    assert f.shape == (4, 20) and M.best_string(f[:, 8:12]) == "GACC"
    with pytest.raises(ValueError):
        em.fit(table(spark, []), ["GACC"], cfg)


def test_readers(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return f"file://{tmp_path}/{name}"

    seqs = lambda df: [r["seq"] for r in df.orderBy("read_id").collect()]
    path = put("a.seq", "ACGT\r\nAXG\n\nGGTT\n")
    assert seqs(readers.read_reads(spark, path)) == ["ACGT", "GGTT"] and readers.bad_lines(spark, path) == 2
    fasta = put("a.fasta", ">one > x\nAC\nGT\n>two\nAXC\n>three\nGG\n\n>four\nTT\n")
    assert seqs(readers.read_reads(spark, fasta)) == ["ACGT", "GG", "TT"]
    assert seqs(readers.read_fasta(spark, fasta, strict=True)) == ["ACGT", "TT"]
    assert seqs(readers.read_reads(spark, put("a.fastq", "@r\nACGT\n+\nIIII\n@s\nANG\n+\nIII\n@t\nGG\n+\n@@\n"))) == ["ACGT", "GG"]
    with pytest.raises(ValueError, match="line 5"):
        readers.read_fastq(spark, put("b.fastq", "@r\nACGT\n+\nIIII\nACGT\nACGT\n+\nIIII\n"))
    with pytest.raises(ValueError):
        readers.read_lines(spark, put("c.seq", "xyz\n"))
    with pytest.raises(ValueError):
        readers.check_alphabet(table(spark, ["ACGU"]))
    assert readers.parse_matrix(["2x2", "1 2", "3 4", "5"]).tolist() == [[1, 2], [3, 4]]
    from tests.test_functions import random_adm

    m = random_adm(4)
    assert np.allclose(readers.parse_adm(writers.adm_text(m).splitlines()).t, m.t, atol=1e-5)
    with pytest.raises(ValueError):
        readers.parse_adm(["1 ADM_DI AA"])


def test_distances_file(spark, tmp_path):
    from strandmill.operators import huddinge

    reads = table(spark, ["ACG", "ACT", "GGG"])
    writers.write_distances(spark, f"file://{tmp_path}/d.bin", reads, huddinge.all_pairs(reads, 2))
    raw = (tmp_path / "d.bin").read_bytes()
    assert raw == b"3\nACG\nACT\nGGG\n" + bytes([1, 2, 3])


def test_alignments_of_pairs(spark):
    from strandmill.operators import huddinge

    rng = random.Random(5)
    rows = [(i * 7 % 101 - 50, "".join(rng.choice("ACGTnN") for _ in range(rng.randint(0, 9)))) for i in range(60)]
    reads = spark.createDataFrame(rows, "read_id long, seq string")
    want = [(i, j, d, a) for i, x in rows for j, y in rows if i > j for d, offsets in [huddinge.alignments(x, y)] for a in offsets]
    for block in (7, 512):
        found = huddinge.all_alignments(reads, block)
        assert found.dtypes == [("i", "bigint"), ("j", "bigint"), ("dist", "int"), ("shift", "int")]
        assert sorted(map(tuple, found.collect())) == sorted(want)


def test_alignments_take_little_longer_than_distances(spark):
    from strandmill.operators import huddinge

    reads = spark.range(2500).selectExpr("id as read_id", "substring(translate(md5(cast(id as string)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 8) as seq").localCheckpoint()
    took = []
    for f in (huddinge.all_pairs, huddinge.all_alignments):
        f(reads.where("read_id < 9")).collect()
        began = time.perf_counter()
        f(reads).write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
    assert took[1] < 6 * took[0]
    sums = [F.count("*"), F.sum(F.xxhash64("i", "j", F.col("dist").cast("int")).cast("decimal(38,0)"))]
    found, pairs = huddinge.all_alignments(reads).select("i", "j", "dist").distinct(), huddinge.all_pairs(reads)
    assert found.agg(*sums).first() == pairs.agg(*sums).first() and pairs.count() == 2500 * 2499 // 2


def test_streaming_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out = f"file://{tmp_path}/out"
    for part in (["ACGT", "AAAA"], ["ACGT"]):
        (tmp_path / "in" / f"{len(list((tmp_path / 'in').iterdir()))}.txt").write_text("\n".join(part) + "\n")
        reads = streaming.stream_lines(spark, f"file://{tmp_path}/in")
        streaming.write_counts(streaming.running_kmer_counts(reads, 2, False), out, f"file://{tmp_path}/check").awaitTermination()
    got = {r["kmer"]: r["n"] for r in spark.read.parquet(out).collect()}
    assert got == {"AC": 2, "CG": 2, "GT": 2, "AA": 3}


def test_config_checks():
    for bad in ({"model": "x"}, {"prior": "x"}, {"epsilon": 0}):
        with pytest.raises(ValueError):
            em.Config(**bad)
    assert em.Config(model="adm").model == "adm-fixed" and em.Config(model="adm").radius == 3 and em.Config().radius == 2


def test_windows_of_short_and_null_reads(spark):
    reads = spark.createDataFrame([(1, "ACG"), (2, "A"), (3, None), (4, "")], "read_id long, seq string")
    assert W.windows(reads, 2, True).count() == 4
    assert W.windows(reads.where("false"), 2).agg(F.count("*")).first()[0] == 0


def test_flanks_of_dimers_and_seed_report(spark):
    reads = table(spark, [f"{'ACGT' * 2}GACCTG{'TT'}GGCATG{'CA' * 3}"] * 3 + ["ACGTTGCA" * 4] * 3)
    state = em.State([em.tensor(M.from_seed(s, 0.97)) for s in ("GACCTG", "GGCATG")], ["GACCTG", "GGCATG"], [0.1, 0.1], np.full(4, 0.25), [em.Pair(0, 1, ("HT",), 2, 2, {("HT", 2): 0.3})])
    f = em.flanks(reads, state, em.Config(two_strands=False))
    assert set(f) == {("m", 0), ("m", 1), ("d", 0, "HT", 2)}
    m = f["d", 0, "HT", 2]
    assert m.shape == (4, 2 * 32 - 14) and M.best_string(m[:, 18:32])[:8] == "GACCTGTT"
    rows = em.seed_report(reads, state, em.Config(two_strands=False, max_gap=2))
    assert [(r["motif"], r["observed"]) for r in rows] == [("0", 3), ("1", 3), ("0-1", 3)]
    assert rows[0]["expected"] == (3 * 23 + 3 * 27) / 4**6


def test_commonest_completions_are_those_of_one_pattern(spark):
    rng = random.Random(3)
    reads = table(spark, ["".join(rng.choice("ACGT") for _ in range(30)) for _ in range(200)])
    cases = [("ACNNT", 2, 2), ("RCNNT", 2, 2), ("GANNNC", 2, 3), ("ACGTACGTACGTNN", 12, 2)]
    for both in (False, True):
        got = W.commonest_completions(reads, cases, both)
        assert got == [tuple(W.most_frequent_completion(reads, *c, both).first()) for c in cases]
        assert W.pattern_counts(reads, [c[0] for c in cases], both) == [W.count_pattern(reads, c[0], both).first()["n"] for c in cases]
    skipped = W.commonest_completions(reads, [("ACNNGT", 2, 2)], True, True)
    assert skipped == [tuple(W.most_frequent_completion(reads, "ACNNGT", 2, 2, True, True).first())]


def test_motifs_of_dimers_alone():
    """From a weight of its dimers on, a motif's own sites no longer count."""
    codes = em.encode(["ACGTTGACCTGACGTTGGCATGACGTACGTACG"] * 4)
    for share, alone in ((0.2, True), (1.0, False)):
        state = em.State([em.tensor(M.from_seed("GACCTG", 0.9)), em.tensor(M.from_seed("GGCATG", 0.9))], ["GACCTG", "GGCATG"], [0.1, 0.1], np.full(4, 0.25), [em.Pair(0, 1, ("HT",), 5, 5, {("HT", 5): 0.6})])
        cfg = em.Config(two_strands=False, gate=False, purely_modular=share)
        kernel = em.Kernel(state, cfg)
        sums = np.zeros(kernel.size)
        kernel.add(codes, sums)
        new = em.maximization(state, cfg, kernel, sums, np.bincount(codes.ravel(), minlength=4).astype(float))
        own, half = (kernel.get(sums, x, "m", 0).sum((0, 1)) for x in ("counts", "half"))
        want = half if alone else half + own
        assert np.allclose(em.ppm(new.models[0]), want / want.sum(0)) and own.sum() > 0


def test_reads_with_ambiguous_bases_are_not_fitted():
    with pytest.raises(ValueError, match="another letter"):
        em.encode(["ACGN"])
