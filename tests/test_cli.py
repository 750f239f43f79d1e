import itertools
import random

import numpy as np

from strandmill import cli
from strandmill.functions import likelihood as L
from strandmill.functions import matrix as M
from strandmill.functions.adm import Adm
from strandmill.functions.alphabet import reverse_complement
from tests.test_functions import random_adm


def test_learn_and_distances(spark, tmp_path):
    rng = random.Random(1)
    seqs = ["".join(rng.choice("ACGT") for _ in range(6)) + "GACCTG" + "".join(rng.choice("ACGT") for _ in range(6)) for _ in range(200)]
    (tmp_path / "r.seq").write_text("\n".join(seqs) + "\n")
    args = ["learn", f"{tmp_path}/r.seq", "GACCTG", "--outputdir", f"{tmp_path}/out", "--max-iter", "3", "--unbound", f"{tmp_path}/unbound", "--names", "m", "--cob", "all", "--dmax", "1", "--flanks", "--unique", "0"]
    cli.run(spark, cli.parser().parse_args(args))
    assert {"m.pfm", "m.svg", "m-m.cob", "monomer_weights.txt", "history", "models", "cob", "flank-0.pfm", "report.html"} <= {p.name for p in (tmp_path / "out").iterdir()}
    (tmp_path / "s.seq").write_text("\n".join([*seqs[:5], seqs[0]]) + "\n")
    cli.run(spark, cli.parser().parse_args(["distances", f"{tmp_path}/s.seq", f"{tmp_path}/d", "--unique"]))
    assert spark.read.parquet(f"{tmp_path}/d").count() == 10
    cli.run(spark, cli.parser().parse_args(["kmers", f"{tmp_path}/s.seq", f"{tmp_path}/k", "-k", "3", "--max-gap", "1"]))
    assert spark.read.parquet(f"{tmp_path}/k").count() > 0
    cli.run(spark, cli.parser().parse_args(["logo", f"{tmp_path}/out/m.pfm", f"{tmp_path}/x.svg"]))
    assert (tmp_path / "x.svg").read_text().startswith("<svg")


def test_read_probabilities_sum_to_one():
    p, m = M.from_seed("AC", 0.7), random_adm(2)
    for model, strand in ((p, 0), (p, 1), (m, 0), (m, 1)):
        total = sum(2 ** L.log_probability("".join(s), model, 1, strand, [0.1, 0.2, 0.3, 0.4]) for s in itertools.product("ACGT", repeat=4))
        assert np.isclose(total, 1)
    total = sum(2 ** L.log_pair_probability("".join(s), p, Adm.from_ppm(p), 1, 0) for s in itertools.product("ACGT", repeat=6))
    assert np.isclose(total, 1)
    s = "ACGTTA"
    assert np.isclose(L.log_probability(s, p, 2, 1), L.log_probability(reverse_complement(s), p, 2, 0))
    assert L.positional_log_probability("AC", np.full((4, 2), 0.25)) == -4 and L.class_probabilities("RN") == [0.5, 1.0]


def test_orientation_sets():
    assert L.orientation_class(["HT", "TH"]) == 9 and L.orientations_of(9) == ["HT", "TH"] and L.orientations_of(8, True) == ["HT"]
