"""Command line: ``python -m strandmill.cli learn|distances|kmers|logo ...``."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandmill", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    learn = sub.add_parser("learn", help="fit motifs, and pairs of motifs, to reads")
    learn.add_argument("reads")
    learn.add_argument("seeds", help="comma-separated seeds, or matrix files with --matrices")
    learn.add_argument("--matrices", action="store_true")
    learn.add_argument("--outputdir", default="out")
    learn.add_argument("--names", default="")
    learn.add_argument("--model", default="ppm", choices=["ppm", "adm", "adm-fixed", "adm-unfixed"])
    learn.add_argument("--prior", default="addone", choices=["none", "addone", "dirichlet"])
    learn.add_argument("--hamming-radius", type=int)
    learn.add_argument("--disable-multinomial", action="store_true", help="count all sites, not those near the seed")
    learn.add_argument("--no-adjust-seeds", action="store_true")
    learn.add_argument("--keep-monomer-fixed", default="", help="comma-separated numbers of motifs")
    learn.add_argument("--meme-init", action="store_true")
    learn.add_argument("--max-iter", type=int, default=150)
    learn.add_argument("--epsilon", type=float, default=0.01)
    learn.add_argument("--cob", default="", help="pairs such as 0-0,0-1, or all")
    learn.add_argument("--cob-cutoff", type=float, default=0.001)
    learn.add_argument("--dmin", type=int)
    learn.add_argument("--dmax", type=int, default=10)
    learn.add_argument("--max-gap-learned", type=int, default=0)
    learn.add_argument("--minimum-distance-for-learning", type=int, default=4)
    learn.add_argument("--ic-threshold", type=float, default=0.40)
    learn.add_argument("--overlap-combine", default="N", choices=["N", "or", "and"])
    learn.add_argument("--single-strand", action="store_true")
    learn.add_argument("--reverse-strand", action="store_true")
    learn.add_argument("--rna", action="store_true")
    learn.add_argument("--freqs", default="", help="background of the first round: four comma-separated frequencies")
    learn.add_argument("--directional-seed", action="store_true", help="seeds of overlapping cases are no near palindromes")
    learn.add_argument("--purely-modular", type=float, default=1.0, help="weight of dimers from which a motif is learned from them alone")
    learn.add_argument("--unique", type=int, help="drop reads within this many mismatches of a kept one")
    learn.add_argument("--unbound", help="write the reads that no motif claims")
    learn.add_argument("--flanks", action="store_true")
    learn.add_argument("--no-visualizations", action="store_true")
    dist = sub.add_parser("distances", help="all pairwise Huddinge distances")
    dist.add_argument("reads")
    dist.add_argument("output", help="Parquet, or with --packed one binary file")
    dist.add_argument("--packed", action="store_true")
    dist.add_argument("--unique", action="store_true")
    kmers = sub.add_parser("kmers", help="k-mer counts")
    kmers.add_argument("reads")
    kmers.add_argument("output")
    kmers.add_argument("-k", type=int, default=6)
    kmers.add_argument("--single-strand", action="store_true")
    kmers.add_argument("--max-gap", type=int, default=0)
    logo = sub.add_parser("logo", help="SVG logo of a matrix")
    logo.add_argument("matrix")
    logo.add_argument("output")
    return p


def _uri(path: str) -> str:
    return path if "://" in path else f"file://{os.path.abspath(path)}"


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    from pyspark.sql import functions as F

    from strandmill.functions import sequence as S
    from strandmill.operators import counts, dedup, huddinge
    from strandmill.plans import em, report
    from strandmill.sources import readers, writers

    if args.command == "logo":
        writers.write_bytes(spark, _uri(args.output), report.logo_svg(readers.read_matrix(spark, _uri(args.matrix))).encode())
        return
    reads = readers.read_reads(spark, _uri(args.reads))
    if args.command == "kmers":
        both = not args.single_strand
        table = counts.gapped_kmer_counts(reads, args.k, args.max_gap, both) if args.max_gap else counts.kmer_counts(reads, args.k, both)
        writers.kmer_table(table, _uri(args.output))
        return
    if args.command == "distances":
        readers.check_alphabet(reads)
        if args.unique:
            reads = reads.groupBy("seq").agg(F.min("read_id").alias("read_id")).select("read_id", "seq")
        pairs = huddinge.all_pairs(reads)
        if args.packed:
            writers.write_distances(spark, _uri(args.output), reads, pairs)
        else:
            pairs.write.mode("overwrite").parquet(_uri(args.output))
        return
    readers.check_alphabet(reads, args.rna)
    if args.reverse_strand:
        reads = reads.withColumn("seq", S.reverse_complement(F.col("seq"), args.rna))
    if args.unique is not None:
        kept = dedup.within(reads, args.unique)
        reads = reads.join(kept.select("seq"), "seq", "left_semi").groupBy("seq").agg(F.min("read_id").alias("read_id")).select("read_id", "seq")
    cob = "all" if args.cob == "all" else tuple(tuple(map(int, x.split("-"))) for x in args.cob.split(",") if x)
    cfg = em.Config(
        model=args.model, two_strands=not args.single_strand, rna=args.rna, radius=args.hamming_radius, gate=not args.disable_multinomial, prior=args.prior, adjust_seeds=not args.no_adjust_seeds,
        fixed_monomers=tuple(int(x) for x in args.keep_monomer_fixed.split(",") if x), max_iter=args.max_iter, epsilon=args.epsilon, cob=cob, cob_cutoff=args.cob_cutoff, dmin=args.dmin, dmax=args.dmax, max_gap=args.max_gap_learned,
        min_distance=args.minimum_distance_for_learning, ic_threshold=args.ic_threshold, combine=args.overlap_combine, directional_seeds=args.directional_seed, purely_modular=args.purely_modular,
        freqs=tuple(float(x) for x in args.freqs.split(",")) if args.freqs else None,
    )
    parts = [x for x in args.seeds.split(",") if x]
    matrices = None
    if args.matrices:
        matrices = [readers.read_adm(spark, _uri(p)).t if p.endswith(".adm") else readers.read_matrix(spark, _uri(p)) for p in parts]
    result = em.fit(reads, [] if matrices else parts, cfg, matrices, args.meme_init)
    out = _uri(args.outputdir)
    names = [x for x in args.names.split(",") if x] or None
    writers.write_result(spark, out, result, cfg, names)
    report.history(spark, result).coalesce(1).write.mode("overwrite").json(f"{out}/history")
    report.models(spark, result.state, cfg).coalesce(1).write.mode("overwrite").parquet(f"{out}/models")
    report.cob_table(spark, result.state).coalesce(1).write.mode("overwrite").parquet(f"{out}/cob")
    for k, t in enumerate(result.state.models):
        writers.write_bytes(spark, f"{out}/{names[k] if names else f'motif{k}'}.svg", report.logo_svg(em.ppm(t)).encode())
    writers.write_bytes(spark, f"{out}/seeds.json", "".join(json.dumps(r) + "\n" for r in em.seed_report(reads, result.state, cfg)).encode())
    writers.write_bytes(spark, f"{out}/report.html", report.html(result, cfg, names, not args.no_visualizations).encode())
    if args.flanks:
        for key, m in em.flanks(reads, result.state, cfg).items():
            pairs = result.state.pairs
            name = key[1] if key[0] == "m" else f"{pairs[key[1]].tf1}-{pairs[key[1]].tf2}.{key[2]}.{key[3]}"
            writers.write_bytes(spark, f"{out}/flank-{name}.pfm", writers.matrix_text(m).encode())
    if args.unbound:
        writers.write_unbound(em.unbound(reads, result.state, cfg), _uri(args.unbound))


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("strandmill").getOrCreate()
    run(spark, args)


if __name__ == "__main__":
    main()
