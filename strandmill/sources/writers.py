"""Writers of models and results, through Hadoop's file systems."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions.adm import Adm


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def matrix_text(m: np.ndarray, digits: int = 6) -> str:
    return "".join("\t".join(f"{x:.{digits}f}" for x in row) + "\n" for row in m)


def adm_text(model: Adm) -> str:
    rows = model.rows()
    out = ["\t".join([*(f"{x:.6f}" for x in rows[4 * a + b, 1:]), "ADM_DI", "ACGT"[a] + "ACGT"[b]]) for a in range(4) for b in range(4)]
    out += ["\t".join([*(f"{x:.6f}" for x in model.ip[a]), f"ADM_MONO_{'ACGT'[a]}"]) for a in range(4)]
    return "\n".join(out) + "\n"


def cob_text(pair) -> str:
    """Orientations by distances."""
    distances = range(pair.dmin, pair.dmax + 1)
    rows = ["\t".join(["", *map(str, distances)])]
    rows += ["\t".join([o, *(f"{pair.lambdas.get((o, d), 0.0):.5f}" for d in distances)]) for o in pair.orientations]
    return "\n".join(rows) + "\n"


def write_result(spark: SparkSession, folder: str, result, cfg, names: list[str] | None = None) -> list[str]:
    """Weights, a .pfm or .adm for each motif, a .cob for each pair and a .dev for each learned case; returns the names."""
    state = result.state
    names = names or [f"motif{k}" for k in range(len(state.models))]
    files = {"monomer_weights.txt": ",".join(names) + "\n" + ",".join(f"{x:.6f}" for x in state.lambdas) + "\n"}
    for name, t in zip(names, state.models, strict=True):
        model = Adm(t)
        files[f"{name}.pfm" if cfg.model == "ppm" else f"{name}.adm"] = matrix_text(model.ip) if cfg.model == "ppm" else adm_text(model)
    for p in state.pairs:
        pair = f"{names[p.tf1]}-{names[p.tf2]}"
        files[f"{pair}.cob"] = cob_text(p)
        for (o, d), dev in p.deviation.items():
            files[f"{pair}.{o}.{d}.dev"] = matrix_text(dev[0] if cfg.model == "ppm" else dev.reshape(16, -1))
    for name, text in files.items():
        write_bytes(spark, f"{folder}/{name}", text.encode())
    return sorted(files)


def write_unbound(reads: DataFrame, path: str) -> None:
    """Sequences, one a line."""
    reads.select("seq").write.mode("overwrite").text(path)


def write_distances(spark: SparkSession, path: str, reads: DataFrame, pairs: DataFrame, most: int = 20_000) -> None:
    """Packed export of all pairs: the number of sequences, the sequences, and a byte for each pair i > j by rows.

    A file of n (n - 1) / 2 bytes made on the driver, so for at most ``most`` sequences; larger sets stay in Parquet.
    """
    rows = reads.orderBy("read_id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} sequences; keep the pairs in Parquet")
    at = {r["read_id"]: k for k, r in enumerate(rows)}
    out = bytearray(len(rows) * (len(rows) - 1) // 2)
    for r in pairs.select("i", "j", "dist").toLocalIterator():
        i, j = sorted((at[r["i"]], at[r["j"]]), reverse=True)
        out[i * (i - 1) // 2 + j] = r["dist"]
    head = "".join([f"{len(rows)}\n", *(r["seq"] + "\n" for r in rows)])
    write_bytes(spark, path, head.encode() + bytes(out))


def kmer_table(counts: DataFrame, path: str) -> None:
    counts.orderBy(F.desc("n"), "kmer").write.mode("overwrite").parquet(path)
