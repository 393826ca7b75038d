import glob
import os

import numpy as np

from twinfold.plans import job


def _planted(scratch, noise=0.0, seed=1):
    """Two matrices sharing mode 1, made from known rank-3 factors with a shared block of 2."""
    rng = np.random.default_rng(seed)
    n1, n2, d, rank, common = 30, 12, 25, 3, 2
    v0 = rng.uniform(0.2, 1.0, (d, common))
    v1 = rng.uniform(0.2, 1.0, (d, rank - common))
    v2 = rng.uniform(0.2, 1.0, (d, rank - common))
    u1 = rng.uniform(0.2, 1.0, (n1, rank))
    u2 = rng.uniform(0.2, 1.0, (n2, rank))
    x1 = u1 @ np.hstack([v0, v1]).T
    x2 = u2 @ np.hstack([v0, v2]).T
    paths = {}
    for name, x in (("a", x1), ("b", x2)):
        mask = rng.uniform(size=x.shape) < 0.6
        hold = rng.uniform(size=x.shape) < 0.15
        for part, sel in (("train", mask & ~hold), ("valid", hold)):
            p = f"{scratch}/{name}_{part}.txt"
            with open(p, "w") as fh:
                for i, j in zip(*np.nonzero(sel)):
                    fh.write(f"{i}\t{j}\t{x[i, j] + noise * rng.normal()}\n")
            paths[(name, part)] = p
    mp = f"{scratch}/map.txt"
    with open(mp, "w") as fh:
        fh.write("0_1\t1_1\n")
    return paths, mp, (n1, d), (n2, d)


def test_job_end_to_end(spark, scratch):
    paths, mp, d1, d2 = _planted(scratch)
    out = f"{scratch}/out"
    args = job.parse_args([
        "--tensor", f"{paths[('a', 'train')]}:{d1[0]}_{d1[1]}",
        "--tensor", f"{paths[('b', 'train')]}:{d2[0]}_{d2[1]}",
        "--coupling", mp, "--rank", "3", "--common", "2", "--optimizer", "CF_0.001_LS",
        "--stop", "0_0.00001_1_25", "--validation", paths[("a", "valid")],
        "--validation", paths[("b", "valid")], "--output", out, "--predict", "--init", "random"])
    model = job.run(spark, args)
    totals = [v for _, _, t, v in model.history if t == "total"]
    assert totals[-1] < 0.05 * totals[0]
    for t, m in [(0, 0), (0, 1), (1, 0), (1, 1)]:
        lines = []
        for f in sorted(glob.glob(f"{out}/U_{t}_{m}/part-*")):
            lines += open(f).read().splitlines()
        assert len(lines) == (d1 if t == 0 else d2)[m]
        assert all(len(line.split("\t")) == 3 for line in lines)
    assert os.path.isdir(f"{out}/Validation_U_0_0") and os.path.isdir(f"{out}/Log")
    assert os.path.isdir(f"{out}/predictions_1") and os.path.isdir(f"{out}/factors/tensor=1/mode=1")
    appended = spark.read.parquet(f"{out}/metrics")
    assert appended.count() == len(model.history)
    log = spark.read.option("sep", "\t").option("header", "true").csv(f"{out}/Log")
    assert set(log.columns) == {"iter", "seconds", "se_0", "se_1", "mean", "total"}
    assert log.count() == len(totals)
    # Shared block: the coupled factors agree on the common columns for keys seen in both tensors.
    fa = {r.idx: list(r.v) for r in model.factor(0, 1).collect()}
    fb = {r.idx: list(r.v) for r in model.factor(1, 1).collect()}
    keys = set(spark.read.option("sep", "\t").csv(paths[("a", "train")]).select("_c1").distinct()
               .toPandas()["_c1"].astype(int)) & set(
        spark.read.option("sep", "\t").csv(paths[("b", "train")]).select("_c1").distinct()
        .toPandas()["_c1"].astype(int))
    for k in keys:
        np.testing.assert_allclose(fa[k][:2], fb[k][:2])


def test_job_refuses_single_data_set(spark, scratch):
    paths, mp, d1, _ = _planted(scratch)
    args = job.parse_args(["--tensor", f"{paths[('a', 'train')]}:{d1[0]}_{d1[1]}", "--coupling", mp,
                           "--rank", "2", "--stop", "1_1", "--output", f"{scratch}/o"])
    try:
        job.run(spark, args)
        raise AssertionError("expected refusal")
    except SystemExit:
        pass


def test_positional_arguments_map_to_named():
    a = job.from_positional(["2", "7889_154", "62_154", "48", "5", "map.txt", "CF_0.1_LS", "0_0.0001",
                             "a.txt", "b.txt", "out", "va.txt", "vb.txt"])
    assert a.tensor == ["a.txt:7889_154", "b.txt:62_154"]
    assert (a.rank, a.split, a.coupling, a.optimizer, a.stop, a.output) == (5, 48, "map.txt", "CF_0.1_LS", "0_0.0001", "out")
    assert a.validation == ["va.txt", "vb.txt"]
    b = job.from_positional(["2", "3_4", "2_4", "8", "2", "m.txt", "CF_1_WLS", "1_3", "a", "b", "o"])
    assert b.validation is None and b.common == 3


def test_job_options_and_rerun(spark, scratch):
    paths, mp, d1, d2 = _planted(scratch)
    out = f"{scratch}/again"
    base = ["--tensor", f"{paths[('a', 'train')]}:{d1[0]}_{d1[1]}", "--tensor", f"{paths[('b', 'train')]}:{d2[0]}_{d2[1]}",
            "--coupling", mp, "--rank", "3", "--common", "2", "--validation", paths[("a", "valid")],
            "--validation", paths[("b", "valid")], "--output", out, "--predict", "--init", "lcg", "--storage", "DISK_ONLY",
            "--method", "gram"]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        plain = job.run(spark, job.parse_args([*base, "--stop", "1_2", "--split", "3"]))
        cells = {(r._c0, r._c1): float(r._c2) for r in spark.read.option("sep", "\t").csv(f"{out}/predictions_1").collect()}
        model = job.run(spark, job.parse_args([*base, "--stop", "1_1", "--split", "3", "--rescale", "--share-init"]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert plain.final_iter == 2 and model.final_iter <= 1
    assert {r.iter for r in spark.read.parquet(f"{out}/metrics").collect()} == {0, 1}
    scaled = {(r._c0, r._c1): float(r._c2) for r in spark.read.option("sep", "\t").csv(f"{out}/predictions_1").collect()}
    assert scaled.keys() == cells.keys() and min(scaled.values()) > 1000 * max(cells.values())
