"""Benchmark: coupled fit on the TPC-H-style tables.

Runs at $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]
and prints one JSON line. Rank 5, common block 3, lambda 0.1, LS, three
sweeps, random init. Reported per phase (seconds):

* tensors: build both tensors from the tables and write them
* prepare: check, count and cache them, one range-partitioned copy per mode
* init: write the initial factors
* loss_first: the first loss pass (SSE of both tensors over their entries)
* loss_pass: mean of the later ones (training SSE from the sums of the
  sweep's last updates; validation SSE and all column means: one job)
* sweep: mean seconds of one Gauss-Seidel sweep (five factor updates)
* predict: predictions at every held-out cell, written to parquet
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    sweeps = int(os.environ.get("BENCH_SWEEPS", "3"))
    from pyspark.sql import functions as F

    from twinfold.operators.predict import predict
    from twinfold.plans.fit import fit
    from twinfold.session import local_session, run_dir
    from twinfold.sources import tpch
    from twinfold.spec import FitConfig, Options, Stop

    spark = local_session("twinfold-bench")
    t0 = time.time()
    tensors, valid, coup = tpch.coupled_pair(spark, sf_dir, materialize=run_dir(spark, "bench-tensors"))
    build_s = time.time() - t0
    t1 = time.time()
    cfg = FitConfig(rank=5, common=3, options=Options(0.1, "ls"), stop=Stop(max_iter=sweeps), init="random")
    model = fit(spark, tensors, coup, cfg, validation=valid)
    fit_s = time.time() - t1
    tm = dict(model.timings)
    loss = [v for k, v in model.timings if k.startswith("loss_") and k != "loss_0"]
    sweep = [v for k, v in model.timings if k.startswith("sweep_")]
    t1 = time.time()
    out = run_dir(spark, "bench-predict")
    parts = [predict(spark, v, model.factors_of(t), model.rank).withColumn("tensor", F.lit(t))
             for t, v in enumerate(valid)]
    parts[0].unionByName(parts[1]).write.mode("overwrite").parquet(out)
    pred_s = time.time() - t1
    total = build_s + fit_s + pred_s
    queries = {
        "tensors": round(build_s, 3),
        "prepare": round(tm.get("prepare", 0.0), 3),
        "init": round(tm.get("init", 0.0), 3),
        "loss_first": round(tm.get("loss_0", 0.0), 3),
        "loss_pass": round(sum(loss) / max(len(loss), 1), 3),
        "sweep": round(sum(sweep) / max(len(sweep), 1), 3),
        "predict": round(pred_s, 3),
        "fit": round(fit_s, 3),
    }
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "coupled_fit_3_sweeps", "value": round(total, 3), "unit": "sec",
                      "queries": queries, "sf": sf}))


if __name__ == "__main__":
    main()
