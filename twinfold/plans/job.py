"""Job entry (M13): ``spark-submit twinfold/plans/job.py --tensor PATH:DIMS ...``.

Arguments follow the reference's job, named instead of positional::

    --tensor train_0.txt:7889_154 --tensor train_1.txt:62_154
    --coupling map.txt --rank 5 --optimizer CF_0.1_LS --stop 0_0.0001
    --validation valid_0.txt --validation valid_1.txt --output OUT

The reference's positional order is accepted too (first argument a number,
see :func:`from_positional`). ``--split`` gives every mode ``min(split, dim)``
partitions of cached entries and raises the shuffle partition count to it. Outputs under
OUT: ``factors/`` (parquet), ``U_{t}_{m}/`` tab exports of the final
model, ``Validation_U_{t}_{m}/`` of each tensor's best validated version,
``metrics/`` (parquet), ``Log/`` and ``Validation_Log/`` (tab text), and,
with ``--predict``, ``predictions_{t}/`` at the validation cells (with
``--rescale`` in the reference's application units).
"""

from __future__ import annotations

import argparse
import os
import sys

if __package__ in (None, ""):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark.sql import SparkSession  # noqa: E402

from twinfold.spec import STORAGE_LEVELS  # noqa: E402


def parse_args(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="twinfold-job", description="coupled matrix/tensor factorisation")
    p.add_argument("--tensor", action="append", required=True, help="PATH:DIMS, dims like 7889_154")
    p.add_argument("--coupling", help="map file of t_m<TAB>t_m lines")
    p.add_argument("--rank", type=int, required=True)
    p.add_argument("--common", type=int, default=3, help="shared columns of the coupled mode (default 3)")
    p.add_argument("--optimizer", default="CF_0.1_LS", help="CF_<lambda>_<LS|WLS>")
    p.add_argument("--stop", required=True, help="0_<min rel decrease>, 1_<max iters>, 2_<max hours>, combined")
    p.add_argument("--validation", action="append", default=None)
    p.add_argument("--output", required=True)
    p.add_argument("--split", type=int, default=None, help="partitions per mode (at most its size), the least per shuffle")
    p.add_argument("--partition-bytes", type=int, default=256 << 20, help="size of a cached partition without --split")
    p.add_argument("--storage", default="MEMORY_AND_DISK", choices=STORAGE_LEVELS, help="level of cached entries")
    p.add_argument("--method", default="auto", choices=["auto", "sum", "gram"], help="form of the normal equations")
    p.add_argument("--share-init", action="store_true", help="start both coupled factors alike")
    p.add_argument("--keep-versions", default="needed", choices=["needed", "all"], help="factor versions to keep")
    p.add_argument("--rescale", action="store_true", help="write predictions in the reference's units")
    p.add_argument("--init", default="random", choices=["random", "lcg", "const"])
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--checkpoint-every", type=int, default=1)
    p.add_argument("--work", default=None, help="folder of the factor versions and commits (default: a new one)")
    p.add_argument("--resume", action="store_true", help="go on from the last iteration committed under --work")
    p.add_argument("--predict", action="store_true", help="write predictions at the validation cells")
    return p.parse_args(argv)


def from_positional(argv: list[str]) -> argparse.Namespace:
    """The reference job's positional order, mapped to the named arguments.

    ``n  dims_1 .. dims_n  split  rank  [map (n > 1)]  optimizer  stopping
    input_1 .. input_n  output  [validation_1 .. validation_n]``
    """
    it = iter(argv)
    try:
        n = int(next(it))
        dims = [next(it) for _ in range(n)]
        split = int(next(it))
        rank = next(it)
        coupling = next(it) if n > 1 else None
        optimizer = next(it)
        stop = next(it)
        inputs = [next(it) for _ in range(n)]
        output = next(it)
    except StopIteration:
        raise SystemExit("too few positional arguments") from None
    rest = list(it)
    if rest and len(rest) != n:
        raise SystemExit("give one validation path per data set, or none")
    named = [a for path, d in zip(inputs, dims) for a in ("--tensor", f"{path}:{d}")]
    named += ["--rank", rank, "--optimizer", optimizer, "--stop", stop, "--output", output, "--split", str(split)]
    if coupling:
        named += ["--coupling", coupling]
    for v in rest:
        named += ["--validation", v]
    return parse_args(named)


def run(spark: SparkSession, args: argparse.Namespace):
    from twinfold.operators.predict import REFERENCE_RESCALE_BREAKS, REFERENCE_RESCALE_ELSE, denormalise, predict
    from twinfold.plans.fit import fit
    from twinfold.sources import sinks, text
    from twinfold.spec import FitConfig, Options, Stop

    if len(args.tensor) < 2:
        raise SystemExit("the coupled fit requires at least two data sets")
    if not args.coupling:
        raise SystemExit("--coupling is required")
    if args.split:
        # Never fewer than the session's: a small split of the entries is no bound on the tasks of every shuffle.
        shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.conf.set("spark.sql.shuffle.partitions", str(max(args.split, shuffled)))
    specs = []
    for item in args.tensor:
        path, _, dims = item.rpartition(":")
        specs.append((path, tuple(int(d) for d in dims.split("_"))))
    tensors = [text.read_tensor(spark, p, d, f"t{i}") for i, (p, d) in enumerate(specs)]
    valid = None
    if args.validation:
        valid = text.read_validation(spark, args.validation, [d for _, d in specs])
    couplings = text.collect_couplings(text.read_coupling(spark, args.coupling))
    cfg = FitConfig(rank=args.rank, common=args.common, options=Options.parse(args.optimizer),
                    stop=Stop.parse(args.stop), init=args.init, seed=args.seed,
                    checkpoint_every=args.checkpoint_every, split=args.split, partition_bytes=args.partition_bytes,
                    storage=args.storage, method=args.method, share_init=args.share_init,
                    keep_versions=args.keep_versions)
    out = args.output.rstrip("/")
    if args.resume and not args.work:
        raise SystemExit("--resume needs --work")
    model = fit(spark, tensors, couplings, cfg, validation=valid, metrics_path=f"{out}/metrics",
                root=args.work.rstrip("/") if args.work else None, resume=args.resume)
    sinks.save_factor_table(model.factor_table(), f"{out}/factors")
    sinks.export_model_text(model, out)
    for t, (_, _, paths) in sorted(model.best_validation.items()):
        sinks.export_model_text(model, out, "Validation_", {k: v for k, v in paths.items() if k[0] == t})
    metrics = model.metrics
    sinks.write_training_log(metrics, len(tensors), f"{out}/Log")
    if valid:
        sinks.write_validation_log(metrics, len(tensors), f"{out}/Validation_Log")
        if args.predict:
            for t, v in enumerate(valid):
                cells = predict(spark, v, model.factors_of(t), model.rank)
                if args.rescale:
                    cells = denormalise(cells, REFERENCE_RESCALE_BREAKS, REFERENCE_RESCALE_ELSE)
                sinks.write_predictions(cells, v.n_modes, f"{out}/predictions_{t}")
    return model


def main(argv: list[str] | None = None) -> None:
    raw = sys.argv[1:] if argv is None else argv
    args = from_positional(raw) if raw and raw[0].isdigit() else parse_args(raw)
    spark = SparkSession.builder.appName("twinfold-job").getOrCreate()
    run(spark, args)


if __name__ == "__main__":
    main()
