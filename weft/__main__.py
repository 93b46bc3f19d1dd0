"""Command line: list, ask, and train.

    python -m weft list --db facts.cfacts [--mode f/2]
    python -m weft list --prog rules.ppr --rule-ids
    python -m weft eval --db facts.cfacts --prog rules.ppr --mode p/io --input a,b
    python -m weft train --db D --prog P --train T --test T [--epochs 10] [--rate 0.1] [--save model.db]
"""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    from weft.catalog import Database
    from weft.engine import Engine, Session, Settings
    from weft.learn import Experiment, FixedRateGD, FixedRateSGD, L2Regulariser, NoRegulariser, RecordingTracer
    from weft.sources.store import open_database, open_dataset

    a = argparse.ArgumentParser("weft")
    a.add_argument("what", choices=["list", "eval", "train"])
    for name in ("db", "prog", "mode", "input", "train", "test", "save", "predictions"):
        a.add_argument(f"--{name}")
    a.add_argument("--rule-ids", action="store_true")
    a.add_argument("--depth", type=int, default=10)
    a.add_argument("--normalise", default="softmax")
    a.add_argument("--top", type=int, default=10)
    a.add_argument("--epochs", type=int, default=10)
    a.add_argument("--rate", type=float, default=0.1)
    a.add_argument("--batch", type=int)
    a.add_argument("--l2", type=float)
    o = a.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    db = open_database(spark, o.db) if o.db else Database(spark)
    if o.what == "list" and not o.prog:
        if o.mode:
            functor, arity = o.mode.split("/")
            for r in db.fact_text(functor, int(arity)).toLocalIterator():
                print(r.value)
        else:
            print(db.listing())
        return
    engine = Engine(db, o.prog, Settings(o.depth, o.normalise, top=o.top), initial_weights=bool(o.db))
    if o.what == "list":
        print("\n".join(f"ruleid\t{r}" for r in engine.features.rule_ids) if o.rule_ids else Session(engine).list(o.mode))
    elif o.what == "eval":
        for symbol in o.input.split(","):
            Session(engine).eval(o.mode, symbol)
    else:
        regulariser = L2Regulariser(o.l2) if o.l2 else NoRegulariser()
        kind = {"epochs": o.epochs, "rate": o.rate, "regulariser": regulariser, "tracer": RecordingTracer()}
        learner = FixedRateSGD(engine, batch=o.batch, **kind) if o.batch else FixedRateGD(engine, **kind)
        for k, v in Experiment(learner, open_dataset(spark, o.train, db), open_dataset(spark, o.test, db), o.save, o.predictions).run().items():
            print(f"{k}\t{v:g}")


if __name__ == "__main__":
    main()
