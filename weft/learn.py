"""Gradient descent on parameter relations, and how good predictions are."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.adjoint import KEYS, gradients
from weft.operators.lower import Evaluation, softmax
from weft.plans.terms import Mode
from weft.scratch import written
from weft.sources.examples import Dataset

log = logging.getLogger(__name__)

#: Mean gradients are kept within this.
CLIP = 100.0
LARGEST = 3.4028234663852886e38


# -- metrics -------------------------------------------------------------------


def predictions_best(p: DataFrame, tie: str = "id") -> DataFrame:
    """(qid, id): each query's best answer; ties go to the symbol first by name, or last."""
    order = F.col("id").asc() if tie == "id" else F.col("id").desc()
    return p.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("w").desc(), order))).filter("rank = 1").select("qid", "id")


def accuracy(y: DataFrame, p: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(accuracy, n): the mean over queries of the label weight of the best
    answer; with k right answers a hit counts 1/k."""
    queries = queries if queries is not None else y.select("qid").distinct()
    hit = predictions_best(p).join(y.withColumnRenamed("w", "hit"), ["qid", "id"])
    return queries.join(hit, "qid", "left").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def cross_entropy(y: DataFrame, p: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(cross_entropy, n): mean over queries of -sum y log p, over the answers
    that were predicted at all; infinite where a label is predicted at zero."""
    queries = queries if queries is not None else y.select("qid").distinct()
    each = F.when(F.col("p") > 0, -F.col("w") * F.log("p")).when(F.col("w") > 0, float("inf")).otherwise(0.0)
    cost = y.join(p.withColumnRenamed("w", "p"), ["qid", "id"]).groupBy("qid").agg(F.sum(each).alias("cost"))
    return queries.join(cost, "qid", "left").agg(F.avg(F.coalesce("cost", F.lit(0.0))).alias("cross_entropy"), F.count(F.lit(1)).alias("n"))


def sigmoid(scores: DataFrame, slope: float = 1.0, bias: float = 0.0) -> DataFrame:
    """Biased logistic of scores, for losses on more than one label."""
    return scores.withColumn("w", 1 / (1 + F.exp(-(F.col("w") * slope + bias))))


def sigmoid_cross_entropy(y: DataFrame, scores: DataFrame) -> DataFrame:
    """(loss): mean over stored scores of the logistic loss with 0/1 labels."""
    both = scores.join(y.select("qid", "id", F.lit(1.0).alias("y")), ["qid", "id"], "left").withColumn("y", F.coalesce("y", F.lit(0.0)))
    s = F.col("w")
    return both.agg(F.avg(F.greatest(s, F.lit(0.0)) - s * F.col("y") + F.log1p(F.exp(-F.abs(s)))).alias("loss"))


def l1_cost(relation: DataFrame) -> DataFrame:
    return relation.agg(F.coalesce(F.sum(F.abs("w")), F.lit(0.0)).alias("l1"))


def rescaled(relation: DataFrame, by: float) -> DataFrame:
    return relation.withColumn("w", F.col("w") * by)


def softplus(relation: DataFrame) -> DataFrame:
    """Positive weights from free ones; :func:`softplus_inverse` undoes it."""
    return relation.withColumn("w", F.when(F.col("w") > 30, F.col("w")).otherwise(F.log1p(F.exp("w"))))


def softplus_inverse(relation: DataFrame) -> DataFrame:
    return relation.withColumn("w", F.when(F.col("w") > 30, F.col("w")).otherwise(F.log(F.greatest(F.expm1("w"), F.lit(1e-12)))))


# -- gradients and updates ------------------------------------------------------


@dataclass
class Gradients:
    """Sums of gradients by parameter, and what else is counted."""

    by_parameter: dict[tuple[str, int], DataFrame] = field(default_factory=dict)
    n: int = 0
    counters: dict[str, float] = field(default_factory=dict)

    def added(self, other: Gradients) -> Gradients:
        out = dict(self.by_parameter)
        for key, g in other.by_parameter.items():
            out[key] = out[key].unionByName(g).groupBy(*KEYS[key[1]]).agg(F.sum("w").alias("w")) if key in out else g
        counters = dict(self.counters)
        for k, v in other.counters.items():
            kind = k.split("-")[0]
            counters[k] = v if k not in counters else min(v, counters[k]) if kind == "min" else max(v, counters[k]) if kind == "max" else v + counters[k]
        return Gradients(out, self.n + other.n, counters)

    def mapped(self, f: Callable[[DataFrame], DataFrame]) -> Gradients:
        return Gradients({k: f(g) for k, g in self.by_parameter.items()}, self.n, self.counters)


def updated(parameter: DataFrame, gradient: DataFrame, rate: float, n: int, clip: float | None = CLIP) -> DataFrame:
    """Up the mean gradient by ``rate``; weights are kept at zero or above,
    components of vectors may be anything."""
    cols = [c for c in ("src", "dst", "id", "k") if c in parameter.columns]
    mean = F.col("w") / max(1, n)
    if clip is not None:
        mean = F.greatest(F.lit(-clip), F.least(F.lit(clip), mean))
    moved = parameter.withColumnRenamed("w", "old").join(gradient.select(*cols, (mean * rate).alias("move")), cols, "full")
    new = F.coalesce("old", F.lit(0.0)) + F.coalesce("move", F.lit(0.0))
    least = -LARGEST if "k" in cols else 0.0
    return moved.select(*cols, F.greatest(F.lit(least), F.least(F.lit(LARGEST), new)).alias("w"))


def updated_free(parameter: DataFrame, gradient: DataFrame, rate: float, n: int, clip: float | None = CLIP) -> DataFrame:
    """As :func:`updated`, with weights ``softplus(v)`` and the step taken in v:
    the gradient by v is the one by the weight times ``1 - exp(-weight)``.
    Weights are positive; a fact that isn't there isn't made."""
    cols = [c for c in ("src", "dst", "id") if c in parameter.columns]
    mean = F.coalesce("g", F.lit(0.0)) * (1 - F.exp(-F.col("w"))) / max(1, n)
    if clip is not None:
        mean = F.greatest(F.lit(-clip), F.least(F.lit(clip), mean))
    moved = softplus_inverse(parameter).withColumnRenamed("w", "v").join(parameter, cols).join(gradient.withColumnRenamed("w", "g"), cols, "left")
    return softplus(moved.select(*cols, (F.col("v") + mean * rate).alias("w"))).select(*cols, "w")


class NoRegulariser:
    def applied(self, relation: DataFrame) -> DataFrame:
        return relation

    def cost(self, relation: DataFrame) -> float:
        return 0.0


@dataclass
class L2Regulariser(NoRegulariser):
    """Decays weights by a factor of 1 - c before each update; costs c times their squares."""

    c: float = 0.01

    def applied(self, relation: DataFrame) -> DataFrame:
        return relation.withColumn("w", F.col("w") * (1 - self.c))

    def cost(self, relation: DataFrame) -> float:
        return float(relation.agg(F.sum(F.col("w") * F.col("w"))).first()[0] or 0.0) * self.c


@dataclass
class SoftmaxLikelihood:
    """The log-likelihood of the labels under the softmax of the scores."""

    def check(self, engine) -> None:
        if engine.normalise != "softmax":
            raise ValueError("gradients need softmax")

    def ascent(self, scores: DataFrame, y: DataFrame, queries: DataFrame) -> tuple[DataFrame, dict[tuple[str, int], DataFrame], int]:
        """((qid, id, w): derivative by each score; gradients of the loss's own
        parameters; how many examples to take means over)."""
        p = softmax(scores, queries)
        delta = y.select("qid", "id", "w").unionByName(p.select("qid", "id", (-F.col("w")).alias("w"))).groupBy("qid", "id").agg(F.sum("w").alias("w")).filter("w <> 0")
        return delta, {}, queries.count()

    def predicted(self, engine, mode: str | Mode, x: DataFrame, underflown: bool = False) -> DataFrame:
        return engine.inference_batch(mode, x, underflown=underflown)


@dataclass
class SigmoidLikelihood:
    """Each score is a yes or no of its own: the log-likelihood of the labels
    under ``sigmoid(slope * score + bias)``, so a query may have any number of
    labels.  Slope and bias are trained with the rest: the symbols ``slope`` and
    ``bias`` of the vectors ``(parameter, 0)``.  Means go over all pairs that
    have a score or a label; a label without a score has score 0."""

    db: object
    parameter: str = "logistic"

    def __post_init__(self) -> None:
        if (self.parameter, 0) not in self.db.relations:
            self.db.add_vectors(self.parameter, self.db.spark.createDataFrame([("slope", 0, 1.0), ("bias", 0, 0.0)], "id string, k int, w double"))
        self.db.mark_parameter(self.parameter, 0)

    def scalars(self) -> tuple[float, float]:
        """(slope, bias) now: two rows."""
        got = {r.id: r.w for r in self.db.relations[(self.parameter, 0)].filter("id in ('slope', 'bias')").collect()}
        return got["slope"], got["bias"]

    def check(self, engine) -> None:
        """Any normalisation will do: scores are taken before it."""

    def _pairs(self, scores: DataFrame, y: DataFrame) -> DataFrame:
        """(qid, id, s, label) of all pairs with a score or a label."""
        labels = y.filter("w > 0").select("qid", "id", F.lit(1.0).alias("label"))
        return scores.select("qid", "id", F.col("w").alias("s")).join(labels, ["qid", "id"], "full").select("qid", "id", F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("label", F.lit(0.0)).alias("label"))

    def ascent(self, scores: DataFrame, y: DataFrame, queries: DataFrame) -> tuple[DataFrame, dict[tuple[str, int], DataFrame], int]:
        slope, bias = self.scalars()
        up = F.col("label") - 1 / (1 + F.exp(-(slope * F.col("s") + bias)))
        pairs = written(self._pairs(scores, y).withColumn("up", up), "pairs")
        own = pairs.agg(F.sum(F.col("up") * F.col("s")).alias("slope"), F.sum("up").alias("bias"), F.count(F.lit(1)).alias("n"))
        rows = own.select(F.explode(F.array(F.struct(F.lit("slope").alias("id"), F.col("slope").alias("w")), F.struct(F.lit("bias").alias("id"), F.col("bias").alias("w")))).alias("e"))
        return pairs.select("qid", "id", (slope * F.col("up")).alias("w")), {(self.parameter, 0): rows.select("e.id", F.lit(0).alias("k"), "e.w").filter("w is not null")}, own.first().n

    def cost(self, scores: DataFrame, y: DataFrame) -> DataFrame:
        """(loss): the mean negative log-likelihood over the pairs."""
        slope, bias = self.scalars()
        t = slope * F.col("s") + bias
        return self._pairs(scores, y).agg(F.avg(F.greatest(t, F.lit(0.0)) - t * F.col("label") + F.log1p(F.exp(-F.abs(t)))).alias("loss"))

    def predicted(self, engine, mode: str | Mode, x: DataFrame, underflown: bool = False) -> DataFrame:
        return sigmoid(engine.proof_count_batch(mode, x), *self.scalars())


def named_by_symbol(x: DataFrame) -> bool:
    """Whether each query's name is the symbol that it asks.  The session then
    lets rows that lie by query meet by query and symbol where they are."""
    if dict(x.dtypes)["qid"] != "string" or x.filter("NOT (qid <=> id)").head(1):
        return False
    x.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return True


Tracer = Callable[[dict], None]


def silent(record: dict) -> None:
    """Keeps nothing."""


def logging_tracer(record: dict) -> None:
    log.info("%s", record)


def cheap_tracer(record: dict) -> None:
    """Logs what costs nothing to know: the epoch and the time; see ``Learner._trace``."""
    log.info("epoch %s after %.1f s", record["epoch"], record["seconds"])


@dataclass
class RecordingTracer:
    """Keeps every record, logs it, and passes it on to another tracer."""

    records: list[dict] = field(default_factory=list)
    then: Tracer = logging_tracer

    def __call__(self, record: dict) -> None:
        self.records.append(record)
        self.then(record)


@dataclass
class TestTracer(RecordingTracer):
    """Also measures accuracy and cross-entropy on other data after each epoch."""

    __test__ = False
    learner: object = None
    data: Dataset | None = None

    def __call__(self, record: dict) -> None:
        p = written(self.learner.dataset_predict(self.data, underflown=True), "prediction")
        super().__call__(record | {"test_accuracy": self.learner.dataset_accuracy(self.data, p), "test_cross_entropy": self.learner.dataset_cross_entropy(self.data, p)})


@dataclass
class EveryEpochs:
    """Passes every n-th record on."""

    n: int
    then: Tracer

    def __call__(self, record: dict) -> None:
        if record["epoch"] % self.n == 0:
            self.then(record)


@dataclass
class Learner:
    """Shared by the learners below.

    ``engine`` has the rules and the database.  ``densify`` lets training make
    facts that weren't there.
    """

    engine: object
    epochs: int = 10
    rate: float = 0.1
    regulariser: NoRegulariser = field(default_factory=NoRegulariser)
    tracer: Tracer = silent
    densify: bool = False
    clip: float | None = CLIP
    #: whether weights are trained as softplus of free ones, so that they stay positive without being cut at zero
    positive: bool = False
    #: what is maximised
    loss: SoftmaxLikelihood | SigmoidLikelihood = field(default_factory=SoftmaxLikelihood)

    def predict(self, mode: str | Mode, x: DataFrame, underflown: bool = False) -> DataFrame:
        return self.loss.predicted(self.engine, mode, x, underflown)

    def dataset_predict(self, data: Dataset, underflown: bool = False) -> DataFrame:
        """(mode, qid, id, w) for all modes of a dataset.  A cross-entropy needs
        the ``underflown`` answers too: a label among them costs the most."""
        out = None
        for m in data.modes():
            p = self.predict(m, data.queries(m), underflown).select(F.lit(m).alias("mode"), "qid", "id", "w")
            out = p if out is None else out.unionByName(p)
        return out

    def dataset_accuracy(self, data: Dataset, p: DataFrame | None = None) -> float:
        """Mean over all examples of all modes."""
        p = p if p is not None else self.dataset_predict(data)
        rows = [accuracy(data.labels(m), p.filter(F.col("mode") == m).select("qid", "id", "w"), data.queries(m).select("qid").distinct()).first() for m in data.modes()]
        n = sum(r.n for r in rows)
        return sum(r.accuracy * r.n for r in rows if r.n) / n if n else 0.0

    def dataset_cross_entropy(self, data: Dataset, p: DataFrame | None = None) -> float:
        """Sum over modes of each mode's mean."""
        p = p if p is not None else self.dataset_predict(data, underflown=True)
        rows = [cross_entropy(data.labels(m), p.filter(F.col("mode") == m).select("qid", "id", "w"), data.queries(m).select("qid").distinct()).first() for m in data.modes()]
        return sum(r.cross_entropy for r in rows if r.n)

    def gradient(self, mode: str | Mode, x: DataFrame, y: DataFrame, seen: list | None = None) -> Gradients:
        """Sums over the examples of the ascent direction of the likelihood;
        ``seen`` takes the deltas by node."""
        engine = self.engine
        self.loss.check(engine)
        root = engine.program.plan(mode)
        ev = Evaluation(engine.db, x, engine.plugin_calls, named=named_by_symbol(x))
        delta, own, n = self.loss.ascent(ev.scores(root), y, ev.queries)
        found = gradients(ev, root, written(delta, "delta"), engine.db.parameters, self.densify, seen)
        return Gradients(found | own, n)

    def apply(self, grads: Gradients, n: int | None = None, rate: float | None = None) -> None:
        """Decay, move, and write every parameter that has a gradient."""
        db = self.engine.db
        for key, g in grads.by_parameter.items():
            old = self.regulariser.applied(db.relations[key])
            move = updated_free if self.positive and key[1] else updated
            new = move(old, g, rate or self.rate, n or grads.n, self.clip)
            db.relations[key] = written(new, "parameter")

    def _trace(self, data: Dataset, epoch: int, began: float) -> None:
        record = {"epoch": epoch, "seconds": time.time() - began}
        if self.tracer not in (silent, cheap_tracer):
            p = written(self.dataset_predict(data, underflown=True), "prediction")
            record |= {"cross_entropy": self.dataset_cross_entropy(data, p), "accuracy": self.dataset_accuracy(data, p)}
            record["regularised"] = record["cross_entropy"] + sum(self.regulariser.cost(self.engine.db.relations[k]) for k in self.engine.db.parameters if k in self.engine.db.relations)
        self.tracer(record)

    def train(self, data: Dataset) -> None:
        raise NotImplementedError


class FixedRateGD(Learner):
    """Full batches, mode by mode."""

    def train(self, data: Dataset) -> None:
        began = time.time()
        modes = data.modes()
        for epoch in range(self.epochs):
            for m in modes:
                self.apply(self.gradient(m, data.queries(m), data.labels(m)))
            self._trace(data, epoch, began)


class OneModeGD(Learner):
    """Full batches of one mode."""

    def train_mode(self, mode: str | Mode, x: DataFrame, y: DataFrame) -> None:
        for _ in range(self.epochs):
            self.apply(self.gradient(mode, x, y))

    def train(self, data: Dataset) -> None:
        (mode,) = data.modes()
        self.train_mode(mode, data.queries(mode), data.labels(mode))


@dataclass
class FixedRateSGD(Learner):
    """An update for each minibatch."""

    batch: int = 100

    def train(self, data: Dataset) -> None:
        began = time.time()
        for epoch in range(self.epochs):
            for m, part in data.batches(self.batch, seed=epoch):
                self.apply(self.gradient(m, part.queries(m), part.labels(m)))
            self._trace(data, epoch, began)


class WholeDatasetGD(Learner):
    """One update an epoch from the gradients of all modes, each by its share of the examples."""

    def whole(self, data: Dataset) -> Gradients:
        total = Gradients()
        for m in data.modes():
            total = total.added(self.gradient(m, data.queries(m), data.labels(m)))
        return total

    def train(self, data: Dataset) -> None:
        began = time.time()
        for epoch in range(self.epochs):
            self.apply(self.whole(data))
            self._trace(data, epoch, began)


@dataclass
class AdaGrad(WholeDatasetGD):
    """Rates fall with the squares of the gradients so far."""

    floor: float = 0.1

    def train(self, data: Dataset) -> None:
        began, squares = time.time(), {}
        for epoch in range(self.epochs):
            total = self.whole(data)
            for key, g in total.by_parameter.items():
                cols = KEYS[key[1]]
                mean = g.withColumn("w", F.col("w") / max(1, total.n))
                square = mean.withColumn("w", F.col("w") * F.col("w"))
                squares[key] = written(square if key not in squares else squares[key].unionByName(square).groupBy(*cols).agg(F.sum("w").alias("w")), "squares")
                step = mean.join(squares[key].withColumnRenamed("w", "s"), cols).select(*cols, (F.col("w") / F.sqrt(F.col("s") + self.floor)).alias("w"))
                total.by_parameter[key] = step
            self.apply(total, n=1)
            self._trace(data, epoch, began)


@dataclass
class Experiment:
    """Evaluate, train, evaluate; save what was learned and predicted.

    Examples and first parameters are stored before, as each epoch and each
    prediction reads them; a dataset that is both is predicted once."""

    learner: Learner
    train: Dataset
    test: Dataset
    save_model: str | None = None
    save_predictions: str | None = None
    save_examples: str | None = None

    def run(self) -> dict[str, float]:
        out, db = {}, self.learner.engine.db
        for key in sorted(db.parameters & set(db.relations)):
            db.relations[key] = written(db.relations[key], "parameter")
        train = self.train.stored()
        test = train if self.test is self.train else self.test.stored()
        for when in ("before", "after"):
            if when == "after":
                began = time.time()
                self.learner.train(train)
                out["seconds"] = time.time() - began
            for name, data in (("train", train), ("test", test)):
                if name == "train" or data is not train:
                    p = written(self.learner.dataset_predict(data, underflown=True), "prediction")
                    right, cost = self.learner.dataset_accuracy(data, p), self.learner.dataset_cross_entropy(data, p)
                out[f"{name}_accuracy_{when}"], out[f"{name}_cross_entropy_{when}"] = right, cost
        if self.save_model:
            from weft.sources.store import save_database

            save_database(self.learner.engine.db, self.save_model)
        for m in test.modes():
            if self.save_predictions:
                ranked_answers(m, test.queries(m), p.filter((F.col("mode") == m) & (F.col("w") > 0))).write.mode("append").text(self.save_predictions)
            if self.save_examples:
                from weft.sources.examples import example_text

                example_text(test, m).write.mode("append").text(self.save_examples)
        return out


def ranked(p: DataFrame, top: int | None = None) -> DataFrame:
    """(qid, rank, w, id): answers by weight, ties by symbol, both descending."""
    out = p.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("w").desc(), F.col("id").desc())))
    return (out if top is None else out.filter(F.col("rank") <= top)).select("qid", "rank", "w", "id")


def ranked_answers(mode: str | Mode, x: DataFrame, p: DataFrame) -> DataFrame:
    """(value): for each query a line that names it, then its ranked answers."""
    f = Mode.parse(mode).functor
    named = x.select("qid", F.col("id").alias("x"))
    heads = named.select("qid", F.lit(0).alias("rank"), F.format_string(f"# proved %d\t{f}(%s,X1).\t999 msec", F.col("qid") + 1, "x").alias("value"))
    body = ranked(p).join(named, "qid").select("qid", "rank", F.format_string(f"%d\t%.18f\t{f}(%s,%s).", "rank", "w", "x", "id").alias("value"))
    return heads.unionByName(body).sort("qid", "rank").select("value")

