"""Network training in stages: the best held-out stage, and grids whose cells drop out by halves.

Spark's network estimator fits to its end in one go. Here it is called for a few iterations at a time,
each stage starting from the weights of the last one, and every stage is scored on held-out rows.
What stays on the driver is one model per run (its best stage) and one line per stage.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.ml.classification import (
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biomeframe.operators.learn import (
    Classifier,
    fit_table,
    hidden_size,
    network_rows,
    training_scaling,
    without_nan,
)
from biomeframe.operators.vectors import taxa_list
from biomeframe.session import concurrently, materialise

EPOCHS, INTERVAL = 500, 50
# The rate's factor on a plateau and the rate at which training ends.
FACTOR, LEAST_RATE = 0.2, 1e-5


def held_out_figures(model: MultilayerPerceptronClassificationModel, held: DataFrame) -> tuple[float, float]:
    """Mean cross-entropy and accuracy in percent of prepared rows; both NaN without rows."""
    chance = F.get(vector_to_array("probability"), F.col("label_idx").cast("int"))
    hit = (F.col("prediction") == F.col("label_idx")).cast("double")
    got = model.transform(held).agg(
        F.avg(-F.ln(F.greatest(chance, F.lit(1e-300)))).alias("loss"), (F.avg(hit) * 100).alias("accuracy")
    )
    row = got.first()
    return tuple(float("nan") if v is None else v for v in (row["loss"], row["accuracy"]))


class Run:
    """One network under training: its weights, its line per stage, and its best stage so far.

    With a ``rate`` the steps are those of full-batch gradient descent at that rate, else of L-BFGS. After
    ``patience`` stages without a smaller training loss the rate falls to a fifth; training ends when it
    reaches ``LEAST_RATE``, or when a stage ends before its iterations (L-BFGS has converged).
    """

    def __init__(
        self,
        rows: DataFrame,
        held: DataFrame,
        layers: list[int],
        seed: int = 0,
        rate: float | None = None,
        patience: int = 0,
        **params: Any,
    ):
        self.rows, self.held, self.layers, self.seed = rows, held, layers, seed
        self.rate, self.patience, self.params = rate, patience, params
        self.model: MultilayerPerceptronClassificationModel | None = None
        self.best: MultilayerPerceptronClassificationModel | None = None
        self.history: list[tuple[int, float, float, float]] = []
        self.done, self._stale = False, 0

    @property
    def epoch(self) -> int:
        return self.history[-1][0] if self.history else 0

    @property
    def chosen(self) -> int:
        """Position of the first stage with the highest held-out accuracy."""
        scores = [a for _, _, _, a in self.history]
        return max(range(len(scores)), key=lambda i: (scores[i] == scores[i], scores[i], -i))

    def advance(self, iterations: int) -> None:
        """One more stage of at most ``iterations`` steps."""
        if self.done or iterations < 1:
            return
        options = dict(self.params, layers=self.layers, seed=self.seed, maxIter=iterations)
        options |= {"featuresCol": "vector", "labelCol": "label_idx"}
        if self.rate is not None:
            options |= {"solver": "gd", "stepSize": self.rate}
        if self.model is not None:
            options["initialWeights"] = self.model.weights
        self.model = MultilayerPerceptronClassifier(**options).fit(self.rows)
        summary = self.model.summary()
        losses = list(summary.objectiveHistory)
        steps = len(losses) - 1
        loss = float(losses[-1])
        before = min((line[1] for line in self.history), default=float("inf"))
        self.history.append((self.epoch + max(steps, 1), loss, *held_out_figures(self.model, self.held)))
        if self.chosen == len(self.history) - 1:
            self.best = self.model
        if self.rate is None:
            self.done = steps < iterations
        elif self.patience:
            self._stale = 0 if loss < before else self._stale + 1
            if self._stale >= self.patience:
                self.rate, self._stale = self.rate * FACTOR, 0
                self.done = self.rate <= LEAST_RATE


def fit_best_stage(
    rows: DataFrame,
    held: DataFrame,
    taxa: list[str],
    labels: list[str],
    epochs: int = EPOCHS,
    interval: int = INTERVAL,
    norm: str = "none",
    regex_remove: list[str] = (),
    class_weighted: bool = False,
    seed: int = 0,
    hidden: int | None = None,
    scaling: dict[str, Any] | None = None,
    **options: Any,
) -> Classifier:
    """A network as it was at its best held-out accuracy, looked at every ``interval`` epochs.

    Of equal accuracies the first stage counts. ``history`` of the result has a line for every stage.
    Pass stored rows, they are read by each stage.
    """
    if epochs < 1 or interval < 1:
        raise ValueError("epochs and interval must be positive")
    hidden = hidden or hidden_size(len(taxa), len(labels))
    data = materialise(network_rows(rows, seed)) if class_weighted else rows
    run = Run(data, held, [len(taxa), hidden, len(labels)], seed, **options)
    while not run.done and run.epoch < epochs:
        run.advance(min(interval, epochs - run.epoch))
    params = {**options, "epochs": epochs, "interval": interval, "seed": seed, "hidden": hidden}
    params["class_weighted"] = class_weighted
    return Classifier(
        run.best, "mlp", taxa, labels, norm, list(regex_remove), params, scaling or {}, history_lines(run)
    )


def history_lines(run: Run) -> list[tuple]:
    """epoch, train loss, test loss, accuracy and whether the stage was chosen."""
    return [(*line, i == run.chosen) for i, line in enumerate(run.history)]


def prepared(
    counts: DataFrame,
    train: DataFrame,
    test_counts: DataFrame,
    test: DataFrame,
    norm: str = "none",
    taxa: list[str] | None = None,
    labels: list[str] | None = None,
) -> tuple[DataFrame, DataFrame, list[str], list[str], dict[str, Any]]:
    """Stored training and held-out rows with their taxa, labels and training statistics."""
    taxa = taxa_list(counts) if taxa is None else taxa
    scaling = training_scaling(counts, train, taxa, norm)
    rows, taxa, labels = fit_table(counts, train, taxa, labels, norm, scaling=scaling)
    held = fit_table(test_counts, test, taxa, labels, norm, scaling=scaling)[0]
    return without_nan(materialise(rows)), without_nan(materialise(held)), taxa, labels, scaling


def halving_search(
    train_counts: DataFrame,
    train: DataFrame,
    test_counts: DataFrame,
    test: DataFrame,
    grid: list[dict[str, Any]],
    norms: list[str] = ("none",),
    seed: int = 0,
    epochs: int = EPOCHS,
    rounds: int = 3,
    keep: float = 0.5,
) -> DataFrame:
    """Successive halving over scalings and parameter sets of networks (``hidden``, ``rate``, ``patience`` and others).

    All cells start; after each round those of the best ``keep`` share by held-out accuracy (of equal ones the first)
    go on from their weights. A round gives each remaining cell as many epochs as all before it together, the
    last one ends at ``epochs``. Returns position, norm, params, epochs trained, best held-out accuracy and
    the round a cell reached; the best cell is the first maximum of the last round.
    """
    if rounds < 1 or not 0 < keep <= 1:
        raise ValueError("rounds must be positive and keep a share above 0")
    cells = []
    for norm in norms:
        rows, held, taxa, labels, _ = prepared(train_counts, train, test_counts, test, norm)
        for cell in grid:
            options = dict(cell)
            hidden = options.pop("hidden", None) or hidden_size(len(taxa), len(labels))
            run = Run(rows, held, [len(taxa), hidden, len(labels)], options.pop("seed", seed), **options)
            cells.append({"at": len(cells), "norm": norm, "cell": cell, "run": run, "round": 0})
    alive = cells
    for number in range(1, rounds + 1):
        goal = max(1, epochs // 2 ** (rounds - number))

        def work(cell: dict) -> None:
            cell["run"].advance(goal - cell["run"].epoch)  # noqa: B023
            cell["round"] = number  # noqa: B023

        concurrently(work, alive)
        ranked = sorted(alive, key=lambda c: (-best_accuracy(c["run"]), c["at"]))
        alive = ranked[: max(1, -int(-len(ranked) * keep // 1))]
    lines = [
        (c["at"], c["norm"], json.dumps(c["cell"], sort_keys=True), c["run"].epoch, best_accuracy(c["run"]), c["round"])
        for c in cells
    ]
    schema = "position int, norm string, params string, epochs int, accuracy double, round int"
    return train.sparkSession.createDataFrame(lines, schema)


def best_accuracy(run: Run) -> float:
    """Held-out accuracy of the chosen stage; below every accuracy where it is undefined."""
    value = run.history[run.chosen][3]
    return value if value == value else -1.0
