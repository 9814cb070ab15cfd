import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from biomeframe.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[4]",
        "biomeframe-tests",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def counts(spark):
    """Five samples, four taxa; sample e is empty, taxon flat is constant in shares."""
    rows = [
        ("a", "G_x", 2.0), ("a", "y z", 2.0), ("a", "flat", 4.0),
        ("b", "G_x", 1.0), ("b", "y z", 3.0), ("b", "flat", 4.0),
        ("c", "y z", 5.0), ("c", "flat", 5.0),
        ("d", "G_x", 1.0), ("d", "flat", 1.0),
        ("e", "G_x", 0.0),
    ]
    return spark.createDataFrame(rows, "sampleID string, taxon string, count double")


@pytest.fixture(scope="session")
def samples(spark):
    rows = [("a", "I"), ("b", "I"), ("c", "II"), ("d", "II"), ("e", "II")]
    return spark.createDataFrame(rows, "sampleID string, HC_subCST string")


@pytest.fixture(scope="session")
def community(spark):
    """150 samples of three classes; taxa t0..t2 mark a class each, n0..n2 are noise."""
    import random

    rnd = random.Random(5)
    counts, labels = [], []
    for i in range(150):
        k = i % 3
        labels.append((i, f"C{k}"))
        for t in range(3):
            counts.append((i, f"t{t}", float(rnd.randint(60, 90) if t == k else rnd.randint(1, 25))))
            counts.append((i, f"n{t}", float(rnd.randint(1, 30))))
    return (
        spark.createDataFrame(counts, "sampleID long, taxon string, count double"),
        spark.createDataFrame(labels, "sampleID long, HC_subCST string"),
    )
