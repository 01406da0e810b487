import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    d = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    return d


R, G1, G2, G3, G4, G5 = "GO:0003674", *(f"GO:000000{i}" for i in range(1, 6))


@pytest.fixture(scope="session")
def graph(spark):
    """terms, edges, reflexive closure, ics of five terms under a root; ic of G4 is unknown."""
    from seqgrove.operators import ontology

    terms = spark.createDataFrame([(R, "molecular_function"), (G1, "parent activity"), (G2, "child A activity"), (G3, "child B activity"), (G4, "unscored activity")], "term_id string, name string")
    edges = spark.createDataFrame([(G1, R), (G2, G1), (G3, G1), (G4, G1)], "child string, parent string")
    up = ontology.closure(edges)
    ics = spark.createDataFrame([(R, 0.0), (G1, 1.0), (G2, 2.0), (G3, 3.0), (G4, None)], "term_id string, ic double")
    return terms, edges, up, ontology.reflexive(terms, up), ics
