"""Filter builder (F6/F7) and per-subject triples with labels."""

import pytest

from terrane.operators import filters as FL
from terrane.operators import relational as R


def test_build_filter_semantics(spark):
    df = spark.createDataFrame([(1, "a_b", 10.0), (2, "axb", 5.0), (3, None, None), (4, "A_B", 7.5)],
                               "id int, name string, v double")
    ids = lambda c: sorted(r.id for r in df.where(c).collect())
    assert ids(FL.build_filter("v", ">=", " 7.5 ")) == [1, 4]          # trimmed, numeric
    assert ids(FL.build_filter("name", "LIKE", "a_b")) == [1, 2]        # '_' stays a wildcard
    assert ids(FL.build_filter("name", "ILIKE", "a_b")) == [1, 2, 4]
    assert ids(FL.build_filter("name", "IS NULL", "ignored")) == [3]
    assert ids(FL.build_filter("name", "=", "axb")) == [2]
    with pytest.raises(ValueError):
        FL.build_filter("name", "DROP", "x")


def test_triples_with_labels_fallbacks(spark):
    triples = spark.createDataFrame([("Q1", "P31", "Q5"), ("Q1", "P17", "Q30"), ("Q1", "P1082", "42"),
                                     ("Q2", "P31", "Q5")], "subject string, predicate string, value string")
    props = spark.createDataFrame([("P31", "prop/P31"), ("P17", "prop/P17"), ("P1082", "prop/P1082")],
                                  "direct_claim string, prop string")
    labels = spark.createDataFrame([("prop/P31", "en", "instance of"), ("Q5", "en", "human"),
                                    ("Q30", "de", "Vereinigte Staaten")], "id string, lang string, label string")
    rows = {r.prop: (r.propLabel, r.valueLabel) for r in
            R.triples_with_labels(triples, props, labels, "Q1").collect()}
    assert rows == {"prop/P31": ("instance of", "human"), "prop/P17": ("prop/P17", "Q30"),
                    "prop/P1082": ("prop/P1082", "42")}
    kept = {r.prop for r in FL.facts_filter(R.triples_with_labels(triples, props, labels, "Q1")).collect()}
    assert kept == {"prop/P31", "prop/P1082"}  # the id-valued label 'Q30' is dropped
