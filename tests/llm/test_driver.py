"""What passes the driver: no join collects a side that grows with the input."""

import re

import pytest

from skyfix.llm import near_copies, simhash


def broadcast(spark, run):
    """Left keys of the broadcast joins of all that ``run`` executes."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = {store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())}
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    done = store.executionsList()
    plans = [e.physicalPlanDescription() for e in map(done.apply, range(done.size())) if e.executionId() not in before]
    assert any("Join" in p for p in plans)
    return [k for p in plans for k in re.findall(r"\) (?:BroadcastHashJoin|BroadcastNestedLoopJoin).*\n(?:.*\n)??Left keys \[\d+\]: \[(.*)\]", p)]


@pytest.fixture
def docs(spark):
    """Near copies of a few texts, exact copies, blank ones."""
    texts = [" ".join(f"w{(k + i) % (97 + k)}" for i in range(150)) + f" tail{j % 3}" for k in range(6) for j in range(4)]
    return spark.createDataFrame(list(enumerate([*texts, "", None])), "doc_id long, text string")


def test_fuzzy_keys_are_never_broadcast(spark, docs):
    """A fingerprint has 53 keys, of which Spark's guess of the table's size knows nothing: 0.6 GB of documents
    made a table of 200 MB that it took for one of less than 10."""
    assert not broadcast(spark, lambda: simhash.near_duplicates(docs).collect())
    assert not broadcast(spark, lambda: simhash.near_pairs(spark.createDataFrame([(1, 1), (3, 3)], "bits long, home long")).collect())


def test_only_bitmaps_of_near_copies_are_broadcast(spark, docs):
    keys = broadcast(spark, lambda: near_copies.deduplicate(docs).collect())
    assert keys and all(re.match(r"_slot#\d+L?$", k) for k in keys)
