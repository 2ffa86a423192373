"""Python workers take the texts of a batch in pieces, however large the batch."""

import random
import tracemalloc
from types import SimpleNamespace

import pyarrow as pa
import pytest

from tersely.llm import jaccard_join
from tersely.llm.common import pieces
from tersely.llm.quality_classifier import Classifier, scored


def batch_of(texts: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])


@pytest.mark.parametrize("texts", [[], [None], ["", None, ""], ["x" * 9, "é" * 9, None, "y" * 300, "", "z"], ["ab"] * 50])
def test_pieces_are_all_rows_in_order(texts):
    for most in (1, 10, 1000):
        found = list(pieces(batch_of(texts), "text", most))
        assert [r for p in found for r in p.to_pylist()] == batch_of(texts).to_pylist()
        assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column("text").to_pylist()) <= most for p in found)


@pytest.fixture(scope="module")
def large():
    r = random.Random(1)
    words = [f"w{i}" for i in range(5000)]
    return batch_of([" ".join(r.choices(words, k=900)) for _ in range(5000)])


def peak(step) -> float:
    """MB that a step holds at most, of Python and numpy."""
    tracemalloc.start()
    for _ in step():
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most / 1e6


def test_survey_holds_little_of_a_large_batch(large, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    kept = []
    jaccard_join.survey(SimpleNamespace(mapInArrow=lambda run, schema: kept.append(run)), 5, 2)
    assert large.nbytes > 24e6
    most = peak(lambda: kept[0](iter([large])))
    assert most < 130


def test_scores_hold_little_of_a_large_batch(large):
    model = Classifier(frozenset(), None, None, {1: 0.1}, 0.0)
    most = peak(lambda: scored(model, 0.35)(iter([large])))
    assert most < 15
