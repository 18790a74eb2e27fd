"""The driver contract where the corpus operators, or what they need, are not there."""

import pytest

import __spark_entry__ as contract
from paragem.plans.queries import QUERIES


@pytest.mark.parametrize("missing, warns", [("paragem.llm", False), ("tokenizers", True)])
def test_core_queries_stay_without_the_corpus_operators(monkeypatch, recwarn, missing, warns):
    def absent(module):
        raise ModuleNotFoundError(f"No module named '{missing}'", name=missing)

    monkeypatch.setattr(contract, "import_module", absent)
    assert set(contract.queries()) == set(QUERIES)
    assert set(contract.oracle_sql()) == {name for name, (_, sql) in QUERIES.items() if sql}
    assert bool([w for w in recwarn if "left out" in str(w.message)]) == warns
