import pytest

pytest.importorskip("fieldledger.llm.registry")
