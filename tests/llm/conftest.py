import pytest

from dimloom.llm.common import prepare


@pytest.fixture(autouse=True)
def workers(spark):
    prepare(spark)


@pytest.fixture(scope="session")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
