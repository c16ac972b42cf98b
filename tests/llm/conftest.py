import pytest
from llm_tables import write_tables

from shelfmark.llm.common import ship


@pytest.fixture(scope="session")
def shipped(spark):
    ship(spark)
    return spark


@pytest.fixture()
def edge(tmp_path):
    return write_tables(
        tmp_path,
        pages=[(1, None), (2, "no host"), (3, "HTTP://A.Example.ORG/es/x?q#f"), (3, "HTTP://A.Example.ORG/es/x?q#f"), (4, "ftp://org"), (5, "x://"), (6, "a://b://c/d"),
               (7, "https://example.org/en/12"), (8, "https://xexample.org/en/12"), (9, "https://m.fr.com/de/?a"), (10, "https://com/fr/"), (11, "https://com#/fr/"), (None, "https://n.net/" + "y" * 5000)],
        labels=[(1, 1, 0), (4, 0, 0), (5, 1, 1), (7, None, 0), (10, 0, 0), (10, 0, 0)],
        benchmark=[(1, "seven wizards judge the sphinx of black quartz and vow"), (2, "Two three!"), (3, None), (4, "--"), (None, "quick onyx"), (1, "lazy dwarf while seven wizards judge the sphinx of black quartz")],
    )


@pytest.fixture()
def empty(tmp_path):
    return write_tables(tmp_path, documents=[])
