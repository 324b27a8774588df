"""The registered queries of the package against their SQL, and their columns."""

import os

import pytest

from barloom.llm.oracle import ORACLE
from barloom.llm.queries import QUERIES
from checks.compare import database, difference

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


def test_every_operator_has_one_query():
    assert [name.split("_")[0] for name in QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    want = database(FOLDER).execute(ORACLE[name]).df()
    assert len(got) and difference(got, want) is None


def test_types(spark):
    kinds = {
        "op8_bounded_ring": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
        "op4_segment_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
        "op7_secret_ledger": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    }
    for name, want in kinds.items():
        assert ", ".join(f"{n} {t}" for n, t in QUERIES[name](spark, FOLDER).dtypes) == want
