"""The queries' columns, and SQL where there is some."""

import pytest

import __spark_entry__ as contract
from daybook.llm import oracles, queries
from oracle import TESTDATA, database

# The columns that each result must have.
COLUMNS = {
    "op1_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op2_topk": "query_id rank vec_id score",
    "op3_language": "doc_id held_out lang_pred score",
    "op4_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op5_simhash": "doc_id fingerprint component_id",
    "op6_mixing": "doc_id size source_size target taken",
    "op7_likelihood": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op8_substrings": "doc_id n_words n_removed kept_sha256",
    "op9_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op10_export": "doc_id start n_tokens ids_crc32",
    "op11_collocations": "lang rank phrase a l r n score",
    "op12_suffixes": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op13_merkle": "doc_id leaf subroot root proof_sha256 folded_root verified",
}


def test_registered():
    assert set(COLUMNS) | {"pipeline"} == {*queries.queries(), "pipeline"} <= set(contract.queries())
    assert set(oracles.oracle_sql()) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", oracles.oracle_sql())
def test_against_sql(spark, name):
    with database(f"{TESTDATA}/sf0.001") as con:
        df = contract.queries()[name](spark, f"{TESTDATA}/sf0.001")
        result = con.execute(oracles.oracle_sql()[name])
        names = [c[0] for c in result.description]
        assert sorted(df.columns) == sorted(names)
        assert sorted(map(repr, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(repr, result.fetchall()))


@pytest.mark.parametrize("name", ["op1_sharding", "op6_mixing", "op9_packing"])
def test_columns(spark, name):
    found = contract.queries()[name](spark, f"{TESTDATA}/sf0.001")
    assert set(COLUMNS[name].split()) <= set(found.columns)
    types = dict(found.dtypes)
    assert all(types.get(c, "bigint") == "bigint" for c in ("size", "slot", "text_crc32", "taken", "source_size", "start", "length", "offset"))
