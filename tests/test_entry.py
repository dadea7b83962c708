"""The driver's contract, with the names and columns of both sides."""

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and "field_control_break_reason" in df.columns


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_queries_build_over_empty_results(spark):
    for name in ("dq_range", "recon_classify", "meta_flatten", "match_gate", "log_root_whole", "lin_direct", "edge_many"):
        assert contract.queries()[name](spark, SF).limit(1).count() <= 1
