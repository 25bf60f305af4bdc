"""Plan checks: no Cartesian products in the metrics, no
unpartitioned window over data rows, pruned scans and pushed filters."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from glossa.plans import REGISTRY
from glossa.sources import io


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_text_metrics_have_no_cartesian_or_nested_loop(spark):
    for name in ("f2_bleu", "f3_chrf", "f4_rouge_n", "f5_rouge_l", "f6_rouge_lsum", "f11_test_report",
                 "f7_greedy_match_pairs"):
        p = plan(REGISTRY[name].fn(spark, SF_SMALL))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_label_scan_prunes_columns(spark):
    p = plan(REGISTRY["e4_weighted_prf_lineitem"].fn(spark, SF_SMALL))
    assert "ReadSchema: struct<l_partkey:bigint,l_returnflag:string>" in p


def test_generation_scores_single_exchange(spark):
    # one scan, per-row statistics in-stage, one hash aggregate per metric family; the only other
    # exchange allowed is spread()'s repartition of a scan that has fewer splits than cores
    p = plan(REGISTRY["f2_bleu"].fn(spark, SF_SMALL))
    exchanges = [line for line in p.splitlines() if "Exchange " in line]
    assert sum("ENSURE_REQUIREMENTS" in x for x in exchanges) == 1
    assert all("ENSURE_REQUIREMENTS" in x or "REPARTITION_BY_NUM" in x for x in exchanges), exchanges


def test_split_filter_is_a_partition_filter(spark, tmp_path):
    from glossa.sources import fixtures as V
    path = str(tmp_path / "nli")
    io.write_splits(V.nli(spark, SF_SMALL).select(*[f.name for f in io.NLI_SCHEMA.fields]), path)
    p = plan(io.read_splits(spark, path, ["test"]))
    assert "PartitionFilters: [isnotnull(split" in p and "test" in p


def test_dense_index_window_only_over_partition_counts(spark):
    df = REGISTRY["c7_assign_batches"].fn(spark, SF_SMALL)
    p = plan(df)
    # the data rows were range-partitioned and checkpointed (lineage cut); the only
    # Window sees one row per partition and its offsets are broadcast back
    assert p.count("Window [") <= 1
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p
    assert df.rdd.getNumPartitions() > 1
