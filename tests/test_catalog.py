"""Every catalogue query against its DuckDB twin on the smallest tables."""

import os

import pytest

from locusflow.plans import catalog

D = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("part", "lineitem"):
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(D), reason="needs the test tables")
@pytest.mark.parametrize("name", ["gene_counts_paired", "largest_overlap", "frac_overlap_paired", "fractional_multi_overlap", "status_both_aligned", "gene_metadata", "exon_numbering", "gtf_attribute_parse", "bam_round_trip", "bam_blocks", "bam_gene_counts", "bam_pairs", "bam_region", "sam_round_trip", "sam_saf_gene_counts", "count_table_file", "exon_table_file", "feature_table_gzip", "gene_table_lines", "annotation_sniffed", "details_file", "summary_file"])
def test_matches_sql(spark, con, name):
    mine = catalog.queries()[name](spark, D).toPandas()
    sql = con.execute(catalog.oracle_sql()[name]).df()
    cols = sorted(mine.columns)
    assert cols == sorted(sql.columns)
    key = lambda df: sorted(map(tuple, df[cols].astype(str).values.tolist()))
    assert key(mine) == key(sql)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
