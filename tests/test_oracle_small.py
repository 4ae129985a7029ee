"""A few registered queries against their DuckDB twins on the smallest driver scale."""
import math

import duckdb
import pytest

from mentionkit.plans.catalog import QUERIES, SQL
from mentionkit.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
NAMES = ["fixture_mentions", "a1_mention_profile", "j8_targets", "w2_tag_ngrams", "f1_dependency_bag",
         "f2_relational_features", "w6_scope_text", "t1_top_features", "r5_cascade_scores",
         "a16_span_embeddings", "j10_nearest_pieces", "f4_phrase_hits_two_words", "k8_error_listing_cascade"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, con, name):
    sc, sr = _rows(QUERIES[name](spark, SF).toPandas())
    dc, dr = _rows(con.sql(SQL[name]).df())
    assert sc == dc and len(sr) == len(dr) and sr == dr
