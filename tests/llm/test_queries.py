"""Registered queries against DuckDB, value by value, and their columns."""

import duckdb
import pytest

from tidemark.llm import queries
from tests.llm.conftest import SMALL, read


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels", "embeddings"):
        db.register(table, read(table))
    want = db.execute(queries.ORACLE[name]).fetchdf()
    got = queries.QUERIES[name](spark, SMALL).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns

    def rows(frame):
        return sorted(map(repr, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()))

    assert rows(got) == rows(want)


COLUMNS = {
    "op1_noisy_channel_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_site_style_tree": "page_id bigint, url string, text string, n_chars bigint",
    "op3_decontaminate": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op5_nbsvm_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op8_language": "doc_id bigint, held_out boolean, lang_pred string, score double, accepted boolean",
    "op9_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_cnn bigint",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    made = queries.QUERIES[name](spark, SMALL)
    assert ", ".join(f"{c} {t}" for c, t in made.dtypes) == COLUMNS[name]
