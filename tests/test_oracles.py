"""Every registered query of the demand engine against its SQL, over the smallest tables."""

import glob
import os

import duckdb
import pytest

from weekloom.plans import catalogue


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(repr, df.where(df.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_agrees_with_sql(spark, sf_dir, duck, name):
    mine = catalogue.QUERIES[name](spark, sf_dir).toPandas()
    theirs = duck.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


def tables_with(folder, sf_dir, table, **columns):
    """The tables with other columns in one of them, each an expression, and a connection that sees them."""
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p)
        if name == f"{table}.parquet":
            con.sql(f"COPY (SELECT * REPLACE ({', '.join(f'{e} AS {c}' for c, e in columns.items())}) FROM '{p}') TO '{folder}/{name}'")
        else:
            os.symlink(p, f"{folder}/{name}")
        con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{folder}/{name}'")
    return str(folder), con


@pytest.mark.parametrize("categories", [1, 2])
def test_kinds_of_few_categories(spark, sf_dir, tmp_path, categories):
    """Where the first attribute has fewer than five values, the next one's are crossed too."""
    folder, con = tables_with(tmp_path, sf_dir, "part", p_type=f"'TYPE ' || p_partkey % {categories}")
    mine, theirs = catalogue.feature_kinds(spark, folder).toPandas(), con.sql(catalogue.ORACLE_SQL["feature_kinds"]).df()
    assert rows(mine) == rows(theirs)
    crossed = [n for n in mine.feature_name if "_x_" in n]
    assert len(crossed) == 15 and sum(n.startswith("premise_") for n in crossed) == 15 - 4 * categories


def test_treatment_of_large_quantities(spark, sf_dir, tmp_path):
    """No value is too large by itself: the parameters name no absolute cap."""
    folder, con = tables_with(tmp_path, sf_dir, "lineitem", l_quantity="l_quantity * 50")
    mine, theirs = catalogue.treat_by_method(spark, folder).toPandas(), con.sql(catalogue.ORACLE_SQL["treat_by_method"]).df()
    assert rows(mine) == rows(theirs)
    assert catalogue.PARAMS.absolute_cap == float("inf") and (mine.qty > 220).any()


#: Held against their definitions in test_model_queries.
WITHOUT_SQL = {
    "autoencoder_embedding", "category_embedding", "comprehensive_features", "feature_importance", "gbt_train_score", "iterative_forecast",
    "leafwise_tournament", "leafwise_train_score", "loss_tournament", "random_search", "recursive_forecast", "supervised_embedding",
}


def test_all_others_have_sql():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) == WITHOUT_SQL


def test_entry(spark, sf_dir):
    assert catalogue.entry(spark, sf_dir).count() > 0
