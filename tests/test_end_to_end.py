"""A synthetic linkage job, trained and applied, as a whole."""

from kindred.config import Config
from kindred.plans import check
from kindred.plans.pipeline import Linkage
from kindred.sources import synthetic
from kindred.sources.store import Store


def test_train_and_test(spark, tmp_path):
    for split, n, seed in (("train", 160, 3), ("test", 80, 4)):
        synthetic.write_dataset(spark, str(tmp_path / "data"), split, n, seed)
    cfg = Config().having(folds=2, iterations=5, depth=4, k_name=8, k_name_addr=8, k_addr=5, decision_rule="threshold")
    train, test = Store(spark, str(tmp_path / "train")), Store(spark, str(tmp_path / "test"))
    r = Linkage(spark, str(tmp_path / "data"), train, cfg, "train").run()
    assert r["metrics"]["macro_f05"] > 0.85 and r["blocking"]["blocking_recall"] > 0.95 and r["issues"] == {}
    assert set(r["errors"]) <= {"false_positive", "false_negative", "blocking_miss"} and train.load("errors").count() == sum(r["errors"].values())
    r = Linkage(spark, str(tmp_path / "data"), test, cfg, "test", train).run()
    assert r["metrics"]["macro_f05"] > 0.85 and r["issues"] == {} and r["metrics"]["n_s1"] == 80
    # the written lists pass the command that checks them, and a list of other records does not
    of = lambda split: [str(tmp_path / "data" / f"{split}_source{k}.tsv") for k in (1, 2, 3)]
    result, candidates = (str(tmp_path / "test" / f"{n}_tsv") for n in ("matches", "candidates"))
    assert check.check(spark, result, of("test")[0], of("test")[1:], candidates) == {}
    assert {"missing_rows", "extra_rows"} <= set(check.check(spark, result, of("train")[0]))


def test_generation_does_not_depend_on_tasks(spark):
    a, _ = synthetic.generate(spark, 30)
    b = [row for i in range(30) for row in synthetic.entity(i, 3, "a")[0]]
    assert sorted(tuple(r) for r in a.select("source", "entity_id", "business_name", "business_address", "country").collect()) == sorted(b)


def _against_sql(spark, folder, items, docs):
    import duckdb

    from kindred.queries import ORACLE_SQL, QUERIES
    from tests.oracle import same_rows

    duck = duckdb.connect()
    for name, key, rows in (("benchmark", "item_id", items), ("documents", "doc_id", docs)):
        spark.createDataFrame(rows, f"{key} long, text string").coalesce(1).write.parquet(f"{folder}/{name}.parquet")
        duck.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    got = QUERIES["linkage_end_to_end"](spark, str(folder))
    same_rows(got, duck, ORACLE_SQL["linkage_end_to_end"])
    return {r["s1"]: r["matched"] for r in got.collect()}


def test_items_that_many_documents_retrieve(spark, tmp_path):
    """Either item has more than 150 documents, which resemble the other one nearly as much: none is matched."""
    shared = " ".join(a + b + c for a in ("ka", "lo", "mi", "nu", "pe", "ri") for b in ("sta", "dro", "vel", "gim", "tun") for c in ("bar", "fex", "hob", "wic"))
    items = [(1, f"{shared} delta"), (2, f"{shared} omega"), (3, "something else")]
    docs = [(i, f"{shared} {'delta' if i % 2 else 'omega'}") for i in range(400)] + [(900, "something else")]
    assert _against_sql(spark, tmp_path, items, docs) == {1: "", 2: "", 3: "900"}


def test_repeated_ids_and_vertical_tabs(spark, tmp_path):
    """Rows of one id are one record; a vertical tab is no white space in the SQL."""
    items = [(1, "alpha beta gamma"), (2, "delta\x0bomega kappa")]
    docs = [(10, "alpha beta sigma"), (10, "alpha beta sigma"), (11, "alpha gamma tau"), (12, "delta omega kappa"), (13, "delta\x0bomega rho"), (14, "rho sigma tau")]
    assert _against_sql(spark, tmp_path, items, docs)[1]
