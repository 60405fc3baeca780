import corpus_pipeline
import duckdb
import pytest

from orbweave.llm import registry

TEXT = "the quick brown fox jumps over the lazy dog and then it runs far away from all of the people in this town because"


def write_stages(spark, docs, folder):
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, None).write.parquet(f"{folder}/{name}")
        docs = out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


def test_each_stage_takes_effect(spark, frame, tmp_path):
    story = " ".join(f"story{i} and the" for i in range(40))
    rows = [
        (1, story + "\n" + TEXT + " number one"),
        (2, story + "\n" + TEXT + " number two"),
        (3, "### *** $$$ " * 20),
        (4, " ".join(f"other{i} of the" for i in range(30)) + "\n" + story),
        (5, " ".join(f"third{i} in the" for i in range(30)) + " write to some.one@mail.example.org"),
        (6, " ".join(f"clean{i} is the" for i in range(30))),
        (7, None),
        (None, " ".join(f"nameless{i} is the" for i in range(30))),
    ]
    d = frame(rows)
    out = write_stages(spark, d, str(tmp_path))
    ids = {n: sorted((r["doc_id"] for r in x.collect()), key=lambda i: i or 0) for n, x in out.items() if n != "packed"}
    assert ids["quality_rules"] == [None, 1, 2, 4, 5, 6]
    assert ids["near_duplicates"] == [None, 1, 4, 5, 6]
    assert ids["repeated_lines"] == ids["personal_data"] == ids["near_duplicates"]
    texts = {r["doc_id"]: r for r in out["personal_data"].collect()}
    assert story not in texts[4]["text"] and texts[4]["n_chars"] == len(texts[4]["text"])
    assert "@" not in texts[5]["text"] and "<EMAIL>" in texts[5]["text"]
    assert texts[6]["text"] == rows[5][1] and texts[None]["text"] == rows[7][1]
    assert all(out[n].columns == d.columns for n in ids)
    assert {r["doc_id"] for r in out["packed"].collect()} == {None, 1, 4, 5, 6}


def test_empty_table(spark, frame, tmp_path):
    out = write_stages(spark, frame([(1, "a")]).limit(0), str(tmp_path))
    assert all(x.count() == 0 for x in out.values())


def test_repeated_rows_leave_one(spark, frame):
    text = " ".join(f"clean{i} is the" for i in range(30))
    assert corpus_pipeline.near_duplicates(spark, frame([(1, text), (1, text), (2, text)]), None).count() == 1


def test_run(spark, sf):
    out = registry.queries()["pipeline"](spark, sf)
    assert out.columns[0] == "doc_id" and out.count() > 100


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql_gives_the_same_rows(spark, sf, name):
    got = registry.queries()[name](spark, sf).toPandas()
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = c.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    assert sorted(map(repr, got[order].itertuples(index=False, name=None))) == sorted(map(repr, want[order].itertuples(index=False, name=None)))


def test_every_operator_has_a_query():
    names = registry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
