"""Readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from voxledger.operators.ledger import counted
from voxledger.sources import readers as S


def test_ledger_headers(spark):
    raw = spark.createDataFrame([("A", "n", "R", "c")], "` ASIN` string, `Product-Name` string, reason string, `customer-comments` string")
    row = S.returns_ledger(raw).first()
    assert row["asin"] == "A" and row["quantity"] is None and row["return_date"] is None
    with pytest.raises(ValueError, match="missing columns"):
        S.returns_ledger(raw.drop("reason"))


def test_exports_and_products(spark, tmp_path):
    (tmp_path / "B01_positive.txt").write_text("line one\nline two")
    exports = S.read_exports(spark, str(tmp_path))
    assert [tuple(r) for r in exports.collect()] == [("B01_positive", "line one\nline two")]
    none = spark.createDataFrame([], "file_stem string, name string, link string")
    assert S.mapped_products(exports, none, F.lit("B01")).first()["name"] == "B01"
    with pytest.raises(ValueError):
        S.mapped_products(exports, spark.createDataFrame([("x", "n", "l")], none.schema), F.lit("B01"))


def test_profile_is_never_empty(spark):
    with pytest.raises(ValueError):
        S.profile(spark, [], [{"title": "t", "layout": "two_level", "categories": []}])
    categories, sheets = S.profile(spark, [{"id": "use"}], [{"title": "t", "layout": "wish", "categories": ["use"]}])
    assert categories.first()["category"] == "use" and sheets.first()["title"] == "t"


def test_overrides_and_labels(spark, tmp_path):
    rules = {"rename": {"Old": "New", "New": "Newer"}, "merge_canonicals": [["keep", "one", "two"], ["alone"]], "move_canonical": {"t": "G"}, "dual_place": [{"quote": "both", "rows": ["a", "b"]}]}
    (tmp_path / "o.json").write_text(json.dumps(rules))
    got = [tuple(r) for r in S.read_overrides(spark, str(tmp_path / "o.json")).orderBy("kind", "rule_seq", "place").collect()]
    assert got == [("dual_place", None, "a", "both", 0, 0), ("dual_place", None, "b", "both", 0, 1), ("merge_rows", "one", "keep", None, 0, 1), ("merge_rows", "two", "keep", None, 0, 2), ("move_row", "t", "G", None, 0, 0), ("rename_group", "Old", "New", None, 0, 0), ("rename_group", "New", "Newer", None, 1, 0)]
    for line, text in (("one", json.dumps({"k": {"category": "use", "label": "keep"}})), ("two", "not json")):
        (tmp_path / "lines" / line).mkdir(parents=True)
        (tmp_path / "lines" / line / "gate_labels.json").write_text(text)
    assert [(r["product_line"], r["key"], r["label"]) for r in S.read_gate_labels(spark, str(tmp_path / "lines")).collect()] == [("one", "k", "keep")]


def test_snapshot_round_trip(spark, tmp_path):
    cells = spark.createDataFrame([("c1", "A", 2, ["1", "2"], ["q"]), ("c1", "B", 3, [], [])], "canonical_id string, product string, votes int, review_ids array<string>, quotes array<string>")
    votes = S.ledger_from_cells(cells)
    assert {(r["product"], r["votes"]) for r in counted(votes).collect()} == {("A", 2), ("B", 3)}
    snapshots = S.Snapshots(spark, str(tmp_path / "s"))
    assert snapshots.save({"votes": votes}) == 1
    back = snapshots.read("votes")
    assert S.vote_differences(votes, back).isEmpty()
    assert S.vote_differences(votes, back.where("product = 'A'")).count() == 1


def test_usage_log(spark, tmp_path):
    runs = spark.createDataFrame([(1, "2024-01-02 00:00:00"), (2, "2024-01-01 00:00:00")], "run_id int, ts string").withColumn("ts", F.to_timestamp("ts"))
    S.append_usage(runs, str(tmp_path / "u"))
    S.append_usage(runs.withColumn("run_id", F.col("run_id") + 2), str(tmp_path / "u"))
    log = S.read_usage(spark, str(tmp_path / "u"))
    assert log.count() == 4 and log.first()["run_id"] in (2, 4)
    S.write_report(log, str(tmp_path / "r"), "csv")
    assert spark.read.csv(str(tmp_path / "r"), header=True).count() == 4


def test_votes_are_inserted_once_and_a_lost_write_changes_nothing(spark, tmp_path, monkeypatch):
    kind = "canonical_id string, product string, review_id string, quote string"
    votes = lambda *rows: spark.createDataFrame(list(rows), kind)
    state = lambda: sorted(tuple(r) for r in snapshots.read("votes").collect())
    snapshots = S.Snapshots(spark, str(tmp_path / "s"))
    with pytest.raises(ValueError):
        snapshots.read("votes")
    groups = spark.createDataFrame([("g", "use")], "group_id string, category string")
    a, b, c = ("c1", "A", "1", "q"), ("c1", "A", "1", "r"), ("c2", "A", None, "q")
    snapshots.save({"groups": groups, "votes": votes(a, a)})
    assert snapshots.insert_votes(votes(a, b, b, c)) == 2 and state() == sorted([a, b, c], key=str)
    assert snapshots.insert_votes(votes(a, c)) == 0 and len(snapshots.commits()) == 2
    commit = snapshots.commit

    def lost(*_):
        raise RuntimeError("the driver is lost")

    monkeypatch.setattr(snapshots, "commit", lost)
    with pytest.raises(RuntimeError):
        snapshots.insert_votes(votes(("c9", "A", "9", "q")))
    with pytest.raises(RuntimeError):
        snapshots.save({"groups": groups, "votes": votes()})
    assert state() == sorted([a, b, c], key=str) and snapshots.read("groups").count() == 1
    monkeypatch.setattr(snapshots, "commit", commit)
    assert snapshots.insert_votes(votes(("c8", "A", "8", "q"))) == 1 and len(state()) == 4
    snapshots.save({"groups": groups, "votes": votes(a)})
    assert state() == [a] and len(snapshots.commits()) == 1


def test_legacy_taxonomy(spark, tmp_path):
    old = {
        "next_id": 9,
        "groups": [{"id": "g1", "category": "use", "name": "Works", "usage_category": ""}],
        "canonicals": [
            {"id": "c1", "text": "works", "group_id": "g1", "votes": {"A": 2, "B": 3}, "quotes": {"A": ["q", "q", "r", "s"]}, "review_ids": {"A": ["1", "2"]}, "quote_sources": {"A": {"q": ["1", "2", "1"]}}},
            {"id": "c2", "text": "fits", "group_id": "g1", "votes": {"A": 5}, "review_ids": {"A": ["1"], "C": ["7"]}},
        ],
    }
    for line in ("one", "two"):
        (tmp_path / line).mkdir()
        (tmp_path / line / "taxonomy.json").write_text(json.dumps(old))
    read = S.read_legacy_taxonomy(spark, str(tmp_path / "*" / "taxonomy.json"))
    assert read["groups"].count() == 2 and [r["canonical_id"] for r in read["canonicals"].where("product_line = 'one'").orderBy("ord").collect()] == ["c1", "c2"]
    votes, lost = S.migrated(read["cells"])
    one = {tuple(r) for r in votes.where("product_line = 'one'").select(*S.VOTE_KEY).collect()}
    assert one == {("c1", "A", "1", "q"), ("c1", "A", "2", "r"), ("c1", "A", "", "s"), ("c1", "B", "__legacy_1", ""), ("c1", "B", "__legacy_2", ""), ("c1", "B", "__legacy_3", ""), ("c2", "A", "1", ""), ("c2", "C", "7", "")}
    assert sorted(tuple(r) for r in lost.select("product_line", "canonical_id", "product", "before", "after").collect()) == [(line, "c2", p, b, 1) for line in ("one", "two") for p, b in (("A", 5), ("C", 0))]
    assert {tuple(r)[1:] for r in read["quote_sources"].collect()} == {("c1", "A", "q", "1"), ("c1", "A", "q", "2")}
