"""The store of segment results."""

from folioframe.session import hadoop_folder
from folioframe.sources.results import ResultStore


def rows(store, version=None):
    return {(r.doc_hash, r.seg_idx): r.result for r in store.read(version).collect()}


def test_versions_tombstones_and_compaction(spark, tmp_path):
    table = lambda *r: spark.createDataFrame(list(r), "doc_hash string, seg_idx long, result string")
    store = ResultStore(spark, f"file://{tmp_path}/store")
    assert store.versions() == [] and rows(store) == {} and store.clear() is None and store.compact() is None
    assert store.set(table(("a", 0, "x"), ("a", 1, None), ("b", 0, "y"), ("a", 0, "z"), (None, 0, "?"), ("a", None, "?"))) == 1
    assert rows(store) == {("a", 0): "z", ("a", 1): None, ("b", 0): "y"}
    assert store.set(table(("a", 0, "z"), ("b", 0, "y"), ("a", 1, None))) is None and store.set(table().limit(0)) is None
    assert store.invalidate(table(("a", 9, None), ("c", 9, None))) == 2 and store.invalidate(table(("a", 0, ""))) is None
    assert rows(store) == {("b", 0): "y"} and rows(store, 1)["a", 0] == "z"
    assert store.set(table(("a", 0, "new"))) == 3
    assert {r.doc_hash: r.n for r in store.totals().collect()} == {"a": 1, "b": 1}
    # A writer that died: its folder holds no commit mark, counts for nothing and gives its number to nobody.
    table(("b", 0, "torn")).selectExpr("4L as version", "'set' as kind", "*").write.parquet(f"{tmp_path}/store/version-{4:012d}")
    place, files = hadoop_folder(spark, f"file://{tmp_path}/store/version-{4:012d}/_SUCCESS")
    files.delete(place, False)
    assert rows(store)["b", 0] == "y" and store.set(table(("b", 0, "y2"))) == 5
    before = rows(store)
    assert store.compact(keep=1) == 6 and rows(store) == before and store.versions() == [5, 6]
    assert store.clear() == 7 and rows(store) == {} and store.compact() == 8 and rows(store) == {}
    assert store.set(table(("a", 0, "again"))) == 9 and rows(store) == {("a", 0): "again"}
