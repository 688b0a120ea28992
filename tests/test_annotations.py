import pytest

from cohortframe.sources import annotations as A


def write(folder, name, text):
    (folder / name).write_text(text)
    return f"file://{folder}/{name}"


def test_numbered_over_parts_and_files(spark, tmp_path):
    (tmp_path / "many").mkdir()
    want = []
    for name, n in (("a", 5), ("b", 900), ("c", 0), ("d", 300)):
        lines = [f"{name}{i}-{'x' * (i % 7)}" for i in range(n)]
        want += lines
        write(tmp_path / "many", f"{name}.txt", "".join(x + "\n" for x in lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
    try:
        got = A.numbered(spark.read.text(f"file://{tmp_path}/many")).collect()
        assert len({r["_position"] for r in got}) == len(got)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["value"] for r in sorted(got, key=lambda r: r["_position"])] == want


def names(spark, tmp_path, *cells):
    return A.read_names(spark, write(tmp_path, f"names{len(cells)}.tsv", "\n".join(f"{c}\tmore" for c in cells) + "\n\n"))


def test_by_key_with_repeats(spark, tmp_path):
    cells = names(spark, tmp_path, "c1", "c2", "c3")
    assert sorted(map(tuple, cells.collect())) == [(0, "c1"), (1, "c2"), (2, "c3")]
    t = A.read_annotations(spark, write(tmp_path, "obs.csv", "name,Cell.Type,my_donor_id\nc3,T,d1\nc9,X,d9\nc1,B,d2\nc3,late,late\nc2,,d1\n"))
    assert t.columns == ["_position", "key", "Cell.Type", "my_donor_id"] and t.count() == 4
    got = {r["obs"]: (r["label"], r["batch"]) for r in A.sidecars(cells, t).collect()}
    assert got == {"c1": ("B", "d2"), "c2": (None, "d1"), "c3": ("T", "d1")}


def test_by_place_and_errors(spark, tmp_path):
    cells = names(spark, tmp_path, "c1", "c2", "c3")
    t = A.read_annotations(spark, write(tmp_path, "labels.tsv", "label\tscore\n1\tu\n2\tv\nx\tw\n"))  # two of three are numbers: no key
    assert {r["key"] for r in t.collect()} == {"cell_0", "cell_1", "cell_2"}
    assert A.single_column(t, "label") == "score" and A.single_column(t.select("_position", "key", "label"), "label") == "label"
    assert sorted(map(tuple, A.aligned(cells, t, "label").collect())) == [("c1", "1"), ("c2", "2"), ("c3", "x")]
    assert {r["obs"]: (r["label"], r["batch"]) for r in A.sidecars(cells, labels=t).collect()} == {"c1": ("u", None), "c2": ("v", None), "c3": ("w", None)}
    with pytest.raises(ValueError):
        A.aligned(cells.where("obs != 'c2'"), t, "label")
    with pytest.raises(ValueError):
        A.aligned(cells, t, "absent")
    with pytest.raises(ValueError):
        A.read_annotations(spark, write(tmp_path, "none.csv", "a,b\n"))
    named = A.read_annotations(spark, write(tmp_path, "half.csv", "k,v\n1,a\nx,b\n"))  # half are numbers
    assert {r["key"] for r in named.collect()} == {"cell_0", "cell_1"}


def test_guesses():
    assert A.guess_annotation_columns(["x", "Cluster", "CELL_TYPE", "Lane"]) == ("CELL_TYPE", "Lane")
    assert A.guess_annotation_columns(["cell-type", "cluster", "Sample ID"]) == ("cluster", "Sample ID")
    assert A.guess_annotation_columns(["broad.cell.type.v2", "the patient"]) == ("broad.cell.type.v2", "the patient")
    assert A.guess_annotation_columns(["a", "b"]) == (None, None)
