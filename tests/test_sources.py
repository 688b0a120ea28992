from cohortframe.sources import tables


def test_observations_get_types_and_stand_ins(spark, tmp_path):
    (tmp_path / "o.csv").write_text("obs_id,sample_id,spatial_x,n_counts,extra\na,,1.5,NaN,x\nb,s1,bad,3,y\n")
    rows = {r.obs_id: r for r in tables.read_observations(spark, f"file://{tmp_path}/o.csv", "csv").collect()}
    assert (rows["a"].sample_id, rows["a"].spatial_x, rows["a"].n_counts, rows["a"].cell_type, rows["a"].extra) == ("sample_0", 1.5, 0.0, "unassigned", "x")
    assert rows["b"].spatial_x is None and rows["b"].n_counts == 3.0


def test_matrix_market(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n% x\n3 2 4\n1 1 5\n2 1 0\n3 2 7\n1 2 2\n")
    (tmp_path / "g.tsv").write_text("g1\tA\ng2\tB\ng3\tC\n")
    (tmp_path / "b.tsv").write_text("c1\nc2\n")
    got = tables.read_matrix_market(spark, *(f"file://{tmp_path}/{n}" for n in ("m.mtx", "g.tsv", "b.tsv")))
    assert sorted(map(tuple, got.collect())) == [("c1", "g1", 5.0), ("c2", "g1", 2.0), ("c2", "g3", 7.0)]


def test_write_and_read(spark, tmp_path):
    df = spark.createDataFrame([("a", "s"), ("b", "t")], "obs_id string, sample_id string")
    for kind in ("parquet", "json", "orc", "csv"):
        tables.write_table(df, f"file://{tmp_path}/{kind}", kind)
        assert tables.read_observations(spark, f"file://{tmp_path}/{kind}", kind).count() == 2
