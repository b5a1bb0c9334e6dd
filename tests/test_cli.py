from odweave import cli
from odweave.sources import tables


def write(spark, path, rows, schema):
    tables.write_csv(spark.createDataFrame(rows, schema), str(path))
    return str(path)


def test_anchors_to_calibrated_regions(spark, tmp_path):
    anchors = write(spark, tmp_path / "a", [(1, 1, 4.0, "k"), (1, 2, 2.0, "t"), (2, 2, 3.0, "k"), (2, 1, 1.0, "t")], "user_id int, site_id int, strength double, type string")
    cli.main(["anchors-to-flows", anchors, str(tmp_path / "f")], spark)
    got = {(r.from_id, r.to_id): r.homework for r in tables.read_csv(spark, str(tmp_path / "f")).collect()}
    assert got == {(1, 1): 0.0, (1, 2): 1.0, (2, 1): 1.0, (2, 2): 0.0}
    cli.main(["flow-indices", str(tmp_path / "f"), str(tmp_path / "i"), "--strength", "homework"], spark)
    row = tables.read_csv(spark, str(tmp_path / "i")).first()
    assert row.homework == 2 and row.homework_cp == 1
    cli.main(["build-system", str(tmp_path / "f"), str(tmp_path / "m"), "--strength", "general"], spark)
    assert tables.read_csv(spark, str(tmp_path / "m")).count() == 2
    units = write(spark, tmp_path / "u", [(1, 1, True, 5), (2, 1, False, 3)], "id int, region int, is_core boolean, mass int")
    cli.main(["delimit-regions", units, str(tmp_path / "f"), str(tmp_path / "r"), "--strength", "homework", "--minimums", "2"], spark)
    assert tables.read_csv(spark, str(tmp_path / "r")).select("region").distinct().count() == 1


def test_every_command_parses():
    for name, (_, inputs, _) in cli.COMMANDS.items():
        assert cli.parser().parse_args([name, *inputs, "out"]).command == name
