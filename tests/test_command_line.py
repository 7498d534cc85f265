from setweave import __main__ as M

LIST = "<ul><li><b>{}</b></li><li><b>{}</b></li><li><b>{}</b></li><li><b>{}</b></li></ul>"


def test_seeds(tmp_path):
    (tmp_path / "s").write_text("new york\n\n a :: b \n")
    assert M.read_seeds(["x_y", f"@{tmp_path}/s"]) == ["x y", "new york", ("a", "b")]


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "1.html").write_text(LIST.format("ann", "bob", "cyd", "dee"))
    (tmp_path / "p" / "2.txt").write_text(LIST.format("bob", "cyd", "eve", "fay"))
    M.main(["expand", f"{tmp_path}/p", "bob", "cyd", "--bracket", "2", "--noisy", "--xml", f"{tmp_path}/x"])
    assert "bob" in (out := capsys.readouterr().out) and "eve" in out
    M.main(["index", f"{tmp_path}/p", f"{tmp_path}/i"])
    assert spark.read.parquet(f"{tmp_path}/i").where("term = 'bob'").count() == 2
    M.main(["search", f"{tmp_path}/p", "fay"])
    assert "2.txt" in capsys.readouterr().out
