import pytest
from pyspark.errors import AnalysisException

from phasorlake.sources import files


def test_lists_of_a_tasks_conditions(spark, tmp_path):
    lists = {"s 1+a/EVs/MOTOR/lf.txt": "1 2 1\n3\t4\t1\n", "s 1+a/EVs/MOTOR/cue.txt": "9 9 9\n", "s2/EVs/WM/0bk_body.txt": "5,6,1\nonset duration\n", "s2/EVs/WM/lf.txt": "8 8 8\n", "s2/EVs/SOCIAL/rnd.txt": "", "s2/MOTOR/lf.txt": "7 7 7\n"}
    for name, text in lists.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = files.find_events(spark, str(tmp_path))
    assert got.columns == ["subject", "task", "condition", "onset", "duration", "amplitude"]
    assert sorted(map(tuple, got.collect())) == [("s 1+a", "MOTOR", "lf", 1.0, 2.0, 1.0), ("s 1+a", "MOTOR", "lf", 3.0, 4.0, 1.0), ("s2", "WM", "0bk_body", 5.0, 6.0, 1.0)]
    assert files.find_events(spark, str(tmp_path), {"REST": ("lf",)}).count() == 0
    assert [len(c) for c in files.CONDITIONS.values()] == [2, 2, 2, 5, 2, 2, 8]
    with pytest.raises(AnalysisException):
        files.find_events(spark, str(tmp_path / "nothing"))


def test_other_files_are_not_opened(spark, tmp_path):
    for c in ("win", "loss", "cue"):
        (tmp_path / "a/EVs/GAMBLING").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"a/EVs/GAMBLING/{c}.txt").write_text("1 1 1\n")
    read = files.find_events(spark, str(tmp_path))
    (tmp_path / "a/EVs/GAMBLING/cue.txt").unlink()
    assert read.count() == 2
