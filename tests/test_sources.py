import pytest

from strataspark.sources import files


def test_irap_surface(spark, tmp_path):
    (tmp_path / "top.irap").write_text("-996 2 50.0 25.0\n10.0 110.0 20.0 45.0\n3 0.0 10.0 20.0\n0 0 0 0 0 0 0\n1 2 3 4\n9999900.0 6\n")
    got = {(r.i, r.j): (r.x, r.y, r.z) for r in files.irap_surface(spark, str(tmp_path / "top.irap")).collect()}
    assert got == {(0, 0): (10, 20, 1), (1, 0): (60, 20, 2), (2, 0): (110, 20, 3), (0, 1): (10, 45, 4), (1, 1): (60, 45, None), (2, 1): (110, 45, 6)}


def test_rms_wells(spark, tmp_path):
    head = "1.0\nUndefined\n{} 1.0 2.0\n4\nDT UNK lin\nFacies DISC 0 sand 1 shale\nRHOB UNK lin\nZone DISC 0 top 1 base\n"
    (tmp_path / "w1.rms").write_text(head.format("W1") + "1 2 1000 80.5 0 2.1 0\n1 2 1004 -999.25 1 -999 1\n")
    (tmp_path / "w2.rms").write_text(head.format("W2").replace("RHOB", "VP") + "3 4 1000 70 1 2000 0\n")
    path = str(tmp_path / "*.rms")
    got = sorted(tuple(r) for r in files.rms_wells(spark, path, ["dt", "facies", "rhob"]).collect())
    assert got == [("W1", 0, 1, 2, 1000, 80.5, 0, 2.1), ("W1", 1, 1, 2, 1004, None, 1, None), ("W2", 0, 3, 4, 1000, 70, 1, None)]
    assert sorted(tuple(r) for r in files.facies_names(spark, path).collect()) == [(0, "sand"), (1, "shale")]
    assert sorted(tuple(r) for r in files.facies_names(spark, path, "zone").collect()) == [(0, "top"), (1, "base")]
    (tmp_path / "w3.rms").write_text(head.format("W3").replace("sand", "coal") + "3 4 1000 70 1 2 0\n")
    with pytest.raises(Exception, match="two names"):
        files.facies_names(spark, path).collect()


def test_jason_wavelet(spark, tmp_path):
    (tmp_path / "w.txt").write_text('* made by hand\n"also a comment\n-4.0\n4.0 ms\n3\n0.5\n1.0\n-0.25\n')
    got = [tuple(r)[1:] for r in files.jason_wavelet(spark, str(tmp_path / "w.txt")).orderBy("k").collect()]
    assert got == [(0, -4, 4, 1, -0.25), (1, -4, 4, 1, 1.0), (2, -4, 4, 1, 0.5)]  # turned; time zero was the second sample
    (tmp_path / "short.txt").write_text("-4.0\n4.0\n5\n0.5\n1.0\n")
    with pytest.raises(Exception, match="fewer samples"):
        files.jason_wavelet(spark, str(tmp_path / "short.txt")).collect()
