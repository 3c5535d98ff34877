import pytest

from quillon.plans.publish import CheckFailed, Publisher


def made(spark, n, failed=0):
    return lambda: (spark.range(n).selectExpr("cast(id as string) document_id"), spark.range(failed).selectExpr("cast(id as string) file", "'x' error"))


def test_readers_see_committed_runs_only(spark, tmp_path):
    p = Publisher(spark, str(tmp_path))
    assert p.current() is None and p.manifests().count() == 0
    first = p.publish("r1", "2024-01-01", made(spark, 3, 1))
    assert (first["processed"], first["failed"], p.current().count()) == (3, 1, 3)
    for bad in (made(spark, 0), made(spark, 2, 3), lambda: (spark.sql("select cast(null as string) document_id"), spark.range(0))):
        with pytest.raises(CheckFailed):
            p.publish("r2", "2024-01-02", bad)
        assert p.current().count() == 3 and p.manifests().count() == 1
    assert p.publish("r2", "2024-01-02", made(spark, 5))["processed"] == 5  # over what the failed attempts left
    assert p.current().count() == 5
    p.publish("r0", "2023-12-31", made(spark, 7))  # an older day, later
    assert p.current().count() == 5 and p.manifests().count() == 3


@pytest.mark.parametrize("step", ["stage", "check", "archive", "commit", "_rename"])
def test_a_run_that_breaks_off(spark, tmp_path, monkeypatch, step):
    p = Publisher(spark, str(tmp_path))
    p.publish("r1", "2024-01-01", made(spark, 3))
    calls = []

    def make():
        calls.append(1)
        return made(spark, 4)()

    real = getattr(Publisher, step)
    for after in (False, True):
        run = f"r2{after}"

        def broken(self, *a, after=after):
            if after:
                real(self, *a)
            raise KeyboardInterrupt

        monkeypatch.setattr(Publisher, step, broken)
        with pytest.raises(KeyboardInterrupt):
            p.publish(run, "2024-01-02", make)
        committed = after and step == "commit"
        assert p.current().count() == (4 if committed else 3)
        monkeypatch.setattr(Publisher, step, real)
        before = len(calls)
        assert p.publish(run, "2024-01-02", make)["processed"] == 4
        assert p.current().count() == 4
        archived = step == "commit" or after and step in ("archive", "_rename")
        assert len(calls) - before == (0 if archived else 1)
        p._fs.delete(p._path(f"{tmp_path}/runs/{run}.json"), False)


def test_names(spark, tmp_path):
    for run, day in (("../x", "2024-01-01"), ("r", "today")):
        with pytest.raises(ValueError):
            Publisher(spark, str(tmp_path)).publish(run, day, made(spark, 1))
