import os

from tidemill import session
from tidemill.session import remove_scratch, stage

def test_tasks_import_the_package_from_any_folder(spark):
    """The shipped archive is on the workers' path, so the folder Spark was started in does not matter."""

    def where(batches):
        import sys

        for batch in batches:
            yield batch.assign(id=sum("tidemill-package.zip" in p for p in sys.path))

    assert spark.range(1).mapInPandas(where, "id long").first()[0] >= 1


def test_scratch_is_removed_with_its_tables_only(spark, tmp_path, monkeypatch):
    other = tmp_path / "other"
    other.mkdir()
    monkeypatch.setattr(session, "scratch_root", lambda _: str(tmp_path))
    assert stage(spark.range(3), "t").count() == 3
    app = f"{tmp_path}/tidemill/{spark.conf.get('spark.app.id')}"
    assert os.listdir(app)
    remove_scratch(spark)
    assert not os.path.exists(app) and other.exists()
    remove_scratch(spark)
