"""Where intermediate tables go."""

from types import SimpleNamespace

import pytest

from marginalia.session import shared_dir, written


class Fake:
    """Just enough of a session: where it runs and what is set."""

    def __init__(self, master: str, folder: str | None = None) -> None:
        self.conf = SimpleNamespace(get=lambda k, d=None: folder)
        self.sparkContext = SimpleNamespace(master=master, applicationId=f"app of {master}", getConf=lambda: SimpleNamespace(get=lambda k: None))


def test_a_cluster_without_a_shared_folder_is_an_error():
    for master in ("spark://host:7077", "yarn", "k8s://https://host"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(Fake(master))
        assert shared_dir(Fake(master, "s3a://shared/steps/")) == "s3a://shared/steps"


def test_a_local_session_has_one_folder():
    assert shared_dir(Fake("local[4]")) == shared_dir(Fake("local[4]"))


def test_written_tables_read_back_the_same(spark):
    df = spark.createDataFrame([(1, "a", [1.5]), (None, None, None)], "i int, s string, a array<double>")
    assert sorted(map(str, written(df).collect())) == sorted(map(str, df.collect()))
    assert written(df.limit(0)).count() == 0
