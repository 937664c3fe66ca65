"""The scratch folder of local sessions without ``spark.checkpoint.dir``."""

from types import SimpleNamespace

from quarrylink.llm import common


def test_local_session_without_the_setting_keeps_one_folder():
    def refuse(*_):
        raise AssertionError("a running session does not let the setting be changed")

    conf = SimpleNamespace(get=lambda *_: None, set=refuse)
    context = SimpleNamespace(getConf=lambda: conf, master="local[2]", applicationId="app-scratch-test")
    spark = SimpleNamespace(conf=conf, sparkContext=context)
    assert common.scratch_dir(spark) == common.scratch_dir(spark)
