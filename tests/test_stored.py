"""Stored tables: fingerprints, publishing, swaps, and the shared folder."""

import os
import shutil
from types import SimpleNamespace

import pytest

from conftest import SF_SMALL
from vacancy_spark import session
from vacancy_spark.plans import materialize, tables


def local(path):
    return path.removeprefix("file://").removeprefix("file:")


def test_a_new_nested_file_changes_the_fingerprint(spark, scratch):
    root = local(scratch)
    os.makedirs(f"{root}/customer.parquet/a/b")
    shutil.copy(f"{SF_SMALL}/customer.parquet", f"{root}/customer.parquet/a/b/one.parquet")
    first = materialize._fingerprint(spark, root, ("customer",))
    shutil.copy(f"{SF_SMALL}/customer.parquet", f"{root}/customer.parquet/a/b/two.parquet")
    assert materialize._fingerprint(spark, root, ("customer",)) == first  # listed once a session
    materialize.refresh()
    assert materialize._fingerprint(spark, root, ("customer",)) != first


def test_two_publishers_leave_one_table(spark, scratch):
    for n in (1, 2):
        spark.range(n).write.parquet(f"{scratch}/_tmp-{n}")
    for n in (1, 2):
        materialize._publish(spark, f"{scratch}/_tmp-{n}", f"{scratch}/final")
    assert spark.read.parquet(f"{scratch}/final").count() == 1
    assert [x for x in os.listdir(local(scratch)) if not x.startswith(".")] == ["final"]
    assert not [x for x in os.listdir(f"{local(scratch)}/final") if x.startswith("_tmp")]


@pytest.mark.parametrize("fails", [1, 2])
def test_a_failing_rename_leaves_the_old_table(spark, scratch, monkeypatch, fails):
    spark.range(3).write.parquet(scratch)
    calls, real = [], tables._rename

    def rename(fs, src, dst):
        calls.append(1)
        if len(calls) == fails:
            raise OSError("no")
        real(fs, src, dst)
    monkeypatch.setattr(tables, "_rename", rename)
    with pytest.raises(OSError):
        tables.replace_path(spark, scratch, lambda p: spark.range(9).write.parquet(p))
    assert spark.read.parquet(scratch).count() == 3


def test_a_cluster_without_a_shared_folder_is_an_error():
    def fake(master):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda p: None)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: d))
    for master in ("yarn", "spark://host:7077", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            session.shared_dir(fake(master))
    assert os.path.isdir(session.shared_dir(fake("local[2]")))
