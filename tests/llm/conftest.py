import os
import pathlib
import tempfile

import pytest

ROOT = str(pathlib.Path(__file__).resolve().parents[2])
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))


@pytest.fixture(scope="session")
def llm(spark):
    """The session, with a shared folder of its own where none is set and imports in its workers."""
    spark.sparkContext.environment["PYTHONPATH"] = os.environ["PYTHONPATH"]
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="shared-"))
    return spark


@pytest.fixture(scope="session")
def tables(llm, tmp_path_factory):
    """Writes tables of a folder as the queries read them: ``tables(documents=(rows, schema))``."""

    def write(**frames):
        folder = tmp_path_factory.mktemp("tables")
        for name, (rows, schema) in frames.items():
            llm.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return write
