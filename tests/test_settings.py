"""Names of settings, where they are looked for, and who may read a workspace."""

from __future__ import annotations

import stat

from evisieve import cli, config
from evisieve.functions import text
from pyspark.sql import functions as F


def test_slips_are_named():
    known = ["retrieval", "security", "sources", "allow_hosts"]
    assert [config.nearest(n, known) for n in ("retreival", "Security", "source", "allowHosts", "allow-host", "nothing", "")] == ["retrieval", "security", "sources", "allow_hosts", "allow_hosts", None, None]
    assert [text.edit_distance(a, b) for a, b in (("", ""), ("a", ""), ("kitten", "sitting"), ("ab", "ba"))] == [0, 1, 3, 2]


def test_nearest_names_of_a_column(spark):
    rows = spark.createDataFrame([("bat",), ("cart",), ("zzzz",), (None,)], "n string")
    got = [r[0] and tuple(r[0]) for r in rows.select(text.nearest_name(F.col("n"), ["cat", "bar", "care"])).collect()]
    assert got == [(1, "bar"), (1, "care"), None, None]


def test_settings_files_are_found_upwards(tmp_path):
    below = tmp_path / "a" / "b"
    below.mkdir(parents=True)
    assert cli.find_config(below) is None
    for folder, name in ((tmp_path, "evisieve.json"), (tmp_path, ".evisieve.config.json"), (tmp_path, "evisieve.config.json"), (tmp_path / "a", "evisieve.json")):
        (folder / name).write_text("{}")
        assert cli.find_config(below) == folder / name


def test_a_workspace_is_for_its_owner(tmp_path):
    own = tmp_path / "w"
    own.mkdir(mode=0o755)
    for _ in range(2):
        cli.guarded(str(own))
    assert stat.S_IMODE(own.stat().st_mode) == 0o700 and (own / ".gitignore").read_text() == "*\n"
    (own / ".gitignore").write_text("mine")
    cli.guarded(f"file://{own}")
    cli.guarded("hdfs://host/w")
    assert (own / ".gitignore").read_text() == "mine"
