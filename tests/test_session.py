"""What queries write for themselves is noted, and goes."""

from pathlib import Path

from meterglass import session
from meterglass.plans import QUERIES

DATA = "/root/testdata/sf0.001"


def test_scratch_is_removed(spark):
    before = len(session.SCRATCH)
    QUERIES["grok_logs"](spark, DATA).collect()
    own = [Path(p.removeprefix("file://")) for p in session.SCRATCH[before:]]
    there = [p for p in own if p.exists()]
    assert there and all(p.parent == Path(session.shared_dir(spark)) for p in own)
    session.clean()
    assert not session.SCRATCH and not any(p.exists() for p in own)
    assert session.SETTINGS["spark.cleaner.referenceTracking.cleanCheckpoints"] == "true"
