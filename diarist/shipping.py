"""Send this repository's packages to the executors, which may run in any working directory."""

import functools
import tempfile
import zipfile
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
_sent = set()


def ship(spark) -> None:
    """Once per application: a zip of the top packages, served by the driver."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    to = Path(tempfile.mkdtemp(prefix="packages-")) / "packages.zip"
    with zipfile.ZipFile(to, "w") as out:
        for top in sorted(p.parent for p in ROOT.glob("*/__init__.py") if p.parent.name != "tests"):
            for p in sorted(top.rglob("*.py")):
                out.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(to))
    _sent.add(app)


def shipped(fn):
    """``fn``, after the packages are sent."""

    @functools.wraps(fn)
    def run(spark, sf_dir):
        ship(spark)
        return fn(spark, sf_dir)

    return run
