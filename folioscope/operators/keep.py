"""Tables that several jobs read: computed once, and safe when executors are lost."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame

from folioscope.config import FolioscopeError


def keep(df: DataFrame) -> DataFrame:
    """``df`` from a reliable checkpoint, in the folder that spark.checkpoint.dir names.

    What reads it plans anew from there, so long text expressions are planned once.  A folder of our own
    serves only where it is unset and all executors are on this machine.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master != "local" and not context.master.startswith("local["):
            raise FolioscopeError("no_checkpoint_folder", "spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="spark-folioscope-"))
    return df.checkpoint(eager=True)
