"""Keeping an index up to date: by polling, as file sources of streams don't report edits and deletions."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import refresh
from ..sources.scan import indexed, scan_signature, scan_tree


class Watcher:
    """Publishes a new version of the index whenever the tree has changed; errors are told and the loop goes on."""

    def __init__(self, spark: SparkSession, root: str, folder: str, seconds: float = 2.0, on_error: Callable[[Exception], None] = print):
        self.spark, self.root, self.folder, self.seconds, self.on_error = spark, root, folder, seconds, on_error
        self.signature = None
        self.busy = threading.Lock()
        self.stopped = threading.Event()

    def files(self) -> DataFrame:
        return scan_tree(self.spark, self.root, wanted=indexed(F.col("path")))

    def refresh(self) -> bool:
        """Indexes again if anything changed; false if nothing did or another refresh is under way."""
        if not self.busy.acquire(blocking=False):
            return False
        try:
            signature = scan_signature(self.spark, self.root)
            if signature == self.signature:
                return False
            refresh(self.spark, self.folder, self.files())
            self.signature = signature
            return True
        finally:
            self.busy.release()

    def run(self) -> None:
        while not self.stopped.is_set():
            try:
                self.refresh()
            except Exception as e:  # the loop outlives a failed round
                self.on_error(e)
            time.sleep(self.seconds)
