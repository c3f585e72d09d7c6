"""Replacing a folder as a whole: readers see the old one or the new one, whenever the writer is killed.

The new folder is written aside. Then one small file, the journal, says what is to be moved where: from that moment the
new folder counts. The moves follow: the old folder becomes a backup, the new one takes its place, a closing note is
written, and the journal goes. Each move is made only if it is still to be made, so whoever comes next can finish them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from evalgrove.sources import files


def _journal(live: str) -> str:
    parent, _, name = live.rstrip("/").rpartition("/")
    return f"{parent or '.'}/_{name}.publish.json"


def publish(spark: SparkSession, live: str, write: Callable[[str], None], note: Callable[[str | None], tuple[str, str]] | None = None) -> str | None:
    """Writes a folder by write(path) and puts it in the place of live; returns where the old one went, if there was one.

    note(backup) is asked for a (path, text) that is written once the folder is in place. A publication that broke off is
    finished first.
    """
    finish(spark, live)
    parent, _, name = live.rstrip("/").rpartition("/")
    mark = uuid.uuid4().hex[:12]
    fresh = f"{parent or '.'}/{name}.new-{mark}"
    write(fresh)
    backup = f"{parent or '.'}/{name}.backup-{mark}" if files.exists(spark, live) else None
    plan = {"fresh": fresh, "backup": backup, "note": note(backup) if note else None}
    files.write_text(spark, _journal(live), json.dumps(plan))
    finish(spark, live)
    return backup


def finish(spark: SparkSession, live: str) -> bool:
    """Makes the moves that a journal asks for and that are not made yet; whether there was one."""
    if not files.exists(spark, _journal(live)):
        return False
    plan = json.loads(files.read_text(spark, _journal(live)))
    if files.exists(spark, plan["fresh"]):
        if plan["backup"] and not files.exists(spark, plan["backup"]):
            files.rename(spark, live, plan["backup"])
        files.rename(spark, plan["fresh"], live)
    if plan["note"]:
        files.write_text(spark, *plan["note"])
    files.delete(spark, _journal(live))
    return True


def current(spark: SparkSession, live: str) -> str:
    """The folder to read for live: itself, or the new one while it is on its way there. Changes nothing."""
    if files.exists(spark, _journal(live)):
        fresh = json.loads(files.read_text(spark, _journal(live)))["fresh"]
        if files.exists(spark, fresh):
            return fresh
    return live
