"""Work with a deadline: what runs past it is stopped, its Spark jobs and those it would still start included."""

from __future__ import annotations

import ctypes
import time
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import SparkSession
from pyspark.util import InheritableThread


def limited(spark: SparkSession, run: Callable, seconds: float | None, grace: float = 30.0):
    """What ``run`` gives, or a TimeoutError after ``seconds``; without a limit it just runs.

    All jobs of the run carry a tag. At the deadline those that run are cancelled, again and again until the run's thread
    has ended, and the thread itself is told to stop, so a loop without jobs ends, too. A thread that still lives after
    ``grace`` seconds, inside some call that hears neither, is left behind as a daemon; jobs it starts are its own.
    """
    if seconds is None:
        return run()
    context, tag, outcome = spark.sparkContext, f"limited-{uuid4().hex}", {}

    def work() -> None:
        context.addJobTag(tag)
        try:
            outcome["value"] = run()
        except BaseException as e:  # the thread's end is the caller's to report
            outcome["error"] = e

    thread = InheritableThread(target=work, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        until = time.monotonic() + grace
        while thread.is_alive() and time.monotonic() < until:
            context.cancelJobsWithTag(tag)
            thread.join(0.2)
            if thread.is_alive():
                ctypes.pythonapi.PyThreadState_SetAsyncExc(ctypes.c_ulong(thread.ident), ctypes.py_object(SystemExit))
                thread.join(0.2)
        context.cancelJobsWithTag(tag)
        raise TimeoutError(f"took more than {seconds:g} seconds")
    if "error" in outcome:
        raise outcome["error"]
    return outcome["value"]
