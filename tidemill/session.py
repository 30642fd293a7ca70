"""Session building and code distribution."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout
from typing import TypeVar

from pyspark.sql import SparkSession

from tidemill.errors import TidemillError

T = TypeVar("T")


def build_session(app_name: str = "tidemill", conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the defaults the examples use; ``conf`` overrides any of them."""
    settings = {
        "spark.master": "local[*]",
        "spark.app.name": app_name,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
        **(conf or {}),
    }
    return SparkSession.builder.config(map=settings).getOrCreate()


def run_app(body: Callable[[SparkSession], T], app_name: str = "tidemill", conf: dict[str, str] | None = None, wait_seconds: float = 3600) -> T:
    """Run ``body`` in a session of its own and stop that session whatever happens. What takes longer than ``wait_seconds`` is cancelled."""
    spark = build_session(app_name, conf)
    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(body, spark).result(wait_seconds)
    except FutureTimeout:
        spark.sparkContext.cancelAllJobs()
        raise TidemillError(f"{app_name} did not end within {wait_seconds:g} seconds") from None
    finally:
        pool.shutdown(wait=False, cancel_futures=True)
        spark.stop()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tidemill-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "tidemill.zip")
    with zipfile.ZipFile(path, "w") as z:
        for base, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    spark.sparkContext.addPyFile(path)
