"""One way to get a session with the settings the library is tested under."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "pactum", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, ANSI and adaptive execution; ``conf`` adds or overrides
    (dots as double underscores)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.ui.showConsoleProgress": "false"}
    return builder.config(map=settings | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()
