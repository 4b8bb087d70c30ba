"""Registered queries over the media tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import importlib
import importlib.util

from reeltable.sources.views import with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query; its SQL may use the views."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_views(sql).replace("WITH ", "WITH RECURSIVE ", 1) if "walk AS" in sql else with_views(sql)
        return f

    return put


def flagship(spark, sf_dir):
    from reeltable.jobs.decoding_queries import documents

    return documents(spark, sf_dir)


for _name in ("detections", "timing", "decoding", "tracking", "streams"):
    if importlib.util.find_spec(f"reeltable.jobs.{_name}_queries"):
        importlib.import_module(f"reeltable.jobs.{_name}_queries")
