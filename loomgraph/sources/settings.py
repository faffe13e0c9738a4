"""Driver-side settings: TOML files with environment overrides, path aliases of TypeScript projects, JSON-lines traces."""

from __future__ import annotations

import json
import os
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def find(start: str, name: str) -> Path | None:
    """The nearest file ``name`` in a folder or one above it."""
    here = Path(start).resolve()
    return next((p / name for p in [here, *here.parents] if (p / name).is_file()), None)


def load(path: Path | None, defaults: dict, prefix: str, env: dict[str, str] | None = None) -> dict:
    """Defaults, then the file's values, then PREFIX_SECTION_KEY from the environment, in the type of the default."""
    env = dict(os.environ) if env is None else env
    given = tomllib.loads(path.read_text("utf-8")) if path else {}
    out = {}
    for section, values in defaults.items():
        out[section] = {**values, **given.get(section, {})}
        for key, value in values.items():
            raw = env.get(f"{prefix}_{section}_{key}".upper())
            if raw is not None:
                out[section][key] = raw.lower() in ("1", "true", "yes") if isinstance(value, bool) else type(value)(raw)
    return out


def path_aliases(root: str) -> dict[str, str]:
    """Alias prefix to folder, of the first of tsconfig.json and jsconfig.json: the first target of each, below baseUrl."""
    for name in ("tsconfig.json", "jsconfig.json"):
        p = Path(root) / name
        if p.is_file():
            c = json.loads(p.read_text("utf-8")).get("compilerOptions", {})
            base = c.get("baseUrl", ".")
            return {k.rstrip("*"): os.path.normpath(os.path.join(base, v[0].rstrip("*"))) + "/" for k, v in c.get("paths", {}).items() if v}
    return {}


TRACE = "session string, turn int, stage string, elapsed_ms double, tokens int"


def traces(spark: SparkSession, path: str) -> DataFrame:
    """Trace lines; a line that is no JSON is left out."""
    return spark.read.schema(TRACE).option("mode", "DROPMALFORMED").json(path)


def trace_summary(t: DataFrame) -> DataFrame:
    return t.groupBy("session").agg(F.count_distinct("turn").alias("turns"), F.round(F.avg("elapsed_ms"), 1).alias("avg_ms"), F.sum("tokens").alias("tokens"))
