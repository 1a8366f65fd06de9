"""A person's settings: a small file of rules, read by the driver and handed on as a table."""

from __future__ import annotations

import json
import os
import shutil
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: What holds where a file says nothing.
DEFAULTS = {"download_path": "./downloads", "courses": ["*"], "sync": True, "default_course_folder": "", "use_section_subfolders": False, "skip_enrollment_sections": True}
#: Sections of a file that are rules, and the kinds that operators.rules knows them by.
RULES = {"course_folders": "course_folder", "section_folder_names": "section_name", "subfolder_destinations": "destination"}


def parsed(text: str) -> dict[str, Any]:
    """The settings in a text: YAML where a reader for it is installed, else JSON, which is YAML too."""
    try:
        import yaml
    except ImportError:
        found = json.loads(text) if text.strip() else {}
    else:
        found = yaml.safe_load(text)
    if found is not None and not isinstance(found, dict):
        raise ValueError("settings must be names with values")
    return found or {}


def settings(raw: dict[str, Any]) -> dict[str, Any]:
    """raw with defaults; texts are trimmed, and rules without pattern or value left out."""
    out = {k: default if (v := raw.get(k)) is None else v.strip() if isinstance(v, str) else v for k, default in DEFAULTS.items()}
    out["download_path"] = os.path.expanduser(out["download_path"] or DEFAULTS["download_path"])
    out["courses"] = out["courses"] or DEFAULTS["courses"]
    for name in RULES:
        pairs = ((str(k).strip(), str(v or "").strip()) for k, v in (raw.get(name) or {}).items())
        out[name] = {k: os.path.expanduser(v) if name == "subfolder_destinations" else v for k, v in pairs if k and v}
    return out


def load(path: str) -> dict[str, Any]:
    with open(path, encoding="utf-8") as file:
        return settings(parsed(file.read()))


def save(values: dict[str, Any], path: str) -> None:
    """Writes settings; what was there before stays as path.bak."""
    if os.path.exists(path):
        shutil.copyfile(path, f"{path}.bak")
    with open(f"{path}.new", "w", encoding="utf-8") as file:
        json.dump(values, file, ensure_ascii=False, indent=2)
    os.replace(f"{path}.new", path)


def rules_of(spark: SparkSession, values: dict[str, Any]) -> DataFrame:
    """(kind, priority, pattern, value): the rules of settings in the order in which they are written, and the wanted courses."""
    rows = [(kind, n, k, v) for name, kind in RULES.items() for n, (k, v) in enumerate(values[name].items())]
    rows += [("course", n, c, "") for n, c in enumerate(values["courses"])]
    return spark.createDataFrame(rows, "kind string, priority int, pattern string, value string")
