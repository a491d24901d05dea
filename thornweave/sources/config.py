"""Run configuration from an INI file."""

from __future__ import annotations

import configparser
from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    input_json: str
    query: str
    base_steps: int = 100
    steps: int = 10
    time_limit: float = 0.0
    num_proc: int = 1
    profile: bool = False
    level: str = "info"


def parse_config(text: str) -> EngineConfig:
    """[Log] profile, level; and a section of any name with input_json, query, base_steps, steps, time_limit, num_proc (partitions here)."""
    ini = configparser.ConfigParser(interpolation=None)
    ini.read_string(text)
    run = next((ini[s] for s in ini.sections() if "input_json" in ini[s]), None)
    if run is None:
        raise ValueError("no section of the configuration has input_json")
    return EngineConfig(
        run["input_json"],
        run["query"],
        run.getint("base_steps", 100),
        run.getint("steps", 10),
        run.getfloat("time_limit", 0.0),
        run.getint("num_proc", 1),
        ini.getboolean("Log", "profile", fallback=False),
        ini.get("Log", "level", fallback="info"),
    )


def read_config(path: str) -> EngineConfig:
    with open(path, encoding="utf-8") as f:
        return parse_config(f.read())
