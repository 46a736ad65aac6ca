"""Configuration: defaults, then a file, then the environment, then validation."""

from __future__ import annotations

import copy
import json
import logging
import os
from typing import Any

# Defaults and allowed ranges of the configuration format.
DEFAULTS: dict[str, Any] = {
    "lancedb": {"persistPath": "~/.corvella/store"},
    "embedding": {"modelName": "Xenova/all-MiniLM-L6-v2", "cachePath": "~/.corvella/models"},
    "mcp": {"transport": "stdio"},
    "server": {"port": 8008, "host": "localhost"},
    "ingestion": {"batchSize": 100, "maxFileSize": 1048576, "maxChunkTokens": 512, "chunkOverlapTokens": 50},
    "search": {"defaultMaxResults": 50, "cacheTimeoutSeconds": 60},
    "logging": {"level": "info"},
    "schemaVersion": "1.0.0",
}
ENVIRONMENT = {
    "LANCEDB_PERSIST_PATH": ("lancedb", "persistPath", str),
    "EMBEDDING_MODEL_NAME": ("embedding", "modelName", str),
    "EMBEDDING_CACHE_PATH": ("embedding", "cachePath", str),
    "SERVER_PORT": ("server", "port", int),
    "SERVER_HOST": ("server", "host", str),
    "INGESTION_BATCH_SIZE": ("ingestion", "batchSize", int),
    "INGESTION_MAX_FILE_SIZE": ("ingestion", "maxFileSize", int),
    "INGESTION_MAX_CHUNK_TOKENS": ("ingestion", "maxChunkTokens", int),
    "INGESTION_CHUNK_OVERLAP_TOKENS": ("ingestion", "chunkOverlapTokens", int),
    "SEARCH_DEFAULT_MAX_RESULTS": ("search", "defaultMaxResults", int),
    "SEARCH_CACHE_TIMEOUT_SECONDS": ("search", "cacheTimeoutSeconds", int),
    "LOG_LEVEL": ("logging", "level", str),
}
#: Read where no file is named; it may be missing, and a broken one is a warning only.
DEFAULT_FILE = "~/.corvella/config.json"
LEVELS = ("debug", "info", "warn", "error")


class ConfigError(ValueError):
    """The merged configuration breaks the format."""


def _merge(base: dict, over: dict, where: str = "") -> dict:
    for key, value in over.items():
        if key not in base:
            raise ConfigError(f"unknown setting {where}{key}")
        if isinstance(base[key], dict):
            if not isinstance(value, dict):
                raise ConfigError(f"{where}{key} must be an object")
            _merge(base[key], value, f"{where}{key}.")
        else:
            base[key] = value
    return base


def validate(config: dict) -> dict:
    for section, keys in config.items():
        for key, value in (keys.items() if isinstance(keys, dict) else ()):
            want = type(DEFAULTS[section][key])
            if not isinstance(value, want) or isinstance(value, bool):
                raise ConfigError(f"{section}.{key} must be of type {want.__name__}")
            if want is str and not value:
                raise ConfigError(f"{section}.{key} must not be empty")
    if not 1 <= config["server"]["port"] <= 65535:
        raise ConfigError("server.port must be in 1..65535")
    if config["mcp"]["transport"] != "stdio":
        raise ConfigError("mcp.transport must be stdio")
    if any(config["ingestion"][k] < 1 for k in ("batchSize", "maxFileSize", "maxChunkTokens")) or config["ingestion"]["chunkOverlapTokens"] < 0:
        raise ConfigError("ingestion limits must be positive")
    if config["search"]["defaultMaxResults"] < 1 or config["search"]["cacheTimeoutSeconds"] < 0:
        raise ConfigError("search limits must be positive")
    if config["logging"]["level"] not in LEVELS:
        raise ConfigError(f"logging.level must be one of {', '.join(LEVELS)}")
    return config


def _read(path: str) -> dict:
    with open(os.path.expanduser(path), encoding="utf-8") as f:
        try:
            out = json.load(f)
        except json.JSONDecodeError as e:
            raise ConfigError(f"{path} is not JSON: {e}") from e
    if not isinstance(out, dict):
        raise ConfigError(f"{path} must hold an object")
    return out


def load(path: str | None = None, env: dict[str, str] | None = None) -> dict:
    """An explicit file must exist. Every environment key changes its own setting only."""
    config = copy.deepcopy(DEFAULTS)
    if path is not None:
        _merge(config, _read(path))
    elif os.path.exists(os.path.expanduser(DEFAULT_FILE)):
        try:
            config = validate(_merge(copy.deepcopy(DEFAULTS), _read(DEFAULT_FILE)))
        except (OSError, ConfigError) as e:
            logging.getLogger("corvella").warning("%s was not used: %s", DEFAULT_FILE, e)
    for name, (section, key, kind) in ENVIRONMENT.items():
        if value := (os.environ if env is None else env).get(name):
            try:
                config[section][key] = kind(value)
            except ValueError as e:
                raise ConfigError(f"{name} must be of type {kind.__name__}") from e
    for section, key in (("lancedb", "persistPath"), ("embedding", "cachePath")):
        config[section][key] = os.path.expanduser(config[section][key])
    return validate(config)
