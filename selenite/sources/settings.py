"""Settings, calibrations and lists: small texts that steer a run.

A path of this machine is opened as it is; an address (``store://...``) is read by Spark, from whatever
storage the cluster knows.
"""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession


def _lines(path: str) -> list[str] | None:
    if "://" in path:
        text = stored_text(path)
    elif os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            text = f.read()
    else:
        text = None
    return None if text is None else [line.split("#")[0].strip() for line in text.splitlines()]


def stored_text(address: str) -> str | None:
    """The text of a file in shared storage, None where there is none."""
    try:
        row = SparkSession.active().read.text(address, wholetext=True).first()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return row[0] if row else ""


def _as(kind: object, text: str):
    """``text`` as the type of a default; a list takes its members' type."""
    if isinstance(kind, bool):
        return text.strip().lower() in ("1", "true", "yes", "on")
    if isinstance(kind, (list, tuple)):
        return [_as(kind[0], x) if kind else x for x in text.replace(",", " ").split()]
    return type(kind)(text.strip()) if kind is not None else text.strip()


def keyed_settings(path: str, defaults: Mapping[str, object]) -> dict[str, object]:
    """``KEY value``, ``KEY = value`` or ``KEY: value`` lines over the defaults.

    The defaults alone where the file is missing; unknown keys and lines without a value are passed over.
    """
    out = dict(defaults)
    for line in _lines(path) or []:
        parts = line.replace("=", " ", 1).replace(":", " ", 1).split(None, 1)
        if len(parts) == 2 and parts[0] in out:
            out[parts[0]] = _as(defaults[parts[0]], parts[1])
    return out


def positional_settings(path: str, defaults: Mapping[str, object]) -> dict[str, object]:
    """One value a line in the order of the defaults; a leading name is dropped, missing lines keep the defaults."""
    out = dict(defaults)
    for (key, kind), line in zip(defaults.items(), [x for x in _lines(path) or [] if x], strict=False):
        parts = line.split(None, 1)
        text = parts[1] if len(parts) == 2 and parts[0].strip(":=") == key else line
        out[key] = _as(kind, text)
    return out


def settings_lines(settings: Mapping[str, object]) -> list[str]:
    """Settings as ``KEY value`` lines; lists with blanks between their members."""
    return [f"{k} {' '.join(map(str, v)) if isinstance(v, (list, tuple)) else v}" for k, v in settings.items()]


def calibration(path: str, shapes: Mapping[str, tuple[int, ...]]) -> dict[str, np.ndarray]:
    """Matrices of a calibration text: a name's line, then its numbers over any lines. Raises if some are missing."""
    found: dict[str, list[float]] = {}
    name = None
    for line in _lines(path) or []:
        for word in line.replace(",", " ").replace("=", " ").replace(":", " ").replace("[", " ").replace("]", " ").replace(";", " ").split():
            if word in shapes:
                name = word
                found[name] = []
            elif name:
                found[name].append(float(word))
    out = {}
    for key, shape in shapes.items():
        if len(found.get(key, [])) < int(np.prod(shape)):
            raise ValueError(f"{path}: {key} is missing")
        out[key] = np.array(found[key][: int(np.prod(shape))]).reshape(shape)
    return out


def try_list(path: str) -> tuple[int, list[str]]:
    """(1, names) of a list file, or (0, []) where it cannot be read."""
    try:
        lines = _lines(path)
    except (OSError, UnicodeDecodeError):
        lines = None
    return (0, []) if lines is None else (1, [x for x in lines if x])


def camera_model_lines(vectors: Mapping[str, Sequence[float]]) -> list[str]:
    """A linear camera model (C, A, H, V and, with distortion, O and R) as ``NAME = (a, b, c)`` lines."""
    return [f"{k} = ({', '.join(f'{x:.6f}' for x in v)})" for k, v in vectors.items() if k in ("C", "A", "H", "V", "O", "R")]


def tile_box_line(tile: Sequence[int]) -> str:
    """A tile's corners: left, top, right, bottom."""
    x, y, w, h = tile
    return f"{x} {y} {x + w} {y + h}"


def matching_wanted(settings: Mapping[str, object], iterations: str = "MAX_ITER", window: str = "WINDOW") -> bool:
    """Whether settings ask for matching: not with no iterations and a window of half sizes 1 and 1."""
    return not (settings[iterations] == 0 and list(settings[window]) == [1, 1])
